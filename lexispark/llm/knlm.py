"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and kept as sorted hash arrays.

Files in the shared folder, which workers map into memory: for each range of word hashes the
sorted hashes, counts and ids; for each length of n-gram from 2 to the order and each range of
their hashes, buckets of sorted 24-bit hashes (which buckets the high half deals out) and a code
for the numbers of each, but for those with the commonest numbers, which stand apart; by id those
of single words. Ids go by count, so those of common words are small and compress well. The numbers are what Kneser-Ney needs of an n-gram: how often it stands (the longest) or how many
words come before it (shorter ones), and as context its total and followers seen once, twice, more.
All dealing is by hash of the n-gram, so a frequent word or context does not load one task; counts are
added up in each task before they are sent.

Tokens of a text are its words, A-Z lower-cased, then one end; before the first word stand start
marks, one less than the order. p_k(w|u) = max(c(u,w) - D, 0) / c(u) + gamma(u) p_(k-1)(w|u
without its first), where c counts occurrences in the longest n-grams and distinct predecessors
in shorter ones; p_1 is interpolated with 1 / (V + 1). A context never seen gives the shorter one's p.

Two n-grams of a range are taken for one if their hashes agree in 24 bits and in the bucket, of 16
entries on average: 1 in a million look-ups of n-grams that are not there, at any size.

Defined cases: a null or empty text is the single token end. A null doc_id is never held out.
With nothing to learn from, V and N are 0, every token has probability 1 and scores are 0.
A discount whose counts of counts are missing is half its count. Repeated rows count as often
as they stand. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import Packer, Scratch, by_range, deal, n_shards, put_file, table, unpack
from .textblock import LOWER, U64, TextBlock, blocks, mix, runs

END, START = U64(0x1B873593CC9E2D51), U64(0x85EBCA6B27D4EB2F)
#: Bytes of input files for a shard, entries of a bucket on average, and bits of a hash in it.
SHARD_BYTES, BUCKET, HASH_BITS = 16 << 20, 16, 24
_CTX = np.dtype([("c", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("before", "<u4")])
_NUMBERS = ["<u8", "<u4", "<u4", "<u4", "<u4"]


def fold_sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Adds up the values of equal keys; keys come out sorted."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)[:-1]
    return [keys[at], *(np.add.reduceat(v[order].astype(np.uint64), at) if len(at) else v for v in values)]


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(u) * U64(0x9E3779B97F4A7C15) + w)


def gram_key(ids: list[np.ndarray]) -> np.ndarray:
    key = ids[0].astype(np.uint64)
    for x in ids[1:]:
        key = pair_key(key, x.astype(np.uint64))
    return key


def fold_grams(ids: list[np.ndarray], values: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Adds up the values of equal n-grams of ids of so many bits; n-grams come out sorted."""
    packed = []
    for at in range(0, len(ids), 64 // bits):
        word = ids[at].astype(np.uint64)
        for x in ids[at + 1 : at + 64 // bits]:
            word = (word << U64(bits)) | x
        packed.append(word)
    order = np.argsort(packed[0]) if len(packed) == 1 else np.lexsort(packed[::-1])
    at = starts(packed, order)
    return [x[order[at]] for x in ids], [np.add.reduceat(v[order], at, dtype=np.uint64) if len(at) else v for v in values]


def starts(columns: list[np.ndarray], order: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Where rows differ from those before, in this order."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def tokens(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, the text of each token, and where the texts end."""
    ends = block.words_at[1:] + np.arange(block.n)
    out = np.full(len(block.start) + block.n, END)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = block.word_hash()
    return out, np.repeat(np.arange(block.n), block.n_words + 1), ends


class Words:
    """Sorted hashes of words, one file for each range of them, with counts and ids beside; opened as needed."""

    def __init__(self, folder: str, n: int):
        self.folder, self.n = folder, n
        self._open: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def shard(self, i: int) -> tuple[np.ndarray, ...]:
        if i not in self._open:
            if len(self._open) > 4096:
                self._open.clear()
            self._open[i] = tuple(mapped(f"{self.folder}/w{i}.{x}", "<u8") for x in ("key", "val", "id"))
        return self._open[i]

    def find(self, keys: np.ndarray, unknown: int) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: ids (unknown if absent) and counts (0 if absent)."""
        cuts = np.searchsorted(by_range(keys, self.n), np.arange(self.n + 1))
        ids, value = np.full(len(keys), unknown, np.uint64), np.zeros(len(keys), np.uint64)
        for i in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[i], cuts[i + 1]
            have, val, own = self.shard(int(i))
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
                hit = np.flatnonzero(have[at] == keys[a:b])
                ids[a + hit], value[a + hit] = own[at[hit]], val[at[hit]]
        return ids, value


def mapped(path: str, dtype) -> np.ndarray:
    try:
        return np.memmap(path, dtype, "r").view(np.ndarray)  # indexing a memmap itself costs more
    except ValueError:  # an empty file can't be mapped
        return np.zeros(0, dtype)


def buckets(keys: np.ndarray, n: int, m: int) -> np.ndarray:
    """Which of the m buckets of its range each key is in."""
    return ((((keys >> U64(32)) * U64(n)) & U64(0xFFFFFFFF)) * U64(m)) >> U64(32)


def put_grams(path: str, keys: np.ndarray, n: int, values: list[np.ndarray]) -> None:
    """Writes a range's n-grams in two parts: those with the commonest row of values, which need no code, and the others.

    A part has its sizes, the distinct rows of values, where buckets start, hashes (low two bytes, third byte) and codes of rows.
    """
    _, first, code, times = np.unique(gram_key(values), return_index=True, return_inverse=True, return_counts=True)
    rows = np.stack([v[first].astype("<u8") for v in values], axis=1)
    common = int(np.argmax(times))
    parts = []
    for mine in (np.flatnonzero(code == common), np.flatnonzero(code != common)):
        m = max(len(mine) // BUCKET, 1)
        own = keys[mine]
        place = (buckets(own, n, m) << U64(HASH_BITS)) | (own & U64((1 << HASH_BITS) - 1))
        order = np.argsort(place)
        place = place[order]
        own_rows = rows[common : common + 1] if not parts else rows
        width = 0 if not parts else next(w for w in (1, 2, 4) if len(rows) <= 1 << (8 * w))
        at = np.searchsorted(place, np.arange(m + 1, dtype=np.uint64) << U64(HASH_BITS)).astype("<u4")
        parts += [np.array([len(mine), m, len(own_rows), width], "<u8"), own_rows, at, place.astype("<u2"), (place >> U64(16)).astype("u1")]
        parts += [code[mine][order].astype(f"<u{width}")] if width else []

    def write(f) -> None:
        for x in parts:
            f.write(x.tobytes())

    put_file(path, write)


class Grams:
    """Files of put_grams, one for each range of keys; opened as needed."""

    def __init__(self, folder: str, name: str, n: int, columns: int):
        self.folder, self.name, self.n, self.columns = folder, name, n, columns
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def shard(self, i: int) -> tuple:
        if i not in self._open:
            if len(self._open) > 4096:
                self._open.clear()
            self._open[i] = self._parts(mapped(f"{self.folder}/{self.name}{i}", np.uint8))
        return self._open[i]

    def _parts(self, raw: np.ndarray) -> tuple:
        found = []
        while len(raw):
            size, m, rows, width = (int(x) for x in raw[:32].view("<u8"))
            cuts = np.cumsum([32, 8 * rows * self.columns, 4 * (m + 1), 2 * size, size, width * size])
            table, at, low, high, code = (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            found.append((np.array(table.view("<u8").reshape(rows, self.columns)), at.view("<u4"), low.view("<u2"), high, code.view(f"<u{width}") if width else None))
            raw = raw[cuts[-1] :]
        return tuple(found)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of values of the keys; zeros for those that are not there."""
        ask, back = np.unique(keys, return_inverse=True)
        return self.find_sorted(ask)[back]

    def find_sorted(self, ask: np.ndarray) -> np.ndarray:
        """As find, for keys that are sorted and distinct."""
        out = np.zeros((len(ask), self.columns), np.uint64)
        cuts = np.searchsorted(by_range(ask, self.n), np.arange(self.n + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            left = np.arange(cuts[i], cuts[i + 1])
            for part in self.shard(int(i)):
                hit, values = self._look_up(ask[left], *part)
                out[left[hit]] = values
                left = left[~hit]
        return out

    def _look_up(self, keys: np.ndarray, rows: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, code: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the values of those."""
        b = buckets(keys, self.n, len(at) - 1).astype(np.int64)
        want, lo, end = keys.astype(np.uint32) & np.uint32((1 << HASH_BITS) - 1), at[b].astype(np.int64), at[b + 1].astype(np.int64)
        if not len(low):
            return np.zeros(len(keys), bool), rows[:0]

        def hashes(i: np.ndarray) -> np.ndarray:
            return (high[i].astype(np.uint32) << np.uint32(16)) | low[i]

        # Halves of buckets; with less than two entries left nothing moves, and what is read then doesn't matter.
        left = end - lo
        for _ in range(int(left.max(initial=0)).bit_length()):
            half = left >> 1
            lo += half * (hashes(lo + half - 1) < want)
            left -= half
        lo += (left == 1) & (hashes(np.minimum(lo, len(low) - 1)) < want)
        hit = (lo < end) & (hashes(np.minimum(lo, len(low) - 1)) == want)
        return hit, np.repeat(rows[:1], hit.sum(), axis=0) if code is None else rows[code[lo[hit]]]


@dataclass
class Model:
    order: int
    words: Words
    grams: dict[int, Grams]  # by length, 2 to the order
    n: int
    largest: int  # words of the range that has most
    vocabulary: int
    train_tokens: int
    discounts: dict[int, list[float]] = field(default_factory=dict)  # by length of n-gram
    predecessors: int = 0
    fresh: float = 0.0  # weight of the uniform distribution in p1
    _ctx: dict = field(default_factory=dict)

    @property
    def start(self) -> int:
        """Id of the start mark; the next one is that of unknown words."""
        return self.largest * self.n

    def context(self, ids: np.ndarray) -> np.ndarray:
        """Records of ids; zeros where there is none."""
        out = np.zeros(len(ids), _CTX)
        shard, at = (ids % U64(self.n)).astype(np.int64), (ids // U64(self.n)).astype(np.int64)
        for i in np.unique(shard):
            if i not in self._ctx:
                self._ctx[i] = mapped(f"{self.words.folder}/ctx{i}.val", _CTX)
            mine = np.flatnonzero((shard == i) & (at < len(self._ctx[i])) & (ids <= self.start))
            out[mine] = self._ctx[i][at[mine]]
        return out

    def numbers(self, gram: list[np.ndarray]) -> np.ndarray:
        """What is kept of n-grams of ids, a row each; zeros where there is nothing."""
        if len(gram) > 1:
            return self.grams[len(gram)].find(gram_key(gram)).astype(np.float64)
        ids, back = np.unique(gram[0], return_inverse=True)
        found = self.context(ids)
        return np.stack([found[x].astype(np.float64) for x in _CTX.names], axis=1)[back]

    def numbers_of_ends(self, grams: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """What is kept of the last k ids of each n-gram, and of the k before the last: mostly the same ones, so they are looked up together."""
        m = len(grams[0])
        found = self.numbers([np.concatenate([x, y]) for x, y in zip(grams[-k:], grams[-k - 1 : -1], strict=True)])
        return found[:m], found[m:]

    def __getstate__(self):
        return self.__dict__ | {"_ctx": {}}


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of items seen once to four times."""
    if not n[0] or not n[1]:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.0), i + 1.0) if n[i] and n[i + 1] else (i + 1) / 2 for i in range(3)]


def discount(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def train(docs: DataFrame, scratch: Scratch, order: int = 3) -> Model:
    """Counts the texts of docs and writes the model's files; order is the length of the longest n-grams, 2 or more."""
    if order < 2:
        raise ValueError("the order of the model must be 2 or more")
    n, folder, docs = n_shards(docs, SHARD_BYTES), scratch.folder("knlm"), docs.select("text")
    lengths = range(2, order + 1)

    for i in range(n):  # a range without entries keeps its empty files
        for x in (f"w{i}.key", f"w{i}.val", f"ctx{i}.val", f"w{i}.id", *(f"g{k}_{i}" for k in lengths)):
            put_file(f"{folder}/{x}", lambda f: None)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, ["<u8", "<u8"], fold=fold_sums, shard_of=lambda a: by_range(a[0], n), squeeze=True)
        for _, block in blocks(batches, table=LOWER):
            keys, counts = np.unique(tokens(block)[0], return_counts=True)
            yield from packer.add(keys, counts)
        yield from packer.flush()

    def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = fold_sums(*unpack(batches, ["<u8", "<u8"], squeeze=True))
        if len(keys):
            shard = int(by_range(keys[:1], n)[0])
            ids = np.empty(len(keys), "<u8")
            ids[np.lexsort((keys, ~counts))] = np.arange(len(keys)) * n + shard
            put_file(f"{folder}/w{shard}.id", lambda f: f.write(ids.tobytes()))
            put_file(f"{folder}/w{shard}.key", lambda f: f.write(keys.tobytes()))
            put_file(f"{folder}/w{shard}.val", lambda f: f.write(counts.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    found = deal(docs.mapInArrow(count_words, Packer.schema(2)), n, keep_words, "shard long, n long, total long").collect()
    vocabulary, total = sum(r.n for r in found), sum(r.total for r in found)
    grams = {k: Grams(folder, f"g{k}_", n, 1 if k == order else len(_NUMBERS)) for k in lengths}
    model = Model(order, Words(folder, n), grams, n, max((r.n for r in found), default=0), vocabulary, total)
    if not vocabulary:
        return model
    #: Ids from here on, one for each length, stand for the numbers of n-grams seen once to four times.
    totals = model.start + 2
    bits = (totals + order + 1).bit_length()
    id_type = "<u4" if bits <= 32 else "<u8"

    def packer(k: int, values: list[str], fold: Callable | None = None) -> Packer:
        """Deals n-grams by hash, single words by id."""
        shard_of = (lambda a: by_range(gram_key(a[:k]), n)) if k > 1 else (lambda a: a[0].astype(np.uint64) % U64(n))
        return Packer(n, [id_type] * k + values, limit=2_000_000, fold=fold, shard_of=shard_of, squeeze=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = lambda *a: sum(fold_grams(a[:order], a[order:], bits), [])
        out = packer(order, ["<u4"], fold)
        for _, block in blocks(batches, table=LOWER):
            ids = [x.astype(id_type) for x in id_grams(block, model)[0]]
            yield from out.add(*fold(*ids, np.ones(len(ids[0]), np.uint32)))
        yield from out.flush()

    def shorter(ids: list[np.ndarray], c: np.ndarray, out: Packer) -> Iterator[pa.RecordBatch]:
        """What sorted n-grams with these counts tell of their contexts and of what is left without their first words."""
        k = len(ids)
        if not len(c):
            return
        at = starts(ids[:-1])
        seen = [np.add.reduceat((c == i).astype(np.uint32), at) for i in (1, 2)] + [np.add.reduceat((c > 2).astype(np.uint32), at)]
        yield from out.add(*(x[at] for x in ids[:-1]), np.add.reduceat(c, at), *seen, np.zeros(len(at)))
        rest, (before,) = fold_grams(ids[1:], [np.ones(len(c), np.uint32)], bits)
        none = np.zeros(len(before))
        yield from out.add(*rest, none, none, none, none, before)
        of = np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)
        yield from out.add(np.array([totals + k]), *[np.zeros(1)] * (k - 2), *(of[i : i + 1] for i in (1, 2, 3, 4)), np.zeros(1))

    def keep_longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *ids, c = unpack(batches, [id_type] * order + ["<u4"], squeeze=True)
        ids, (c,) = fold_grams(ids, [c], bits)
        if len(c):
            keys = gram_key(ids)
            put_grams(f"{folder}/g{order}_{int(by_range(keys[:1], n)[0])}", keys, n, [c])
            del keys
        out = packer(order - 1, _NUMBERS)
        yield from shorter(ids, c, out)
        yield from out.flush()

    def keep_shorter(k: int) -> Callable:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = unpack(batches, [id_type] * k + _NUMBERS, squeeze=True)
            ids, values = fold_grams(got[:k], got[k:], bits)
            del got
            cut = int(np.searchsorted(ids[0], totals))
            out = packer(k - 1, _NUMBERS)
            if cut < len(ids[0]):
                yield from out.add(*(x[cut:] for x in ids[:-1]), *(v[cut:] for v in values))
            ids, values = [x[:cut] for x in ids], [v[:cut] for v in values]
            if cut:
                keys = gram_key(ids)
                put_grams(f"{folder}/g{k}_{int(by_range(keys[:1], n)[0])}", keys, n, values)
                del keys
            some = np.flatnonzero(values[-1])
            yield from shorter([x[some] for x in ids], values[-1][some], out)
            yield from out.flush()

        return keep

    def keep_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *values = fold_sums(*unpack(batches, [id_type, *_NUMBERS], squeeze=True))
        cut = int(np.searchsorted(ids, totals))
        found = np.zeros((order + 1, 4), np.int64)
        for i, *of in zip(ids[cut:], *(v[cut:] for v in values[:4]), strict=True):
            found[int(i) - totals] = of
        seen = [0] * 2
        if cut:
            ids, values = ids[:cut].astype(np.int64), [v[:cut] for v in values]
            shard = int(ids[0]) % n
            out = np.zeros(int(ids[-1]) // n + 1, _CTX)
            for name, v in zip(_CTX.names, values, strict=True):
                out[name][ids // n] = v
            put_file(f"{folder}/ctx{shard}.val", lambda f: f.write(out.tobytes()))
            before = out["before"].astype(np.int64)
            found[1] = np.bincount(np.minimum(before, 5), minlength=6)[1:5]
            seen = [int((before > 2).sum()), int(before.sum())]
        yield pa.RecordBatch.from_pydict({"v": [[*found.ravel().tolist(), *seen]]})

    kept = deal(docs.mapInArrow(count, Packer.schema(order + 1)), n, keep_longest, Packer.schema(order - 1 + len(_NUMBERS)))
    for k in range(order - 1, 1, -1):
        kept = deal(kept, n, keep_shorter(k), Packer.schema(k - 1 + len(_NUMBERS)))
    rows = [r.v for r in deal(kept, n, keep_contexts, "v array<long>").collect()]
    *of, more, model.predecessors = [sum(x) for x in zip(*rows, strict=True)]
    model.discounts = {k: discounts(of[4 * k : 4 * k + 4]) for k in range(1, order + 1)}
    d = model.discounts[1]
    model.fresh = (d[0] * of[4] + d[1] * of[5] + d[2] * more) / model.predecessors
    return model


def id_grams(block: TextBlock, model: Model) -> tuple[list[np.ndarray], np.ndarray]:
    """For every token the ids of the n-gram that it ends, and the count of the word."""
    seq, doc, ends = tokens(block)
    keys, back = np.unique(seq, return_inverse=True)
    ids, counts = model.words.find(keys, model.start + 1)
    w = ids[back]
    place = np.arange(len(w)) - np.concatenate([[0], ends[:-1] + 1])[doc]
    grams = [w]
    for back_by in range(1, model.order):
        u = np.full(len(w), U64(model.start))
        inside = np.flatnonzero(place >= back_by)
        u[inside] = w[inside - back_by]
        grams.insert(0, u)
    return grams, counts[back]


def log_probs(block: TextBlock, model: Model) -> tuple[np.ndarray, ...]:
    """Text, base log10 probability, model log10 probability and whether known, of every token."""
    grams, count = id_grams(block, model)
    doc = np.repeat(np.arange(block.n), block.n_words + 1)
    base = np.log10((count + 0.1) / (model.train_tokens + 0.1 * (model.vocabulary + 1)))
    if not model.vocabulary:
        return doc, base, np.zeros(len(count)), count > 0
    keys = gram_key(grams)
    order = np.argsort(keys)  # np.unique would sort stably, which takes longer, to give first places
    at = starts([keys], order)
    back = np.empty(len(keys), np.int64)
    back[order] = np.repeat(np.arange(len(at)), np.diff(at, append=len(keys)))
    keys, grams = keys[order[at]], [x[order[at]] for x in grams]
    own, context = model.numbers_of_ends(grams, 1)
    before = own[:, 4]
    p = np.maximum(before - discount(before, model.discounts[1]), 0) / model.predecessors + model.fresh / (model.vocabulary + 1)
    for k in range(2, model.order + 1):
        d, (total, *seen, _) = model.discounts[k], context.T
        if k == model.order:
            c = model.grams[k].find_sorted(keys)[:, 0].astype(np.float64)
        else:
            own, context = model.numbers_of_ends(grams, k)
            c = own[:, 4]
        some = np.maximum(total, 1)
        gamma = (d[0] * seen[0] + d[1] * seen[1] + d[2] * seen[2]) / some
        p = np.where(total > 0, np.maximum(c - discount(c, d), 0) / some + gamma * p, p)
    return doc, base, np.log10(p)[back], count > 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, table=LOWER):
            doc, base, lp, known = log_probs(block, model)
            n = block.n_words.astype(np.int64) + 1
            total = np.bincount(doc, lp, block.n)
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": n, "n_known": np.bincount(doc, known, block.n).astype(np.int64), "train_tokens": np.full(block.n, model.train_tokens, np.int64)}
            yield from table(cols | {"base_score": np.bincount(doc, base, block.n), "score": total, "perplexity": 10 ** np.minimum(-total / n, 300)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; null ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
