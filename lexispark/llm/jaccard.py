"""Exact Jaccard join of shingle sets in metric space, with components of the links.

Jaccard distance is a metric, but unrelated texts are all at distance 1, where no pivot tells
anything. So texts without a possible partner are put aside first, exactly, and pivots are
taken where texts meet:

1. Of each set the smallest hashes are dealt out, an eighth more than the prefix in which two
   linked sets must meet; a set with too few of them elsewhere has no partner (prefix filter
   with several matches).
2. For the sets left, how many sets hold a shingle is counted; those whose shared shingles are
   too few for the threshold go. The prefix in the order of frequency is the set's rare end.
3. The sets that meet at a prefix shingle have their smallest member as pivot. A set stands in the region of each
   pivot it meets, so every linked pair is together in one.
   Heavy shingles, found beforehand, are counted and led apart in 2 and 3: every task knows their
   list, whose length is bounded by their share, so none of them is gathered in one task.
4. In every region, whatever its size, the distances to its pivot are taken, the region's members spread over tasks in parts
   of PART. Sets within the threshold are linked to the pivot, and need no comparing with each other.
   By the triangle inequality a set beyond it can only be linked with sets that are at most the threshold nearer to the pivot:
   those are replicated into the window that is joined.
5. A window of more than LEAF sets is divided again: some of its members become pivots, each set goes to the Voronoi region
   of its nearest one, and to every other whose pivot is at most twice the threshold farther away than
   that (so of two linked sets each stands in the other's region). Sets too far from all pivots for that to tell regions apart
   go to a region of their own, with those that are at most the threshold nearer. 4 follows in each region, and so on. Where regions hardly get
   smaller or their windows are more than twice the whole, the sets are too far from each other for pivots to tell
   anything, and blocks of bounded size are joined instead. Windows of at most LEAF sets are joined exactly.
   A region of many variants of one text gets no smaller that way, all of them being near all pivots. There the shingles that most
   of its pivots hold are taken as their base. Members linked with the class of those nearest to the base are joined to it, and are not compared with
   each other. Of a pair in which one is not, the overlap is at most the lesser of the two overlaps with the base, and what both hold outside it:
   where the first is too little, they must meet at a shingle outside the base, in a prefix of those, which makes smaller regions. The few for which
   the base would be enough are joined in blocks, of those outside the class with all such.
6. Links become components by rounds of joins.

Texts with equal sets are one node throughout. Every step's data is dealt by hash.

Defined cases: null texts and texts without words have no shingles, link with nothing and are
their own component. A text of fewer words than k is one shingle. A null doc_id links with
nothing and has a null component. Repeated rows get a row each; equal ids with unequal texts
are separate nodes. doc_id must be of an integer type. Very long texts are arrays of their shingles in a worker. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .components import components
from .knlm import fold_sums
from .shards import Packer, Scratch, deal, free_name, if_small, n_shards, table, unpack
from .textblock import LOWER, U64, blocks, mix, runs, shingle_sets

#: Sets of a window that one task joins; sets of a region that one task measures, with its pivots; pivots of a window that is divided.
LEAF, PART, PIVOTS = 256, 128, 16
#: Times that a window is divided before it is joined in blocks.
LEVELS = 6
FAR = 0x9D39247E33776D41
#: A shingle with 1 / HEAVY of all entries or more is heavy; at most 2 * HEAVY are listed (16 bytes each), none with fewer than LEAST_HEAVY entries.
HEAVY, LEAST_HEAVY = 100_000, 64
SHINGLE = 5
SIMILARITY = 75


def row_key(docs: DataFrame) -> Column:
    """Tells apart the texts of rows with the same doc_id."""
    return F.xxhash64(docs["text"])


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any partner, and so the least size of a partner."""
    return -(-(n * percent) // 100)


def spare(n: np.ndarray, percent: int) -> np.ndarray:
    """Matches that the prefix of the first step is longer for."""
    return (n - need(n, percent)) // 2 + 1


def _shard(a: list[np.ndarray], n: int) -> np.ndarray:
    return (mix(a[0].view(U64)) >> U64(33)) % U64(n)


def _first_of_runs(cut: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(cut) - 1), np.diff(cut))


def distinct_meetings(h: np.ndarray, doc: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry of each hash and document, sorted by both; the greatest met stays."""
    order = np.lexsort((met, doc, h))
    h, doc, met = h[order], doc[order], met[order]
    last = np.ones(len(h), bool)
    last[:-1] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[last], doc[last], met[last]


def _meet_here(h: np.ndarray, doc: np.ndarray, met: np.ndarray) -> list[np.ndarray]:
    """What a task knows of its documents already. Of documents with the same hash the first alone is sent by it, with
    met = 1 if there are others; each of the others has one entry with 1 + its number of such hashes, dealt by document.
    So a shingle of very many documents costs one entry a task."""
    h, doc, met = distinct_meetings(h, doc, met)
    cut = runs(h)
    many, head = np.diff(cut), np.zeros(len(h), bool)
    head[cut[:-1]] = True
    if len(h):
        met = (np.repeat(many, many) > 1).astype(np.uint32)
    ids, times = np.unique(doc[~head], return_counts=True)
    return [np.concatenate([h[head], mix(ids.view(U64))]), np.concatenate([doc[head], ids]), np.concatenate([met[head], times + 1])]


def candidates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, met): in how many of its smallest shingles a document meets another; those that meet none are absent."""
    n = n_shards(docs)

    types = ["<u8:5", "<i8", "<u4"]  # of a hash within its shard five bytes do: a chance match only lets a document on

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, types, limit=3_000_000, fold=_meet_here)
        for batch, block in blocks(batches, table=LOWER):
            doc, h = shingle_sets(block, k)
            cut = np.searchsorted(doc, np.arange(block.n + 1))
            size = np.diff(cut)
            some = np.arange(len(doc)) - cut[doc] < (size - need(size, percent) + spare(size, percent))[doc]
            h = h[some]
            yield from packer.add(h, batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)[doc[some]], np.zeros(len(h), np.uint32))
        yield from packer.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, met = unpack(batches, types)
        packer = Packer(n, ["<i8", "<u4"], limit=1 << 60, shard_of=lambda a: _shard(a, n))
        known = met > 1
        list(packer.add(doc[known], met[known] - 1))
        h, doc, met = distinct_meetings(h[~known], doc[~known], met[~known])
        many = np.diff(runs(h)) if len(h) else np.zeros(0, np.int64)
        doc, met = np.unique(doc[(np.repeat(many, many) > 1) | (met == 1)], return_counts=True)
        list(packer.add(doc, met))
        yield from packer.flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, met = unpack(batches, ["<i8", "<u4"])
        ids, back = np.unique(doc, return_inverse=True)
        yield from table({"_id": ids, "_met": np.bincount(back, met, len(ids)).astype(np.int64)})

    known = docs.where("doc_id is not null").select("doc_id", "text")
    sent = deal(known.mapInArrow(send, Packer.schema(3)), n, meet, Packer.schema(2))
    return deal(sent, n, total, "_id long, _met long")


def shingle_table(docs: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, node, twin, shingles): equal sets have equal node and twin, two hashes of the whole set; shingles only where a partner is possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, table=LOWER):
            doc, h = shingle_sets(block, k)
            cut = np.searchsorted(doc, np.arange(block.n + 1))
            size = np.diff(cut)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(c)))]) for c in (1, 2)]
                node, twin = (mix(s[cut[1:]] - s[cut[:-1]] + size.astype(U64)).view(np.int64) for s in sums)
            least = need(size, percent)
            keep = (batch.column("_met").fill_null(0).to_numpy(zero_copy_only=False) >= spare(least, percent)) & (size > 0)
            sets = pa.array([h[cut[i] : cut[i + 1]].tobytes() if keep[i] else None for i in range(block.n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(size.astype(np.int64)), pa.array(node), pa.array(twin), sets], names=["doc_id", "row", "n_shingles", "node", "twin", "shingles"])

    joined = docs.select("doc_id", row_key(docs).alias("row"), "text").join(if_small(met), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "row", "text", "_met")
    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, n_shingles long, node long, twin long, shingles binary")


def heavy_shingles(sets: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The heavy shingles, sorted, and a weight of each, which takes the place of its frequency.

    A task reports, of each million entries, the shingles that are at least half as frequent there as a heavy one. So a
    heavy shingle is reported for more than half of its entries, and of those reported for so many there are at most 2 * HEAVY.
    """
    n, share = n_shards(sets), 2 * HEAVY

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, total = Packer(n, ["<u8", "<u8"], fold=fold_sums), 0
        parts: list[np.ndarray] = []
        size, seen = 0, set()

        def report() -> Iterator[pa.RecordBatch]:
            if parts:
                h, times = np.unique(np.concatenate(parts), return_counts=True)
                some = times >= max(2, size // share)
                yield from packer.add(h[some], times[some])

        for b in batches:
            for node, data in zip(b.column("node").to_pylist(), b.column("shingles"), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                parts.append(np.frombuffer(data.as_buffer(), "<u8"))
                size += len(parts[-1])
                total += len(parts[-1])
                if size >= 1_000_000:
                    yield from report()
                    parts, size = [], 0
                    seen.clear()
        yield from report()
        list(packer.add(np.array([2**64 - 1], np.uint64), np.array([total])))
        yield from packer.flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, times = fold_sums(*unpack(batches, ["<u8", "<u8"]))
        yield from table({"h": h.view(np.int64), "times": times.astype(np.int64)})

    found = scratch.save(deal(sets.where("shingles is not null").select("node", "shingles").mapInArrow(send, Packer.schema(2)), n, add_up, "h long, times long"), "reported")
    total = found.where("h = -1").agg(F.sum("times")).first()[0] or 0
    rows = found.where((F.col("h") != -1) & (F.col("times") >= max(LEAST_HEAVY, total // share))).collect()
    h, times = np.array([r.h for r in rows], np.int64).view(U64), np.array([r.times for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], times[order]


def place_in(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each h among the sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


def shared_sets(sets: DataFrame, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, n, shared, prefix): of each node its size, its shingles that other nodes have, rarest first, and how many of them are in its prefix."""
    n = n_shards(sets)
    types, found_types = ["<u8", "<i8", "<u4"], ["<i8", "<u8", "<u4", "<u4"]
    keys, weights = heavy

    def fold(h: np.ndarray, node: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((node, h))
        h, node, size = h[order], node[order], size[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        return [h[new], node[new], size[new]]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, types, fold=fold)
        for b in batches:
            for node, data in zip(b.column("node").to_pylist(), b.column("shingles"), strict=True):
                h = np.frombuffer(data.as_buffer(), "<u8")
                rest = h[place_in(keys, h) < 0]
                yield from packer.add(rest, np.full(len(rest), node), np.full(len(rest), len(h)))
        yield from packer.flush()

    def send_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, found_types, fold=once, shard_of=lambda a: _shard(a, n))
        for b in batches:
            for node, data in zip(b.column("node").to_pylist(), b.column("shingles"), strict=True):
                h = np.frombuffer(data.as_buffer(), "<u8")
                at = place_in(keys, h)
                at = at[at >= 0]
                yield from packer.add(np.full(len(at), node), keys[at], np.full(len(at), len(h)), weights[at])
        yield from packer.flush()

    def once(node: np.ndarray, h: np.ndarray, size: np.ndarray, df: np.ndarray) -> list[np.ndarray]:
        """By node and frequency, each shingle of a node once."""
        order = np.lexsort((h, df, node))
        node, h, size, df = node[order], h[order], size[order], df[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        return [node[new], h[new], size[new], df[new]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, node, size = fold(*unpack(batches, types))
        df = np.diff(runs(h)) if len(h) else np.zeros(0, np.int64)
        df = np.repeat(df, df)
        two = df > 1
        packer = Packer(n, found_types, limit=1 << 60, shard_of=lambda a: _shard(a, n))
        list(packer.add(node[two], h[two], size[two], df[two]))
        yield from packer.flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h, size, _ = once(*unpack(batches, found_types))
        size = size.astype(np.int64)
        cut = runs(node)
        n_shared, size = np.diff(cut), size[cut[:-1]] if len(node) else np.zeros(0, np.int64)
        least = need(size, percent)
        good = np.flatnonzero(n_shared >= least)
        for s in range(0, len(good), 2000):
            g = good[s : s + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(node[cut[g]]), pa.array(size[g]), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in g], pa.binary()), pa.array(n_shared[g] - least[g] + 1)], names=["node", "n", "shared", "prefix"])

    some = sets.where("shingles is not null").select("node", "shingles")
    found = deal(some.mapInArrow(send, Packer.schema(3)), n, count, Packer.schema(4))
    if len(keys):
        found = found.unionAll(some.mapInArrow(send_heavy, Packer.schema(4)))
    return deal(found, n, gather, "node long, n long, shared binary, prefix long")


def regions(nodes: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(pivot, node): each node and the pivots it meets in its prefix; every pivot is in its own region."""
    n = n_shards(nodes)
    types = ["<u8", "<i8", "<u4"]
    keys = heavy[0]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        for b in batches:
            for node, size, data, k in zip(*(b.column(c).to_pylist() for c in ("node", "n", "shared", "prefix")), strict=True):
                yield node, size, np.frombuffer(data, "<u8", count=k)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, types)
        for node, size, h in prefixes(batches):
            h = h[place_in(keys, h) < 0]
            yield from packer.add(h, np.full(len(h), node), np.full(len(h), size))
        yield from packer.flush()

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each heavy shingle the smallest set in whose prefix it is, among those of a task."""
        least = np.full(len(keys), 2**63 - 1), np.full(len(keys), 2**63 - 1)
        for node, size, h in prefixes(batches):
            at = place_in(keys, h)
            at = at[at >= 0]
            at = at[(size < least[0][at]) | ((size == least[0][at]) & (node < least[1][at]))]
            least[0][at], least[1][at] = size, node
        at = np.flatnonzero(least[0] < 2**63 - 1)
        yield from table({"at": at, "n": least[0][at], "node": least[1][at]})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], []]
        for node, _, h in prefixes(batches):
            at = place_in(keys, h)
            mine = np.unique(pivots[at[at >= 0]])
            out[0].append(mine)
            out[1].append(np.full(len(mine), node))
        if out[0]:
            yield from table({"pivot": np.concatenate(out[0]), "node": np.concatenate(out[1])})

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, node, size = unpack(batches, types)
        order = np.lexsort((node, size, h))
        h, node = h[order], node[order]
        cut = runs(h)
        many = np.diff(cut)
        pivot = node[cut[:-1]][_first_of_runs(cut)] if len(h) else node
        keep = np.repeat(many, many) > 1 if len(h) else np.zeros(0, bool)
        both = np.unique(np.stack([pivot[keep], node[keep]]), axis=1)
        yield from table({"pivot": both[0], "node": both[1]})

    pairs = deal(nodes.mapInArrow(send, Packer.schema(3)), n, lead, "pivot long, node long")
    if len(keys):
        pivots = np.zeros(len(keys), np.int64)
        for r in nodes.mapInArrow(smallest, "at long, n long, node long").groupBy("at").agg(F.min(F.struct("n", "node")).alias("first")).collect():
            pivots[r["at"]] = r["first"].node
        pairs = pairs.unionAll(nodes.mapInArrow(follow, "pivot long, node long"))
    return pairs.distinct()


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and overlap with every set, of each set."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    values, col = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(col, kind="stable")
    begin = np.searchsorted(col[order], np.arange(len(values) + 1))
    by_value, start = row[order], np.concatenate([[0], np.cumsum(size)])
    wide = np.flatnonzero(np.diff(begin) > max(16, len(sets) // 8))  # held by many sets: as a dense matrix
    dense = np.zeros((len(sets), len(wide)), np.float32)
    for j, v in enumerate(wide):
        dense[by_value[begin[v] : begin[v + 1]], j] = 1
    is_wide = np.zeros(len(values), bool)
    is_wide[wide] = True
    for lo in range(0, len(sets), 256):
        full = (dense[lo : lo + 256] @ dense.T).astype(np.int64)
        for i in range(lo, min(lo + 256, len(sets))):
            mine = col[start[i] : start[i + 1]]
            mine = mine[~is_wide[mine]]
            if len(mine):
                who = np.concatenate([by_value[begin[v] : begin[v + 1]] for v in mine])
                full[i - lo] += np.bincount(who, minlength=len(sets))
            yield i, full[i - lo]


def join_region(node: np.ndarray, size: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that join the nodes of the region as all their pairs would."""
    root = np.arange(len(node))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, common in overlaps(sets):
        for j in np.flatnonzero(100 * common >= percent * (size + size[i] - common)).tolist():
            if j != i:
                a, b = find(i), find(j)
                if node[a] != node[b]:
                    a, b = (a, b) if node[a] < node[b] else (b, a)
                    root[b] = a
    top = np.array([find(i) for i in range(len(node))], np.int64)
    moved = top != np.arange(len(node))
    return node[moved], node[top[moved]]


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            now = tuple(c[lo] for c in cols)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _sets(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("shared")]


def beyond(percent: int) -> float:
    """Distance to the nearest pivot beyond which a set's regions could be all."""
    return 1 - 2 * (1 - percent / 100)


def measured(members: DataFrame, pivots: DataFrame, sizes: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(region, cell, pivot, node, distance, linked) of each member of a region and the pivots in whose cell it stands; without a pivot, the cell of those far from all.

    members: (region, node); pivots: (region, node); sizes: (region, members). A member stands in the cell of its nearest pivot
    and in those of pivots at most twice the threshold farther away. Every part of a region gets its pivots.
    """
    least, bound = 1 - percent / 100, beyond(percent)
    parts = if_small(sizes.select("region", F.ceil(F.col("members") / PART).cast("int").alias("parts")))
    own = members.join(parts, "region").select("region", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(False).alias("leads"))
    lead = pivots.join(parts, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.lit(True).alias("leads"))
    rows = own.unionAll(lead).join(sets, "node").repartition(n, "region", "part").sortWithinPartitions("region", "part")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "region", "part"):
            leads, node, size, data = g.column("leads").to_numpy(), g.column("node").to_numpy(), g.column("n").to_numpy(), _sets(g)
            top, rest = np.flatnonzero(leads), np.flatnonzero(~leads)
            if not len(rest):
                continue
            length = np.array([len(data[i]) for i in rest])
            values, row = np.concatenate([data[i] for i in rest]), np.repeat(np.arange(len(rest)), length)
            common = np.zeros((len(rest), len(top)), np.int64)
            for k, p in enumerate(top):
                common[:, k] = np.bincount(row, np.isin(values, data[p]), len(rest))
            total = size[rest][:, None] + size[top][None] - common
            distance, linked = 1 - common / total, 100 * common >= percent * total
            home = distance.min(1)
            at, k = np.nonzero((distance <= home[:, None] + 2 * least + 1e-9) & (home <= bound)[:, None])
            far = np.flatnonzero(home > bound - least - 1e-9)
            region = g.column("region").to_numpy()[:1].astype(np.int64)
            with np.errstate(over="ignore"):
                seed = mix(region.view(U64))
                cell = np.concatenate([mix(seed + node[top[k]].view(U64)), np.repeat(mix(seed ^ U64(FAR)), len(far))]).view(np.int64)
            pivot = pa.array(np.concatenate([node[top[k]], far]), mask=np.arange(len(cell)) >= len(k))
            yield from table(
                {"region": np.repeat(region, len(cell)), "cell": cell, "pivot": pivot, "node": node[rest[np.concatenate([at, far])]], "distance": np.concatenate([distance[at, k], home[far]]), "linked": np.concatenate([linked[at, k], np.zeros(len(far), bool)])}
            )

    return rows.mapInArrow(measure, "region long, cell long, pivot long, node long, distance double, linked boolean")


def need_of_pair(total: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two linked sets of so many shingles together."""
    return -(-(total * percent) // (100 + percent))


def bases(pivots: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(region, base): the shingles that more than half of a region's pivots hold, of regions where at least half of the pivots have half of theirs among them."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "region"):
            data = _sets(g)
            values, held = np.unique(np.concatenate(data), return_counts=True)
            base = values[2 * held > len(data)]
            if 2 * sum(2 * np.isin(x, base).sum() >= len(x) for x in data) >= len(data):
                yield pa.RecordBatch.from_pydict({"region": [g.column("region")[0].as_py()], "base": [base.tobytes()]})

    return sets.join(if_small(pivots), "node").repartition(n, "region").sortWithinPartitions("region").mapInArrow(vote, "region long, base binary")


def nearest(members: DataFrame, base: DataFrame) -> DataFrame:
    """(region, node): of each region the PIVOTS members nearest to the base."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = [n - 2 * int(np.isin(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")).sum()) for n, x, y in zip(*(b.column(c).to_pylist() for c in ("n", "shared", "base")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("region"), b.column("node"), pa.array(far, pa.int64())], names=["region", "node", "far"])

    rows = members.join(if_small(base), "region").select("region", "node", "n", "shared", "base").mapInArrow(measure, "region long, node long, far long")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("region").orderBy("far", "node"))).where(F.col("r") <= PIVOTS).select("region", "node")


def settled(members: DataFrame, leads: DataFrame, base: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame:
    """(region, node, n, held, outside, root, linked) of each member: how much of the base it has, its other shared shingles, and whether it is
    linked with one of the largest class of linked leads, of which root is the smallest. members: (region, node, n, shared); leads: (region, node) of some."""
    parts = if_small(sizes.select("region", F.ceil(F.col("members") / PART).cast("int").alias("parts")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    own = members.join(parts, "region").select("region", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(0).alias("kind"), "n", "shared")
    lead = members.join(if_small(leads), ["region", "node"], "left_semi").join(parts, "region").select("region", every, "node", F.lit(1), "n", "shared")
    rows = own.unionAll(lead).unionAll(base.join(parts, "region").select("region", every, F.lit(0).cast("long"), F.lit(2), F.lit(0).cast("long"), "base"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "region", "part"):
            kind, node, size, data = g.column("kind").to_numpy(), g.column("node").to_numpy(), g.column("n").to_numpy(), _sets(g)
            rest, top, (at,) = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
            if not len(rest):
                continue
            top = top[np.argsort(node[top])]
            some = np.concatenate([top, rest])
            cut = np.cumsum([0, *(len(data[i]) for i in some)])
            values, row = np.concatenate([data[i] for i in some]), _first_of_runs(cut)
            common = np.stack([np.bincount(row, np.isin(values, data[p]), len(some)) for p in top], axis=1).astype(np.int64)
            linked = 100 * common >= percent * (size[some][:, None] + size[top][None] - common)
            joined, linked = linked[: len(top)].copy(), linked[len(top) :]
            for k in range(len(top)):
                joined |= joined[:, k, None] & joined[k]
            mine = joined[joined.sum(1).argmax()]
            inside = np.split(np.isin(values, data[at]), cut[1:-1])[len(top) :]
            yield pa.RecordBatch.from_arrays(
                [
                    g.column("region").combine_chunks().take(pa.array(rest)),
                    pa.array(node[rest]),
                    pa.array(size[rest]),
                    pa.array([int(x.sum()) for x in inside], pa.int64()),
                    pa.array([data[i][~x].tobytes() for i, x in zip(rest, inside, strict=True)], pa.binary()),
                    pa.array(np.full(len(rest), node[top[mine]].min())),
                    pa.array((linked & mine).any(1)),
                ],
                names=["region", "node", "n", "held", "outside", "root", "linked"],
            )

    return rows.repartition(n, "region", "part").sortWithinPartitions("region", "part").mapInArrow(measure, "region long, node long, n long, held long, outside binary, root long, linked boolean")


def outer_prefixes(found: DataFrame, percent: int) -> DataFrame:
    """(region, node, n, linked, weak, prefix) of the members of settled that may have a partner, one of the two at least not being linked to the class.

    Two sets have at most the lesser of their overlaps with the base in common inside it. The rest of what they need must be outside. Of each size,
    the greatest overlap with the base that members have tells how much that is at least. Where it may be nothing, the set is weak.
    """
    most = found.groupBy("region", "linked", "n").agg(F.max("held").alias("held")).groupBy("region").agg(F.collect_list(F.struct("n", "held", "linked")).alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            known: dict[int, tuple[np.ndarray, ...]] = {}
            for i, (region, n, held, linked) in enumerate(zip(*(b.column(c).to_pylist() for c in ("region", "n", "held", "linked")), strict=True)):
                if region not in known:
                    rows = b.column("most")[i].as_py()
                    known[region] = tuple(np.array([r[c] for r in rows]) for c in ("n", "held", "linked"))
                sizes, inner, tied = known[region]
                may = (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & ~(tied & linked)
                if may.any():
                    least = int((need_of_pair(sizes + n, percent) - np.minimum(inner, held))[may].min())
                    outside = b.column("outside")[i].as_buffer()
                    length = len(outside) // 8 - max(least, 1) + 1
                    if least <= 0 or length > 0:
                        out.append((i, least <= 0, outside.to_pybytes()[: 8 * max(length, 0)]))
            if out:
                at, weak, prefix = zip(*out, strict=True)
                some = b.select(["region", "node", "n", "linked"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(weak), pa.array(prefix, pa.binary())], names=["region", "node", "n", "linked", "weak", "prefix"])

    return found.join(if_small(most), "region").select("region", "node", "n", "held", "outside", "linked", "most").mapInArrow(run, "region long, node long, n long, linked boolean, weak boolean, prefix binary")


def outer_regions(ruled: DataFrame, n: int) -> DataFrame:
    """(region, node): the members of a region that meet at a shingle of their prefixes, where one at least is not linked to the class; as in regions, by their smallest."""
    types = ["<u8", "<i8", "<i8", "<u4", "<u4"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, types)
        for b in batches:
            for region, node, size, linked, data in zip(*(b.column(c).to_pylist() for c in ("region", "node", "n", "linked", "prefix")), strict=True):
                h = np.frombuffer(data, "<u8")
                with np.errstate(over="ignore"):
                    key = mix(h + mix(np.array([region], np.int64).view(U64)))
                yield from packer.add(key, *(np.full(len(h), x) for x in (region, node, size, int(linked))))
        yield from packer.flush()

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, region, node, size, linked = unpack(batches, types)
        if not len(key):
            return
        order = np.lexsort((node, size, region, key))
        key, region, node, linked = key[order], region[order], node[order], linked[order]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (region[1:] != region[:-1])]))
        many = np.diff(np.append(at, len(key)))
        keep = np.repeat((many > 1) & (np.add.reduceat(linked.astype(np.int64), at) < many), many)
        first = np.repeat(node[at], many)
        with np.errstate(over="ignore"):
            under = mix(mix(region.view(U64)) + first.view(U64)).view(np.int64)
        both = np.unique(np.stack([under[keep], node[keep]]), axis=1)
        yield from table({"region": both[0], "node": both[1]})

    return deal(ruled.where(F.octet_length("prefix") > 0).mapInArrow(send, Packer.schema(5)), n, lead, "region long, node long").distinct()


def weak_blocks(ruled: DataFrame, scratch: Scratch, level: int) -> DataFrame:
    """(leaf, node): blocks in which every weak member that is not linked to its region's class meets every weak member."""
    weak = scratch.save(ruled.where("weak").select("region", "node", "linked"), f"weak{level}")
    part = lambda of: F.ceil(of / (LEAF // 2)).cast("int")
    sizes = weak.groupBy("region").agg(part(F.count("*")).alias("parts"), part(F.sum((~F.col("linked")).cast("long"))).alias("lone")).where("lone > 0")
    dealt = weak.join(if_small(scratch.save(sizes, f"blocks{level}")), "region")
    own = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rows = dealt.select("region", "node", own("parts").alias("i"), each("lone").alias("j"))
    lone = dealt.where("not linked").select("region", "node", each("parts").alias("i"), own("lone").alias("j"))
    return rows.unionAll(lone).select(F.xxhash64("region", "i", "j").alias("leaf"), "node").distinct()


def links(nodes: DataFrame, scratch: Scratch, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b) links between nodes, enough to join what the threshold links."""
    n, sets, least = n_shards(nodes), nodes.select("node", "n", "shared"), 1 - percent / 100
    members = scratch.save(regions(nodes, heavy).withColumnRenamed("pivot", "region"), "members0")
    sizes = scratch.save(members.groupBy("region").agg(F.count("*").alias("members")), "sizes0")
    pivots = sizes.select("region", F.col("region").alias("node"))
    found, leaves = [], []
    for level in range(LEVELS):
        under = None
        if 0 < level < LEVELS - 1:
            base = scratch.save(bases(pivots, sets, n), f"bases{level}")
            if base.limit(1).count():
                dense = if_small(base.select("region"))
                mine = scratch.save(members.join(dense, "region", "left_semi").join(sets, "node").select("region", "node", "n", "shared"), f"dense{level}")
                members, sizes, pivots = (x.join(dense, "region", "left_anti") for x in (members, sizes, pivots))
                leads = scratch.save(nearest(mine, base), f"leads{level}")
                of = mine.groupBy("region").agg(F.count("*").alias("members"))
                tied = scratch.save(settled(mine, leads, base, scratch.save(of, f"densesizes{level}"), n, percent), f"settled{level}")
                found.append(tied.where("linked and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
                ruled = scratch.save(outer_prefixes(tied, percent), f"ruled{level}")
                leaves.append(weak_blocks(ruled, scratch, level))
                under = scratch.save(outer_regions(ruled, n), f"under{level}")
                over = if_small(scratch.save(under.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > LEAF).select("region"), f"over{level}"))
                leaves.append(under.join(over, "region", "left_anti").select(F.col("region").alias("leaf"), "node"))
                under = under.join(over, "region", "left_semi")
                if not sizes.limit(1).count() and not under.limit(1).count():
                    break
        far = scratch.save(measured(members, pivots, sizes, sets, n, percent), f"far{level}")
        found.append(far.where("linked and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        edge = far.where("not linked").groupBy("cell").agg((F.min("distance") - least - 1e-9).alias("edge"), F.max("pivot").alias("pivot"), F.max("distance").alias("most"))
        edge = scratch.save(edge.where(F.col("pivot").isNotNull() | (F.col("most") > beyond(percent))).select("cell", "edge"), f"edges{level}")
        window = scratch.save(far.join(if_small(edge), "cell").where("not linked or distance >= edge").select("region", "cell", "node", "linked"), f"window{level}")
        cells = scratch.save(window.groupBy("region", "cell").agg(F.count("*").alias("held")), f"cells{level}")
        if under is None and not cells.where(F.col("held") > LEAF).limit(1).count():
            leaves.append(window.select(F.col("cell").alias("leaf"), "node"))
            break
        whole = sizes.join(cells.groupBy("region").agg(F.sum("held").alias("total"), F.max("held").alias("largest")), "region")
        stuck = (F.col("total") > 2 * F.col("members")) | (10 * F.col("largest") > 9 * F.col("members")) if level else F.lit(False)
        whole = scratch.save(whole.where(F.col("largest") > LEAF).select("region", "members", (stuck | F.lit(level == LEVELS - 1)).alias("stuck")), f"whole{level}")
        # Regions that get no smaller: every two blocks of their members meet in one leaf.
        blocks_of = whole.where("stuck").select("region", F.ceil(F.col("members") / (LEAF // 2)).cast("int").alias("parts"))
        dealt = members.join(if_small(blocks_of), "region").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("region", F.least("part", j), F.greatest("part", j)))
        leaves.append(dealt.select(F.explode(pair).alias("leaf"), "node"))
        rest = window.join(if_small(whole.where("stuck").select("region")), "region", "left_anti")
        large = scratch.save(cells.where(F.col("held") > LEAF).select("cell", F.col("held").alias("members")), f"large{level}")
        leaves.append(rest.join(if_small(large), "cell", "left_anti").select(F.col("cell").alias("leaf"), "node"))
        members = rest.join(if_small(large), "cell").select(F.col("cell").alias("region"), "node")
        members = scratch.save(members if under is None else members.unionAll(under), f"members{level + 1}")
        sizes = scratch.save(members.groupBy("region").agg(F.count("*").alias("members")), f"sizes{level + 1}")
        first = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(level)), "node"))
        pivots = scratch.save(members.withColumn("r", first).where(F.col("r") <= PIVOTS).select("region", "node"), f"pivots{level + 1}")
        if not sizes.limit(1).count():
            break
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionAll(x)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "leaf"):
            if g.num_rows > 1:
                a, b = join_region(g.column("node").to_numpy(), g.column("n").to_numpy(), _sets(g), percent)
                if len(a):
                    yield from table({"a": a, "b": b})

    out = leaf.join(sets, "node").repartition(n, "leaf").sortWithinPartitions("leaf").mapInArrow(join, "a long, b long")
    for x in found:
        out = out.unionAll(x)
    return out


def classes(docs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, stays) of every row; row is row_key's, stays is false where another document comes first in the component."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type")
    docs = docs.select("doc_id", "text")
    met = scratch.save(candidates(docs, k, percent), "met")
    sets = scratch.save(shingle_table(docs, met, k, percent), "sets")
    heavy = heavy_shingles(sets, scratch)
    nodes = scratch.save(shared_sets(sets, percent, heavy), "nodes")
    linked = scratch.save(components(links(nodes, scratch, percent, heavy), scratch), "linked")
    scratch.drop("met", "reported", "nodes", *(f"{x}{k}" for k in range(LEVELS + 1) for x in ("members", "sizes", "far", "edges", "window", "cells", "whole", "large", "pivots", "bases", "dense", "leads", "densesizes", "settled", "ruled", "weak", "blocks", "under", "over")))
    rows = sets.select("doc_id", "row", "n_shingles", "node", "twin")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    first = some.groupBy("node", "twin").agg(F.min(F.struct("doc_id", "row")).alias("first")).join(linked.select("node", "root"), "node", "left")
    # A written table, so that Spark can split the join of a very large component's nodes.
    first = scratch.save(first.select("node", "twin", "first", F.coalesce("root", "node").alias("root")), "firsts")
    least = scratch.save(first.groupBy("root").agg(F.min("first").alias("lead")), "least")
    whole = scratch.save(first.join(least, "root").select("node", "twin", "lead"), "classes")
    out = rows.join(whole, ["node", "twin"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("lead.doc_id")))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), (alone | (F.struct("doc_id", "row") == F.col("lead"))).alias("stays"))


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, k: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that links of the given similarity reach."""
    return classes(docs, scratch or Scratch(docs.sparkSession), k, percent).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, scratch: Scratch | None = None, k: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, whose document comes first in its component, by doc_id and then by a hash of the text.

    Of rows with equal id and text one stays. Rows of one id are decided by their own texts; those that are linked with each other
    alone all stay, as do rows without an id and texts without words.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    key, row = free_name(docs, "_key"), free_name(docs, "_row")
    found = scratch.save(classes(docs, scratch, k, percent), "decided")
    gone = scratch.save(found.where("not stays").select(F.col("doc_id").alias(key), F.col("row").alias(row)).distinct(), "gone")
    again = found.where("stays and doc_id is not null").groupBy(F.col("doc_id").alias(key), F.col("row").alias(row)).agg(F.count("*").alias("n"))
    again = scratch.save(again.where("n > 1").select(key, row), "again")

    def same(df: DataFrame) -> Column:
        return (docs["doc_id"] == df[key]) & (row_key(docs) == df[row])

    out = docs.join(if_small(gone), same(gone), "left_anti")
    if not again.limit(1).count():
        return out
    once = docs.join(if_small(again), same(again), "left_semi").withColumn(row, row_key(docs)).dropDuplicates(["doc_id", row]).drop(row)
    return out.join(if_small(again), same(again), "left_anti").unionAll(once)
