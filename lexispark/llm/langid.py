"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier over byte n-grams predicts each bit of
it (log odds of the n-gram between the languages whose bit is 1 and those whose bit is 0).
Loss-weighted decoding takes the language whose codeword costs least, each bit weighted by
how well its classifier does on that language, and flags a text whose two best are close.

Training reads at most `max_docs_per_lang` labelled documents of each language, those with
the smallest hash of their id and text; prediction reads every text whole. The driver holds 1 MB for each
language and the workers the weights of all bits (0.5 MB each, some 10 log2 of the number of languages).

Defined cases: rows are sampled, not ids: a null id, or one that many rows share, is learned from like any other; rows of
equal id and text count once. a text that is null, empty or without letters gives `und`, score 0, and is
ambiguous. With no labelled row every text gives `und`; with one language it is that one.
Equal costs go to the language that sorts first. Repeated rows each get their own row.
Columns besides doc_id, text and lang are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shards import Scratch, if_small
from .textblock import TextBlock, blocks

#: Labelled documents of a language that training reads at most.
MAX_DOCS_PER_LANG = 1000
#: Relative gap between the two least costs under which a text is ambiguous.
MARGIN = 0.1
SIZE = 1 << 16
SMOOTH = 0.5

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # language x bit, 1 or -1
    weight: np.ndarray  # 2 * SIZE x bit: log odds of each n-gram
    scale: np.ndarray  # of each bit: mean absolute margin
    trust: np.ndarray  # language x bit, rows sum to 1


def codewords(k: int) -> np.ndarray:
    """k x bits of 1 and -1, rows far apart: all splits of up to five languages, else the best of seeded random codes."""
    if k <= 5:
        bits = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 2 ** max(k - 1, 0))]
        return np.array(bits, np.int8).reshape(-1, k).T
    rng, n = np.random.default_rng(5), 10 * int(np.ceil(np.log2(k))) + 5
    best, far = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (k, n))
        code = code[:, np.abs(code.sum(0)) < k]
        same = code.astype(int) @ code.T
        np.fill_diagonal(same, -(10**6))
        d = code.shape[1] - same.max()
        if d > far:
            best, far = code, d
    return best


def ngrams(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the byte pairs and triples of all texts, and the text of each; those of blanks only are dropped."""
    b = _PLAIN[block.buf].astype(np.int32)
    if len(b) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    two = (b[:-2] << 8) | b[1:-1]
    three = (((two << 8) | b[2:]).astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32) + SIZE
    doc = np.repeat(np.arange(block.n), np.diff(block.off))[:-2]
    keep = (b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))
    keep &= doc == np.repeat(np.arange(block.n), np.diff(block.off))[2:]
    return two[keep], three[keep], doc[keep]


def margins(block: TextBlock, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log odds of each text for each bit, and whether it has a letter."""
    two, three, doc = ngrams(block)
    at = np.searchsorted(doc, np.arange(block.n + 1))
    n = np.maximum(np.diff(at), 1)
    out = np.zeros((block.n, weight.shape[1]))
    for bit in range(weight.shape[1]):
        w = weight[:, bit]
        total = np.zeros(len(two) + 1)
        np.cumsum(w[two] + w[three], out=total[1:], dtype=np.float64)
        out[:, bit] = (total[at[1:]] - total[at[:-1]]) / n
    letter = block.sums(_LETTER[block.buf]) > 0
    for i in np.flatnonzero(~letter):
        letter[i] = any(c.isalpha() for c in block.text(i))
    return out, letter


def decode(z: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share among all of exp(-cost), and the relative gap to the second."""
    z = np.clip(z / model.scale, -4, 4)
    cost = (np.exp(-z[:, None, :] * model.code[None]) * model.trust[None]).sum(2)
    best = cost.argmin(1)
    e = np.exp(cost.min(1, keepdims=True) - cost)
    share = e[np.arange(len(e)), best] / e.sum(1)
    two = np.sort(cost, axis=1)[:, :2]
    gap = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1] + two[:, 0], 1e-12) if cost.shape[1] > 1 else np.ones(len(cost))
    return best, share, gap


def train(docs: DataFrame, scratch: Scratch, max_docs_per_lang: int = MAX_DOCS_PER_LANG) -> Model:
    """docs: (doc_id, text, lang), those to learn from; rows without text or lang are left out."""
    known = docs.where("text is not null and lang is not null")
    # A language's rows are thinned by their hash to four times the number wanted, then ranked: neither loads one task.
    # Shares are of distinct hashes (estimated within a few percent), so rows that repeat take nobody's place.
    known = known.select("text", "lang", F.xxhash64("doc_id", "text").alias("_key"))
    part = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / (1 << 30)
    share = scratch.save(known.groupBy("lang").agg((F.lit(4.0 * max_docs_per_lang + 100) / F.approx_count_distinct("_key")).alias("_share")), "langid_shares")
    some = known.join(if_small(share), "lang").where(part <= F.col("_share")).groupBy("lang", "_key").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(part, "_key"))
    sample = scratch.save(some.withColumn("_rank", rank).where(F.col("_rank") <= max_docs_per_lang).select("text", "lang").repartition(4), "langid_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch, block in blocks(batches):
            two, three, doc = ngrams(block)
            lang = np.array(batch.column("lang").to_pylist(), object)
            for x in dict.fromkeys(lang):
                mine = (lang == x)[doc]
                seen.setdefault(x, np.zeros(2 * SIZE))[:] += np.bincount(np.concatenate([two[mine], three[mine]]), minlength=2 * SIZE)
        for x, c in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": [x], "counts": [c.astype(np.float32).tobytes()]})

    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts, np.float32).astype(np.float64)
    langs = sorted(total)
    if not langs:
        scratch.drop("langid_sample", "langid_shares")
        return Model([], *[np.zeros((0, 0))] * 4)
    code = codewords(len(langs))
    p = np.array([total[x] for x in langs]).reshape(len(langs), 2, SIZE) + SMOOTH / 100
    p /= p.sum(2, keepdims=True)
    p = p.reshape(len(langs), 2 * SIZE)
    weight = np.stack([np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1).astype(np.float32) if code.size else np.zeros((2 * SIZE, 0), np.float32)
    bits = weight.shape[1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, right, size = np.zeros(len(langs)), np.zeros((len(langs), bits)), np.zeros(bits)
        for batch, block in blocks(batches):
            z, letter = margins(block, weight)
            which = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
            good = z * code[which] > 0
            np.add.at(n, which[letter], 1)
            np.add.at(right, which[letter], good[letter])
            size += np.abs(z[letter]).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n.tobytes()], "good": [right.tobytes()], "size": [size.tobytes()]})

    n, right, scale = np.zeros(len(langs)), np.zeros((len(langs), bits)), np.zeros(bits)
    for r in sample.mapInArrow(judge, "n binary, good binary, size binary").toLocalIterator():
        n += np.frombuffer(r.n)
        right += np.frombuffer(r.good).reshape(right.shape)
        scale += np.frombuffer(r.size)
    scratch.drop("langid_sample", "langid_shares")
    trust = (right + 1) / (n[:, None] + 2)
    return Model(langs, code, weight, np.maximum(scale / max(n.sum(), 1), 1e-9), trust / np.maximum(trust.sum(1, keepdims=True), 1e-9))


def label(block: TextBlock, model: Model, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    if not model.langs:
        return np.array(["und"] * block.n, object), np.zeros(block.n), np.ones(block.n, bool)
    z, letter = margins(block, model.weight)
    best, share, gap = decode(z, model)
    return np.where(letter, np.array(model.langs, object)[best], "und"), np.where(letter, share, 0.0), ~letter | (gap < margin)


def predict(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches):
            lang, score, ambiguous = label(block, model, margin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(lang), pa.string()), pa.array(score), pa.array(ambiguous)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text has a language; `und` goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches):
            yield batch.filter(pa.array(label(block, model, MARGIN)[0] != "und"))

    return docs.mapInArrow(run, docs.schema)
