"""Substring deduplication over sliding spans of consecutive sentences.

A sentence ends after a word that ends in `.`, `!` or `?`, at a line break, and at the end of
the text. A sentence of more than RUN_ON words (a table, a list, run-on prose) is divided after its words that
end in `,`, `;`, `:` or `|`; its parts then are the sentences. Spans are the shortest runs of consecutive sentences,
from every sentence forwards and from every sentence backwards, that meet one of RUNS: three
sentences and 20 words, two and 30 words, or 50 words. Spans with the same words (A-Z lower-cased, any white space between) are
joined across the corpus by hash; the first by (doc_id, place) stays, and every sentence
covered by another one is removed. Since the runs depend on the words alone, a
repeated passage gives the same spans wherever it stands, up to its first and last sentence. A passage without any
end of a sentence inside it is found only together with the sentence around it.

Each task sends only its first occurrence of a span, so a very common passage costs one entry
a task.

Defined cases: doc_id must be of an integer type. Null and empty texts have no sentences and stay as they are. Rows with the same
doc_id and the same text are the same document: a repeated row is treated like its twin, so neither removes the
other. Rows with the same doc_id and different texts are documents of their own, in the order of a hash of their texts.
Rows with a null doc_id come after all others. A text that nothing is removed from stays the same byte for byte;
one that loses all its sentences becomes empty. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from .shards import Packer, Scratch, deal, free_name, if_small, n_shards, unpack
from .textblock import LOWER, U64, TextBlock, blocks, mix, powers, runs

#: (sentences, words) of which a run must have one pair at least.
RUNS = ((3, 20), (2, 30), (1, 50))
#: Words beyond which a sentence is divided at its clause marks.
RUN_ON = 30
NO_ID = np.int64(2**63 - 1)
_STOP, _CLAUSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLAUSE[list(b",;:|")] = True
#: Hash of the span, doc_id, hash of the text, first and last sentence, whether it is known to be a repeat.
_TYPES = ["<u8", "<i8", "<i8", "<u4", "<u4", "<u1"]


def sentences(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and text of each sentence. The block must be lower-cased."""
    n = len(block.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = block.buf[block.end - 1]
    lines = np.concatenate([[0], np.cumsum(block.buf == 10)])
    last = _STOP[mark]
    last[:-1] |= (block.doc[1:] != block.doc[:-1]) | (lines[block.start[1:]] > lines[block.end[:-1]])
    last[-1] = True
    size = np.diff(np.flatnonzero(last), prepend=-1)
    last |= np.repeat(size > RUN_ON, size) & _CLAUSE[mark]
    to = np.flatnonzero(last) + 1
    at = np.concatenate([[0], to[:-1]])
    return at, to, block.doc[at]


def spans(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first sentence and last sentence (numbered within the block) of each span."""
    at, to, doc = sentences(block)
    n = len(at)
    if not n:
        return (np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)
    i = np.arange(n)
    last, first = np.full(n, n), np.full(n, -1)
    for m, words in RUNS:
        last = np.minimum(last, np.maximum(i + m - 1, np.searchsorted(to, at + words)))
        first = np.maximum(first, np.minimum(i - m + 1, np.searchsorted(at, to - words, side="right") - 1))
    f, b = last < n, first >= 0
    a, z = np.concatenate([i[f], first[b]]), np.concatenate([last[f], i[b]])
    same = doc[a] == doc[z]
    both = np.unique(a[same] * n + z[same])
    a, z = both // n, both % n
    up, down = powers(len(block.start) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(block.start) + 1, U64)
        np.cumsum(block.word_hash() * up[: len(block.start)], out=total[1:])
        h = mix((total[to[z]] - total[at[a]]) * down[at[a]] + (to[z] - at[a]).astype(U64))
    return h, doc[a], a, z


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def row_key(docs: DataFrame) -> Column:
    """Tells apart the texts of rows with the same doc_id."""
    return F.xxhash64(docs["text"])


def _dealt(doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(doc.view(U64) ^ mix(row.view(U64)))


def _fold(key: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, done: np.ndarray) -> list[np.ndarray]:
    """Keeps the first place of each hash; the others are known to be repeats (done = 1, dealt by document)."""
    order = np.lexsort((first, row, doc, key))
    key, doc, row, first, last = (x[order] for x in (key, doc, row, first, last))
    again = later(key, doc, row, first)
    key = np.where(again, _dealt(doc, row), key)
    return [key, doc, row, first, last, again.astype(np.uint8)]


def later(key: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of sorted entries, those at another place than the first of their key."""
    cut = runs(key)
    head = np.repeat(cut[:-1], np.diff(cut))
    return (doc != doc[head]) | (row != row[head]) | (first != first[head])


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row, first, last): the sentence ranges of each document to remove, merged; a written table."""
    n = n_shards(docs)
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, _TYPES, fold=_fold)
        for batch, block in blocks(batches, table=LOWER):
            h, doc, a, z = spans(block)
            base = np.searchsorted(sentences(block)[2], np.arange(block.n))[doc]
            yield from packer.add(h, _ids(batch)[doc], batch.column("row").to_numpy()[doc], a - base, z - base, np.zeros(len(h), np.uint8))
        yield from packer.flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, row, first, last, done = unpack(batches, _TYPES)
        packer = Packer(n, _TYPES[1:5], limit=1 << 60, shard_of=lambda a: (_dealt(a[0], a[1]) >> U64(33)) % U64(n))
        known, new = done == 1, done == 0
        list(packer.add(doc[known], row[known], first[known], last[known]))
        key, doc, row, first, last = (x[new] for x in (key, doc, row, first, last))
        order = np.lexsort((first, row, doc, key))
        key, doc, row, first, last = (x[order] for x in (key, doc, row, first, last))
        again = later(key, doc, row, first)
        list(packer.add(doc[again], row[again], first[again], last[again]))
        yield from packer.flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, row, first, last = unpack(batches, _TYPES[1:5])
        if not len(doc):
            return
        order = np.lexsort((first, row, doc))
        doc, row, first, last = doc[order], row[order], first[order].astype(np.int64), last[order].astype(np.int64)
        no = np.zeros(len(doc), np.int64)
        no[1:] = np.cumsum((doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
        lift = no << 33
        reach = np.maximum.accumulate(last + lift)
        new = np.ones(len(doc), bool)
        new[1:] = first[1:] + lift[1:] > reach[:-1] + 1
        at = np.flatnonzero(new)
        end = reach[np.concatenate([at[1:], [len(doc)]]) - 1] - lift[at]
        cut = runs(no[at])
        ids, rows = doc[at][cut[:-1]], row[at][cut[:-1]]
        off = pa.array(cut.astype(np.int32))
        for s in range(0, len(ids), 20_000):
            o = off.slice(s, min(20_000, len(ids) - s) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 20_000]), pa.array(rows[s : s + 20_000]), pa.ListArray.from_arrays(o, pa.array(first[at])), pa.ListArray.from_arrays(o, pa.array(end))], names=["doc_id", "row", "first", "last"])

    found = deal(docs.select("doc_id", "text", row_key(docs).alias("row")).mapInArrow(find, Packer.schema(6)), n, join, Packer.schema(4))
    return scratch.save(deal(found, n, merge, "doc_id long, row long, first array<long>, last array<long>"), "repeats")


def added(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns with the numbers of sentences and of removed ones: _sentences and _removed, if they are free."""
    return free_name(docs, "_sentences"), free_name(docs, "_removed")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the found sentences taken out of text, and how many it had and lost as the columns that added() names."""
    key, row, first, last = (free_name(docs, x) for x in ("_id", "_row", "_first", "_last"))
    cut = if_small(found.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("first").alias(first), F.col("last").alias(last)))
    joined = docs.join(cut, (F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NO_ID))) == F.col(key)) & (row_key(docs) == F.col(row)), "left").drop(key, row)
    n_name, gone_name = added(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, table=LOWER):
            at, _, doc = sentences(block)
            begin = np.searchsorted(doc, np.arange(block.n + 1))
            firsts, lasts = batch.column(first), batch.column(last)
            removed = np.zeros(block.n, np.int64)
            texts = None
            for i in np.flatnonzero(np.asarray(firsts.is_valid())):
                texts = batch.column("text").to_pylist() if texts is None else texts
                edge = np.concatenate([block.start[at[begin[i] : begin[i + 1]]], [block.off[i + 1]]])
                pieces, here = [], block.off[i]
                for a, z in zip(firsts[i].as_py(), lasts[i].as_py(), strict=True):
                    pieces.append(block.raw[here : edge[a]])
                    here = edge[z + 1]
                    removed[i] += z + 1 - a
                pieces.append(block.raw[here : block.off[i + 1]])
                texts[i] = "" if removed[i] == begin[i + 1] - begin[i] else np.concatenate(pieces).tobytes().decode("utf-8")
            cols = [c if name != "text" or texts is None else pa.array(texts, c.type) for name, c in zip(batch.schema.names, batch.columns, strict=True) if name not in (first, last)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(begin)), pa.array(removed)], names=[x for x in batch.schema.names if x not in (first, last)] + [n_name, gone_name])

    schema = StructType([*docs.schema.fields, StructField(n_name, LongType()), StructField(gone_name, LongType())])
    return joined.mapInArrow(run, schema)
