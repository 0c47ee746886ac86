"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Seeds are the hashes of every MIN_MATCH consecutive words of the benchmark items, in a table that is joined with the
seeds of the documents. A document's windows first pass a bit filter of bounded size (FILTER_BITS), so few of them
are sent. A pair that is to be reported has COVERAGE of the item's words in tiles, and so a certain number of the
item's seeds: the pairs to look at are those that share one of the others, rarest in the documents
first (as many as that number allows to be left out), so a phrase that very many documents and items
share brings no pairs by itself.

Each such pair is tiled: of the common runs of words that are not marked yet the longest is marked, of equal ones
the first in the item, then in the document, until none of MIN_MATCH words is left. Common runs
come from equal running hashes of the windows, checked word by word. The pair is reported if the tiles cover COVERAGE
of the item's words, in whatever order its passages stand in the document. Words are runs of letters and digits (all characters
beyond ASCII included), A-Z lower-cased, and compared by 64-bit hashes.

Neither the benchmark nor what is found comes to the driver, but for the filter. Documents are read twice, however large the
benchmark is; the second time only those with a candidate go on.

Defined cases: null and empty texts and items match nothing. An item of fewer words than
MIN_MATCH matches where all of it stands as one run. Ids may be of any type, and null. Repeated rows and repeated items give
their own pairs. An empty benchmark or no documents give no pairs. Of a very long text several windows may
be the same; each occurrence can hold a tile. Columns besides doc_id, item_id and text are not read; keep_clean passes all on.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shards import Scratch, free_name, if_small, table
from .textblock import LETTERS, U64, blocks, mix, powers, window_hash

MIN_MATCH = 5
COVERAGE = 0.5
#: The filter has 2 ** FILTER_BITS bits at most (16 MB).
FILTER_BITS = 27
#: Window pairs of a document and an item that are held at once.
PAIRS_AT_ONCE = 2_000_000


def karp_rabin(words: np.ndarray, k: int) -> np.ndarray:
    """Running hashes of every k consecutive words, from prefix sums of a polynomial modulo 2 ** 64."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, U64)
        np.cumsum(mix(words) * up[: len(words)], out=total[1:])
        return (total[k:] - total[:-k]) * down[:n]


def common_runs(item: np.ndarray, doc: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the longest common runs: none can be made longer at either end."""
    hi, hd = karp_rabin(item, least), karp_rabin(doc, least)
    if not len(hi) or not len(hd):
        return
    order = np.argsort(hi, kind="stable")
    sorted_hi = hi[order]
    lo, up = np.searchsorted(sorted_hi, hd), np.searchsorted(sorted_hi, hd, side="right")
    places = np.flatnonzero(up > lo)
    if not len(places):
        return
    many = (up - lo)[places]
    parts: list[np.ndarray] = []
    cut = np.unique(np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), PAIRS_AT_ONCE), side="right"))
    for a, b in zip(cut, [*cut[1:], len(places)], strict=True):
        n = many[a:b]
        j = np.repeat(places[a:b], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = order[np.repeat(lo[places[a:b]], n) + within]
        same = np.ones(len(i), bool)
        for k in range(least):
            same &= item[i + k] == doc[j + k]
        i, j = i[same], j[same]
        if not len(i):
            continue
        by = np.lexsort((i, j - i))
        i, d = i[by], (j - i)[by]
        new = np.ones(len(i), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
        at = np.flatnonzero(new)
        parts.append(np.stack([d[at], i[at], i[np.concatenate([at[1:], [len(i)]]) - 1]]))
    if not parts:
        return
    d, first, last = np.concatenate(parts, axis=1)
    by = np.lexsort((first, d))
    d, first, last = d[by], first[by], last[by]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (first[1:] != last[:-1] + 1)
    at = np.flatnonzero(new)
    end = last[np.concatenate([at[1:], [len(d)]]) - 1]
    yield from zip(first[at].tolist(), (first[at] + d[at]).tolist(), (end - first[at] + least).tolist(), strict=True)


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length) of greedy string tiling."""
    item, doc = np.asarray(item, U64), np.asarray(doc, U64)
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    queue = [(-k, i, j) for i, j, k in common_runs(item, doc, least)]
    heapq.heapify(queue)
    left = len(item)
    while queue and left >= least:
        k, i, j = heapq.heappop(queue)
        k = -k
        free = free_item[i : i + k] & free_doc[j : j + k]
        if free.all():
            free_item[i : i + k] = free_doc[j : j + k] = False
            left -= k
            tiles.append((i, j, k))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(queue, (a - b, i + a, j + a))
    return tiles


def row_key(df: DataFrame, id_column: str) -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64(df[id_column], df["text"])


def item_table(benchmark: DataFrame, scratch: Scratch, least: int, coverage: float) -> DataFrame:
    """(item, words, seeds, spare): each item's word hashes, its seeds in order, and how many of them a pair can do without; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, table=LETTERS):
            words = block.word_hash()
            some = np.flatnonzero(block.n_words)
            own = [words[block.words_at[i] : block.words_at[i + 1]] for i in some]
            seeds = [window_hash(w, min(least, len(w))).view(np.int64).tolist() for w in own]
            spare = [max(1, math.ceil(coverage * len(w) / least - 1e-9)) - 1 if len(w) >= least else 0 for w in own]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(some)), pa.array([w.tobytes() for w in own], pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array(spare, pa.int32())], names=["item", "words", "seeds", "spare"])

    keyed = benchmark.select(row_key(benchmark, "item_id").alias("item"), "text").where("text is not null").dropDuplicates(["item"])
    return scratch.save(keyed.mapInArrow(run, "item long, words binary, seeds array<long>, spare int"), "items")


def seed_filter(seeds: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits, eight a byte, of which the two that a seed names are set; and the logarithm of their number."""
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(64 * max(n, 1)))))
    slots = seeds.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND((1 << bits) - 1))).alias("s")).select((F.col("s") + 1).alias("s"))
    found = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in found.toLocalIterator():
        part = np.frombuffer(r.m, np.uint8)
        at = (r.b - 1) * 4096
        out[at : at + len(part)] = part[: len(out) - at]
    return out, bits


def passes(maybe: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for s in (h >> U64(64 - bits), h & U64((1 << bits) - 1)):
        out &= (maybe[(s >> U64(3)).astype(np.int64)] >> (s & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def candidates(docs: DataFrame, items: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(doc, item) row keys of the documents and items that share a seed that counts; a written table."""
    seeds = scratch.save(items.select("item", "spare", F.size("seeds").alias("n"), F.explode("seeds").alias("h")), "seeds")
    sizes = sorted({least} | {r.k for r in items.select(F.least(F.lit(least), (F.octet_length("words") / 8).cast("int")).alias("k")).distinct().collect()})
    maybe, bits = seed_filter(seeds, seeds.count())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, table=LETTERS):
            words, key = block.word_hash(), batch.column("doc").to_numpy()
            for k in sizes:
                h = window_hash(words, k)
                at = np.flatnonzero(passes(maybe, bits, h)) if len(h) else np.zeros(0, np.int64)
                at = at[block.doc[at] == block.doc[at + k - 1]]
                if len(at):
                    both = np.unique(np.stack([h[at], block.doc[at].astype(U64)]), axis=1)
                    yield from table({"h": both[0].view(np.int64), "doc": key[both[1].astype(np.int64)]})

    keyed = docs.select(row_key(docs, "doc_id").alias("doc"), "text").where("text is not null")
    hits = scratch.save(keyed.mapInArrow(find, "h long, doc long"), "hits")
    df = scratch.save(hits.groupBy("h").agg(F.count("*").alias("df")), "seed_counts")
    # Of an item's seeds, the most frequent that a pair can do without bring no candidates.
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.col("df"), F.col("h")))
    rare = seeds.join(if_small(df), "h", "left").fillna(0, ["df"]).withColumn("r", order).where("r <= n - spare and df > 0").select("item", "h").distinct()
    rare = scratch.save(rare, "rare")
    return scratch.save(hits.join(if_small(rare), "h").select("doc", "item").distinct(), "pairs")


def tiled(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, coverage: float, least: int) -> DataFrame:
    """(doc_id, doc, item, coverage, n_tiles, longest) of every row of docs and every distinct item it holds enough of."""
    items = item_table(benchmark, scratch, least, coverage)
    pairs = candidates(docs, items, scratch, least)
    right = items.select("item", "words")
    # A document's candidates are bounded by its own seeds.
    lists = scratch.save(pairs.join(if_small(right), "item").groupBy("doc").agg(F.collect_list(F.struct("item", "words")).alias("of")), "lists")
    size = F.aggregate("of", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["words"]) + 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, table=LETTERS):
            words, out = block.word_hash(), []
            for d, of in enumerate(batch.column("of").to_pylist()):
                mine = words[block.words_at[d] : block.words_at[d + 1]]
                for x in of:
                    item = np.frombuffer(x["words"], "<u8")
                    k = [t[2] for t in tile(item, mine, min(least, len(item)))]
                    if sum(k) >= coverage * len(item) - 1e-9:
                        out.append((d, x["item"], sum(k) / len(item), len(k), max(k)))
            if out:
                d, x, c, n, longest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), batch.column("doc").take(pa.array(d)), pa.array(x), pa.array(c), pa.array(n), pa.array(longest)], names=["doc_id", "doc", "item", "coverage", "n_tiles", "longest"])

    keyed = docs.select("doc_id", "text", row_key(docs, "doc_id").alias("doc"))
    joined = keyed.join(if_small(lists, size), "doc").select("doc_id", "text", "doc", "of")
    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc long, item long, coverage double, n_tiles long, longest long")


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of every document and item it holds enough of."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = tiled(docs, benchmark, scratch, coverage, least)
    ids = scratch.save(benchmark.where("text is not null").select("item_id", row_key(benchmark, "item_id").alias("item")), "item_ids")
    return found.join(if_small(ids), "item").select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def keep_clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    scratch = scratch or Scratch(docs.sparkSession)
    key = free_name(docs, "_key")
    gone = scratch.save(tiled(docs, benchmark, scratch, coverage, least).select(F.col("doc").alias(key)).distinct(), "gone")
    return docs.join(if_small(gone), row_key(docs, "doc_id") == F.col(key), "left_anti")
