"""Gaps between the ascending document ids of a term, and the ids back from the gaps.

A term may stand in a third of all documents. So windows run within blocks of BLOCK ids, and
what goes before a block comes from one row a block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Bits of the ids of a block: it has at most 2 ** BLOCK postings of a term.
BLOCK = 20


def encode(postings: DataFrame) -> DataFrame:
    """(term, doc_id, gap): the id less the term's id before it, or less 0."""
    p = postings.select("term", "doc_id", F.shiftright("doc_id", BLOCK).alias("_block"))
    ends = p.groupBy("term", "_block").agg(F.max("doc_id").alias("_end"))
    before = ends.select("term", "_block", F.lag("_end", 1, 0).over(Window.partitionBy("term").orderBy("_block")).alias("_before"))
    last = F.lag("doc_id").over(Window.partitionBy("term", "_block").orderBy("doc_id"))
    return p.withColumn("_last", last).join(before, ["term", "_block"]).select("term", "doc_id", (F.col("doc_id") - F.coalesce("_last", "_before")).alias("gap"))


def decode(gaps: DataFrame) -> DataFrame:
    """(term, doc_id, decoded): running sums of the gaps in the order of doc_id."""
    g = gaps.select("term", "doc_id", "gap", F.shiftright("doc_id", BLOCK).alias("_block"))
    sums = g.groupBy("term", "_block").agg(F.sum("gap").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("term").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("term", "_block", F.coalesce(upto, F.lit(0)).alias("_before"))
    here = F.sum("gap").over(Window.partitionBy("term", "_block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("_here", here).join(before, ["term", "_block"]).select("term", "doc_id", (F.col("_here") + F.col("_before")).alias("decoded"))


class Blocks:
    """Blocks of the postings of an index. Terms of few documents have one, -1; the others have one for each PIECE documents
    by id, so that no part of the index holds all of a frequent term. Which terms those are decides on the balance of
    the parts alone, so it is seen from PROBE documents; gaps are right with any choice.
    """

    #: Documents of a block of a frequent term, documents looked at, and the share of them that a frequent term is in.
    PIECE, PROBE, SHARE = 1 << 17, 20_000, 0.05

    def __init__(self, frequent: list[str], bounds: list[int]):
        self.frequent, self.bounds = frequent, bounds

    @classmethod
    def of(cls, docs: DataFrame, tokenize: Callable[[DataFrame], DataFrame]) -> Blocks:
        n = docs.count()
        pieces = -(-n // cls.PIECE)
        if pieces < 2:
            return cls([], [])
        seen = docs.select("doc_id", "text").sample(min(1.0, cls.PROBE / n), seed=1)
        held = tokenize(seen).select("term", "doc_id").distinct().groupBy("term").count()
        frequent = [r.term for r in held.where(F.col("count") >= max(1, cls.SHARE * min(n, cls.PROBE))).collect()]
        bounds = docs.select(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], 10_000).alias("b")).first().b
        return cls(frequent, sorted(set(bounds or [])))

    def add(self, postings: DataFrame) -> DataFrame:
        if not self.frequent or not self.bounds:
            return postings.withColumn("_block", F.lit(-1))
        at = reduce(add, (F.when(F.col("doc_id") >= b, 1).otherwise(0) for b in self.bounds))
        return postings.withColumn("_block", F.when(F.col("term").isin(self.frequent), at).otherwise(-1))


def _here() -> WindowSpec:
    return Window.partitionBy("term", "_block").orderBy("doc_id")


def _carried(rows: DataFrame, value: Column, before: Column) -> DataFrame:
    """rows with _before, made of one value a block. Only frequent terms have several blocks, so the table is small."""
    found = rows.where("_block >= 0").groupBy("term", "_block").agg(value.alias("_value"))
    found = found.select("term", "_block", before.alias("_before")).where("_before is not null")
    return rows.join(F.broadcast(found), ["term", "_block"], "left")


def encode_blocks(blocked: DataFrame) -> DataFrame:
    """(term, _block, doc_id, gap) of postings that lie sorted by term, _block and doc_id, where they lie."""
    p = _carried(blocked.select("term", "_block", "doc_id"), F.max("doc_id"), F.lag("_value").over(Window.partitionBy("term").orderBy("_block")))
    return p.select("term", "_block", "doc_id", (F.col("doc_id") - F.coalesce(F.lag("doc_id").over(_here()), "_before", F.lit(0))).alias("gap"))


def decode_blocks(gaps: DataFrame) -> DataFrame:
    """(term, doc_id, decoded) from what encode_blocks gives."""
    upto = F.sum("_value").over(Window.partitionBy("term").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    here = F.sum("gap").over(_here().rowsBetween(Window.unboundedPreceding, 0))
    return _carried(gaps, F.sum("gap"), upto).select("term", "doc_id", (here + F.coalesce("_before", F.lit(0))).alias("decoded"))
