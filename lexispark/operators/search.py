"""The three query modes over an index. Each gives (doc_id, name), one row a document, by name.

Boolean and positional queries read the postings of their terms once and group them by
document, however many operators they have.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import parse
from .index import Index, IndexNotBuiltError


def near(a: Column, b: Column, k: int) -> Column:
    """Whether two position arrays have members at most k apart: in the merged order the nearest two stand side by side.
    Small distances are spelled out instead, which takes no sorting."""
    if k <= 8:
        return F.arrays_overlap(F.flatten(F.transform(a, lambda x: F.sequence(x - k, x + k))), b)
    merged = F.array_sort(F.concat(F.transform(a, lambda x: x.cast("long") * 2), F.transform(b, lambda y: y.cast("long") * 2 + 1)))
    pairs = lambda m: F.exists(F.sequence(F.lit(1), F.size(m) - 1), lambda i: _side_by_side(F.get(m, i - 1), F.get(m, i), k))
    return F.get(F.transform(F.array(merged), pairs), 0)  # through an array of one, the merged order is made once


def _side_by_side(x: Column, y: Column, k: int) -> Column:
    return (x.bitwiseAND(1) != y.bitwiseAND(1)) & (F.shiftright(y, 1) - F.shiftright(x, 1) <= k)


class Searcher:
    def __init__(self, index: Index | None):
        if index is None:
            raise IndexNotBuiltError("the index is not built")
        self.index = index

    def search(self, mode: str, query: str) -> DataFrame:
        """mode: boolean, positional or joker."""
        query = query.strip()
        if not query:
            raise ValueError("empty query is not allowed")
        return {"boolean": self.boolean, "positional": self.positional, "joker": self.joker}[mode.lower()](query)

    def _named(self, ids: DataFrame) -> DataFrame:
        return self.index.docs.join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "name").orderBy("name", "doc_id")

    def _none(self) -> DataFrame:
        return self.index.docs.select("doc_id", "name").limit(0)

    def boolean(self, query: str) -> DataFrame:
        groups = parse.boolean(query)
        wanted = sorted({t for g in groups for t in g.include + g.exclude})
        if not groups:
            return self._none()
        flag = {t: F.col(f"t{i}") for i, t in enumerate(wanted)}
        has = self.index.postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(*(F.bool_or(F.col("term") == t).alias(f"t{i}") for i, t in enumerate(wanted)))
        met = reduce(or_, (reduce(and_, [*(flag[t] for t in g.include), *(~flag[t] for t in g.exclude)]) for g in groups))
        return self._named(has.where(met))

    def positional(self, query: str, chain: str = "any") -> DataFrame:
        """chain: any adjacent pair is enough, or all pairs are needed."""
        q = parse.positional(query)
        terms = list(dict.fromkeys(q.terms))
        if None in terms or not q.distances or self.index.postings.where(F.col("term").isin(terms)).select("term").distinct().count() < len(terms):
            return self._none()
        at = {t: F.col(f"p{i}") for i, t in enumerate(terms)}
        has = self.index.postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(*(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)))
        pairs = [F.coalesce(near(at[a], at[b], k), F.lit(False)) for a, b, k in zip(q.terms, q.terms[1:], q.distances, strict=False)]
        return self._named(has.where(reduce(or_ if chain == "any" else and_, pairs)))

    def joker(self, query: str, combine: str = "fold") -> DataFrame:
        """combine: fold as described below, or all: every word must match.

        The fold starts with nothing. Plain words before the first star word have no effect. A
        star word's documents are intersected with what there is, or replace it if that is
        nothing after a plain word; nothing after a star word ends the query. A plain word's
        documents are intersected.
        """
        words = [w for w in parse.joker(query) if w.star or w.term]
        first = next((i for i, w in enumerate(words) if w.star), None)
        if not words or (first is None and combine == "fold"):
            return self._none()
        if combine == "fold":
            words = words[first:]
        # A word is matched against the term of each posting: that costs less than to join the postings with the vocabulary's matches.
        tests = [self._matches(w) for w in words]
        flags = [F.col(f"w{i}") for i in range(len(words))]
        has = self.index.postings.where(reduce(or_, tests)).groupBy("doc_id").agg(*(F.bool_or(t).alias(f"w{i}") for i, t in enumerate(tests)))
        if combine == "all":
            return self._named(has.where(reduce(and_, flags)))
        # Whatever the fold does, what is valid at word i are the documents of the words from some word s to i. One row
        # says of each such stretch whether it has any.
        stretch = lambda s, i: reduce(and_, flags[s : i + 1])
        some = has.agg(*(F.coalesce(F.bool_or(stretch(s, i)), F.lit(False)).alias(f"s{s}_{i}") for i in range(len(words)) for s in range(i + 1))).first() if len(words) > 1 else None
        start, nothing = 0, False
        for i, w in enumerate(words):
            if i and w.star and nothing:
                start = i
            if some is not None:
                nothing = not some[f"s{start}_{i}"]
                if w.star and nothing and i + 1 < len(words):
                    return self._none()
        return self._named(has.where(stretch(start, len(words) - 1)))

    @staticmethod
    def _matches(w: parse.Word) -> Column:
        if not w.star:
            return F.col("term") == w.term
        tests = [F.lit(True)]
        if w.prefix:
            tests.append(F.col("term").startswith(w.prefix))
        if w.suffix:
            tests.append(F.col("term").endswith(w.suffix))
        if w.middle:
            tests.append(F.col("term").contains(w.middle))
        return reduce(and_, tests)
