"""The positional inverted index: four tables, built by one pass over the documents.

A document's tokens are grouped by term within its row; the one exchange of postings is by range of term and block of
documents (gaps.Blocks: a frequent term has several), and leaves them sorted by term and document: a lookup of terms skips what
it can't be in, kept or stored, and neither storing nor gaps need a further exchange. Postings and vocab are made when first used.

docs (doc_id, path, name); tokens (doc_id, pos, term), not stored; postings (term, doc_id, tf,
positions), one row for each term of a document, so no row grows beyond a document;
vocab (term, rev_term, df, cf), each term once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stem import normalize
from ..sources.library import ranked, read_library, spread
from .gaps import Blocks


class IndexNotBuiltError(RuntimeError):
    """There is no index yet."""


class CacheError(OSError):
    """A stored index is missing or damaged."""


def tokenize(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term)."""
    return docs.select("doc_id", F.posexplode(text.terms()).alias("pos", "term"))


def make_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions), without an exchange unless ids are repeated: rows of one id count as one document."""
    docs = docs.select("doc_id", "text")
    repeated = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    if repeated.isEmpty():
        return _by_row(docs)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    tokens = tokenize(docs.join(repeated, same, "left_semi"))
    merged = tokens.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return _by_row(docs.join(repeated, same, "left_anti")).unionByName(merged.select("term", "doc_id", F.size("positions").alias("tf"), "positions"))


def _by_row(docs: DataFrame) -> DataFrame:
    """The postings of each row: its terms are sorted together with their positions, and cut where another term begins."""
    terms = docs.select("doc_id", text.terms().alias("t"))
    both = terms.select("doc_id", F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("pos")))).alias("s"))
    # Only single members of s are looked at: s.term would be a new array for each of them, as Spark moves it to where it is used.
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"]))
    cut = both.select("doc_id", "s", F.when(F.size("s") > 0, starts).alias("starts"))
    # From an inner explode Spark infers a filter on starts, and moves that, with all of the above, below it a second time.
    cut = cut.select("doc_id", "s", "starts", F.posexplode_outer("starts").alias("k", "at")).where("at is not null")
    tf = F.coalesce(F.get("starts", F.col("k") + 1), F.size("s")) - F.col("at")
    return cut.select(F.get("s", F.col("at"))["term"].alias("term"), "doc_id", tf.alias("tf"), F.slice("s", F.col("at") + 1, tf)["pos"].alias("positions"))


#: Bytes of input for each part of the postings, so that a task's share doesn't grow with the input.
PART_BYTES = 8 << 20


def parts(docs: DataFrame) -> int:
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = (leaves.apply(i) for i in range(leaves.size()))
    return max(n, sum(int(str(x.stats().sizeInBytes())) for x in found if x.getClass().getSimpleName() == "LogicalRelation") // PART_BYTES)


def sorted_by_term(docs: DataFrame) -> DataFrame:
    """The postings with the column _block. Finding the ranges makes them once more than dealing them out, which costs less than keeping them."""
    blocks = Blocks.of(docs, tokenize)
    return blocks.add(make_postings(docs)).repartitionByRange(parts(docs), "term", "_block").sortWithinPartitions("term", "_block", "doc_id")


def terms_of_segment(docs: DataFrame) -> int:
    """A fifth of the mean bytes of the first, middle and last document by id."""
    sized = ranked(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")), "doc_id", "rank")
    n = sized.count()
    rows = {r["rank"]: r.bytes for r in sized.where(F.col("rank").isin(0, n // 2, n - 1)).collect()}
    return (rows[0] + rows[n - 1] + rows[n // 2]) // 3 // 5 if rows else 0


def segments(ranks: DataFrame, size: int) -> DataFrame:
    """(segment, term): a segment is closed by the term that brings its count beyond size; the first has one term more."""
    return ranks.select(F.floor(F.greatest(F.col("rank") - 1, F.lit(0)) / (size + 1)).alias("segment"), "term")


def make_vocab(postings: DataFrame) -> DataFrame:
    """(term, rev_term, df, cf)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf")).select("term", F.reverse("term").alias("rev_term"), "df", "cf")


class Index:
    """docs, postings and vocab, with the lookups on them. Lookups take terms as they stand; normalize() makes them."""

    def __init__(self, docs: DataFrame, postings: DataFrame | None = None, vocab: DataFrame | None = None, vocab_by_rev: DataFrame | None = None):
        """With tables as given, or else those of docs with a text."""
        self._texts, self.docs = docs, docs.select("doc_id", "path", "name")
        if postings is not None:
            self.postings, self.vocab = postings, vocab
            self.vocab_by_rev = vocab if vocab_by_rev is None else vocab_by_rev

    @classmethod
    def build(cls, docs: DataFrame) -> Index:
        """From (doc_id, path, name, text). Postings and vocab are made when first used and kept, on disk where memory is short, until release()."""
        return cls(docs)

    @cached_property
    def blocked(self) -> DataFrame:
        """The postings with their _block."""
        kept = sorted_by_term(spread(self._texts)).persist()
        kept.count()
        return kept

    @cached_property
    def postings(self) -> DataFrame:
        return self.blocked.select("term", "doc_id", "tf", "positions")

    @cached_property
    def vocab(self) -> DataFrame:
        """From the postings if there are any, else from the texts, which takes no sorting by term."""
        return make_vocab(self.postings if "blocked" in self.__dict__ else make_postings(spread(self._texts))).persist()

    @cached_property
    def vocab_by_rev(self) -> DataFrame:
        return self.vocab

    def release(self) -> None:
        """Gives up what was kept; it is made anew when it is used again."""
        for name in ("blocked", "vocab"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @classmethod
    def build_library(cls, spark: SparkSession, root: str) -> Index:
        """From the files of a folder."""
        return cls.build(read_library(spark, root))

    def save(self, path: str) -> None:
        """Stores the index, postings and both vocabularies sorted so that lookups skip row groups."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.vocab.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocab")
        self.vocab.repartitionByRange("rev_term").sortWithinPartitions("rev_term").write.mode("overwrite").parquet(f"{path}/vocab_by_rev")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        try:
            return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("docs", "postings", "vocab", "vocab_by_rev")))
        except AnalysisException as e:
            raise CacheError(f"no index can be loaded from {path}") from e

    @staticmethod
    def present(spark: SparkSession, path: str) -> bool:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return all(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS")) for x in ("docs", "postings", "vocab", "vocab_by_rev"))

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    # Lookups

    normalize = staticmethod(normalize)

    def contains(self, term: str) -> bool:
        return bool(self.vocab.where(F.col("term") == term).limit(1).count())

    def get_postings(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id")

    def get_term_data(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term).select("doc_id", "tf", "positions")

    def starts_with(self, prefix: str) -> DataFrame:
        return self.vocab.where(F.col("term").startswith(prefix)).select("term").orderBy("term")

    def ends_with(self, suffix: str) -> DataFrame:
        """A prefix search on the reversed terms, which a sorted file can prune."""
        return self.vocab_by_rev.where(F.col("rev_term").startswith(suffix[::-1])).orderBy("rev_term").select("term")

    def ranks(self) -> DataFrame:
        """(term, rank), numbers from 0 in the order of the terms."""
        return ranked(self.vocab.select("term"), "term", "rank")

    def term_rank(self, term: str) -> int:
        """Rank of a term, -1 if absent."""
        return self.vocab.where(F.col("term") < term).count() if self.contains(term) else -1

    def terms(self) -> DataFrame:
        return self.vocab.select("term").orderBy("term")

    def doc_name(self, doc_id: int) -> str | None:
        row = self.docs.where(F.col("doc_id") == doc_id).select("name").first()
        return row and row.name

    def doc_path(self, doc_id: int) -> str | None:
        row = self.docs.where(F.col("doc_id") == doc_id).select("path").first()
        return row and row.path
