"""From raw documents to token ids: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and is
written as Parquet before the next one reads it. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import decontam, jaccard, langid, spans, spm
from lexispark.llm.queries import held_out, read
from lexispark.llm.shards import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; `und` goes."""
    model = langid.train(docs.where(~held_out(4, 2)), Scratch(spark))
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group, once. Rows without an id stay."""
    return jaccard.keep_first(docs, Scratch(spark))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated spans; a document that had sentences and has none left goes."""
    had, lost = map(F.col, spans.added(docs))
    out = spans.remove(docs, spans.repeats(docs, Scratch(spark))).where((lost == 0) | (lost < had))
    n_chars = [F.when(lost > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return out.select(*(n_chars[0] if c == "n_chars" else F.col(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"), Scratch(spark))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return spm.encode(docs, Scratch(spark))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language ID and SentencePiece can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
