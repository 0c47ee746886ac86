"""Where documents come from: a folder of text files, or a table."""

from __future__ import annotations

import os
import re
import tempfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine a temporary one if it is unset, on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="index-")


def spread(docs: DataFrame) -> DataFrame:
    """Documents in parts enough for all cores; texts are dealt out anew only where their files give fewer."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = min(n, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    return docs if docs.rdd.getNumPartitions() >= enough else docs.repartition(n)


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with a number from 0 in the order of a unique column, without sorting in one task.

    Rows are dealt by range and numbered within their part; the parts' sizes, one number each,
    give where a part starts.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist()
    sizes = {r._part: r.n for r in part.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    start, rows = 0, []
    for i in sorted(sizes):
        rows.append((i, start))
        start += sizes[i]
    starts = F.broadcast(spark.createDataFrame(rows, "_part int, _start long"))
    return part.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def read_library(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, name, text) of every file below a folder; ids follow the order of the paths."""
    if not root or not root.strip():
        raise ValueError("the path of the library is empty")
    url = urlparse(root)
    if url.scheme in ("", "file") and not os.path.exists(url.path):
        raise FileNotFoundError(root)
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return ranked(files, "path", "doc_id").select("doc_id", "path", F.element_at(F.split("path", "/"), -1).alias("name"), "text")


def from_table(table: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = None) -> DataFrame:
    """The same of a table, whose ids are kept; without a column of paths the path is `doc` and the id. The name is the path's last part."""
    path = F.col(path_column) if path_column else F.concat(F.lit("doc"), F.col(id_column).cast("string"))
    named = table.select(F.col(id_column).cast("long").alias("doc_id"), path.alias("path"), F.col(text_column).alias("text"))
    return named.select("doc_id", "path", F.element_at(F.split("path", "/"), -1).alias("name"), "text")
