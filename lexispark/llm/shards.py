"""Dealing packed arrays to shards, and tables in the folder that all executors share.

Operators that compare hashes across the corpus send one row per task and shard, whose
binary columns hold numpy arrays. This keeps a shuffled entry at the bytes of its values,
and lets a shard be worked on as arrays. The number of shards follows the bytes of the input, so
a shard's size doesn't grow with it; where there are more shards than partitions, Spark sorts
a partition's rows by shard (spilling as needed) and the worker holds one shard at a time.
Nothing depends on which executor does the work, so a lost task is simply run again.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of input files that a shard stands for at most.
SHARD_BYTES = 64 << 20
#: Partitions of a shuffle at most, unless Spark's own setting is higher; beyond, a partition has several shards.
MAX_PARTITIONS = 20_000


def input_bytes(df: DataFrame) -> int:
    """Size of the files that df reads, from the plan; tables in memory count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(x.stats().sizeInBytes())) for x in found if x.getClass().getSimpleName() == "LogicalRelation")


def n_partitions(spark: SparkSession, n: int) -> int:
    return min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTITIONS))


def n_shards(docs: DataFrame, each: int = SHARD_BYTES) -> int:
    """As many as Spark's shuffle partitions, or more if the input is large."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // each))


def deal(df: DataFrame, n: int, work: Callable, schema: str) -> DataFrame:
    """Gives the rows of each of the n shards, together, to work, a function from batches to batches."""
    parts = n_partitions(df.sparkSession, n)
    if parts == n:
        return df.repartitionById(n, F.col("shard")).mapInArrow(work, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in by_shard(batches):
            yield from work(own)

    return df.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard").mapInArrow(run, schema)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The batches of each shard, of batches that are sorted by it. Each must be used up before the next."""
    rest: list[pa.RecordBatch] = []

    def pull() -> bool:
        while not rest:
            b = next(batches, None)
            if b is None:
                return False
            if b.num_rows:
                rest.append(b)
        return True

    def own(shard: int) -> Iterator[pa.RecordBatch]:
        while pull() and rest[0].column("shard")[0].as_py() == shard:
            b = rest.pop()
            k = int(np.searchsorted(b.column("shard").to_numpy(), shard, side="right"))
            if k < b.num_rows:
                rest.append(b.slice(k))
            yield b.slice(0, k)

    batches = iter(batches)
    while pull():
        group = own(rest[0].column("shard")[0].as_py())
        yield group
        for _ in group:
            pass


def planes(x: np.ndarray, width: int) -> bytes:
    """All first bytes, all second bytes and so on, `width` of them: small or sorted numbers then compress well in a shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T[:width]).tobytes()


def from_planes(data, dtype: np.dtype, width: int) -> np.ndarray:
    sent = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((sent.shape[1], dtype.itemsize), np.uint8)
    out[:, :width] = sent.T
    return out.view(dtype).ravel()


def _types(dtypes: list[str]) -> list[tuple[np.dtype, int]]:
    """"<u8:5" is a number of which the low five bytes are sent."""
    found = [x.partition(":") for x in dtypes]
    return [(np.dtype(d), int(w or np.dtype(d).itemsize)) for d, _, w in found]


def by_range(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards that each hold a range of the 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Packer:
    """Gathers parallel arrays and gives them out as rows (shard, one binary per array).

    The arrays of a row are sorted by the first one. fold, if given, merges equal keys of
    what was gathered before it is given out. squeeze sends differences
    of the first array, which is sorted, and compresses by entropy, which Spark's own compression
    of a shuffle doesn't; unpack must be told, too.
    """

    def __init__(self, n: int, dtypes: list[str], limit: int = 1_000_000, fold: Callable | None = None, shard_of: Callable | None = None, squeeze: bool = False):
        self.n, self.limit, self.fold = n, limit, fold
        self.squeeze = squeeze
        self.pack = zstandard.ZstdCompressor(level=1).compress if squeeze else bytes
        self.dtypes, self.widths = zip(*_types(dtypes), strict=True)
        self.shard_of = shard_of or (lambda arrays: (arrays[0] >> np.uint64(33)) % np.uint64(n))
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    @staticmethod
    def schema(k: int) -> str:
        return "shard int, " + ", ".join(f"a{i} binary" for i in range(k))

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(arrays[0]):
            self.parts.append([np.asarray(x).astype(d, copy=False) for x, d in zip(arrays, self.dtypes, strict=True)])
            self.size += len(arrays[0])
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        arrays = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        if self.fold:
            arrays = [x.astype(d, copy=False) for x, d in zip(self.fold(*arrays), self.dtypes, strict=True)]
        shard = self.shard_of(arrays).astype(np.int64)
        for x, w in zip(arrays, self.widths, strict=True):
            if w < x.itemsize:
                x &= x.dtype.type((1 << (8 * w)) - 1)
        if self.n <= 1 << 16 and (arrays[0][1:] >= arrays[0][:-1]).all():  # sorted already, as from a fold: by shard alone, of 16 bits, is a radix sort
            order = np.argsort(shard.astype(np.uint16), kind="stable")
        else:
            order = np.lexsort((arrays[0], shard))
        arrays, shard = [x[order] for x in arrays], shard[order]
        cuts = np.searchsorted(shard, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(cuts))
        cols = [pa.array(full.astype(np.int32))]
        for k, (x, w) in enumerate(zip(arrays, self.widths, strict=True)):
            steps = (lambda a: np.diff(a, prepend=a.dtype.type(0))) if self.squeeze and not k else (lambda a: a)
            cols.append(pa.array([self.pack(planes(steps(x[cuts[i] : cuts[i + 1]]), w)) for i in full], pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, names=["shard", *(f"a{i}" for i in range(len(arrays)))])


def unpack(batches: Iterator[pa.RecordBatch], dtypes: list[str], squeeze: bool = False) -> list[np.ndarray]:
    """All arrays of a partition, joined."""
    plain = zstandard.ZstdDecompressor().decompress if squeeze else lambda x: x
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for b in batches:
        for i, (d, w) in enumerate(_types(dtypes)):
            col = b.column(f"a{i}")
            found = [from_planes(plain(x.as_buffer()), d, w) for x in col if x.is_valid]
            parts[i] += [np.cumsum(x, dtype=d) for x in found] if squeeze and not i else found
    return [np.concatenate(p) if p else np.zeros(0, d) for p, (d, _) in zip(parts, _types(dtypes), strict=True)]


def table(rows: dict[str, np.ndarray | pa.Array], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows."""
    cols = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in rows.items()}
    n = len(next(iter(cols.values())))
    for at in range(0, n, size):
        yield pa.RecordBatch.from_arrays([c.slice(at, size) for c in cols.values()], names=list(cols))


class Scratch:
    """Tables and files of one call in the folder that spark.checkpoint.dir names.

    Where that is unset and all runs on one machine, as in tests, a temporary folder is set; on a
    cluster that is an error. Tables stay until drop(), since a lazy result may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/lexispark-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table, which cuts the lineage, and reads it again."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def folder(self, name: str) -> str:
        """Path of a folder that workers open as files; the shared folder must be mounted on them."""
        url = urlparse(self.root)
        if url.scheme not in ("", "file"):
            raise ValueError(f"{name} needs a shared folder that workers can open as files; spark.checkpoint.dir is {self.root}")
        path = f"{url.path}/{name}"
        os.makedirs(path, exist_ok=True)
        return path


def put_file(path: str, write: Callable) -> None:
    """Writes a file whole or not at all: a second attempt of the task, even at the same time, does no harm."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        write(f)
    os.replace(part, path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or it with underscores in front, such that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bytes up to which a table may be sent to every executor, and what a row counts as besides its strings and arrays.
SMALL_BYTES, ROW_BYTES = 48 << 20, 64


def if_small(df: DataFrame, more: Column | None = None) -> DataFrame:
    """Marks a table as one to send to every executor if it is small enough; else Spark shuffles both sides.

    Rows and the bytes of strings, binaries and arrays (8 an element; more, if given, is what else a row has) are counted
    first, so df must be cheap to read, such as a written table.
    """
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else 8 * F.coalesce(F.size(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    row = F.lit(ROW_BYTES)
    for w in [*wide, *([] if more is None else [more])]:
        row = row + w
    n = df.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if n <= SMALL_BYTES else df
