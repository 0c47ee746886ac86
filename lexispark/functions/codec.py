"""Gap coding of ascending numbers and variable-byte codes, as columns.

A code has seven bits a byte, most significant group first; the top bit is set on the last
byte. Numbers are 0 to 2**31 - 1; negative ones have no code (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaps(values: Column) -> Column:
    """Differences of an ascending array, the first against 0."""
    return F.transform(values, lambda p, i: p - F.when(i == 0, F.lit(0)).otherwise(F.get(values, i - 1)))


def ungap(values: Column) -> Column:
    """Inverse of gaps: running sums."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).cast("long").alias("sum"), F.concat(acc["out"], F.array((acc["sum"] + x).cast("long"))).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def vlc_size(n: Column) -> Column:
    """Bytes of the code."""
    return F.when(n < 0, None).when(n < 128, 1).when(n < 16384, 2).when(n < 2097152, 3).when(n < 268435456, 4).otherwise(5)


def vlc_hex(n: Column) -> Column:
    """The code's bytes in hexadecimal."""
    n = n.cast("long")
    byte = lambda k: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127) + (128 if k == 0 else 0)), 2, "0")
    size = vlc_size(n)
    return F.when(n < 0, None).otherwise(F.concat(*(F.when(size > k, byte(k)).otherwise(F.lit("")) for k in (4, 3, 2, 1, 0))))


def vlc_decode(code: Column) -> Column:
    """The number of a code in hexadecimal."""
    digits = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(code) > 0, F.aggregate(digits, F.lit(0).cast("long"), lambda acc, b: acc * 128 + b.bitwiseAND(127)))
