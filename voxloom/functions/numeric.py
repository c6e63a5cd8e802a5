"""Column expressions with the arithmetic of IEEE floats where Spark's differs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand-in for an infinite logarithm: the largest double.
HUGE = 1.7976931348623157e308
#: Matrices with no larger element count as zero, and no larger sum of squares off the diagonal as diagonal.
TINY = 1e-30


def log10_total(x: Column) -> Column:
    """log10 with 0 for NaN, null and negative values, and -HUGE / HUGE for 0 and infinity."""
    return (
        F.when(x.isNull() | F.isnan(x) | (x < 0), F.lit(0.0)).when(x == 0, F.lit(-HUGE)).when(x == F.lit(math.inf), F.lit(HUGE)).otherwise(F.log10(x))
    )


def clip(x: Column, low, high) -> Column:  # noqa: ANN001
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b with NaN for 0 / 0 and signed infinity for other divisions by zero."""
    return F.when(b != 0, a / b).when(a == 0, F.lit(math.nan)).when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))


def with_eigenvalues(df: DataFrame, planes: tuple[str, ...], out: tuple[str, str, str] = ("e0", "e1", "e2")) -> DataFrame:
    """Add the ascending eigenvalues of a symmetric 3 x 3 matrix (columns xx, xy, xz, yy, yz, zz) in closed form.

    The trigonometric solution of the cubic, in steps of columns so that no expression is repeated. A matrix without
    off-diagonal parts gives its diagonal as it stands, a zero matrix three zeros."""
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in planes)
    q, p, off, half, high, low = (F.col(f"__{c}") for c in ("q", "p", "off", "half", "high", "low"))
    df = df.withColumns({"__q": (xx + yy + zz) / 3.0, "__off": xy * xy + xz * xz + yz * yz})
    df = df.withColumn("__p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * off) / 6.0))
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    df = df.withColumn("__half", F.when(p > 0, clip(det / (2.0 * F.when(p > 0, p * p * p)), -1.0, 1.0)).otherwise(0.0))
    df = df.withColumns({"__high": q + 2.0 * p * F.cos(F.acos(half) / 3.0), "__low": q + 2.0 * p * F.cos(F.acos(half) / 3.0 + 2.0 * math.pi / 3.0)})
    plain, zero = off <= TINY, F.greatest(*[F.abs(c) for c in (xx, xy, xz, yy, yz, zz)]) < TINY
    values = (F.when(zero, 0.0).when(plain, a).otherwise(b) for a, b in ((xx, low), (yy, 3.0 * q - high - low), (zz, high)))
    return df.withColumns(dict(zip(out, values, strict=True))).drop("__q", "__off", "__p", "__half", "__high", "__low")


def structureness(e0: Column, e1: Column, e2: Column) -> Column:
    return e0 * e0 + e1 * e1 + e2 * e2


def blobness(e0: Column, e1: Column, e2: Column) -> Column:
    """0 for a zero matrix."""
    return F.when((e0 == 0) & (e1 == 0) & (e2 == 0), F.lit(0.0)).otherwise(ratio(e2 * e2, e0 * e1))
