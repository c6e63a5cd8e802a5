"""Aggregates of labelled voxels: one hash aggregation for all features of all regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import blobness, structureness, with_eigenvalues

HESSIAN = ("xx", "xy", "xz", "yy", "yz", "zz")


def region_features(df: DataFrame, label: str, keys: tuple[str, ...] = (), value: str = "norm", intensity: str | None = None) -> DataFrame:
    """Size, centroid, largest, smallest, summed and mean value, and sums of the Hessian planes that df has."""
    aggs = {
        "n_voxels": F.count(F.lit(1)),
        "cz": F.avg("z"),
        "cy": F.avg("y"),
        "cx": F.avg("x"),
        "max_norm": F.max(value),
        "min_norm": F.min(value),
        "sum_norm": F.sum(value),
        "mean_norm": F.avg(value),
    }
    if intensity:
        aggs["max_intensity"] = F.max(intensity)
    aggs |= {f"sum_{h}": F.sum(h) for h in HESSIAN if h in df.columns}
    out = df.groupBy(*keys, label).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.withColumn("size", (F.col("n_voxels") % 65536).cast("int"))  # sizes are stored in 16 bits


def shape_features(df: DataFrame) -> DataFrame:
    """Structureness and blobness from the summed Hessian."""
    df = with_eigenvalues(df, tuple(f"sum_{h}" for h in HESSIAN))
    return df.withColumns({"structureness": structureness(*map(F.col, ("e0", "e1", "e2"))), "blobness": blobness(*map(F.col, ("e0", "e1", "e2")))})


def masked_mean(df: DataFrame, value: str, mask: str, keys: list[str]) -> DataFrame:
    """Mean response over the mask, for choosing a scale."""
    m = F.col(mask).cast("double")
    return df.groupBy(*keys).agg((F.sum(F.col(value) * m) / F.when(F.sum(m) > 0, F.sum(m))).alias("response"))
