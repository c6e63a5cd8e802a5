"""Scores of predicted points against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nearest
from .windows import gaussian_weights


def with_nearest(points: DataFrame, key: str, others: DataFrame, other: str, bound: float) -> DataFrame:
    """Add near_id and near_d (null beyond the bound, which is inclusive)."""
    return nearest.with_nearest(points, key, others, other, bound, inclusive=True).withColumn("near_d", F.sqrt("near_d2")).drop("near_d2")


def truth_from_markers(predicted: DataFrame, key: str, false_pos: DataFrame, false_neg: DataFrame, bound: float) -> DataFrame:
    """Predictions without those nearest to a false-positive marker, at any distance, and the false-negative markers.

    bound: where the search for neighbours begins."""
    wrong = nearest.nearest_any(false_pos, key, predicted, key, bound).select(F.col("near_id").alias(key)).distinct()
    right = predicted.join(wrong, key, "left_anti")
    return right.select("x", "y", "z").withColumn("kind", F.lit("TP")).unionByName(false_neg.select("x", "y", "z").withColumn("kind", F.lit("FN")))


def rates(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Precision, recall and F; null where there is nothing to divide by."""
    t, p, n = (F.col(c).cast("double") for c in (tp, fp, fn))
    df = df.withColumns({"prec": F.try_divide(t, t + p), "rec": F.try_divide(t, t + n)})
    return df.withColumn("f_score", F.try_divide(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")))


def matched_score(predicted: DataFrame, truth: DataFrame, d: float) -> DataFrame:
    """Both sides: id, x, y, z, inside (in the margin). A hit is a point inside whose nearest other is within d; the
    smaller of the two numbers of hits counts as true positives."""
    a = with_nearest(truth, "id", predicted, "id", d).where("inside").agg(F.count("*").alias("m"), F.count("near_d").alias("tm"))
    b = with_nearest(predicted, "id", truth, "id", d).where("inside").agg(F.count("*").alias("n"), F.count("near_d").alias("tn"))
    one = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")  # two single rows
    one = one.withColumn("tp", F.least("tm", "tn"))
    return rates(one.withColumns({"fp": F.col("n") - F.col("tp"), "fn": F.col("m") - F.col("tp")}))


def hit_kinds(predicted: DataFrame, key: str, truth: DataFrame, other: str, d: float) -> DataFrame:
    """FP, TP or DC: double count, several predictions with the same nearest truth."""
    p = with_nearest(predicted, key, truth, other, d)
    shared = p.where("near_id is not null").groupBy("near_id").agg(F.count("*").alias("__n"))
    p = p.join(shared, "near_id", "left")
    return p.withColumn("kind", F.when(F.col("near_id").isNull(), "FP").when(F.col("__n") > 1, "DC").otherwise("TP")).drop("__n")


def sweep(distances: DataFrame, d: str, thresholds: list[float]) -> DataFrame:
    """Rows with a distance within each threshold, from one aggregation."""
    counts = distances.agg(*[F.count_if(F.col(d) <= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("n")) for i, t in enumerate(thresholds)])
    return counts.select(F.inline(each))


def splat(df: DataFrame, size: dict[str, int], weight: int = 5000, by: list[str] | None = None) -> DataFrame:
    """Weighted counts in unit bins; the far end of each axis belongs to its last bin."""
    bins = {f"b{a}": F.when(F.col(a) == n, n - 1).otherwise(F.floor(a)).cast("int") for a, n in size.items()}
    inside = F.lit(True)
    for a, n in size.items():
        inside = inside & F.col(a).between(0, n)
    return df.where(inside).groupBy(*(by or []), *[c.alias(n) for n, c in bins.items()]).agg((F.count("*") * weight).alias("v"))


def extents(df: DataFrame, axes: str = "zyx") -> dict[str, int]:
    """Unit bins along each axis that hold all coordinates, by one aggregation; 1 where there are none."""
    most = df.agg(*[F.floor(F.max(a)).cast("long").alias(a) for a in axes]).first()
    return {a: max(0, most[a] or 0) + 1 for a in axes}


def _spread(axis: str, n: int, weights: list[float]) -> Column:
    """Places within 0 to n - 1 that a voxel's value reaches along an axis, with weights.

    A place p takes from p + j, mirrored at the borders (the end value first) as often as needed."""
    r, at = len(weights) // 2, F.col(axis)
    turns = range(-(r // (2 * n)) - 1, r // (2 * n) + 2)
    each = [F.struct((q + (2 * n * m - j)).alias("to"), F.lit(w).alias("w")) for j, w in zip(range(-r, r + 1), weights, strict=True) for m in turns for q in (at, -at - 1)]
    return F.filter(F.array(*each), lambda e: e["to"].between(0, n - 1))


def sparse_blur(df: DataFrame, c: str, size: dict[str, int], sigma: dict[str, float], keys: tuple[str, ...] = (), truncate: float = 2.0) -> DataFrame:
    """Gaussian blur of whole numbers on a volume of which only the voxels that aren't 0 have rows (keys, axes, c).

    Each voxel is spread over the kernel's reach along one axis and summed by voxel; each pass is cut to a whole number,
    borders are mirrored. The grid is never built."""
    axes = list(sigma)
    out = df.select(*keys, *[F.col(a).cast("long").alias(a) for a in axes], F.col(c).cast("double").alias(c))
    for a in axes:
        rest = [*keys, *[b for b in axes if b != a]]
        spread = out.select(*rest, c, F.inline(_spread(a, size[a], gaussian_weights(sigma[a], truncate))))
        out = spread.groupBy(*rest, F.col("to").alias(a)).agg(F.floor(F.round(F.sum(F.col(c) * F.col("w")), 6)).cast("double").alias(c)).where(F.col(c) > 0)
    return out.select(*keys, *axes, c)
