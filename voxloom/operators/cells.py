"""Filters and coordinate algebra on cell records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


@dataclass(frozen=True)
class Axis:
    """One axis of a half scan: position of the stacks, step of a local unit, extent of an image."""

    scale: float
    size: int = 0


def stack_origin(matrix: list[list[float]], xname: Column, yname: Column, z0: Column) -> list[Column]:
    """Rows of a 4 x 4 affine map applied to (x name, y name, first z, 1)."""
    if matrix[2][0] or matrix[2][1]:
        raise ValueError("the stack's z must not depend on its place in the grid")
    return [xname * r[0] + yname * r[1] + z0 * r[2] + F.lit(float(r[3])) for r in matrix[:3]]


def to_global(offset: Column, local: Column, axis: Axis) -> Column:
    """Local to scan coordinates; a mirrored axis is counted from its other end."""
    g = offset + local * axis.scale
    return g - axis.size * axis.scale if axis.scale < 0 and axis.size else g


def candidate(df: DataFrame, z: str, y: str, x: str, *, depth: Column, margin: int, left: int, top: int, right: int, bottom: int, width: int, height: int, min_size: int, min_intensity: float = 0.0) -> DataFrame:
    """Candidates in the kept range of their substack and image, large and bright enough.

    NaN intensity stays (as every comparison with it would in IEEE arithmetic); NaN coordinates stay as well."""
    nan = lambda c: F.isnan(F.col(c).cast("double"))
    zz, yy, xx = F.col(z), F.col(y), F.col(x)
    return df.where(
        (nan(z) | (zz >= margin) & (zz < depth - margin))
        & (nan(x) | (xx >= left) & (xx < width - right))
        & (nan(y) | (yy >= top) & (yy < height - bottom))
        & (F.col("size") >= min_size)
        & (nan("intensity") | (F.col("intensity") > min_intensity))
    )


def valid_between(z: Column, low: float, high: float) -> Column:
    """Closed interval, whichever end is given first."""
    a, b = min(low, high), max(low, high)
    return (z >= a) & (z <= b)


def scale_and_flip(v: tuple[Column, Column, Column], offset: tuple[float, ...], step: tuple[float, ...], margin: tuple[float, float], swap_xy: bool, flips: tuple[bool, bool, bool], extent: tuple[float, ...]) -> tuple[Column, ...]:
    """Scan coordinates to the merged, scaled and flipped volume."""
    s = [(c - o) * k for c, o, k in zip(v, offset, step, strict=True)]
    s[0], s[1] = s[0] - margin[0], s[1] - margin[1]
    if swap_xy:
        s[0], s[1] = s[1], s[0]
    return tuple(F.lit(float(e)) - c if f else c for c, f, e in zip(s, flips, extent, strict=True))


def in_substack(z: Column, z0: int, z1: int) -> Column:
    return (z >= z0) & (z < z1)


def region_of_interest(df: DataFrame, ranges: dict[str, tuple[float, float]], flips: dict[str, int] | None = None) -> DataFrame:
    """Closed ranges on each axis; coordinates then start at the range's low end, or count back from its size if flipped."""
    for c, (lo, hi) in ranges.items():
        df = df.where(F.col(c).between(lo, hi))
    return df.withColumns({c: (F.lit(flips[c]) - (F.col(c) - lo)) if flips and c in flips else F.col(c) - lo for c, (lo, _) in ranges.items()})


def inside_margin(x: Column, y: Column, z: Column, w: int, h: int, d: int) -> Column:
    return (x >= 10) & (x < w - 10) & (y >= 10) & (y < h - 10) & (z > 5) & (z < d - 5)


def lookup(df: DataFrame, keys: DataFrame, on: str, missing: str = "flag") -> DataFrame:
    """Each row with the columns of its key. A key that isn't there is flagged (column `found`), or an error."""
    out = df.join(keys.withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if missing == "flag":
        return out
    told = F.raise_error(F.concat(F.lit(f"no such {on}: "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return out.withColumn("found", F.when(F.col("found"), F.col("found")).otherwise(told.cast("boolean")))


def slice_global_z(slices: DataFrame, by: list[str], z: str, offset: Column, scale: float, out: str = "global_z", completed: bool = False) -> DataFrame:
    """Global z of each slice of a stack, from the numbers in the slices' names.

    Numbers count from the stack's first slice in steps of its first gap; in a completed grid they count as they are."""
    w = Window.partitionBy(*by).orderBy(z)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.lit(1) if completed else F.coalesce(F.nth_value(z, 2).over(whole) - F.first(z).over(whole), F.lit(1))
    return slices.withColumn(out, offset + (F.col(z) - F.first(z).over(whole)) / gap * scale)


#: Points up to which an as-of join broadcasts them, if no bucket holds more than so many.
SMALL_POINTS, IN_BUCKET = 100_000, 64


def greatest_at_most(df: DataFrame, at: str, points: DataFrame, point: str, keep: list[str]) -> DataFrame:
    """As-of join: each row gets the columns of the greatest `point` not beyond `at`; rows before all points and null ones go.

    Of points at one place the one counts whose kept columns sort last, whatever the sizes and the order of the rows;
    points that are null or not a number are none; a row that is not a number comes after all points."""
    real = F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double"))
    p = materialize(points.where(real).groupBy(F.col(point).alias("__at")).agg(F.max(F.struct(*keep)).alias("__kept")), "as-of-points")
    lo, hi, n = p.agg(F.min("__at"), F.max("__at"), F.count("*")).first()
    rows = df.where(F.col(at).isNotNull())
    if not n:
        return df.where("false").withColumns({c: F.lit(None).cast(points.schema[c].dataType) for c in keep})
    spread = _in_lists(rows, at, p, lo, hi, n) if n <= SMALL_POINTS else None
    return (spread if spread is not None else _in_ranges(rows, at, p)).select(*df.columns, "__got.*")


def _in_lists(rows: DataFrame, at: str, p: DataFrame, lo: float, hi: float, n: int) -> DataFrame | None:
    """Few points go to the rows, in lists of equal width, if they are spread evenly enough; the rows stay where they are."""
    buckets = max(1, min(n, 10_000))
    width = max((float(hi) - float(lo)) / buckets, 1e-300) if hi > lo else 1.0

    def cell(c: str) -> Column:
        v = F.col(c).cast("double")
        v = F.when(F.isnan(v), F.lit(float(buckets))).otherwise(F.least(F.greatest((v - float(lo)) / width, F.lit(-1.0)), F.lit(float(buckets))))
        return F.floor(v).cast("int")

    lists = materialize(p.groupBy(cell("__at").alias("__b")).agg(F.sort_array(F.collect_list(F.struct("__at", "__kept"))).alias("__list")), "as-of-lists")
    if (lists.agg(F.max(F.size("__list"))).first()[0] or 0) > IN_BUCKET:
        return None
    grid = rows.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("__b")).join(lists, "__b", "left")
    # the last point of the buckets before (at most 10,001 rows)
    last = F.try_element_at("__list", F.lit(-1))["__kept"]
    before = F.last(last, ignorenulls=True).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    own = F.try_element_at(F.filter("__list", lambda e: e["__at"] <= F.col(at)), F.lit(-1))["__kept"]
    got = rows.withColumn("__b", cell(at)).join(F.broadcast(grid.withColumn("__before", before)), "__b")
    return got.withColumn("__got", F.coalesce(own, "__before")).where("__got is not null")


def _in_ranges(rows: DataFrame, at: str, p: DataFrame) -> DataFrame:
    """Rows and points in one order, cut at quantiles of both, so that no range is crowded: within a range the last point
    is carried forward, and each range begins with the last point of the ranges before."""
    row, kept = F.struct(*rows.columns), p.schema["__kept"].dataType
    kind = p.schema["__at"].dataType
    a = rows.select(F.col(at).cast(kind).alias("__at"), F.lit(1).alias("__kind"), F.monotonically_increasing_id().alias("__id"), row.alias("__row"), F.lit(None).cast(kept).alias("__kept"))
    b = p.select("__at", F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__id"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__kept")
    keys = ["__at", "__kind", "__id"]
    put = materialize(a.unionByName(b), "as-of-rows").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__seq", F.monotonically_increasing_id())
    put = materialize(put, "as-of-ranges").withColumn("__part", F.shiftright("__seq", 33))
    last = put.groupBy("__part").agg(F.max_by("__kept", F.when(F.col("__kind") == 0, F.col("__seq"))).alias("__last"))
    until = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = last.select(F.col("__part"), F.last("__last", ignorenulls=True).over(until).alias("__before"))
    carried = F.last("__kept", ignorenulls=True).over(Window.partitionBy("__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0))
    out = put.withColumn("__own", carried).where("__kind = 1").join(F.broadcast(before), "__part")
    return out.select("__row.*", F.coalesce("__own", "__before").alias("__got")).where("__got is not null")
