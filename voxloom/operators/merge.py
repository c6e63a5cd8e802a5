"""Merging two half scans: slice plan, geometry, block aggregation of mosaics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLIP_X, FLIP_Y, ROTATE_CCW, ROTATE_CW = 1, 2, 4, 8


@dataclass(frozen=True)
class Strip:
    """Which slices of a side are used: up to or from the boundary slice, every skip-th counted from it, and the order."""

    upto: bool
    descending: bool


#: (same direction, sign of FW, FW origin before RV's) -> order of the sides, and each side's strip.
#: The geometry: a side that ends at the boundary uses slices up to it if it grows towards it, else from it.
def case_of(scale_fw: float, scale_rv: float, first_fw: float | None, last_fw: float | None, first_rv: float | None) -> tuple[int, tuple[str, str], dict[str, Strip]]:
    half = first_fw is None or first_rv is None
    if scale_fw * scale_rv > 0:
        if not half and first_fw == first_rv:
            raise TypeError("both halves start at the same place")
        fw_first = half or first_fw < first_rv
        up = scale_fw > 0
        number = (1 if fw_first else 2) if up else (3 if fw_first else 4)
        # the first side leads to the boundary: it uses the slices before it, in index order if the index grows with z
        lead, trail = Strip(up, not up), Strip(not up, not up)
        sides = ("FW", "RV") if fw_first else ("RV", "FW")
        return number, sides, {sides[0]: lead, sides[1]: trail}
    if scale_fw * scale_rv < 0:
        if scale_fw < 0 and (half or last_fw < first_rv):
            return 5, ("FW", "RV"), {"FW": Strip(False, True), "RV": Strip(False, False)}
        if scale_fw > 0 and (half or last_fw > first_rv):
            return 6, ("RV", "FW"), {"RV": Strip(False, True), "FW": Strip(False, False)}
        if last_fw != first_rv:
            raise NotImplementedError("halves that grow towards each other from these sides")
    raise TypeError("no way to merge halves with these directions")


def plan_slices(slices: DataFrame, boundary: dict[str, int], skip: dict[str, int], sides: tuple[str, str], strips: dict[str, Strip], use: str, reverse: bool = False) -> DataFrame:
    """slices: side, index. Result: side, index, position in the merged volume.

    Each side keeps every skip-th slice counted from its boundary slice; of the two boundary slices only the one of
    the side `use` stays."""
    i, side = F.col("index"), F.col("side")
    keep, rank = F.lit(False), F.lit(0)
    for k, s in enumerate(sides):
        b, strip = boundary[s], strips[s]
        part = (i <= b) if strip.upto else (i >= b)
        one = (side == s) & part & (F.abs(i - b) % skip[s] == 0)
        if s != use:
            one = one & (i != b)
        keep = keep | one
        rank = F.when(side == s, F.lit(k * (1 << 40)) + (-i if strip.descending else i)).otherwise(rank)
    kept = slices.where(keep).withColumn("__r", rank)
    w = Window.orderBy(F.col("__r").desc() if reverse else F.col("__r"))  # over a scan's list of slices
    return kept.withColumn("position", (F.row_number().over(w) - 1).cast("int")).drop("__r")


def z_bounds(sides: tuple[str, str], z: dict[str, float], half: bool) -> dict[str, tuple[float, float]]:
    """Closed range of valid z for each side."""
    inf = float("inf")
    if half:
        return dict.fromkeys(sides, (-inf, inf))
    return {sides[0]: (-inf, z[sides[0]]), sides[1]: (z[sides[1]], inf)}


@dataclass(frozen=True)
class Downscale:
    sampled: tuple[int, int]
    actual: tuple[float, float]
    skip_z: int
    margins: tuple[float, float, float, float]  # left, top, right, bottom


def downscale(scale_xy: float, scale_z: float, unit: float, width: int, height: int, margins: tuple[int, int, int, int], flags: int = 0, post: int = 0) -> Downscale:
    """Sampled extents of a tile, the ratio that they really mean, and the margins after flips and rotations."""
    ratio, skip = abs(scale_xy) / unit, int(unit / abs(scale_z))
    left, top, right, bottom = margins
    strip = (width - left - right, height - top - bottom)
    if flags & (ROTATE_CCW | ROTATE_CW):
        strip = strip[::-1]
    sampled = (int(strip[0] * ratio), int(strip[1] * ratio))
    actual = (sampled[0] / strip[0], sampled[1] / strip[1])
    m = [left * actual[0], top * actual[1], right * actual[0], bottom * actual[1]]
    for step in (flags & FLIP_X, flags & FLIP_Y, flags & ROTATE_CCW, flags & ROTATE_CW, post & FLIP_X, post & FLIP_Y):
        if step == FLIP_X:
            m = [m[2], m[1], m[0], m[3]]
        elif step == FLIP_Y:
            m = [m[0], m[3], m[2], m[1]]
        elif step == ROTATE_CCW:
            m = [m[1], m[2], m[3], m[0]]
        elif step == ROTATE_CW:
            m = [m[3], m[0], m[1], m[2]]
    return Downscale(sampled, actual, skip, tuple(m))


def turned(x: Column, y: Column, width: int, height: int, flags: int) -> tuple[Column, Column]:
    """Where a pixel goes: rotation first, then flips of the rotated image."""
    if flags & ROTATE_CW:
        x, y, width, height = F.lit(height - 1) - y, x, height, width
    elif flags & ROTATE_CCW:
        x, y, width, height = y, F.lit(width - 1) - x, height, width
    if flags & FLIP_X:
        x = F.lit(width - 1) - x
    if flags & FLIP_Y:
        y = F.lit(height - 1) - y
    return x, y


def block_aggregate(df: DataFrame, value: str, left: int, top: int, kw: int, kh: int, cols: int, rows: int, keys: list[str]) -> DataFrame:
    """Mean (whole division), largest and smallest value of kw x kh blocks; what doesn't fill a block is left out."""
    bx, by = F.floor((F.col("x") - left) / kw).cast("int"), F.floor((F.col("y") - top) / kh).cast("int")
    d = df.withColumns({"bx": bx, "by": by}).where((F.col("x") >= left) & (F.col("y") >= top) & (F.col("bx") < cols) & (F.col("by") < rows))
    total = F.sum(F.col(value).cast("long"))
    return d.groupBy(*keys, "bx", "by").agg(F.expr(f"sum(cast({value} as bigint)) div count(*)").alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), total.alias("total"))


def place_tiles(blocks: DataFrame, cols: int, rows: int, tx: str = "tile_x", ty: str = "tile_y") -> DataFrame:
    """Block coordinates within the mosaic."""
    return blocks.withColumns({"mx": F.col(tx) * cols + F.col("bx"), "my": F.col(ty) * rows + F.col("by")})


def grid_overlay(df: DataFrame, value: str, bright: int = 5000) -> DataFrame:
    """Mark the first row and column of every tile."""
    return df.withColumn(value, F.when((F.col("bx") == 0) | (F.col("by") == 0), F.lit(bright)).otherwise(F.col(value)))


def mirror(df: DataFrame, width: int, height: int, flags: int) -> DataFrame:
    x, y = F.col("mx"), F.col("my")
    return df.withColumns({"mx": F.lit(width - 1) - x if flags & FLIP_X else x, "my": F.lit(height - 1) - y if flags & FLIP_Y else y})


def region_image(df: DataFrame, zlim: tuple[int, int], ylim: tuple[int, int], xlim: tuple[int, int], width: int, height: int, flip_x: bool = False, flip_y: bool = False) -> DataFrame:
    """Voxels of half-open ranges, counted from their starts; flips of the whole slices come before the cut."""
    flipped = {"x": F.lit(width - 1) - F.col("x") if flip_x else F.col("x"), "y": F.lit(height - 1) - F.col("y") if flip_y else F.col("y")}
    df = df.where((F.col("z") >= zlim[0]) & (F.col("z") < zlim[1])).withColumns(flipped)
    for c, (lo, hi) in (("y", ylim), ("x", xlim)):
        df = df.where((F.col(c) >= lo) & (F.col(c) < hi))
    return df.withColumns({c: F.col(c) - lo for c, (lo, _) in (("z", zlim), ("y", ylim), ("x", xlim))})


def stack_planes(planes: DataFrame, plan: DataFrame, on: list[str]) -> DataFrame:
    """Merged planes as one volume: each plane's rows get the position that the plan gives its slice."""
    return planes.join(plan.select(*on, "position"), on).withColumnRenamed("position", "mz")


def every_slice(slices: DataFrame, name: str, skip: int) -> DataFrame:
    """Every skip-th of the slice names that any tile has, with its position."""
    w = Window.orderBy(name)  # over a scan's list of slice names
    numbered = slices.select(name).distinct().withColumn("__i", F.row_number().over(w) - 1)
    return numbered.where(F.col("__i") % skip == 0).withColumn("position", F.expr(f"cast(__i div {skip} as int)")).drop("__i")
