"""Point transforms: affine maps and displacement fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affine(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Rows of a 3 x 4 matrix applied to (x, y, z, 1)."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points.withColumns({c: x * r[0] + y * r[1] + z * r[2] + F.lit(r[3]) for c, r in zip("xyz", matrix, strict=True)})


def displaced(points: DataFrame, key: str, grid: DataFrame) -> DataFrame:
    """Add to each point the displacement (dz, dy, dx) interpolated between the eight grid nodes around it.

    Nodes outside the grid count as no displacement. Each point becomes eight weighted rows, joined with the grid by
    equality and summed again."""
    base = {a: F.floor(a).cast("long") for a in "zyx"}
    corners = F.array(*[F.struct(*[(base[a] + o).alias(f"g{a}") for a, o in zip("zyx", k, strict=True)]) for k in [(i, j, l) for i in (0, 1) for j in (0, 1) for l in (0, 1)]])
    c = points.select(key, "z", "y", "x", F.explode(corners).alias("c")).select(key, "z", "y", "x", "c.*")
    w = F.lit(1.0)
    for a in "zyx":
        w = w * (1 - F.abs(F.col(a) - F.col(f"g{a}")))
    g = grid.select(*[F.col(a).alias(f"g{a}") for a in "zyx"], "dz", "dy", "dx")
    s = c.withColumn("w", w).join(g, ["gz", "gy", "gx"]).groupBy(key).agg(*[F.sum(F.col("w") * F.col(f"d{a}")).alias(f"d{a}") for a in "zyx"])
    out = points.join(s, key, "left")
    return out.withColumns({a: F.col(a) + F.coalesce(F.col(f"d{a}"), F.lit(0.0)) for a in "zyx"}).drop("dz", "dy", "dx")
