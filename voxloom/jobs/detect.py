"""Candidate detection: substacks of all stacks through the filter chain, as tables of blocks.

Substacks overlap along z by what the filters reach, and each candidate is kept by the one that its centre lies in. Along
y and x a substack is cut into blocks: local contrast and second derivatives come from blocks with halos, regions are
labelled and added up in each block, and labels that meet over faces are joined, so a region counts whole however many
blocks it reaches over. A task holds some ten arrays of a block with its halo, whatever the size of a slice or radius.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import kernels as K
from ..operators import regions as R
from ..operators.cells import candidate
from ..operators.partition import substacks
from ..sources import datasource
from ..sources.shared import materialize

if TYPE_CHECKING:
    import pandas as pd


@dataclass(frozen=True)
class Settings:
    depth: int = 32
    extra_margin: int = 3
    radii: tuple[int, int, int] = (3, 3, 1)
    box: tuple[int, int, int] = (3, 3, 1)
    least: float = 5000
    small: tuple[float, float] = (1.5, 0.8)
    large: tuple[float, float] = (2.2, 1.2)
    gamma: float = 1.0
    edges: tuple[int, int, int, int] = (2, 2, 2, 2)
    min_size: int = 4
    mean_intensity: bool = False

    @property
    def margin(self) -> int:
        return int(2.0 * self.large[1] + 0.5) + self.extra_margin

    @property
    def reach(self) -> int:
        """What the blur and two gradients reach along x and y."""
        return int(2.0 * self.large[0] + 0.5) + 2

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """From a parameter file. Optional keys have defaults, any other missing one is an error."""
        j = json.loads(text)
        image, p = j["input_image_info"], j["HDoG_param"]
        r, g = p["radius_norm"], p["sigma_dog"]
        wide = (r["xy_large"], r["xy_large"], r["z_large"])
        return cls(
            depth=p["depth"], extra_margin=p["extra_depth_margin"], radii=wide, box=wide, least=p["min_intensity"], small=(g["xy_small"], g["z_small"]), large=(g["xy_large"], g["z_large"]), gamma=p["gamma_n"],
            edges=(image["left_margin"], image["top_margin"], image["right_margin"], image["bottom_margin"]), min_size=p["min_size"], mean_intensity=j.get("is_ave_mode", False),
        )


#: Columns of a region's part: their sums, the largest value for max_norm.
PART = ("n_voxels", "sum_z", "sum_y", "sum_x", "max_norm", "sum_norm", *[f"sum_{h}" for h in R.HESSIAN])


def _parts(norm: np.ndarray, h: tuple[np.ndarray, ...], mask: np.ndarray, place: B.Place, grid: B.Grid) -> dict[str, np.ndarray]:
    """Voxels of a block's foreground with their part's label, and sums over each part."""
    lin, label = B.local_labels(mask, place, grid)
    own, which = np.unique(label, return_inverse=True)
    at = np.flatnonzero(mask.ravel())
    z, y, x = np.unravel_index(at, mask.shape)
    value = norm.ravel()[at]
    total = lambda v: np.bincount(which, weights=v, minlength=len(own))
    most = np.full(len(own), -np.inf)
    np.maximum.at(most, which, value)
    sums = [total(c + o) for c, (o, _) in zip((z, y, x), place.own, strict=True)]
    columns = [total(np.ones(len(at))), *sums, most, total(value), *[total(a.ravel()[at]) for a in h]]
    return {"lin": lin, "label": label, "part": own} | dict(zip(PART, columns, strict=True))


def block_features(v: np.ndarray, s: Settings) -> pd.DataFrame:
    """Aggregates of all regions of a dense block, the counterpart of the blocks' way on one array."""
    import pandas as pd

    grid = B.Grid(v.shape[1], v.shape[2], v.shape)
    norm = K.normalize(v, s.radii, s.box, s.least)
    h = K.hessian(K.difference_of_gaussians(norm, s.small, s.large, s.gamma))
    box = grid.box((0, 0, 0), len(v))
    p = _parts(norm, h, K.negative_definite(h), B.Place(box, box, len(v)), grid)
    df = pd.DataFrame({c: p[c] for c in PART})
    return df.assign(label=p["part"], **{f"c{a}": df[f"sum_{a}"] / df["n_voxels"] for a in "zyx"})


def detect_blocks(substack_blocks: DataFrame, grid: B.Grid, s: Settings) -> DataFrame:
    """Candidates of substacks (keys ..., z0, length; each as deep as the settings say) given as blocks of raw values,
    or as the pieces for the halo of local contrast."""
    contrast = B.Grid(grid.height, grid.width, grid.block, grid.keys)
    halo = (0, s.reach, s.reach)
    blocks = B.normalize(substack_blocks, grid, s.radii, s.box, s.least, (contrast, halo))

    def parts(v: np.ndarray, place: B.Place) -> dict:
        h = K.hessian(K.difference_of_gaussians(v[0], s.small, s.large, s.gamma))
        p = _parts(place.inner(v[0]), tuple(map(place.inner, h)), place.inner(K.negative_definite(h)), place, grid)
        return {k: [np.ascontiguousarray(a).tobytes()] for k, a in p.items()}

    fields = ", ".join(f"{c} binary" for c in ("lin", "label", "part", *PART))
    found = materialize(B.with_halo(blocks, contrast, halo, parts, fields), "detected-parts")
    rows = B.unpacked(found, grid.keys, {"part": np.int64, **dict.fromkeys(PART, np.float64)}).withColumnRenamed("part", "label")
    whole = B.relabelled(rows, B.joined_labels(found, grid), grid).groupBy(*grid.keys, "label")
    f = whole.agg(*[(F.max if c == "max_norm" else F.sum)(c).alias(c) for c in PART])
    f = f.withColumns({f"c{a}": F.col(f"sum_{a}") / F.col("n_voxels") for a in "zyx"})
    f = R.shape_features(f.withColumn("size", (F.col("n_voxels").cast("long") % 65536).cast("int")))
    f = f.withColumn("intensity", F.col("sum_norm") / F.col("n_voxels") if s.mean_intensity else F.col("max_norm"))
    left, top, right, bottom = s.edges
    f = candidate(f, "cz", "cy", "cx", depth=F.least(F.lit(s.depth), F.col("length") - F.col("z0")), margin=s.margin, left=left, top=top, right=right, bottom=bottom, width=grid.width, height=grid.height, min_size=s.min_size)
    stack = [k for k in grid.keys if k not in ("z0", "length")]
    return f.select(*stack, (F.col("cz") + F.col("z0")).alias("z"), F.col("cy").alias("y"), F.col("cx").alias("x"), "structureness", "blobness", "intensity", "size")


def _substacks(rows: DataFrame, s: Settings, stack: tuple[str, ...]) -> DataFrame:
    """Rows of slices or parts of them (column z), repeated for each substack that covers them, with z counted in it."""
    rows = B.with_depth(rows, stack, F.col("z")).withColumnRenamed("depth", "length")
    rows = substacks(rows, "z", F.col("length"), s.depth, s.margin)
    return rows.withColumns({"z": F.col("z") - F.col("z0"), "depth": F.lit(s.depth).cast("long")})


def _grid(height: int, width: int, s: Settings, stack: tuple[str, ...], tile: int, dtype: str = "<f8") -> B.Grid:
    return B.Grid(height, width, (s.depth, tile, tile), (*stack, "z0", "length"), dtype)


def detect(voxels: DataFrame, value: str, height: int, width: int, s: Settings = Settings(), stack: tuple[str, ...] = (), tile: int = 256) -> DataFrame:  # noqa: B008
    """Candidates of every stack (columns `stack`) given as voxel rows: coordinates in the stack, shape features, intensity, size."""
    rows = _substacks(voxels.select(*stack, F.col("z").cast("long").alias("z"), "y", "x", F.col(value).alias("value")), s, stack)
    grid = _grid(height, width, s, stack, tile)
    return detect_blocks(B.from_voxels(rows, "value", grid), grid, s)


def detect_lines(lines: DataFrame, values: str, height: int, width: int, s: Settings = Settings(), stack: tuple[str, ...] = (), tile: int = 256) -> DataFrame:  # noqa: B008
    """The same of rows that hold a line's values along x as an array."""
    rows = _substacks(lines.select(*stack, F.col("z").cast("long").alias("z"), "y", F.col(values).alias("values")), s, stack)
    grid = _grid(height, width, s, stack, tile)
    return detect_blocks(B.from_lines(rows, "values", grid, B.first_halo(grid, s.radii, s.box)), grid, s)


def detect_files(spark: SparkSession, path: str, height: int, width: int, s: Settings = Settings(), tile: int = 256, stored: str = "<u2") -> DataFrame:  # noqa: B008
    """The same of a folder of raw slices; slices count in the order of their names. No voxel is ever a row.

    stored: the files' 16-bit numbers, "<i2" where they have a sign."""
    stack = ("side", "yname", "xname")
    rows = _substacks(datasource.read_slices(spark, path, width), s, stack)
    grid = _grid(height, width, s, stack, tile, stored)
    return detect_blocks(B.from_slices(rows, grid, stored), grid, s)
