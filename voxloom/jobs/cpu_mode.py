"""Detection in the other mode, which differs from the first one in what its filters do at borders and in its labels.

The contrast divides the whole value by the spread; the box sees zeros beyond the border; derivatives at a border are
steps to the one neighbour there is; regions are numbered 1 to n in the order of their first voxels; sizes don't wrap
at 16 bits, and no region is dropped. Blocks with halos and labels joined over faces, as in the first mode.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import kernels as K
from ..operators import regions as R
from ..operators.partition import numbered
from ..sources.shared import materialize
from .detect import PART, _parts


def features(blocks: DataFrame, grid: B.Grid, radii: tuple[int, int, int], least: float, small: tuple[float, float], large: tuple[float, float], gamma: float = 1.0) -> DataFrame:
    """Keys, index (from 0, dense in each stack), intensity, size, blobness, structureness and centroid of each region."""
    halo = tuple(2 * r for r in radii)[::-1]
    contrast = B.filtered(blocks, grid, halo, lambda v: K.share(v[0].astype(float), radii, least)[None])
    whole = B.Grid(grid.height, grid.width, grid.block, grid.keys)
    reach = (int(2.0 * large[1] + 0.5) + 2, *[int(2.0 * large[0] + 0.5) + 2] * 2)

    def parts(v: np.ndarray, place: B.Place) -> dict:
        h = K.hessian_one_sided(K.difference_of_gaussians(v[0], small, large, gamma))
        p = _parts(place.inner(v[0]), tuple(map(place.inner, h)), place.inner(K.negative_definite(h)), place, grid)
        return {k: [np.ascontiguousarray(a).tobytes()] for k, a in p.items()}

    fields = ", ".join(f"{c} binary" for c in ("lin", "label", "part", *PART))
    found = materialize(B.with_halo(contrast, whole, reach, parts, fields), "cpu-parts")
    rows = B.unpacked(found, grid.keys, {"part": np.int64, **dict.fromkeys(PART, np.float64)}).withColumnRenamed("part", "label")
    f = B.relabelled(rows, B.joined_labels(found, grid), grid).groupBy(*grid.keys, "label").agg(*[(F.max if c == "max_norm" else F.sum)(c).alias(c) for c in PART])
    f = R.shape_features(f).withColumns({"size": F.col("n_voxels"), "intensity": F.col("max_norm"), **{f"centroid_{a}": F.col(f"sum_{a}") / F.col("n_voxels") for a in "xyz"}})
    # numbers follow the first voxels, which are the labels
    return numbered(f.select(*grid.keys, "label", "intensity", "size", "blobness", "structureness", "centroid_x", "centroid_y", "centroid_z"), ["label"], list(grid.keys), "index").drop("label")
