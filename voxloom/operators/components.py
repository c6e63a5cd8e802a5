"""Connected components of foreground voxels (26 neighbours); a label is the smallest linear voxel number.

Slabs of slices are labelled on their own with numpy; only the voxels of a slab's first and last slice meet their
neighbour slab, and what remains is a graph of slab labels, merged by smallest labels and pointer jumping.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import kernels

if TYPE_CHECKING:
    import pandas as pd


def smallest_reached(edges: DataFrame, name: str = "graph") -> DataFrame:
    """edges: a, b (long). Result: node, label (smallest node that it reaches), for every node with an edge.

    Each round joins edges with labels, takes the smallest neighbouring label and then the label of that label, which
    halves the distances; every round is written to the shared folder. The joins with the edges and with the labels'
    labels are plain ones of two tables, so that a hub of many edges is split among tasks."""
    e = edges.where("a <> b").select("a", "b")
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = materialize(e.select(ways).select("e.a", "e.b").distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = materialize(labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next")), f"{name}-next")
        up = lower.select(F.col("node").alias("at"), F.col("next").alias("further"))
        new = materialize(lower.join(up, lower["next"] == up["at"]).select("node", F.col("label").alias("old"), F.col("further").alias("label")), f"{name}-labels")
        labels = new.drop("old")
        if not new.where("old <> label").limit(1).count():
            return labels


def label_components(foreground: DataFrame, height: int, width: int, slab: int = 8, wrap: bool = False) -> DataFrame:
    """foreground: z, y, x (long) of one volume. Result: z, y, x, label."""
    fg = foreground.select("z", "y", "x", (F.col("z") * (height * width) + F.col("y") * width + F.col("x")).alias("lin"), F.floor(F.col("z") / slab).cast("long").alias("slab"))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lin")
        return pdf.assign(label=kernels.label_block(pdf["lin"].to_numpy(), height, width, wrap))

    part = materialize(fg.groupBy("slab").applyInPandas(own, "z long, y long, x long, lin long, slab long, label long"), "slab-labels")
    # a step between neighbours reaches the next slice, with wrap from a slice's end also the one after it
    reach = 2 if wrap else 1
    if slab < 2 * reach:
        raise ValueError("a slab must hold the slices that meet both its neighbours")
    seam = F.when(F.col("z") % slab >= slab - reach, F.floor(F.col("z") / slab) + 1).when(F.col("z") % slab < reach, F.floor(F.col("z") / slab))
    seams = part.select("lin", "label", seam.cast("long").alias("seam")).where("seam is not null")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lin")
        a, b = kernels.touching(pdf["lin"].to_numpy(), height, width, wrap)
        label = pdf["label"].to_numpy()
        pairs = np.unique(np.column_stack([label[a], label[b]]), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
        import pandas as pd

        return pd.DataFrame(pairs[pairs[:, 0] != pairs[:, 1]], columns=["a", "b"])

    joined = smallest_reached(seams.groupBy("seam").applyInPandas(meet, "a long, b long"))
    out = part.join(joined.withColumnRenamed("label", "final"), F.col("label") == F.col("node"), "left")
    return out.select("z", "y", "x", F.coalesce("final", "label").alias("label"))


