"""Atlas points from CSV, markers from XML, flags of classified cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of markers; fixed values of the format.
MARKERS = {"2": "FP", "3": "FN"}
_MARKER_TYPE = "Type string, Marker array<struct<MarkerX: int, MarkerY: int, MarkerZ: int>>"


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z and atlas_id; the first line of each file is a header."""
    return spark.read.schema("x float, y float, z float, atlas_id int").option("header", "true").option("enforceSchema", "true").csv(path)


def read_markers(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """kind (FP or FN), x, y, z of the markers of XML files; z counts slices of all channels."""
    types = spark.read.format("xml").option("rowTag", "Marker_Type").schema(_MARKER_TYPE).load(path)
    m = types.where(F.trim("Type").isin(*MARKERS)).select(F.when(F.trim("Type") == "2", "FP").otherwise("FN").alias("kind"), F.explode("Marker").alias("m"))
    return m.select("kind", F.col("m.MarkerX").alias("x"), F.col("m.MarkerY").alias("y"), F.floor(F.col("m.MarkerZ") / channels).cast("int").alias("z"))


def write_flags(cells: DataFrame, positive: Column, path: str, stack: list[str]) -> None:
    """Every cell with is_positive, one folder a stack."""
    cells.withColumn("is_positive", positive).write.partitionBy(*stack).option("compression", "zstd").parquet(path)


def read_flags(spark: SparkSession, path: str, positive_only: bool = False) -> DataFrame:
    """Flagged cells; with positive_only the others don't leave the scan."""
    df = spark.read.parquet(path)
    return df.where("is_positive") if positive_only else df
