"""The given tables read as images, cells and points, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 64, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense volume: z, y, x, v, inten (16-bit like) and a region label for each row of voxels."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("z"), F.expr("vec_id % 50").alias("y"), "label", F.posexplode_outer("embedding").alias("x", "v"))
    e = e.select("z", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"), "label")
    return e.withColumn("inten", F.floor((F.col("v") + 0.6) * 10000).cast("int"))


def slice_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z of every slice."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("z")).distinct()


def n_slices(spark: SparkSession, sf_dir: str) -> int:
    return (table(spark, sf_dir, "embeddings").agg(F.max(F.expr("vec_id div 50"))).first()[0] or 0) + 1


N_SLICES = "(SELECT max(z) + 1 FROM vox)"

VOX = """vox AS (SELECT vec_id // 50 AS z, vec_id % 50 AS y, CAST(u.i - 1 AS BIGINT) AS x, CAST(embedding[u.i] AS DOUBLE) AS v, label,
  CAST(floor((CAST(embedding[u.i] AS DOUBLE) + 0.6) * 10000) AS INTEGER) AS inten FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cell records of two half scans with a 4 x 3 grid of stacks each."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linestatus") == "F", "FW").otherwise("RV").alias("side"),
        (F.col("l_suppkey") % 4).cast("int").alias("ix"),
        (F.col("l_partkey") % 3).cast("int").alias("iy"),
        ((F.col("l_orderkey") * 37) % 2560).cast("double").alias("lx"),
        ((F.col("l_orderkey") * 53 + F.col("l_partkey") * 7) % 2160).cast("double").alias("ly"),
        (F.col("l_quantity") * 2 - 1).cast("double").alias("lz"),
        F.col("l_extendedprice").alias("structureness"),
        (F.col("l_tax") + 0.01).alias("blobness"),
        F.col("l_discount").alias("intensity"),
        F.col("l_quantity").cast("int").alias("size"),
    )


CELLS = """cells AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'FW' ELSE 'RV' END AS side,
  CAST(l_suppkey % 4 AS INTEGER) AS ix, CAST(l_partkey % 3 AS INTEGER) AS iy, CAST((l_orderkey * 37) % 2560 AS DOUBLE) AS lx,
  CAST((l_orderkey * 53 + l_partkey * 7) % 2160 AS DOUBLE) AS ly, CAST(l_quantity * 2 - 1 AS DOUBLE) AS lz, l_extendedprice AS structureness,
  l_tax + 0.01 AS blobness, l_discount AS intensity, CAST(l_quantity AS INTEGER) AS size FROM lineitem)"""

#: Total order of cells; rows that agree in all of it are interchangeable.
CELL_ORDER = ["l_orderkey", "l_linenumber", "structureness", "lx", "ly", "lz", "ix", "iy", "size", "blobness", "intensity"]


def atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("point_id"), ((p * 97) % 1000).cast("double").alias("x"), ((p * 61) % 1000).cast("double").alias("y"), (F.col("p_size") * 20).cast("double").alias("z"), F.col("p_size").alias("atlas_id"))


ATLAS = "atlas AS (SELECT p_partkey AS point_id, CAST((p_partkey * 97) % 1000 AS DOUBLE) AS x, CAST((p_partkey * 61) % 1000 AS DOUBLE) AS y, CAST(p_size * 20 AS DOUBLE) AS z, p_size AS atlas_id FROM part)"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points in the atlas' space."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("cell_id"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 53) % 1000).cast("double").alias("y"), ((k * 11) % 1000).cast("double").alias("z"))


PROBES = "probes AS (SELECT o_orderkey AS cell_id, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS x, CAST((o_orderkey * 53) % 1000 AS DOUBLE) AS y, CAST((o_orderkey * 11) % 1000 AS DOUBLE) AS z FROM orders)"
