"""Dealing stacks to workers and cutting stacks into overlapping substacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def round_robin(stacks: DataFrame, size: str, keys: list[str], workers: int) -> DataFrame:
    """Stacks by falling size (one row each), dealt in turn."""
    w = Window.orderBy(F.col(size).desc(), *keys)
    return stacks.withColumn("worker", ((F.row_number().over(w) - 1) % workers).cast("int"))


def serpentine(stacks: DataFrame, size: str, keys: list[str], workers: int) -> DataFrame:
    """Stacks by falling size, dealt to and fro, which evens out the sums."""
    i = F.row_number().over(Window.orderBy(F.col(size).desc(), *keys)) - 1
    forth = F.floor(i / workers) % 2 == 0
    return stacks.withColumn("job", F.when(forth, i % workers).otherwise(F.pmod(-i - 1, F.lit(workers))).cast("int"))


def substacks(df: DataFrame, z: str, length: Column, depth: int, margin: int) -> DataFrame:
    """Repeat each slice for every substack that covers it (column z0).

    Substacks start every depth - 2 * margin slices while below length - margin; the starts that cover a slice follow
    from its number, so no join is needed."""
    step = depth - 2 * margin
    if step <= 0:
        raise ValueError("depth must exceed twice the margin")
    zz = F.col(z).cast("long")
    last = F.floor((length - margin - 1) / step)
    low = F.greatest(F.lit(0), F.ceil((zz - depth + 1) / step)).cast("long")
    high = F.least(F.floor(zz / step), last).cast("long")
    starts = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("z0", F.explode(starts))


def kept_range(z: Column, z0: Column, length: Column, depth: int, margin: int) -> Column:
    """Slices of a substack that no other substack keeps."""
    actual = F.least(F.lit(depth), length - z0)
    return (z - z0 >= margin) & (z - z0 < actual - margin)


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "rn") -> DataFrame:
    """Number the rows of each group from 0 in an order; rows that agree in all of it may change places.

    The table is sorted by ranges of (group, order), and a row's number is its place in its range plus what the group has
    in the ranges before, from counts of (group, range): a group of any size is sorted by many tasks. Nulls come first."""
    by, names = by or [], df.columns
    # a number for each row as last key, so that equal rows can fall into several ranges
    inner = materialize(df.toDF(*[f"__{i}" for i in range(len(names))]).withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    place = {c: f"__{i}" for i, c in enumerate(names)}
    groups, keys = [place[c] for c in by], [*[place[c] for c in by], *[place[c] for c in order], "__row"]
    put = materialize(inner.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered-ranges")
    put = put.withColumn("__part", F.shiftright("__at", 33))
    # a row for each range that a group touches; groups are compared by their fields as text-free structs, nulls included
    group = F.struct(*groups, F.lit(0).alias("__all"))
    blocks = put.groupBy(group.alias("__g"), "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    until = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("__g"), F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(until), F.lit(0)).alias("__before"))
    got = put.join(blocks, group.eqNullSafe(blocks["__g"]) & (put["__part"] == blocks["__p"]))
    return got.select(*[F.col(place[c]).alias(c) for c in names], (F.col("__before") + F.col("__at") - F.col("__first")).alias(out))


def every_nth(df: DataFrame, n: int, order: list[str], by: list[str]) -> DataFrame:
    """Systematic sample: rows 0, n, 2n, ... of each group in a total order."""
    return numbered(df, order, by, "__rn").where(F.col("__rn") % n == 0).drop("__rn")


def facets(df: DataFrame, order: list[str], by: list[str], least: int = 10_000, step: int = 1_000) -> DataFrame:
    """Every step-th row of the groups that hold at least so many."""
    n = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return every_nth(df.join(n, by), step, order, by)
