"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u) / w from a hash of its id and its quality weight w (the share of letters
in its text). Within a source, the documents in order of their keys fill the source's word budget: whole epochs first
(every document once each), then the documents with the smallest keys up to the rest of the budget. A document is
taken whole, so a source ends within half a document of its target.

No source is sorted in one task: keys fall into `COARSE` x `FINE` cells per source, cell sums locate the one cell in
which the budget ends, and only that cell is ordered. What is broadcast is one row for each source.

Defined results: null text counts 0 words and is taken 0 words; null is a source of its own, last in order; repeated
rows and equal ids share a key and go together; texts of any length are counted whole; empty tables give no rows; other
columns pass through, except those named as the four that `mix` adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, private, table, words

COARSE, FINE = 256, 4096
#: A mixture names a weight for each source, so the list of sources is small; more than this many are refused.
MAX_SOURCES = 100_000
MAX_EPOCHS = 3
LEAST_WEIGHT = 0.1
OWN = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between LEAST_WEIGHT and 1: the share of letters, the plainest sign of prose."""
    n = F.length(text)
    letters = n - F.length(F.regexp_replace(text, "\\p{L}+", ""))
    return F.when(n > 0, F.round(F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) * letters / n, 3)).otherwise(F.lit(LEAST_WEIGHT))


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a hash of the id."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def water_fill(sizes: list[int], weights: list[float], most: int = MAX_EPOCHS) -> list[float]:
    """Shares of sum(sizes) by weight; none above `most` times its size, the excess goes to the others by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while open_:
        share = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * share >= most * sizes[i]}
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else weights[i] * share
        rest -= sum(out[i] for i in full)
        open_ -= full or open_
    return out


def _cell(key: Column) -> Column:
    """Monotone in the key, in [0, 1): the distribution function of a key of the least weight.

    So keys of any weight in [LEAST_WEIGHT, 1] fall nowhere denser than 1 / LEAST_WEIGHT times the mean."""
    return F.least(F.lit(1.0) - F.exp(-key * LEAST_WEIGHT), F.lit(1.0 - 2.0**-40))


def plan(docs: DataFrame, seed: int = 7) -> DataFrame:
    """One row for each source: target, whole epochs, and the last (key, id) that the rest of the budget takes.

    docs: source, doc_id, size, key. Reads docs three times, so pass a table rather than a long plan.
    """
    spark = docs.sparkSession
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per = sorted(((r["source"], int(r["source_size"])) for r in per), key=lambda x: (x[0] is None, x[0] or ""))
    targets = water_fill([s for _, s in per], [1.0 + i % 3 for i in range(len(per))])
    rows = []
    for (source, s), target in zip(per, targets, strict=True):
        epochs = min(MAX_EPOCHS, int(target // s)) if s else 0
        rows.append((source, s, target, epochs, target - epochs * s))
    goal = spark.createDataFrame(rows, "source string, source_size long, target double, epochs int, budget double")
    cell = _cell(F.col("key"))
    d = docs.withColumns({"coarse": F.floor(cell * COARSE).cast("int"), "fine": F.floor(cell * COARSE * FINE).cast("long")})

    def boundary(level: DataFrame, by: str) -> DataFrame:
        """Of each source the first cell whose sum passes the budget, and what is left of the budget before it."""
        w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = level.groupBy("source", by).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"))
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        return sums.where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("n") > F.col("budget"))).select("source", F.col(by).alias("at"), (F.col("budget") - F.col("before")).alias("budget"))

    def within(by: str, edge: DataFrame, of: DataFrame) -> DataFrame:
        e = F.broadcast(edge.withColumnRenamed("source", "s_"))
        return of.drop("budget").join(e, of["source"].eqNullSafe(F.col("s_")) & (F.col(by) == F.col("at"))).drop("s_", "at")

    first = within_sources(d, goal.select("source", "budget"))
    edge1 = boundary(first, "coarse")
    second = within("coarse", edge1, d)
    edge2 = boundary(second, "fine")
    third = within("fine", edge2, d)
    order = Window.partitionBy("source").orderBy("key", "doc_id")
    third = third.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size"), F.first("budget").alias("budget"))
    third = third.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nearest = F.col("before") + F.col("size") / 2.0 <= F.col("budget")  # stop where the total is nearest to the budget
    last = third.groupBy("source").agg(F.max(F.when(nearest, F.struct("key", "doc_id"))).alias("last"), F.min(F.struct("key", "doc_id")).alias("head"))
    return goal.alias("g").join(last.withColumnRenamed("source", "s_"), F.col("g.source").eqNullSafe(F.col("s_")), "left").drop("s_")


def within_sources(d: DataFrame, goal: DataFrame) -> DataFrame:
    g = F.broadcast(goal.withColumnRenamed("source", "s_"))
    return d.join(g, d["source"].eqNullSafe(F.col("s_"))).drop("s_")


def keyed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size (0 without words) and the sampling key, with the columns that `private` has named."""
    own = [c for c in docs.columns if c.startswith("__")]
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("text"))
    return docs.select(*own, "doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Add size, source_size, target and taken (words, repeats counted) to every document; other columns pass."""
    small = materialize(keyed(docs.select("doc_id", "source", "text"), seed), "mix-keys")
    inner, names = private(docs.drop(*OWN))
    inner = inner.withColumns({c: F.col(names[c]) for c in ("doc_id", "source", "text")})
    out = taken_of(keyed(inner, seed), seed, small)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *OWN)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    small = materialize(keyed(docs), "mix-keys")
    return taken_of(small).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def taken_of(d: DataFrame, seed: int = 7, sized: DataFrame | None = None) -> DataFrame:
    """d: rows with source, doc_id, size and key; sized: a table of these columns to plan on, d itself if not given."""
    goal = F.broadcast(plan(sized if sized is not None else d, seed).withColumnRenamed("source", "s_"))
    d = d.join(goal, d["source"].eqNullSafe(F.col("s_")))
    at = F.struct(F.col("key"), F.col("doc_id"))
    extra = F.when(F.col("head").isNull(), F.lit(0)).when(at < F.col("head"), F.lit(1)).when(F.col("last").isNotNull() & (at <= F.col("last")), F.lit(1)).otherwise(0)
    return d.withColumn("taken", F.col("size") * (F.col("epochs") + extra)).drop("s_", "epochs", "budget", "last", "head", "key")


_SQL = r"""
WITH a AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, source, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
  CASE WHEN length(text) > 0 THEN round(0.1 + CAST(0.9 AS DOUBLE) * (length(text) - length(regexp_replace(text, '\pL+', '', 'g'))) / length(text), 3) ELSE 0.1 END AS w,
  (CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4503599627370496.0 AS u FROM a),
k AS (SELECT doc_id, source, size, -ln(u) / w AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM k GROUP BY source),
o AS (SELECT *, sum(n) OVER () AS total, coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
c AS (SELECT *, w * (total - before) / rest >= 3 * n AS capped FROM o),
t AS (SELECT source, n, CASE WHEN capped THEN 3.0 * n ELSE w * (total - coalesce(sum(3 * n) FILTER (WHERE capped) OVER (), 0)) / sum(w) FILTER (WHERE NOT capped) OVER () END AS target FROM c),
g AS (SELECT source, n, CAST(target AS DOUBLE) AS target, CASE WHEN n > 0 THEN least(3, floor(target / n)) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, g.n, g.target, g.epochs, g.target - g.epochs * g.n AS budget,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, round(target, 6) AS target, CAST(size * (epochs + CASE WHEN before + size / 2.0 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLE = {"op2_mixing": _SQL}
