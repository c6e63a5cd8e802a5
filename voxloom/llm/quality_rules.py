"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every document's words and word pairs fall into `BUCKETS` hash buckets. Two smoothed multinomials are counted over the
buckets: one over all documents, one over trusted documents (labels with quality 1 and toxic 0, a sample of at most
`TRUSTED_DOCS` of them, chosen by hash). A document's score is the mean, over its n-grams, of the log of the ratio of
the two; the base rules and a fixed threshold on the score decide. Only Spark's own functions run.

Defined results: null and empty texts have no words, score 0 and fail the base rules (fewer than ten words); without
trusted documents every score is 0, and the base rules alone decide; repeated rows and ties are judged alike; an empty
table gives no rows; texts of any length are judged whole; columns of the input other than the operator's own pass
through. The threshold was set on labelled documents of sf0.1: 99.8 % of the trusted ones score as much or more (mean
0.018), of those with quality 0 and toxic 0, 23 %.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blanks, table, words

BUCKETS = 1 << 14
#: Bound of the sample of trusted documents: 8 bytes an id, so at most 160 kB are broadcast.
TRUSTED_DOCS = 20_000
#: Mean log ratio under which a document is rejected.
THRESHOLD = -0.1
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _after(a: Column, k: int) -> Column:
    """The array without its first k items."""
    return F.slice(a, k + 1, F.greatest(F.size(a) - F.lit(k), F.lit(0)))


def _pairs(w: str) -> Column:
    """Hash of each word and its successor; the last item has no successor."""
    return F.zip_with(w, _after(F.col(w), 1), lambda a, b: F.xxhash64(a, b))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def base_measures(df: DataFrame, text: str) -> DataFrame:
    """Add __w (words), __p (hashes of word pairs) and the base columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", words(F.col(text)))
    df = df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.replace(blanks(t), F.lit(" "), F.lit(""))).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
            "__lines": F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]"))),
            "__p": _pairs("__w"),
        }
    )
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    # windows of five words: pairs of pairs, then the fifth word
    df = df.withColumn("__q", F.zip_with("__p", _after(F.col("__p"), 2), lambda a, b: F.xxhash64(a, b)))
    five = F.zip_with("__q", _after(F.col("__w"), 4), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("__h", F.slice(five, 1, F.greatest(F.size("__w") - F.lit(WINDOW - 1), F.lit(0)))).drop("__q")
    repeated = F.size("__h") > F.size(F.array_distinct("__h"))
    # positions are looked at only where some window comes twice
    df = df.withColumn("__h", F.when(repeated, F.col("__h")).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__s", F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).drop("__h")
    df = df.withColumn("__e", F.zip_with("__s", _after(F.col("__s"), 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    df = df.withColumn("__e", F.zip_with("__e", F.concat(F.array(F.lit(False)), F.col("__e")), lambda a, b: F.coalesce(a | b, F.lit(False))))
    df = df.withColumn("__i", F.sort_array(F.filter(F.zip_with("__s", "__e", lambda s, e: F.when(e, s["i"])), lambda i: i.isNotNull()))).drop("__s", "__e")
    steps = F.zip_with("__i", _after(F.col("__i"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x + y)).drop("__i")


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_DOCS).withColumn("__trusted", F.lit(1))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", smooth: float = 1.0) -> list[float]:
    """Log ratio of each bucket. Counts cover all documents; BUCKETS rows reach the driver."""
    d = df.select("doc_id", F.col(text).alias("text")).join(F.broadcast(trusted_ids(labels)), "doc_id", "left")
    d = d.select(words(F.col("text")).alias("w"), "__trusted").withColumn("z", F.arrays_zip("w", _after(F.col("w"), 1).alias("n")))
    d = d.select(F.explode_outer("z").alias("z"), "__trusted")  # outer, so that no filter repeats the splitting
    two = F.when(F.col("z.n").isNotNull(), _bucket(F.xxhash64("z.w", "z.n")))
    g = d.select(F.explode_outer(F.array(_bucket(F.xxhash64("z.w")), two)).alias("b"), "z", "__trusted").where("b is not null and z.w is not null")
    rows = g.groupBy("b").agg(F.count("*").alias("raw"), F.count("__trusted").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["b"]], good[r["b"]] = r["raw"], r["good"]
    if not sum(good):
        return [0.0] * BUCKETS
    a, b = sum(good) + smooth * BUCKETS, sum(raw) + smooth * BUCKETS
    return [math.log((x + smooth) / a) - math.log((y + smooth) / b) for x, y in zip(good, raw, strict=True)]


def judge(df: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add the base measures, score and verdict.

    Write the result before filtering on it: a filter would be pushed below the measures and repeat them."""
    df = base_measures(df.drop(*OWN), text)
    model = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded to one constant
    pairs = F.slice(F.col("__p"), 1, F.greatest(F.size("__p") - F.lit(1), F.lit(0)))
    total = F.aggregate("__w", F.lit(0.0), lambda s, x: s + F.get(model, _bucket(F.xxhash64(x))))
    total += F.aggregate(pairs, F.lit(0.0), lambda s, h: s + F.get(model, _bucket(h)))
    n = 2 * F.col("n_words") - 1
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "score": F.when(n > 0, total / n).otherwise(0.0)}).drop("__w", "__p")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *OWN)


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE: dict[str, str] = {}
