"""From raw documents to encoded training text, in stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Defined results: rows of null or empty text pass the first stage and have no language, so the second rejects them;
equal rows are judged alike until the third stage keeps one of them; in the third stage ties go to the smallest id (see
there for missing and repeated ids); a null source is a source of its own; empty tables give empty results; further
columns pass through all stages but the last, whatever their names; texts of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, jaccard_join, language_id, mixing, toxicity
from voxloom.llm.common import fresh_path, materialize, private, restored, small_side, table

#: A document's language must have at least this mean posterior; `und` is rejected as well.
LANGUAGE_SCORE = 0.35
#: Near duplicates: word 5-grams, Jaccard similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier chain calls toxic."""
    models = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    inner, names = private(docs)
    return restored(toxicity.score(inner, models, text=names["text"]).where(~F.col("toxic")), names)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose words agree on no language."""
    field = language_id.train(docs.select("doc_id", "text", "lang"))
    inner, names = private(docs)
    out = language_id.predict(inner, field, text=names["text"])
    return restored(out.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, one without an id if none has one.

    Rows are judged by their own texts: of rows with equal id and text one stays, texts without words included; rows of
    one id with different texts stay or go on their own. Rows without an id and without words are all kept."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        return _drop_by_row(docs)
    groups = jaccard_join.jaccard_components(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    gone = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
    inner, names = private(docs)
    return restored(inner.join(small_side(gone), inner[names["doc_id"]] == gone["doc_id"], "left_anti"), names)


def _drop_by_row(docs: DataFrame) -> DataFrame:
    """The stage above where ids are missing or repeated: each row gets a key of its own."""
    inner, names = private(docs)
    keyed = materialize(inner.withColumn("row", F.monotonically_increasing_id()), "pipeline-keyed")
    id_, text = F.col(names["doc_id"]), F.col(names["text"])
    groups = jaccard_join.jaccard_components(keyed.select(F.col("row").alias("doc_id"), text.alias("text")), NEAR_WORDS, NEAR_PERCENT).withColumnRenamed("doc_id", "row")
    order = F.struct(id_.isNull().alias("last"), id_.alias("id"), F.xxhash64(*names.values()).alias("hash"), F.col("row"))
    rows = groups.join(keyed.select("row", id_.alias("id"), F.sha2(text.cast("binary"), 256).alias("digest"), order.alias("order")), "row")
    no_words = F.col("n_grams") == 0
    by = [F.when(~no_words, F.col("component_id")), F.when(no_words, F.col("id")), F.when(no_words, F.col("digest")), F.when(no_words & F.col("id").isNull(), F.col("row"))]
    stay = rows.groupBy(*[c.alias(f"by{i}") for i, c in enumerate(by)]).agg(F.min("order").alias("first")).select("first.row")
    return restored(keyed.join(small_side(materialize(stay, "pipeline-stay")), "row", "left_semi"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes k times comes k times."""
    inner, names = private(docs)
    out = mixing.mix(inner.withColumns({c: F.col(names[c]) for c in ("doc_id", "source", "text")}))
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    out = out.select(*names.values(), times.alias("times")).where("times > 0")
    return restored(out.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times")))), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and decoded text."""
    return bpe.digests(docs, small=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Classifier, field and byte-pair encoding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
