"""Chat formatting: preference pairs with a shared prompt.

For each pair the longest common prefix of turns (same role and text, position by position) of the chosen and the
rejected conversation is rendered once as the prompt; what follows is rendered as two completions. Each completion
comes with the character spans that a loss may count: the texts of assistant turns and their end marks. Everything
outside the spans is masked.

A row of the result is one training example and so holds one pair of conversations. Defined results: a null role or
text renders as empty and equals only another null; turns are ordered by turn, then role, then text, so repeated
rows stay and ties are stable; rows without a conversation id or turn are left out; a pair that lacks one side is left
out; identical conversations give an empty pair of completions; empty tables give no rows; other columns of the input
are ignored. A pair's turns meet in one task, as one training example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, MID, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _turns(df: DataFrame, name: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return df.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull()).groupBy("pair_id").agg(ordered.alias(name))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MID))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """Array of [from, to) in characters of the rendered completion, one for each assistant turn."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        a = s["at"] + F.length(_head(t))
        b = a + F.length(_body(t))
        one = F.array(F.struct(a.cast("long").alias("from"), b.cast("long").alias("to")))
        return F.struct(b.cast("long").alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(s["spans"], one)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both inputs: pair_id, turn, role, text. Result: pair_id, n_prompt_turns, prompt, chosen, rejected and their spans."""
    both = _turns(chosen, "a").join(_turns(rejected, "b"), "pair_id")
    same = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    both = both.withColumn("__same", same)
    differs = F.array_position("__same", F.lit(False))
    both = both.withColumn("n_prompt_turns", F.when(differs > 0, differs - 1).otherwise(F.size("__same")).cast("long"))

    def rest(c: str) -> Column:
        return F.slice(F.col(c), F.col("n_prompt_turns").cast("int") + F.lit(1), F.greatest(F.size(c) - F.col("n_prompt_turns").cast("int"), F.lit(0)))

    both = both.withColumns({"__p": F.slice(F.col("a"), F.lit(1), F.col("n_prompt_turns").cast("int")), "__a": rest("a"), "__b": rest("b")})
    return both.select("pair_id", "n_prompt_turns", _render(F.col("__p")).alias("prompt"), _render(F.col("__a")).alias("chosen"), _render(F.col("__b")).alias("rejected"), _spans(F.col("__a")).alias("chosen_spans"), _spans(F.col("__b")).alias("rejected_spans"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are pair k, an assumption on the table; spans as text, `from-to` joined by commas."""
    t = table(spark, sf_dir, "conversations").select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "turn", "role", "text")
    out = preference_pairs(t.where("side = 0").drop("side"), t.where("side = 1").drop("side"))

    def text(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ",")

    return out.withColumns({c: text(c) for c in ("chosen_spans", "rejected_spans")})


_TURN = "'<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"
_SQL = f"""
WITH t AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, (conv_id % 2 + 2) % 2 AS side, turn, role, text, {_TURN} AS shown,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS i
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT * FROM t WHERE side = 0), b AS (SELECT * FROM t WHERE side = 1),
n AS (SELECT pair_id, max(i) FILTER (WHERE side = 0) AS na, max(i) FILTER (WHERE side = 1) AS nb FROM t GROUP BY pair_id),
d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) AS first
      FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.i = b.i
      WHERE a.i IS NULL OR b.i IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
p AS (SELECT n.pair_id, coalesce(d.first - 1, greatest(na, nb)) AS k FROM n LEFT JOIN d USING (pair_id) WHERE na IS NOT NULL AND nb IS NOT NULL),
q AS (SELECT t.*, p.k, sum(CASE WHEN t.i > p.k THEN length(shown) ELSE 0 END) OVER (PARTITION BY t.pair_id, t.side ORDER BY t.i) AS upto FROM t JOIN p USING (pair_id)),
s AS (SELECT *, CASE WHEN role = 'assistant' AND i > k THEN CAST(upto - length(coalesce(text, '')) - 11 AS BIGINT) || '-' || CAST(upto AS BIGINT) END AS span FROM q)
SELECT pair_id, CAST(any_value(k) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= k), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 0 AND i > k), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 1 AND i > k), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 0), '') AS chosen_spans,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 1), '') AS rejected_spans
FROM s GROUP BY pair_id"""

QUERIES = {"op8_chat_format": op8_chat_format}
ORACLE = {"op8_chat_format": _SQL}
