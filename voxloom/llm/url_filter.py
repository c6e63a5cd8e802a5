"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a text of the public filter-list kind: `||` anchors at the start of a host label, `*` stands for any run of
characters, `^` for a separator or the end; everything else is literal. A rule is tried only on URLs that hold its
index token, which is the literal token of the rule that the URLs hold least often; only these candidates run the
rule's regular expression. Rules without a complete literal token are tried on every URL.

Everything runs in Spark's own functions. Up to `inline_rules` rules the index is a constant map beside the scan
(no shuffle at all); longer lists are joined with the exploded URL tokens instead.

Defined results: a null URL or one without `://` has an empty host and path and no rule; repeated rows are judged
alike; ties of length go to the rule first in code point order; URLs of any length are read whole; an empty table gives
no rows; other columns of the input pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules with more than this many entries are joined rather than inlined.
INLINE_RULES = 1000
#: Characters of patterns up to which a longer list is broadcast.
INDEX_CHARS = 16 << 20


@dataclass(frozen=True)
class Rule:
    text: str  #: what the result names
    pattern: str  #: filter-list syntax
    action: str  #: allow or block
    rank: int = 0  #: a higher rank wins before length


def host_rule(host: str, path: str, action: str) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with `path`."""
    return Rule(host + path, f"||{host}{path}", action, 1)


def rule_regex(pattern: str) -> str:
    out, rest = ("^(?:[^/]*\\.)?", pattern[2:].rstrip("*")) if pattern.startswith("||") else ("", pattern.strip("*"))  # a `*` at an end says nothing, and costs
    for ch in rest:
        out += "[\\s\\S]*" if ch == "*" else "(?:[^A-Za-z0-9]|$)" if ch == "^" else ch if ch.isalnum() else "\\" + ch
    return out


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL holds whole: bounded on both sides by a separator in the pattern."""
    anchored = pattern.startswith("||")
    body = pattern[2:].lower() if anchored else pattern.lower()
    found = []
    for m in TOKEN.finditer(body):
        before = body[m.start() - 1] if m.start() else ("|" if anchored else "*")
        after = body[m.end()] if m.end() < len(body) else "*"
        if before != "*" and after != "*" and before.isascii() and after.isascii():
            found.append(m[0])
    return sorted(set(found))


def with_host_path(df: DataFrame, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    df = df.withColumn("__rest", F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit("")))
    raw = F.regexp_extract("__rest", "^[^/?#]*", 0)
    after = F.substr(F.col("__rest"), F.length(raw) + F.lit(1))
    return df.withColumns({"host": ascii_lower(raw), "path": F.regexp_extract(after, "^[^?#]*", 0)}).drop("__rest")


def _tokens() -> Column:
    return F.array_distinct(F.split(ascii_lower(F.concat("host", "path")), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Over all URLs; at most one row for each token of the rules reaches the driver."""
    if not vocabulary:
        return {}
    held = F.array_intersect(_tokens(), F.array(*[F.lit(t) for t in vocabulary]))
    rows = urls.select(F.explode(held).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    return {r["t"]: r["n"] for r in rows}


def index_tokens(rules: list[Rule], counts: dict[str, int]) -> dict[Rule, str | None]:
    return {r: min(literal_tokens(r.pattern), key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def _entry(r: Rule) -> Column:
    return F.struct(
        F.lit(r.rank).alias("rank"), F.lit(len(r.text)).alias("len"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"), F.lit(rule_regex(r.pattern)).alias("regex")
    )


def _best(matched: Column) -> Column:
    """Highest rank, then the longest rule, then the first in code point order."""
    return F.try_element_at(
        F.array_sort(
            matched,
            lambda a, b: F.when(a["rank"] != b["rank"], b["rank"] - a["rank"]).when(a["len"] != b["len"], b["len"] - a["len"]).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0),
        ),
        F.lit(1),
    )


def url_filter(df: DataFrame, url_col: str, rules: list[Rule], default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Add host, path, rule, rule_rank and verdict; `rule` is null where the default decides."""
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "rule_rank", "verdict")]
    urls = with_host_path(df.select(*kept), url_col)
    tokens = sorted({t for r in rules for t in literal_tokens(r.pattern)})
    index = index_tokens(rules, token_counts(urls, tokens))
    if len(rules) <= inline_rules:
        by: dict[str, list[Rule]] = {}
        for r, t in index.items():
            by.setdefault(t or "", []).append(r)
        always = by.pop("", [])
        cands = F.array(*[_entry(r) for r in always]) if always else None
        if by:
            table_ = F.create_map(*[x for t, rs in sorted(by.items()) for x in (F.lit(t), F.array(*[_entry(r) for r in rs]))])
            found = F.flatten(F.filter(F.transform(_tokens(), lambda t: F.try_element_at(table_, t)), lambda c: c.isNotNull()))
            cands = found if cands is None else F.concat(cands, found)
        if cands is None:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_rank": F.lit(None).cast("int"), "verdict": F.lit(default)})
        subject = F.concat("host", "path")
        best = _best(F.filter(cands, lambda c: F.regexp_like(subject, c["regex"])))
        out = urls.withColumn("__best", best)
    else:
        rows = [(t, r.rank, len(r.text), r.text, r.action, rule_regex(r.pattern)) for r, t in index.items() if t is not None]
        listed = df.sparkSession.createDataFrame(rows, "token string, rank int, len int, rule string, action string, regex string")
        # a list that the driver holds; broadcast if it is small, so that common tokens gather nowhere
        listed = F.broadcast(listed) if sum(len(r.pattern) for r in rules) <= INDEX_CHARS else listed
        # one judgement for each distinct address, so that repeated rows need no key of their own
        each = urls.select("host", "path").distinct()
        fits = F.expr("regexp_like(concat(host, path), regex)")
        hits = each.select("host", "path", F.explode(_tokens()).alias("token")).join(listed, "token").drop("token").where(fits)
        always = [_entry(r) for r, t in index.items() if t is None]
        if always:  # tried on every address, beside the scan
            hits = hits.union(each.select("host", "path", F.explode(F.array(*always)).alias("r")).select("host", "path", "r.*").where(fits))
        pick = F.max_by(F.struct("rank", "len", "rule", "action"), F.struct("rank", "len", F.expr("transform(split(rule, ''), c -> -ascii(c))"))).alias("__best")
        out = urls.join(hits.groupBy("host", "path").agg(pick), ["host", "path"], "left")
    return out.withColumns({"rule": F.col("__best.rule"), "rule_rank": F.col("__best.rank"), "verdict": F.coalesce(F.col("__best.action"), F.lit(default))}).drop("__best")


#: The rules of the contract (host, path) and, after them, the pattern rules of the method.
HOST_RULES = [host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"), host_rule("example.com", "/de/", "block"), host_rule("org", "/fr/", "allow")]
PATTERN_RULES = [
    Rule(p, p, "block")
    for p in ("||cheap-pills.", "||spam-farm.", "||casino-win.", "||free-bets.", "||adult-x.", "||ads-track.", "/casino/", "/pills/", "-bets.", "/adserver^")
] + [Rule("/docs/free-", "/docs/free-", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), "url", HOST_RULES + PATTERN_RULES)
    host = F.col("rule_rank") == 1
    return out.select("page_id", "host", "path", F.when(host, F.col("rule")).alias("rule"), "verdict", F.when(~host, F.col("rule")).alias("pattern"))


def _sql() -> str:
    values = ", ".join(f"({r.rank}, {len(r.text)}, '{r.text}', '{r.action}', '{rule_regex(r.pattern)}')" for r in HOST_RULES + PATTERN_RULES)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM b),
d AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM c),
r(rank, len, rule, action, regex) AS (VALUES {values}),
m AS (SELECT d.page_id, d.host, d.path, r.rank, r.rule, r.action, row_number() OVER (PARTITION BY d.page_id ORDER BY r.rank DESC, r.len DESC, r.rule) AS k
      FROM d LEFT JOIN r ON regexp_matches(d.host || d.path, r.regex))
SELECT page_id, host, path, CASE WHEN rank = 1 THEN rule END AS rule, coalesce(action, 'allow') AS verdict, CASE WHEN rank <> 1 THEN rule END AS pattern FROM m WHERE k = 1"""


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLE = {"op1_url_filters": _sql()}
