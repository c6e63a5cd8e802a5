"""Merkle manifest of a dataset: a digest for every row, group and the whole table, and a proof for every row.

The manifest is a content-addressed graph: records map a node's digest to its children's digests, nothing else. A
request for a leaf starts at the root's digest; the digits of its rank (base 3, one a level) name the child to follow, and
the children not followed are collected. Requests that share the first digits share their descent, so a level is one
join of as many rows as it has nodes; the leaves meet their parents' rows at last. Segments, collected from the root down,
are reversed to run from leaf to root.

Ranks come from ranges: rows are sorted by range, blocks of a group within a range are counted, and counts are summed
over blocks; no group is sorted by one task. A level's groups hold three nodes.

Defined results: null columns count as `-`; a leaf digest counts bytes of UTF-8, so texts of any length and letters do;
rows of equal order within a group (a null order comes first) are ordered by their digests, equal rows are leaves of
their own with equal digests, which share their record; a null group is a group of its own and comes first; an empty
table has no root and gives no rows; columns that aren't named play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_sql, materialize, table

#: Children of a node, a fixed value of the manifest's format.
WIDTH = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that SQL is written for.
SQL_LEVELS = 14


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row's values, each with its length before it."""
    values = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def ranked(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 as column `rank`. The table must be written, its order total.

    A row's place is its place in its range plus the counts of the group's blocks in the ranges before."""
    keys = [by, *order]
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    blocks = placed.groupBy(by, part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    until = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group touches
    blocks = blocks.select(F.col(by).alias("by_"), F.col("part").alias("part_"), "first", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("before"))
    joined = placed.join(blocks, placed[by].eqNullSafe(blocks["by_"]) & (part == blocks["part_"]))
    return joined.select(*df.columns, (F.col("before") + F.col("at") - F.col("first")).alias("rank"))


@dataclass
class Manifest:
    """What build() wrote. levels[k] has the nodes of level k + 1, top those above the groups' own roots."""

    #: group number, rank, height of the group's tree, leaf, and the columns that were to be kept
    leaves: DataFrame
    #: group number, its root, height of its tree
    groups: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    #: none if the table is empty
    root: str | None

    def records(self) -> DataFrame:
        """The content-addressed store: each digest once, with its children."""
        every = [*self.levels, *self.top]
        if not every:
            return self.leaves.select(F.col("leaf").alias("digest"), F.array("leaf").alias("children")).where("false")
        out = every[0].select("digest", "children")
        for more in every[1:]:
            out = out.unionByName(more.select("digest", "children"))
        return _store(out)


def _store(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("digest").agg(F.first("children").alias("children"))


def _height(n: Column) -> Column:
    """Levels above n leaves: how many powers of 3, from 1 on, are below n."""
    powers = F.array(*[F.lit(WIDTH**k) for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def _grow(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Nodes above (gid, height, rank, digest), level by level, each written."""
    out = []
    for level in range(1, height + 1):
        runs = nodes.where(F.col("height") >= level).groupBy("gid", "height", F.floor(F.col("rank") / WIDTH).alias("up"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda s: s["digest"])
        made = runs.agg(kids.alias("children")).select("gid", "height", F.col("up").alias("rank"), "children", F.sha2(_joined(F.col("children")), 256).alias("digest"))
        nodes = materialize(made, f"{name}-{level}")
        out.append(nodes)
    return out


def build(df: DataFrame, group: str = "source", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, keep: dict[str, Column] | None = None) -> Manifest:
    """Digests of all rows, groups and the table. keep: further columns of the leaves, by name."""
    kept = keep or {}
    first = df.select(F.col(group).alias("g_"), F.col(order).alias("o_"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), F.struct(*[c.alias(k) for k, c in kept.items()], F.lit(None).cast("int").alias("none_")).alias("kept_"))
    # a number of its own for each row, so that equal rows can fall into several ranges
    first = materialize(first.withColumn("row_", F.monotonically_increasing_id()), "merkle-leaves")
    names = materialize(first.select("g_").distinct().withColumn("all_", F.lit(0)), "merkle-groups")
    names = ranked(names, "all_", ["g_"], "merkle-group-ranks").select(F.col("g_").alias("name_"), F.col("rank").alias("gid"))
    leaves = materialize(first.join(names, first["g_"].eqNullSafe(names["name_"])).drop("name_", "g_"), "merkle-numbered")
    leaves = ranked(leaves, "gid", ["o_", "leaf", "row_"], "merkle-ranges")
    sizes = leaves.groupBy("gid").agg((F.max("rank") + 1).alias("n")).select(F.col("gid").alias("gid_"), _height(F.col("n")).alias("height"))
    leaves = leaves.join(sizes, F.col("gid") == F.col("gid_"))
    leaves = materialize(leaves.select("gid", "height", "rank", "leaf", *[F.col(f"kept_.{k}").alias(k) for k in kept]), "merkle-ranked")

    tallest = leaves.agg(F.max("height")).first()[0]
    levels = _grow(leaves.select("gid", "height", "rank", F.col("leaf").alias("digest")), tallest or 0, "merkle-level")
    groups = leaves.where("height = 0").select("gid", "height", F.col("leaf").alias("digest"))
    for k, nodes in enumerate(levels):
        groups = groups.unionByName(nodes.where(F.col("height") == k + 1).select("gid", "height", "digest"))
    groups = materialize(groups, "merkle-subroots")
    if tallest is None:
        return Manifest(leaves, groups, [], [], None)
    high = groups.agg(_height(F.count("*"))).first()[0]
    top = _grow(groups.select(F.lit(0).alias("gid"), F.lit(high).alias("height"), F.col("gid").alias("rank"), "digest"), high, "merkle-top")
    root = (top[-1] if top else groups).select("digest").first()[0]
    return Manifest(leaves, groups, levels, top, root)


def _step(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests at a level's nodes, with the records that their digests name."""
    return at.join(_store(nodes), "digest")


def _segment(children: Column, digit: Column) -> Column:
    """What stands left and right of the child that is followed."""
    return F.struct(_joined(F.slice(children, 1, digit)).alias("left"), _joined(F.slice(children, digit + 2, WIDTH)).alias("right"))


def _down(at: DataFrame, nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Follow every child of the nodes that requests have reached."""
    out = _step(at, nodes).select(*keep, "rank", "path", "children", F.posexplode("children").alias("digit", "child"))
    path = F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))
    return out.select(*keep, (F.col("rank") * WIDTH + F.col("digit")).alias("rank"), path.alias("path"), F.col("child").alias("digest"))


def prove(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Leaves with `subroot` and `path`: segments (left, right) of sibling digests from leaf to root.

    requests: rows (gid, rank) of the leaves that are asked for, all if not given."""

    def wanted(at: DataFrame, level: int, by: list[str]) -> DataFrame:
        if requests is None:
            return at
        place = F.floor(F.col("rank") / WIDTH**level) if by == ["gid", "rank"] else F.floor(F.col("gid") / WIDTH**level)
        return at.join(requests.select(*[F.col(c) for c in by if c != "rank"], place.alias("rank")).distinct(), by, "left_semi")

    spark = m.leaves.sparkSession
    none = F.array().cast("array<struct<left:string,right:string>>")
    at = spark.range(1 if m.root is not None else 0).select(F.lit(0).cast("long").alias("rank"), none.alias("path"), F.lit(m.root).cast("string").alias("digest"))
    for level in range(len(m.top), 0, -1):
        at = wanted(_down(at, m.top[level - 1], []), level - 1, ["rank"])
    groups = m.groups.select(F.col("gid").alias("rank"), "height")
    below = at.join(groups, "rank").select(F.col("rank").alias("gid"), "height", F.lit(0).cast("long").alias("rank"), "path", "digest", F.col("digest").alias("subroot"))
    if m.top or len(m.levels) > 1:
        below = materialize(below, "merkle-descent")
    keep = ["gid", "subroot"]
    at = below.where("false").drop("height")
    for level in range(len(m.levels), 0, -1):
        at = at.unionByName(below.where(F.col("height") == level).drop("height"))
        if level > 1:
            at = wanted(_down(at, m.levels[level - 1], keep), level - 1, ["gid", "rank"])
    # at the nodes of level 1 the leaves themselves ask: their last digit is their place there
    parents = _step(at, m.levels[0]).drop("digest") if m.levels else at.select("gid", "rank", "path", "subroot", F.array("digest").alias("children"))
    alone = below.where("height = 0").select("gid", "subroot", "rank", "path", F.lit(None).cast("array<string>").alias("children"))
    parents = parents.select("gid", "subroot", "rank", "path", "children").unionByName(alone) if m.levels else alone
    leaves = wanted(m.leaves, 0, ["gid", "rank"]).withColumns({"gid_": F.col("gid"), "up_": F.floor(F.col("rank") / WIDTH)}).drop("gid").withColumnRenamed("rank", "leaf_rank_")
    out = leaves.join(parents, (F.col("gid_") == F.col("gid")) & (F.col("up_") == F.col("rank")))
    digit = (F.col("leaf_rank_") % WIDTH).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(_segment(F.col("children"), digit))))
    kept = [c for c in m.leaves.columns if c not in ("gid", "rank", "height")]
    return out.select("gid", F.col("leaf_rank_").alias("rank"), *kept, "subroot", F.reverse(path).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(_joined(F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proved; those whose id has an even checksum are presented without their line ends."""
    docs = table(spark, sf_dir, "documents")
    bare = F.replace("text", F.lit("\n"), F.lit(""))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    # rows that tampering doesn't change are presented by their own leaf
    keep = {"doc_id": F.col("doc_id"), "shown": F.when(hit, leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), bare]))}
    m = build(docs, keep=keep)
    out = prove(m).withColumn("folded_root", fold(F.coalesce("shown", "leaf"), F.col("path")))
    root = F.lit(m.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def _oracle() -> str:
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"

    def levels(name: str, by: str, start: str) -> list[str]:
        out = [f"{name}0 as ({start})"]
        for k in range(1, SQL_LEVELS):
            out.append(f"{name}{k} as (select {by}, r // 3 as r, any_value((n + 2) // 3) as n, sha256(string_agg(d, '' order by r)) as d from {name}{k - 1} where n > 1 group by {by}, r // 3)")
        return out

    def climb(name: str, tree: str, on: str, start: str) -> list[str]:
        out = [f"{name}0 as ({start})"]
        for k in range(1, SQL_LEVELS):
            near = lambda side: f"coalesce((select string_agg(t.d, '' order by t.r) from {tree}{k - 1} t where {on} and t.n > 1 and t.r // 3 = p.r // 3 and t.r {side} p.r), '')"  # noqa: E731, B023
            own = f"(select max(t.n) from {tree}{k - 1} t where {on}) > 1"
            out.append(f"{name}{k} as (select p.* exclude (r, proof, folded), p.r // 3 as r, case when {own} then proof || {near('<')} || {near('>')} else proof end as proof, case when {own} then sha256({near('<')} || folded || {near('>')}) else folded end as folded from {name}{k - 1} p)")
        return out

    last = SQL_LEVELS - 1
    both = lambda name, by: " union all ".join(f"select {by}, d from {name}{k} where n = 1" for k in range(SQL_LEVELS))
    bare = f"case when {crc32_sql('doc_id::varchar')} % 2 = 0 then replace(text, chr(10), '') else text end"
    ctes = [
        f"leaves as (select doc_id, coalesce('s' || source, '') as s, {leaf('text')} as leaf, {leaf(bare)} as shown from documents)",
        "ranked as (select *, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by s) as n from leaves)",
        *levels("a", "s", "select s, r, n, leaf as d from ranked"),
        f"subroots as ({both('a', 's')})",
        *levels("b", "g", "select 0 as g, row_number() over (order by s) - 1 as r, count(*) over () as n, d from subroots"),
        f"roots as ({both('b', 'g')})",
        *climb("p", "a", "t.s = p.s", "select doc_id, leaf, s, r, '' as proof, shown as folded from ranked"),
        *climb("q", "b", "true", f"select p.doc_id, p.leaf, p.s, g.r, p.proof, p.folded from p{last} p join (select s, row_number() over (order by s) - 1 as r from subroots) g on g.s = p.s"),
    ]
    return "with " + ", ".join(ctes) + f" select q.doc_id, q.leaf, s.d as subroot, r.d as root, sha256(q.proof) as proof_sha256, q.folded as folded_root, q.folded = r.d as verified from q{last} q join subroots s on s.s = q.s cross join roots r"


QUERIES = {"op11_merkle": op11_merkle}
ORACLE = {"op11_merkle": _oracle()}
