"""Queries on cell records: dealing, filters, coordinates, features, density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import features as FE
from ..operators import mixture as X
from ..operators import partition as P
from ..sources.shared import materialize
from .views import CELL_ORDER, CELLS, N_SLICES, VOX, cells, n_slices, table, voxels

SX, SY, SZ, W, H = -0.65, -0.65, 5.0, 2560, 2160
MATRIX = [[0.1, 0.0, 0.0, 10.0], [0.0, 0.1, 0.0, 20.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
ID = ["l_orderkey", "l_linenumber"]


def with_global(df: DataFrame) -> DataFrame:
    off = C.stack_origin(MATRIX, F.col("ix") * 14000.0, F.col("iy") * 12000.0, F.lit(0.0))
    axes = (C.Axis(SX, W), C.Axis(SY, H), C.Axis(SZ))
    g = [C.to_global(o, F.col(c), a) for o, c, a in zip(off, ("lx", "ly", "lz"), axes, strict=True)]
    return df.withColumns(dict(zip(("mx", "my", "mz"), g, strict=True)))


GLOBAL = f"""placed AS (SELECT *, (ix * 1400.0 + 10.0) + lx * {SX} - {W} * {SX} AS mx, (iy * 1200.0 + 20.0) + ly * {SY} - {H} * {SY} AS my, lz * {SZ} AS mz FROM cells)"""


def r(c: str, n: int = 6) -> F.Column:
    return F.round(c, n).alias(c)


def cel_04_06_global(s: SparkSession, d: str) -> DataFrame:
    return with_global(cells(s, d)).select(*ID, r("mx"), r("my"), r("mz"))


def cel_07_validity(s: SparkSession, d: str) -> DataFrame:
    g = with_global(cells(s, d))
    ok = F.when(F.col("side") == "FW", C.valid_between(F.col("mz"), float("-inf"), 250.0)).otherwise(C.valid_between(F.col("mz"), float("inf"), 250.0))
    return g.withColumn("ok", ok).groupBy("side", "ok").agg(F.count("*").alias("n"))


def cel_08_scale_flip(s: SparkSession, d: str) -> DataFrame:
    g = with_global(cells(s, d))
    v = C.scale_and_flip((F.col("mx"), F.col("my"), F.col("mz")), (10.0, 20.0, 0.0), (0.01, 0.02, 0.0625), (5.0, 6.0), True, (True, False, True), (40.0, 60.0, 32.0))
    return g.select(*ID, *[F.round(c, 6).alias(n) for c, n in zip(v, ("sx", "sy", "sz"), strict=True)])


def cel_09_substack(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).where(C.in_substack(F.col("lz"), 16, 48)).select(*ID, "lz")


def cel_10_roi(s: SparkSession, d: str) -> DataFrame:
    out = C.region_of_interest(cells(s, d), {"lz": (10.0, 60.0), "ly": (100.0, 1100.0), "lx": (200.0, 1800.0)}, {"lx": 1600})
    return out.select(*ID, "lz", "ly", "lx")


def cel_11_margin(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).where(C.inside_margin(F.col("lx"), F.col("ly"), F.col("lz"), W, H, 100)).groupBy("side", "ix", "iy").agg(F.count("*").alias("n"))


def cel_12_asof(s: SparkSession, d: str) -> DataFrame:
    stacks = table(s, d, "supplier").select((F.col("s_suppkey") * 40).cast("double").alias("off"), F.col("s_name").alias("stack"))
    return C.greatest_at_most(cells(s, d).select(*ID, "lx"), "lx", stacks, "off", ["off", "stack"]).select(*ID, "lx", "off", "stack")


def cel_13_lookup(s: SparkSession, d: str) -> DataFrame:
    keys = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    c = cells(s, d).withColumn("k", (F.col("ix") * 3 + F.col("iy") + 1).cast("long"))
    return C.lookup(c, keys, "k").groupBy("s_nationkey", "found").agg(F.count("*").alias("n"))


def cel_14_physical(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).select(*ID, F.round(F.col("lx") * 0.65, 6).alias("px"), F.round(F.col("ly") * 0.65, 6).alias("py"), F.round(F.col("lz") * SZ, 6).alias("pz"))


def cel_16_counts(s: SparkSession, d: str) -> DataFrame:
    c = FE.feature_columns(cells(s, d))
    out = c.rollup("side", "ix", "iy").agg(F.count_if(FE.above(F.col("f1"), 4.5)).alias("positive"), F.count("*").alias("n"))
    return out


def cel_01_candidates(s: SparkSession, d: str) -> DataFrame:
    out = C.candidate(cells(s, d), "lz", "ly", "lx", depth=F.lit(100), margin=8, left=100, top=100, right=100, bottom=100, width=W, height=H, min_size=10)
    return out.select(*ID, "lz", "size", "intensity")


def cel_03_dedup(s: SparkSession, d: str) -> DataFrame:
    """Every cell in all substacks that cover it, then only where it is kept."""
    sub = P.substacks(cells(s, d), "lz", F.lit(101), 32, 8)
    kept = sub.where(P.kept_range(F.col("lz"), F.col("z0"), F.lit(101), 32, 8))
    return kept.groupBy("side", "z0").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


def par_01_round_robin(s: SparkSession, d: str) -> DataFrame:
    n = cells(s, d).groupBy("side", "ix", "iy").agg(F.count("*").alias("n"))
    return P.round_robin(n, "n", ["side", "ix", "iy"], 4)


def par_02_serpentine(s: SparkSession, d: str) -> DataFrame:
    n = cells(s, d).groupBy("side", "ix", "iy").agg(F.count("*").alias("n"))
    return P.serpentine(n, "n", ["side", "ix", "iy"], 5).groupBy("job").agg(F.count("*").alias("stacks"), F.sum("n").alias("cells"))


def par_03_substacks(s: SparkSession, d: str) -> DataFrame:
    return P.substacks(cells(s, d), "lz", F.lit(101), 32, 8).groupBy("z0").agg(F.count("*").alias("n"), F.min("lz").alias("low"), F.max("lz").alias("high"))


def cls_01_features(s: SparkSession, d: str) -> DataFrame:
    c = FE.feature_columns(cells(s, d)).withColumn("g", FE.log_feature(F.col("intensity"), 0.0, 2.0, 3.0))
    big = lambda c: F.when(F.abs(c) > 1e300, F.col(c)).otherwise(F.round(c, 6)).alias(c)
    return c.select(*ID, big("f0"), big("f1"), big("f2"), big("g"))


def cls_02_background(s: SparkSession, d: str) -> DataFrame:
    c = FE.feature_columns(cells(s, d)).where("f0 > -1e300")
    img = voxels(s, d).select("z", "y", "x", (F.col("inten") + 1).alias("w"))
    n = n_slices(s, d)
    at = {"z": F.col("lz") * n / 110, "y": F.col("ly") / 40 - 1, "x": F.col("lx") / 38}
    out = FE.background_normalized(c, img, at, {"z": n, "y": 50, "x": 64}, "w", "f0")
    return out.select(*ID, F.round("f0", 6).alias("f0"))


def cls_03_threshold(s: SparkSession, d: str) -> DataFrame:
    return FE.feature_columns(cells(s, d)).where(FE.above(F.col("f1"), 4.6)).select(*ID, "structureness")


def cls_04_linear(s: SparkSession, d: str) -> DataFrame:
    c = FE.feature_columns(cells(s, d)).where("f0 > -1e300")
    return c.withColumn("pos", FE.linear(F.col("f1"), F.col("f0"), 6.0, 0.75, -25.9)).groupBy("pos").agg(F.count("*").alias("n"))


def cls_08_systematic(s: SparkSession, d: str) -> DataFrame:
    out = P.every_nth(cells(s, d).withColumn("stack", F.concat_ws("_", "side", "ix", "iy")), 10, CELL_ORDER, ["stack"])
    return out.groupBy("stack").agg(F.count("*").alias("n"), F.sum("lx").alias("sx"))


def cls_11_density(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d).select((F.col("lz") / 5).alias("z"), (F.col("ly") / 100).alias("y"), (F.col("lx") / 100).alias("x"))
    return FE.density(c, ("z", "y", "x"))


def cls_12_facets(s: SparkSession, d: str) -> DataFrame:
    """Every 1000th cell of stacks with at least 1000 cells."""
    out = P.facets(cells(s, d), CELL_ORDER, ["side", "ix", "iy"], least=1000)
    return out.select("side", "ix", "iy", "lx", "structureness")


def cls_09_gather(s: SparkSession, d: str) -> DataFrame:
    """Feature means of valid cells, by side."""
    c = FE.feature_columns(with_global(cells(s, d)), mean_intensity=True).where("mz <= 250 and f0 > -1e300")
    return c.groupBy("side").agg(F.count("*").alias("n"), *[F.round(F.avg(f), 6).alias(f) for f in ("f0", "f1", "f2")])


def cls_09_rows(s: SparkSession, d: str) -> DataFrame:
    """The matrix of features of all valid cells, stack by stack, its rows numbered."""
    c = FE.feature_columns(with_global(cells(s, d)), mean_intensity=True).where("mz <= 250 and f0 > -1e300")
    return P.numbered(c, ["side", "iy", *CELL_ORDER]).select("rn", "side", "iy", r("f0"), r("f1"), r("f2"))


def flagship_density(s: SparkSession, d: str) -> DataFrame:
    """Cells to features, linear classifier, validity and density."""
    c = with_global(FE.feature_columns(cells(s, d))).where("f0 > -1e300")
    ok = FE.linear(F.col("f1"), F.col("f0"), 6.0, 0.75, -25.9) & C.valid_between(F.col("mz"), 0.0, 450.0)
    return FE.density(c.where(ok).select((F.col("lz") / 5).alias("z"), (F.col("ly") / 100).alias("y"), (F.col("lx") / 100).alias("x")), ("z", "y", "x"))


def cls_05_gmm(s: SparkSession, d: str) -> DataFrame:
    """Two Gaussian clusters on the features; the one with the larger mean of the second feature is positive."""
    rows = materialize(X.counted(FE.feature_columns(cells(s, d)).where("f0 > -1e300"), ["f0", "f1", "f2"]), "gmm-rows")
    model = X.gaussians(rows, ["f0", "f1", "f2"], 2)
    out = model.predict(rows, "cluster").groupBy((F.col("cluster") == model.largest("f1")).alias("positive"))
    return out.agg(F.sum("weight").alias("n"), F.round(F.sum(F.col("f1") * F.col("weight")) / F.sum("weight"), 6).alias("f1"))


def cls_06_tree(s: SparkSession, d: str) -> DataFrame:
    """Depth-2 tree on centred principal components, trained on four fifths and scored on the rest."""
    c = FE.feature_columns(cells(s, d)).where("f0 > -1e300").withColumn("label", FE.above(F.col("f1"), 4.5).cast("double"))
    train = F.pmod(F.xxhash64(*ID), F.lit(5)) != 0
    model = FE.boundary_tree(["f0", "f1", "f2"], "label").fit(c.where(train))
    return model.transform(c.where(~train)).groupBy("label", "prediction").agg(F.count("*").alias("n"))


_LOG = "CASE WHEN {0} > 0 THEN log10({0}) WHEN {0} = 0 THEN -1.7976931348623157e308 ELSE 0.0 END"
F0, F1, F2 = (_LOG.format(c) for c in ("intensity", "structureness", "blobness"))
FEAT = f"feat AS (SELECT *, {F0} AS f0, {F1} AS f1, {F2} AS f2 FROM cells)"
_BIG = "CASE WHEN abs({0}) > 1e300 THEN {0} ELSE round({0}, 6) END"


def _density_sql(src: str) -> str:
    axes = "".join(f", e{i} AS (SELECT k AS b, k * ((n{i} - 1) / n{i}) AS lo, (k + 1) * ((n{i} - 1) / n{i}) AS hi, k = n{i} - 1 AS last, n{i} - 1 AS top FROM m, (SELECT unnest(range(0, 4000)) AS k) WHERE k < n{i})" for i in range(3))
    joins = " ".join(f"JOIN e{i} ON p.v{i} >= e{i}.lo AND (p.v{i} < e{i}.hi AND NOT e{i}.last OR e{i}.last AND p.v{i} <= e{i}.top)" for i in range(3))
    return f"""WITH {CELLS}, {GLOBAL}, src AS ({src}), p AS (SELECT lz / 5 AS v0, ly / 100 AS v1, lx / 100 AS v2 FROM src),
    m AS (SELECT CAST(floor(max(v0)) AS INTEGER) AS n0, CAST(floor(max(v1)) AS INTEGER) AS n1, CAST(floor(max(v2)) AS INTEGER) AS n2 FROM p){axes}
    SELECT CAST(e0.b AS INTEGER) AS b0, CAST(e1.b AS INTEGER) AS b1, CAST(e2.b AS INTEGER) AS b2, count(*) AS n FROM p {joins} GROUP BY ALL"""


_STACKS = "n AS (SELECT side, ix, iy, count(*) AS n FROM cells GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, side, ix, iy) - 1 AS i FROM n)"
_SUB = "sub AS (SELECT *, o.z0 FROM cells, (SELECT CAST(unnest(range(0, 93, 16)) AS BIGINT) AS z0) o WHERE lz >= z0 AND lz < z0 + 32)"
_ORDER = ", ".join(CELL_ORDER)

ORACLE = {
    "cel_04_06_global": f"WITH {CELLS}, {GLOBAL} SELECT l_orderkey, l_linenumber, round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz FROM placed",
    "cel_07_validity": f"WITH {CELLS}, {GLOBAL} SELECT side, CASE WHEN side = 'FW' THEN mz <= 250 ELSE mz >= 250 END AS ok, count(*) AS n FROM placed GROUP BY ALL",
    "cel_08_scale_flip": f"""WITH {CELLS}, {GLOBAL} SELECT l_orderkey, l_linenumber, round(40.0 - ((my - 20.0) * 0.02 - 6.0), 6) AS sx, round((mx - 10.0) * 0.01 - 5.0, 6) AS sy,
      round(32.0 - mz * 0.0625, 6) AS sz FROM placed""",
    "cel_09_substack": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, lz FROM cells WHERE lz >= 16 AND lz < 48",
    "cel_10_roi": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, lz - 10 AS lz, ly - 100 AS ly, 1600 - (lx - 200) AS lx FROM cells WHERE lz BETWEEN 10 AND 60 AND ly BETWEEN 100 AND 1100 AND lx BETWEEN 200 AND 1800",
    "cel_11_margin": f"WITH {CELLS} SELECT side, ix, iy, count(*) AS n FROM cells WHERE lx >= 10 AND lx < 2550 AND ly >= 10 AND ly < 2150 AND lz > 5 AND lz < 95 GROUP BY ALL",
    "cel_12_asof": f"""WITH {CELLS}, st AS (SELECT CAST(s_suppkey * 40 AS DOUBLE) AS off, s_name AS stack FROM supplier)
      SELECT l_orderkey, l_linenumber, lx, off, stack FROM cells ASOF JOIN st ON cells.lx >= st.off""",
    "cel_13_lookup": f"WITH {CELLS} SELECT s_nationkey, s_suppkey IS NOT NULL AS found, count(*) AS n FROM cells LEFT JOIN supplier ON s_suppkey = ix * 3 + iy + 1 GROUP BY ALL",
    "cel_14_physical": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, round(lx * 0.65, 6) AS px, round(ly * 0.65, 6) AS py, round(lz * 5.0, 6) AS pz FROM cells",
    "cel_16_counts": f"WITH {CELLS}, {FEAT} SELECT side, ix, iy, count(*) FILTER (WHERE f1 > 4.5) AS positive, count(*) AS n FROM feat GROUP BY ROLLUP (side, ix, iy)",
    "cel_01_candidates": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, lz, size, intensity FROM cells WHERE lz >= 8 AND lz < 92 AND lx >= 100 AND lx < 2460 AND ly >= 100 AND ly < 2060 AND size >= 10 AND intensity > 0",
    "cel_03_dedup": f"WITH {CELLS}, {_SUB} SELECT side, z0, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM sub WHERE lz - z0 >= 8 AND lz - z0 < least(32, 101 - z0) - 8 GROUP BY ALL",
    "par_01_round_robin": f"WITH {CELLS}, {_STACKS} SELECT side, ix, iy, n, CAST(i % 4 AS INTEGER) AS worker FROM k",
    "par_02_serpentine": f"WITH {CELLS}, {_STACKS} SELECT CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS job, count(*) AS stacks, CAST(sum(n) AS BIGINT) AS cells FROM k GROUP BY ALL",
    "par_03_substacks": f"WITH {CELLS}, {_SUB} SELECT z0, count(*) AS n, min(lz) AS low, max(lz) AS high FROM sub GROUP BY ALL",
    "cls_01_features": f"WITH {CELLS}, {FEAT}, g AS (SELECT *, CASE WHEN abs(f0) < 1e300 THEN (f0 + 2.0) * 3.0 ELSE f0 END AS g FROM feat) SELECT l_orderkey, l_linenumber, {', '.join(f'{_BIG.format(c)} AS {c}' for c in ('f0', 'f1', 'f2', 'g'))} FROM g",
    "cls_02_background": f"""WITH {CELLS}, {FEAT}, {VOX} SELECT l_orderkey, l_linenumber, round(f0 - log10(inten + 1.0), 6) AS f0 FROM feat JOIN vox
      ON vox.z = least(greatest(floor(lz * {N_SLICES} / 110), 0), {N_SLICES} - 1) AND vox.y = least(greatest(floor(ly / 40 - 1), 0), 49) AND vox.x = least(greatest(floor(lx / 38), 0), 63) WHERE f0 > -1e300""",
    "cls_03_threshold": f"WITH {CELLS}, {FEAT} SELECT l_orderkey, l_linenumber, structureness FROM feat WHERE f1 > 4.6",
    "cls_04_linear": f"WITH {CELLS}, {FEAT} SELECT 6.0 * f1 + 0.0 * f0 - 25.0 > 0 AS pos, count(*) AS n FROM feat WHERE f0 > -1e300 GROUP BY ALL",
    "cls_08_systematic": f"WITH {CELLS}, s AS (SELECT *, side || '_' || ix || '_' || iy AS stack FROM cells), q AS (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY {_ORDER}) - 1 AS i FROM s) SELECT stack, count(*) AS n, sum(lx) AS sx FROM q WHERE i % 10 = 0 GROUP BY ALL",
    "cls_11_density": _density_sql("SELECT * FROM cells"),
    "cls_12_facets": f"WITH {CELLS}, q AS (SELECT *, row_number() OVER (PARTITION BY side, ix, iy ORDER BY {_ORDER}) - 1 AS i, count(*) OVER (PARTITION BY side, ix, iy) AS n FROM cells) SELECT side, ix, iy, lx, structureness FROM q WHERE n >= 1000 AND i % 1000 = 0",
    "cls_09_gather": f"""WITH {CELLS}, {GLOBAL}, q AS (SELECT side, {_LOG.format('(intensity / size)')} AS f0, {F1} AS f1, {F2} AS f2 FROM placed WHERE mz <= 250)
      SELECT side, count(*) AS n, round(avg(f0), 6) AS f0, round(avg(f1), 6) AS f1, round(avg(f2), 6) AS f2 FROM q WHERE f0 > -1e300 GROUP BY ALL""",
    "cls_09_rows": f"""WITH {CELLS}, {GLOBAL}, q AS (SELECT *, {_LOG.format('(intensity / size)')} AS f0, {F1} AS f1, {F2} AS f2 FROM placed WHERE mz <= 250)
      SELECT row_number() OVER (ORDER BY side, iy, {_ORDER}) - 1 AS rn, side, iy, round(f0, 6) AS f0, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM q WHERE f0 > -1e300""",
    "flagship_density": _density_sql(f"SELECT * FROM (SELECT *, {F0} AS f0, {F1} AS f1 FROM placed) WHERE f0 > -1e300 AND 6.0 * f1 + 0.0 * f0 - 25.0 > 0 AND mz BETWEEN 0 AND 450"),
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and k[:4] in ("cel_", "par_", "cls_", "flag")}
