"""Queries on points: atlas annotation, channel gathering, scores against truth; file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import nearest as N
from ..operators.transform import affine, displaced
from ..operators.windows import gaussian_weights
from ..sources import raw
from ..sources.shared import fresh_path
from .cell_queries import F1, ID
from .voxel_queries import _mirror
from .views import ATLAS, CELLS, HEIGHT, N_SLICES, PROBES, VOX, WIDTH, atlas, cells, n_slices, probes, voxels

MAP = [[0.9, 0.1, 0.0, 5.0], [-0.1, 0.9, 0.0, 60.0], [0.0, 0.05, 1.1, -20.0]]
BOUND = 80.0


def annotate(s: SparkSession, d: str) -> DataFrame:
    """Every point with its nearest atlas point within the bound: 0 and null where there is none."""
    a = atlas(s, d)
    out = N.with_nearest(probes(s, d), "cell_id", a, "point_id", BOUND).join(a.select(F.col("point_id").alias("near_id"), "atlas_id"), "near_id", "left")
    return out.select("cell_id", "near_id", F.coalesce("atlas_id", F.lit(0)).alias("atlas_id"), F.round("near_d2", 6).alias("near_d2"))


def atl_02_affine(s: SparkSession, d: str) -> DataFrame:
    out = affine(probes(s, d), MAP)
    return out.select("cell_id", *[F.round(c, 6).alias(c) for c in "xyz"])


def atl_02_warp(s: SparkSession, d: str) -> DataFrame:
    """Trilinear displacement from a grid of the atlas' space, taken from the voxel table."""
    grid = voxels(s, d).select("z", "y", "x", (F.col("v") * 20).alias("dz"), (F.col("v") * -10).alias("dy"), (F.col("v") * 5).alias("dx"))
    p = probes(s, d).select("cell_id", (F.col("z") * n_slices(s, d) / 1250).alias("z"), (F.col("y") / 25).alias("y"), (F.col("x") / 20).alias("x"))
    out = displaced(p, "cell_id", grid)
    return out.select("cell_id", *[F.round(c, 6).alias(c) for c in "zyx"])


def atl_03_05_annotate(s: SparkSession, d: str) -> DataFrame:
    return annotate(s, d)


def atl_07_region_counts(s: SparkSession, d: str) -> DataFrame:
    return annotate(s, d).groupBy("atlas_id").agg(F.count("*").alias("n"))


def atl_04_06_valid(s: SparkSession, d: str) -> DataFrame:
    """Valid and positive cells, in micrometres of the atlas."""
    c = FE.feature_columns(cells(s, d)).where(FE.above(F.col("f1"), 4.5) & (F.col("lz") <= 50))
    return c.select(*ID, *[F.round(F.col(a) * 25.0, 3).alias(a) for a in ("lx", "ly", "lz")])


def mch_01_gather(s: SparkSession, d: str) -> DataFrame:
    """Logarithm of two channels at each positive cell's voxel, the second channel upside down; NaN for other cells."""
    c = FE.feature_columns(cells(s, d))
    img = voxels(s, d).select("z", "y", "x", "inten")
    other = voxels(s, d).select("z", (F.lit(HEIGHT - 1) - F.col("y")).alias("y"), "x", (F.col("inten") + F.col("label")).alias("inten"))
    at = {"z": F.col("lz") * n_slices(s, d) / 110, "y": F.col("ly") / 44, "x": F.col("lx") / 41}
    out = FE.gather(FE.gather(c, img, at, "inten", "first"), other, at, "inten", "second")

    def logged(k: str) -> F.Column:
        x = F.when(F.col(k) > 0, F.round(F.log10(F.col(k).cast("double")), 6)).when(F.col(k) == 0, F.lit(float("-inf")))
        return F.when(FE.above(F.col("f1"), 4.5), x).otherwise(F.lit(float("nan"))).alias(k)

    return out.select(*ID, logged("first"), logged("second"))


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as predictions, parts as truth, in one box of a thousand units."""
    inside = (F.col("x") >= 10) & (F.col("x") < 990) & (F.col("y") >= 10) & (F.col("y") < 990) & (F.col("z") > 5) & (F.col("z") < 995)
    p = probes(s, d).select(F.col("cell_id").alias("id"), "x", "y", "z").withColumn("inside", inside)
    t = atlas(s, d).select(F.col("point_id").alias("id"), "x", "y", "z").withColumn("inside", inside)
    return p, t


def eva_01_distances(s: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest truth within 60 units, in bins of 10."""
    p, t = _sides(s, d)
    out = E.with_nearest(p, "id", t, "id", 60.0)
    return out.groupBy(F.floor(F.col("near_d") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum("near_d"), 6).alias("total"))


def eva_02_self_nearest(s: SparkSession, d: str) -> DataFrame:
    """Mean distance of a truth point to its nearest other, without a bound."""
    _, t = _sides(s, d)
    return N.nearest_any(t, "id", t, "id", 60.0, apart=True).agg(F.round(F.avg(F.sqrt("near_d2")), 6).alias("d_th"), F.count("*").alias("n"))


def eva_03_truth(s: SparkSession, d: str) -> DataFrame:
    """Markers in the lowest regions as false positives, in the highest as false negatives."""
    p, t = _sides(s, d)
    fp = t.where(F.col("z") <= 140)
    fn = t.where(F.col("z") >= 900)
    return E.truth_from_markers(p, "id", fp, fn, 200.0).groupBy("kind").agg(F.count("*").alias("n"), F.sum("x").alias("sx"))


def eva_04_score_true(s: SparkSession, d: str) -> DataFrame:
    """Score from the numbers of positions, false positives and false negatives."""
    c = cells(s, d).agg(F.count("*").alias("p"), F.count_if(F.col("lz") > 90).alias("fp"), F.count_if(F.col("lz") < 4).alias("fn"))
    out = E.rates(c.withColumn("tp", F.col("p") - F.col("fp")))
    return out.select("p", "tp", "fp", "fn", *[F.round(k, 9).alias(k) for k in ("prec", "rec", "f_score")], F.round(F.col("tp") / ((2560 - 20.0) * (2160 - 20) * (100 - 10)), 12).alias("density"))


def eva_05_score_test(s: SparkSession, d: str) -> DataFrame:
    p, t = _sides(s, d)
    out = E.matched_score(p, t, 40.0)
    return out.select("m", "n", "tm", "tn", "tp", "fp", "fn", *[F.round(k, 9).alias(k) for k in ("prec", "rec", "f_score")])


def eva_06_sweep(s: SparkSession, d: str) -> DataFrame:
    """Predictions within each of twenty thresholds, from one nearest-neighbour pass."""
    p, t = _sides(s, d)
    return E.sweep(E.with_nearest(p, "id", t, "id", 40.0), "near_d", [round(40 * i / 19, 6) for i in range(20)])


def eva_07_double_count(s: SparkSession, d: str) -> DataFrame:
    p, t = _sides(s, d)
    return E.hit_kinds(p, "id", t, "id", 40.0).groupBy("kind").agg(F.count("*").alias("n"))


def eva_08_splat(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d).select((F.col("lz") / 5).alias("z"), (F.col("ly") / 100).alias("y"), (F.col("lx") / 100).alias("x"))
    return E.splat(c, {"z": 20, "y": 21, "x": 25})


def eva_08_kinds(s: SparkSession, d: str) -> DataFrame:
    """Hits, false ones and double counts as blurred volumes of their own, in bins of 50 units."""
    p, t = _sides(s, d)
    kinds = E.hit_kinds(p, "id", t, "id", 40.0).select("kind", *[(F.col(a) / 50).alias(a) for a in "zyx"])
    size = E.extents(kinds)
    bins = E.splat(kinds, size, by=["kind"]).select("kind", *[F.col(f"b{a}").alias(a) for a in "zyx"], "v")
    return E.sparse_blur(bins, "v", size, {"z": 1.8, "y": 4.0, "x": 4.0}, ("kind",), truncate=4.0)


def eva_09_slices(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).where(F.col("lz").between(40 - 3, 40 + 3)).groupBy("lz").agg(F.count("*").alias("n"))


def eva_11_histograms(s: SparkSession, d: str) -> DataFrame:
    """Ten equal bins of each coordinate between its extremes, the last one closed."""
    c = cells(s, d).select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("lx", "ly", "lz")])).alias("e")).select("e.*")
    ends = c.groupBy("axis").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.least(F.floor((F.col("v") - F.col("lo")) * 10 / (F.col("hi") - F.col("lo"))), F.lit(9)).cast("int")
    return c.join(F.broadcast(ends), "axis").groupBy("axis", b.alias("bin")).agg(F.count("*").alias("n"))


def snk_01_src_05_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Cells to packed records, one file for each stack's rows, and back."""
    path = fresh_path(s, "records")
    c = cells(s, d).select("side", F.col("iy").cast("string").alias("yname"), F.col("ix").cast("string").alias("xname"), F.col("lx").alias("local_x"), F.col("ly").alias("local_y"), F.col("lz").alias("local_z"), "structureness", "blobness", "intensity", "size")
    raw.write_records(c, path)
    back = raw.read_records(s, path)
    return back.groupBy("side", "yname", "xname").agg(F.count("*").alias("n"), F.sum(F.col("local_x").cast("double")).alias("sx"), F.sum("size").alias("total"))


def src_01_02_slices(s: SparkSession, d: str) -> DataFrame:
    """The volume as raw 16-bit slice files, found and read again; missing slices of the grid count as zero."""
    path = fresh_path(s, "slices")
    raw.write_slices(voxels(s, d).select(F.lit("FW").alias("side"), F.lit("0000").alias("yname"), (F.col("z") % 2).cast("string").alias("xname"), "z", "y", "x", F.col("inten").alias("v")), path, HEIGHT, WIDTH)
    found = raw.complete_grid(raw.list_slices(s, path))
    vox = raw.read_voxels(s, path, WIDTH)
    total = vox.groupBy("side", "yname", "xname", "zname").agg(F.sum(F.col("v").cast("long")).alias("total"))
    out = found.join(total, ["side", "yname", "xname", "zname"], "left")
    return out.select("xname", F.col("zname").cast("int").alias("z"), "is_dummy", F.coalesce("total", F.lit(0)).alias("total"))


_NEAR = """near AS (SELECT p.cell_id, a.point_id, a.atlas_id, (p.x - a.x) ** 2 + (p.y - a.y) ** 2 + (p.z - a.z) ** 2 AS d2 FROM probes p JOIN atlas a
  ON a.x BETWEEN p.x - {b} AND p.x + {b} AND a.y BETWEEN p.y - {b} AND p.y + {b} AND a.z BETWEEN p.z - {b} AND p.z + {b}),
  best AS (SELECT cell_id, point_id, atlas_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, point_id) AS k FROM near WHERE d2 {op} {b} * {b}) WHERE k = 1)"""
_ANNO = f"WITH {ATLAS}, {PROBES}, {_NEAR.format(b=80.0, op='<')}, anno AS (SELECT p.cell_id, b.point_id AS near_id, coalesce(b.atlas_id, 0) AS atlas_id, round(b.d2, 6) AS near_d2 FROM probes p LEFT JOIN best b USING (cell_id))"
_IN = "(x >= 10 AND x < 990 AND y >= 10 AND y < 990 AND z > 5 AND z < 995)"


def _matched(b: float) -> str:
    return f"WITH {ATLAS}, {PROBES}, {_NEAR.format(b=b, op='<=')}, m AS (SELECT p.cell_id, {_IN.replace('x ', 'p.x ').replace('y ', 'p.y ').replace('z ', 'p.z ')} AS inside, b.point_id, sqrt(b.d2) AS near_d FROM probes p LEFT JOIN best b USING (cell_id))"


ORACLE = {
    "atl_02_affine": f"WITH {PROBES} SELECT cell_id, " + ", ".join(f"round(x * {r[0]} + y * {r[1]} + z * {r[2]} + {r[3]}, 6) AS {c}" for c, r in zip("xyz", MAP, strict=True)) + " FROM probes",
    "atl_02_warp": f"""WITH {PROBES}, {VOX}, p AS (SELECT cell_id, z * {N_SLICES} / 1250 AS z, y / 25 AS y, x / 20 AS x FROM probes),
      c AS (SELECT p.*, g.i AS gz, h.i AS gy, k.i AS gx, (1 - abs(p.z - g.i)) * (1 - abs(p.y - h.i)) * (1 - abs(p.x - k.i)) AS w FROM p,
        (SELECT unnest([0, 1]) AS o) a, (SELECT unnest([0, 1]) AS o) b, (SELECT unnest([0, 1]) AS o) e, LATERAL (SELECT floor(p.z) + a.o AS i) g, LATERAL (SELECT floor(p.y) + b.o AS i) h, LATERAL (SELECT floor(p.x) + e.o AS i) k),
      s AS (SELECT cell_id, sum(c.w * vox.v) AS v FROM c JOIN vox ON vox.z = c.gz AND vox.y = c.gy AND vox.x = c.gx GROUP BY cell_id)
      SELECT p.cell_id, round(p.z + coalesce(s.v, 0) * 20, 6) AS z, round(p.y - coalesce(s.v, 0) * 10, 6) AS y, round(p.x + coalesce(s.v, 0) * 5, 6) AS x FROM p LEFT JOIN s USING (cell_id)""",
    "atl_03_05_annotate": _ANNO + " SELECT * FROM anno",
    "atl_07_region_counts": _ANNO + " SELECT atlas_id, count(*) AS n FROM anno GROUP BY atlas_id",
    "atl_04_06_valid": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, round(lx * 25.0, 3) AS lx, round(ly * 25.0, 3) AS ly, round(lz * 25.0, 3) AS lz FROM cells WHERE log10(structureness) > 4.5 AND lz <= 50",
    "mch_01_gather": f"""WITH {CELLS}, {VOX} SELECT l_orderkey, l_linenumber, CASE WHEN {F1} > 4.5 THEN CASE WHEN a.inten > 0 THEN round(log10(a.inten), 6) WHEN a.inten = 0 THEN '-inf'::DOUBLE END ELSE 'nan'::DOUBLE END AS first,
      CASE WHEN {F1} > 4.5 THEN CASE WHEN b.inten + b.label > 0 THEN round(log10(b.inten + b.label), 6) WHEN b.inten + b.label = 0 THEN '-inf'::DOUBLE END ELSE 'nan'::DOUBLE END AS second
      FROM cells LEFT JOIN vox a ON a.z = floor(lz * {N_SLICES} / 110) AND a.y = floor(ly / 44) AND a.x = floor(lx / 41) LEFT JOIN vox b ON b.z = floor(lz * {N_SLICES} / 110) AND b.y = 49 - floor(ly / 44) AND b.x = floor(lx / 41)""",
    "eva_01_distances": _matched(60.0) + " SELECT CAST(floor(near_d / 10) AS INTEGER) AS bin, count(*) AS n, round(sum(near_d), 6) AS total FROM m GROUP BY ALL",
    "eva_02_self_nearest": f"WITH {ATLAS}, n AS (SELECT a.point_id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d2 FROM atlas a JOIN atlas b ON a.point_id <> b.point_id GROUP BY 1) SELECT round(avg(sqrt(d2)), 6) AS d_th, count(*) AS n FROM n",
    "eva_03_truth": f"""WITH {ATLAS}, {PROBES}, w AS (SELECT DISTINCT arg_min(p.cell_id, struct_pack(d := (p.x - a.x) ** 2 + (p.y - a.y) ** 2 + (p.z - a.z) ** 2, i := p.cell_id)) AS cell_id FROM atlas a, probes p WHERE a.atlas_id <= 7 GROUP BY a.point_id)
      SELECT 'TP' AS kind, count(*) AS n, sum(x) AS sx FROM probes WHERE cell_id NOT IN (SELECT cell_id FROM w) UNION ALL SELECT 'FN', count(*), sum(x) FROM atlas WHERE atlas_id >= 45""",
    "eva_04_score_true": f"""WITH {CELLS}, c AS (SELECT count(*) AS p, count(*) FILTER (WHERE lz > 90) AS fp, count(*) FILTER (WHERE lz < 4) AS fn FROM cells), k AS (SELECT *, p - fp AS tp, (p - fp) / p AS prec, (p - fp) / (p - fp + fn) AS rec FROM c)
      SELECT p, tp, fp, fn, round(prec, 9) AS prec, round(rec, 9) AS rec, round(2 * prec * rec / (prec + rec), 9) AS f_score, round(tp / (2540.0 * 2140 * 90), 12) AS density FROM k""",
    "eva_05_score_test": f"""WITH {ATLAS}, {PROBES}, d AS (SELECT p.cell_id, a.point_id FROM probes p JOIN atlas a ON a.x BETWEEN p.x - 40 AND p.x + 40 AND a.y BETWEEN p.y - 40 AND p.y + 40 AND a.z BETWEEN p.z - 40 AND p.z + 40
        WHERE (p.x - a.x) ** 2 + (p.y - a.y) ** 2 + (p.z - a.z) ** 2 <= 1600),
      q AS (SELECT (SELECT count(*) FROM atlas WHERE {_IN}) AS m, (SELECT count(*) FROM probes WHERE {_IN}) AS n,
        (SELECT count(*) FROM atlas WHERE {_IN} AND point_id IN (SELECT point_id FROM d)) AS tm, (SELECT count(*) FROM probes WHERE {_IN} AND cell_id IN (SELECT cell_id FROM d)) AS tn),
      k AS (SELECT *, least(tm, tn) AS tp FROM q), r AS (SELECT *, n - tp AS fp, m - tp AS fn, tp / n AS prec, tp / m AS rec FROM k)
      SELECT m, n, tm, tn, tp, fp, fn, round(prec, 9) AS prec, round(rec, 9) AS rec, round(2 * prec * rec / (prec + rec), 9) AS f_score FROM r""",
    "eva_06_sweep": _matched(40.0) + ", t AS (SELECT round(40 * i / 19, 6) AS threshold FROM (SELECT unnest(range(20)) AS i)) SELECT threshold, count(m.near_d) AS n FROM t LEFT JOIN m ON m.near_d <= t.threshold GROUP BY threshold",
    "eva_07_double_count": _matched(40.0) + ", c AS (SELECT *, count(*) OVER (PARTITION BY point_id) AS k FROM m) SELECT CASE WHEN point_id IS NULL THEN 'FP' WHEN k > 1 THEN 'DC' ELSE 'TP' END AS kind, count(*) AS n FROM c GROUP BY ALL",
    "eva_08_splat": f"""WITH {CELLS} SELECT CAST(least(floor(lz / 5), 19) AS INTEGER) AS bz, CAST(least(floor(ly / 100), 20) AS INTEGER) AS "by", CAST(least(floor(lx / 100), 24) AS INTEGER) AS bx, count(*) * 5000 AS v
      FROM cells WHERE lz / 5 BETWEEN 0 AND 20 AND ly / 100 BETWEEN 0 AND 21 AND lx / 100 BETWEEN 0 AND 25 GROUP BY ALL""",
    "eva_08_kinds": _matched(40.0) + f""", k AS (SELECT cell_id, CASE WHEN point_id IS NULL THEN 'FP' WHEN count(*) OVER (PARTITION BY point_id) > 1 THEN 'DC' ELSE 'TP' END AS kind FROM m),
      q AS (SELECT kind, floor(z / 50) AS z, floor(y / 50) AS y, floor(x / 50) AS x FROM k JOIN probes USING (cell_id)), n AS (SELECT CAST(max(z) AS BIGINT) + 1 AS nz, CAST(max(y) AS BIGINT) + 1 AS ny, CAST(max(x) AS BIGINT) + 1 AS nx FROM q),
      grid AS (SELECT DISTINCT kind, i AS z, j AS y, k AS x FROM q, n, LATERAL (SELECT unnest(range(nz)) AS i), LATERAL (SELECT unnest(range(ny)) AS j), LATERAL (SELECT unnest(range(nx)) AS k)),
      b AS (SELECT kind, z, y, x, count(*) * 5000.0::DOUBLE AS c FROM q GROUP BY ALL), p0 AS MATERIALIZED (SELECT kind, z, y, x, coalesce(b.c, 0.0) AS c FROM grid LEFT JOIN b USING (kind, z, y, x)), """
    + _mirror("p0", {a: f"(SELECT n{a} FROM n)" for a in "zyx"}, {"z": gaussian_weights(1.8, 4.0), "y": gaussian_weights(4.0, 4.0), "x": gaussian_weights(4.0, 4.0)}, "kind") + " SELECT kind, z, y, x, c AS v FROM blurred WHERE c > 0",
    "eva_09_slices": f"WITH {CELLS} SELECT lz, count(*) AS n FROM cells WHERE lz BETWEEN 37 AND 43 GROUP BY lz",
    "eva_11_histograms": f"""WITH {CELLS}, e AS (SELECT 'lx' AS axis, lx AS v FROM cells UNION ALL SELECT 'ly', ly FROM cells UNION ALL SELECT 'lz', lz FROM cells), b AS (SELECT *, min(v) OVER (PARTITION BY axis) AS lo, max(v) OVER (PARTITION BY axis) AS hi FROM e)
      SELECT axis, CAST(least(floor((v - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY ALL""",
    "snk_01_src_05_round_trip": f"WITH {CELLS} SELECT side, CAST(iy AS VARCHAR) AS yname, CAST(ix AS VARCHAR) AS xname, count(*) AS n, sum(lx) AS sx, CAST(sum(size) AS BIGINT) AS total FROM cells GROUP BY ALL",
    "src_01_02_slices": f"""WITH {VOX}, t AS (SELECT CAST(z % 2 AS VARCHAR) AS xname, CAST(z AS INTEGER) AS z, CAST(sum(inten) AS BIGINT) AS total FROM vox GROUP BY ALL), g AS (SELECT DISTINCT a.xname, b.z FROM t a, t b)
      SELECT g.xname, g.z, t.total IS NULL AS is_dummy, coalesce(t.total, 0) AS total FROM g LEFT JOIN t USING (xname, z)""",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and k[:4] in ("atl_", "mch_", "eva_", "snk_", "src_")}
