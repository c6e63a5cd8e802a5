"""Queries of both detection modes from volume to regions, with their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import mixture as X
from ..operators.windows import dog_factor
from ..sources import datasource
from ..sources.shared import fresh_path, materialize
from . import cpu_mode, detect
from .views import HEIGHT, VOX, WIDTH
from .voxel_queries import HESS, LEAST, RADII, S_LARGE, S_SMALL, TIELESS, _intensities, _sig, lines

SETTINGS = detect.Settings(depth=8, extra_margin=1)


def detect_candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates of overlapping substacks, each cut into blocks that regions reach over."""
    found = detect.detect_lines(lines(s, d).select("z", "y", _intensities().alias("inten")), "inten", HEIGHT, WIDTH, SETTINGS, tile=16)
    return found.select(*[F.round(c, 5).alias(c) for c in "zyx"], F.round(F.col("intensity") * TIELESS, 6).alias("intensity"), F.round(F.col("structureness") * TIELESS, 6).alias("structureness"), "size")


def detect_from_files(s: SparkSession, d: str) -> DataFrame:
    """Two stacks as files of raw slices, the volume and its upside-down negative, from files to candidates.

    Slices are written with a sign, as bright voxels are below 0 in the negative."""
    path = fresh_path(s, "detect-slices")
    both = F.explode(F.array(F.struct(F.lit("FW").alias("side"), F.col("y").alias("row"), _intensities().alias("v")), F.struct(F.lit("RV").alias("side"), (HEIGHT - 1 - F.col("y")).alias("row"), F.transform(_intensities(), lambda v: 11_500 - v).alias("v")))).alias("e")
    rows = B.with_depth(lines(s, d), (), F.col("z")).select("depth", "z", both).select("e.side", "depth", "z", F.col("e.row").alias("y"), "e.v")
    grid = B.Grid(HEIGHT, WIDTH, (1, HEIGHT, WIDTH), ("side",), "<i2")
    slices = B.from_lines(rows, "v", grid)
    datasource.register(s)
    named = slices.select("side", F.lit("0").alias("yname"), F.lit("1").alias("xname"), F.lpad(F.col("bz").cast("string"), 6, "0").alias("zname"), F.col("data").alias("content"))
    named.write.format("raw_slices").option("path", path).mode("append").save()
    found = detect.detect_files(s, path, HEIGHT, WIDTH, SETTINGS, tile=16, stored="<i2")
    return found.select("side", *[F.round(c, 5).alias(c) for c in "zyx"], F.round(F.col("intensity") * TIELESS, 6).alias("intensity"), F.round(F.col("structureness") * TIELESS, 6).alias("structureness"), "size")


def cpu_02_features(s: SparkSession, d: str) -> DataFrame:
    """Regions of the volume in the other detection mode, numbered from 0."""
    grid = B.Grid(HEIGHT, WIDTH, (5, 16, 16))
    blocks = B.from_lines(B.with_depth(lines(s, d), (), F.col("z")).withColumn("v", _intensities()), "v", grid)
    f = cpu_mode.features(blocks, grid, RADII, LEAST, S_SMALL, S_LARGE)
    return f.select("index", F.col("size").cast("long").alias("size"), *[F.round(c, 5).alias(c) for c in ("intensity", "centroid_x", "centroid_y", "centroid_z")], F.round(F.col("structureness") * TIELESS, 4).alias("structureness"))


def cpu_03_unsupervised(s: SparkSession, d: str) -> DataFrame:
    """Regions of the other mode in three clusters by size, brightness and shape; wanted is the one with the largest second feature."""
    grid = B.Grid(HEIGHT, WIDTH, (5, 16, 16))
    blocks = B.from_lines(B.with_depth(lines(s, d), (), F.col("z")).withColumn("v", _intensities()), "v", grid)
    f = cpu_mode.features(blocks, grid, RADII, LEAST, S_SMALL, S_LARGE).where("size > 1")
    f = materialize(f.select("index", "size", F.log10("size").alias("a"), F.log10("structureness").alias("b"), F.log10("intensity").alias("c")).where("b is not null and c is not null"), "regions")
    model = X.fit(f, ["a", "b", "c"], 3, "b").pruned()
    return model.predict(f).groupBy((F.col("component") == model.largest("b")).alias("wanted")).agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("voxels"))


_OTHER = {"x": "sub, z, y", "y": "sub, z, x", "z": "sub, y, x"}
_DET = "(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz))"


def _over(axis: str, rows: str = "") -> str:
    return f"OVER (PARTITION BY {_OTHER[axis]} ORDER BY {axis} {rows})"


def _within(fn: str, axis: str, r: int) -> str:
    return f"{fn}(c) {_over(axis, f'ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING')}"


def _mean(axis: str, r: int) -> str:
    """Border values repeated."""
    whole = _over(axis, "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    i, n = f"(row_number() {_over(axis)} - 1)", f"count(*) {whole}"
    return f"({_within('sum', axis, r)} + greatest(0, {r} - {i}) * first_value(c) {whole} + greatest(0, {r} - ({n} - 1 - {i})) * last_value(c) {whole}) / {2 * r + 1}"


def _blur(axis: str, weights: list[float]) -> str:
    r = len(weights) // 2
    return " + ".join(f"{k!r} * " + ("c" if not j else f"coalesce({'lag' if j < 0 else 'lead'}(c, {abs(j)}) {_over(axis)}, 0)") for j, k in zip(range(-r, r + 1), weights, strict=True))


def _steps(name: str, source: str, steps: list[tuple[str, str]]) -> str:
    out = []
    for i, (axis, e) in enumerate(steps):
        out.append(f"{name}{i} AS MATERIALIZED (SELECT sub, z, y, x, inten, {e} AS c FROM {source})")
        source = f"{name}{i}"
    return ", ".join(out)


def _regions_sql(volume: str, mean, contrast: str, gradient) -> str:  # noqa: ANN001
    """CTEs from p0 (sub, z, y, x, inten, c) to regions q (sub, label, size, ...)."""
    r = dict(zip("xyz", RADII, strict=True))
    spread = [_steps(p, "p0", [(a, _within(fn, a, r[a])) for a in "xyz"] + [(a, mean(a, r[a])) for a in "zyx"]) for p, fn in (("e", "min"), ("d", "max"))]
    blurred = [_steps(p, "nn", [(a, _blur(a, _sig(sig, a))) for a in "xyz"]) for p, sig in (("g", S_SMALL), ("b", S_LARGE))]
    near = ", ".join(f"({i}, {j}, {k})" for i, j, k in itertools.product((-1, 0, 1), repeat=3) if (i, j, k) != (0, 0, 0))
    return f"""WITH RECURSIVE {VOX}, {volume}, {', '.join(spread)},
      nn AS MATERIALIZED (SELECT sub, z, y, x, inten, CASE WHEN inten >= {LEAST} THEN {contrast} ELSE 0.0 END AS c FROM e5 JOIN d5 USING (sub, z, y, x, inten)), {', '.join(blurred)},
      dog AS MATERIALIZED (SELECT sub, z, y, x, nn.c AS norm, (g2.c - b2.c) * {dog_factor(*S_SMALL, 1.0)!r} AS v FROM g2 JOIN b2 USING (sub, z, y, x) JOIN nn USING (sub, z, y, x)),
      gr AS (SELECT *, {gradient('v', 'x')} AS gx, {gradient('v', 'y')} AS gy, {gradient('v', 'z')} AS gz FROM dog),
      h AS MATERIALIZED (SELECT *, {gradient('gx', 'x')} AS xx, {gradient('gx', 'y')} AS xy, {gradient('gx', 'z')} AS xz, {gradient('gy', 'y')} AS yy, {gradient('gy', 'z')} AS yz, {gradient('gz', 'z')} AS zz FROM gr),
      fg AS MATERIALIZED (SELECT *, sub * 1000000000 + z * 3200 + y * 64 + x AS id FROM h WHERE xx < 0 AND xx * yy - xy * xy > 0 AND {_DET} < 0), o(i, j, k) AS (VALUES {near}),
      e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM fg a, o, fg b WHERE b.sub = a.sub AND b.z = a.z + o.i AND b.y = a.y + o.j AND b.x = a.x + o.k),
      lab(id, label) USING KEY (id) AS (SELECT id, id FROM fg UNION (SELECT e.b, min(l.label) FROM lab l JOIN e ON e.a = l.id JOIN recurring.lab r ON r.id = e.b WHERE l.label < r.label GROUP BY e.b)),
      q AS (SELECT sub, label, count(*) AS size, max(norm) AS intensity, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, {', '.join(f'sum({c}) AS {c}' for c in HESS)} FROM fg JOIN lab USING (id) GROUP BY sub, label)"""


_STRUCTURE = "(xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz))"


def _one_sided(c: str, a: str) -> str:
    return f"CASE WHEN lag({c}) {_over(a)} IS NULL THEN lead({c}) {_over(a)} - {c} WHEN lead({c}) {_over(a)} IS NULL THEN {c} - lag({c}) {_over(a)} ELSE (lead({c}) {_over(a)} - lag({c}) {_over(a)}) / 2 END"


def _zero_beyond(c: str, a: str) -> str:
    return f"(coalesce(lead({c}) {_over(a)}, 0) - coalesce(lag({c}) {_over(a)}, 0)) * CAST(0.5 AS DOUBLE)"


def _detect_sql(stacks: str = "SELECT 0 AS side, z, y, x, inten FROM vox", side: str = "") -> str:
    """stacks: side (0, 1, ...), z, y, x, inten; a substack's number is its side's thousands and its first slice."""
    m, depth, length = SETTINGS.margin, SETTINGS.depth, "(SELECT max(z) + 1 FROM vox)"
    volume = f"""st AS MATERIALIZED ({stacks}), subs AS (SELECT s.side * 1000 + z0 AS sub, s.side, z0 FROM (SELECT DISTINCT side FROM st) s, (SELECT unnest(range(0, {length} - {m}, {depth - 2 * m})) AS z0)),
      box AS (SELECT sub, side, z0, i AS z, y, x FROM subs, (SELECT unnest(range({depth})) AS i), (SELECT DISTINCT y, x FROM vox)),
      p0 AS MATERIALIZED (SELECT box.sub, box.z, box.y, box.x, coalesce(st.inten, 0) AS inten, CAST(coalesce(st.inten, 0) AS DOUBLE) AS c FROM box LEFT JOIN st ON st.side = box.side AND st.z = box.z0 + box.z AND st.y = box.y AND st.x = box.x)"""
    left, top, right, bottom = SETTINGS.edges
    kept = f"cz >= {m} AND cz < least({depth}, {length} - sub % 1000) - {m} AND cx >= {left} AND cx < {WIDTH - right} AND cy >= {top} AND cy < {HEIGHT - bottom} AND size >= {SETTINGS.min_size} AND intensity > 0"
    cols = f"{side}round(cz + sub % 1000, 5) AS z, round(cy, 5) AS y, round(cx, 5) AS x, round(intensity * CAST({TIELESS} AS DOUBLE), 6) AS intensity, round({_STRUCTURE} * CAST({TIELESS} AS DOUBLE), 6) AS structureness, CAST(size % 65536 AS INTEGER) AS size"
    return _regions_sql(volume, _mean, "(inten - e5.c) / (d5.c - e5.c)", _zero_beyond) + f" SELECT {cols} FROM q WHERE {kept}"


def _cpu_sql() -> str:
    volume = "p0 AS MATERIALIZED (SELECT 0 AS sub, z, y, x, inten, CAST(inten AS DOUBLE) AS c FROM vox)"
    cols = ", ".join(f"round({c}, 5) AS {n}" for c, n in (("intensity", "intensity"), ("cx", "centroid_x"), ("cy", "centroid_y"), ("cz", "centroid_z")))
    zeros = lambda a, r: f"{_within('sum', a, r)} / {2 * r + 1}"
    return _regions_sql(volume, zeros, "inten / (d5.c - e5.c)", _one_sided) + f" SELECT row_number() OVER (ORDER BY label) - 1 AS index, size, {cols}, round({_STRUCTURE} * CAST({TIELESS} AS DOUBLE), 4) AS structureness FROM q"


_FILES = "SELECT 0 AS side, z, y, x, inten FROM vox UNION ALL SELECT 1, z, 49 - y, x, 11500 - inten FROM vox"
ORACLE = {"detect_candidates": _detect_sql(), "detect_from_files": _detect_sql(_FILES, "CASE WHEN sub >= 1000 THEN 'RV' ELSE 'FW' END AS side, "), "cpu_02_features": _cpu_sql()}
QUERIES = {f.__name__: f for f in (detect_candidates, detect_from_files, cpu_02_features, cpu_03_unsupervised)}
