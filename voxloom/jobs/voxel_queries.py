"""Queries on dense volumes: neighbourhood filters, region aggregates, components, mosaics, detection."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import structureness, with_eigenvalues
from ..operators import blocks as B
from ..operators import cells as C
from ..operators import components as CC
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import merge as M
from ..operators import regions as R
from ..operators import windows as V
from . import detect
from .cell_queries import F1
from .views import CELLS, HEIGHT, VOX, WIDTH, cells, n_slices, slice_numbers, table, voxels

RADII, SMALL, LEAST = (3, 3, 1), (3, 3, 1), 5000
#: Radii of the reach that wide backgrounds need, beyond every line of the volume along y and x.
WIDE = (100, 100, 5)
S_SMALL, S_LARGE = (1.5, 0.8), (2.2, 1.2)
#: Keeps values that are multiples of a power of two off the ties of rounding.
TIELESS = 0.7310585
HESS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _intensities() -> Column:
    return F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 10000).cast("int"))


def base(s: SparkSession, d: str) -> DataFrame:
    return voxels(s, d).select("z", "y", "x", "v", "inten", "label")


def out(df: DataFrame, *cols: str, digits: int | None = 9) -> DataFrame:
    return df.select("z", "y", "x", *[(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in cols])


def flt_01_erosion(s: SparkSession, d: str) -> DataFrame:
    return out(V.erode(base(s, d), "v", "e", RADII), "e", digits=None)


def flt_02_dilation(s: SparkSession, d: str) -> DataFrame:
    return out(V.dilate(base(s, d), "v", "e", RADII), "e", digits=None)


def flt_03_box(s: SparkSession, d: str) -> DataFrame:
    return out(V.box_mean(base(s, d), "v", "b", RADII), "b")


def flt_04_normalize(s: SparkSession, d: str) -> DataFrame:
    return out(V.normalize(base(s, d), "inten", "norm", RADII, SMALL, LEAST), "norm", digits=8)


def _tieless(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", F.col("norm") * TIELESS)


def flt_04_normalize_wide(s: SparkSession, d: str) -> DataFrame:
    return out(_tieless(V.normalize(base(s, d), "inten", "norm", WIDE, WIDE, LEAST)), "norm", digits=8)


def flt_05_copy_threshold(s: SparkSession, d: str) -> DataFrame:
    return out(V.normalize(base(s, d), "inten", "norm", (0, 0, 0), SMALL, LEAST), "norm", digits=None)


def flt_06_zero_erosion(s: SparkSession, d: str) -> DataFrame:
    """Erosion with zeros beyond the border: a frame that is cut short has a zero in it."""
    df = base(s, d)
    for a in "xyz":
        df = V.by_slice(df) if a == "x" else V.by_column(df) if a == "z" else df
        w = V.line(a).rowsBetween(-2, 2)
        df = df.withColumn("v", F.when(F.count("v").over(w) == 5, F.min("v").over(w)).otherwise(F.least(F.lit(0.0), F.min("v").over(w))))
    return out(df, "v", digits=None)


def flt_08_gaussian(s: SparkSession, d: str) -> DataFrame:
    return out(V.gaussian(base(s, d), "v", "g", *S_SMALL), "g")


def flt_09_dog(s: SparkSession, d: str) -> DataFrame:
    return out(V.difference_of_gaussians(base(s, d), "v", "dog", S_SMALL, S_LARGE), "dog")


def flt_10_gradient(s: SparkSession, d: str) -> DataFrame:
    df = V.by_slice(base(s, d)).withColumns({"gx": V.gradient("v", "x"), "gy": V.gradient("v", "y")})
    return out(V.by_column(df).withColumn("gz", V.gradient("v", "z")), "gx", "gy", "gz", digits=10)


def flt_11_hessian(s: SparkSession, d: str) -> DataFrame:
    return out(V.hessian(base(s, d), "v"), *HESS, digits=10)


def flt_12_negative_definite(s: SparkSession, d: str) -> DataFrame:
    h = V.hessian(base(s, d), "inten")
    return h.withColumn("pd", V.negative_definite(*map(F.col, HESS))).groupBy("z", "pd").agg(F.count("*").alias("n"))


def flt_14_gaussian_u16(s: SparkSession, d: str) -> DataFrame:
    """Blur of whole numbers: the volume's borders are mirrored, each pass is cut to a whole number again."""
    size = {"z": n_slices(s, d), "y": HEIGHT, "x": WIDTH}
    return out(V.blur_whole(base(s, d), "inten", "g", (1.0, 1.0, 1.0), size=size), "g", digits=None)


def cls_14_prediction_image(s: SparkSession, d: str) -> DataFrame:
    """Positive cells as bright voxels of an image as large as the cells' extents, blurred without building it."""
    c = FE.feature_columns(cells(s, d)).select("f1", (F.col("lz") / 5).alias("z"), (F.col("ly") / 100).alias("y"), (F.col("lx") / 100).alias("x"))
    hit = c.where(FE.above(F.col("f1"), 4.5)).select(*[F.floor(a).alias(a) for a in "zyx"]).distinct().withColumn("g", F.lit(5000))
    return E.sparse_blur(hit, "g", E.extents(c), {"z": 1.0, "y": 2.0, "x": 2.0})


def eva_10_region_image(s: SparkSession, d: str) -> DataFrame:
    return M.region_image(base(s, d).select("z", "y", "x", "inten"), (2, 6), (5, 30), (10, 40), WIDTH, HEIGHT, flip_x=True, flip_y=True)


def eva_13_stages(s: SparkSession, d: str) -> DataFrame:
    """Every stage of the chain on a region: difference of Gaussians and the planes of its Hessian."""
    df = V.hessian(V.difference_of_gaussians(base(s, d), "v", "dog", S_SMALL, S_LARGE), "dog")
    return out(M.region_image(df.select("z", "y", "x", "dog", *HESS), (0, 8), (5, 30), (10, 40), WIDTH, HEIGHT), "dog", *HESS)


def regions(s: SparkSession, d: str) -> DataFrame:
    df = V.hessian(base(s, d).withColumnRenamed("v", "norm"), "norm")
    return R.region_features(df, "label", value="norm", intensity="inten")


def agg_01_09_features(s: SparkSession, d: str) -> DataFrame:
    r = regions(s, d)
    sums = [c for c in r.columns if c.startswith("sum_") or c in ("cz", "cy", "cx", "mean_norm")]
    return r.select("label", "n_voxels", "size", "max_norm", "min_norm", "max_intensity", *[F.round(c, 6).alias(c) for c in sums])


def agg_10_eigen(s: SparkSession, d: str) -> DataFrame:
    """Of every voxel row's summed Hessian: trace and shape features."""
    df = V.hessian(base(s, d), "inten").groupBy("z", "y").agg(*[F.sum(h).alias(h) for h in HESS])
    df = with_eigenvalues(df, HESS)
    e = [F.col(c) for c in ("e0", "e1", "e2")]
    return df.select("z", "y", *[F.round(F.col(c) * TIELESS, 3).alias(c) for c in ("e0", "e1", "e2")], F.round(F.col("e0") + F.col("e1") + F.col("e2"), 3).alias("trace"), F.round(structureness(*e) * TIELESS * 1e-6, 3).alias("structureness"), F.round(e[0] * e[1] * e[2] * TIELESS * 1e-9, 3).alias("det"))


def cpu_01_scale_response(s: SparkSession, d: str) -> DataFrame:
    df = base(s, d).withColumn("m", F.col("inten") > 6000)
    return R.masked_mean(df, "v", "m", ["label"]).select("label", F.round("response", 9).alias("response"))


def ccl_01_components(s: SparkSession, d: str) -> DataFrame:
    fg = base(s, d).where("v > 0.12")
    return CC.label_components(fg, HEIGHT, WIDTH).select("z", "y", "x", "label")


def ccl_regions(s: SparkSession, d: str) -> DataFrame:
    """Components and their aggregates."""
    fg = base(s, d).where("v > 0.12")
    lab = CC.label_components(fg, HEIGHT, WIDTH, slab=4)
    df = fg.drop("label").join(lab, ["z", "y", "x"]).withColumnRenamed("v", "norm")
    r = R.region_features(df, "label")
    return r.select("label", "size", "max_norm", *[F.round(c, 6).alias(c) for c in ("cz", "cy", "cx", "sum_norm")])


def lines(s: SparkSession, d: str) -> DataFrame:
    """The volume's lines along x, an array each."""
    return table(s, d, "embeddings").select(F.expr("vec_id div 50").alias("z"), F.expr("vec_id % 50").alias("y"), "embedding")


def two_stacks(s: SparkSession, d: str) -> tuple[DataFrame, B.Grid]:
    """The volume and its negative as two stacks, in pieces of blocks."""
    sign = F.explode(F.create_map(F.lit("bright"), F.lit(1.0), F.lit("dark"), F.lit(-1.0))).alias("stack", "sign")
    both = B.with_depth(lines(s, d), (), F.col("z")).select("*", sign)
    both = both.withColumn("v", F.transform("embedding", lambda v: v.cast("double") * F.col("sign")))
    grid = B.Grid(HEIGHT, WIDTH, (4, 16, 16), ("stack",))
    return B.from_lines(both, "v", grid, (0, 0, 0)), grid


def ccl_blocks(s: SparkSession, d: str) -> DataFrame:
    """Components of two stacks, labelled in blocks and joined over faces."""
    blocks, grid = two_stacks(s, d)
    return B.label_blocks(blocks, grid, lambda v: v > 0.15)


def ccl_blocks_wrap(s: SparkSession, d: str) -> DataFrame:
    """The same where rows run on into each other."""
    blocks, grid = two_stacks(s, d)
    return B.label_blocks(blocks, grid, lambda v: v > 0.15, wrap=True)


def flt_04_blocks(s: SparkSession, d: str) -> DataFrame:
    """Local contrast on blocks, with one exchange of halos."""
    grid = B.Grid(HEIGHT, WIDTH, (10, 32, 32), fill=float("nan"))
    blocks = B.from_lines(B.with_depth(lines(s, d), (), F.col("z")).withColumn("v", _intensities()), "v", grid)
    return out(_tieless(B.voxels(B.normalize(blocks, grid, RADII, SMALL, LEAST), grid.marked, "norm")), "norm", digits=8)


def flt_04_blocks_wide(s: SparkSession, d: str) -> DataFrame:
    """Radii beyond a block: an exchange along each axis."""
    grid = B.Grid(HEIGHT, WIDTH, (10, 16, 16), fill=float("nan"))
    blocks = B.from_lines(B.with_depth(lines(s, d), (), F.col("z")).withColumn("v", _intensities()), "v", grid)
    return out(_tieless(B.voxels(B.normalize(blocks, grid, WIDE, WIDE, LEAST), grid.marked, "norm")), "norm", digits=8)


def mrg_05_rotate_flip(s: SparkSession, d: str) -> DataFrame:
    df = base(s, d)
    x, y = M.turned(F.col("x"), F.col("y"), WIDTH, HEIGHT, M.ROTATE_CW | M.FLIP_X)
    x2, y2 = M.turned(F.col("x"), F.col("y"), WIDTH, HEIGHT, M.ROTATE_CCW | M.FLIP_Y)
    return df.select("z", x.alias("rx"), y.alias("ry"), x2.alias("qx"), y2.alias("qy"), "inten")


def blocks(s: SparkSession, d: str) -> DataFrame:
    df = base(s, d).withColumns({"tile_x": (F.col("z") % 2).cast("int"), "tile_y": F.expr("z div 2 % 2").cast("int")})
    return M.block_aggregate(df, "inten", 2, 1, 6, 7, 10, 7, ["z", "tile_x", "tile_y"])


def mrg_06_block_agg(s: SparkSession, d: str) -> DataFrame:
    return blocks(s, d).select("z", "bx", "by", "mean", "max", "min")


def mrg_07_09_mosaic(s: SparkSession, d: str) -> DataFrame:
    """Blocks to mosaic, with the grid drawn in, mirrored."""
    m = M.mirror(M.grid_overlay(M.place_tiles(blocks(s, d), 10, 7), "mean"), 20, 14, M.FLIP_X)
    return m.select("z", "mx", "my", "mean")


def mrg_01_plan(s: SparkSession, d: str) -> DataFrame:
    """Slices of two half scans that overlap, merged at a boundary; every second slice."""
    z = slice_numbers(s, d)
    sl = z.select(F.lit("FW").alias("side"), F.col("z").cast("int").alias("index")).unionByName(z.select(F.lit("RV").alias("side"), F.col("z").cast("int").alias("index")))
    _, sides, strips = M.case_of(5.0, 5.0, 0.0, 45.0, 30.0)
    return M.plan_slices(sl, {"FW": 7, "RV": 1}, {"FW": 2, "RV": 2}, sides, strips, "RV")


def mrg_02_bounds(s: SparkSession, d: str) -> DataFrame:
    """Cells of each side within its closed range of valid z."""
    _, sides, _ = M.case_of(5.0, 5.0, 0.0, 45.0, 30.0)
    bound = M.z_bounds(sides, {"FW": 250.0, "RV": 200.0}, False)
    z = F.col("lz") * 5.0
    ok = F.when(F.col("side") == "FW", C.valid_between(z, *bound["FW"])).otherwise(C.valid_between(z, *bound["RV"]))
    return cells(s, d).groupBy("side", ok.alias("ok")).agg(F.count("*").alias("n"))


def _plan(s: SparkSession, d: str, reverse: bool = False) -> DataFrame:
    z = slice_numbers(s, d).select(F.col("z").cast("int").alias("index"))
    sl = z.select(F.explode(F.array(F.lit("FW"), F.lit("RV"))).alias("side"), "index")
    _, sides, strips = M.case_of(5.0, 5.0, 0.0, 45.0, 30.0)
    return M.plan_slices(sl, {"FW": 7, "RV": 1}, {"FW": 2, "RV": 2}, sides, strips, "RV", reverse)


def mrg_03_reversed(s: SparkSession, d: str) -> DataFrame:
    return _plan(s, d, True)


def mrg_04_geometry(s: SparkSession, d: str) -> DataFrame:
    """Slices scaled down by a tile's geometry: pixels without margins, every skip-th slice."""
    g = M.downscale(-0.65, 5.0, 13.0, WIDTH, HEIGHT, (2, 1, 2, 1))
    x, y = F.floor((F.col("x") - 2) * g.actual[0]).cast("int"), F.floor((F.col("y") - 1) * g.actual[1]).cast("int")
    df = base(s, d).where(F.col("z") % g.skip_z == 0).withColumns({"bx": x, "by": y})
    df = df.where((F.col("x") >= 2) & (F.col("y") >= 1) & (F.col("bx") < g.sampled[0]) & (F.col("by") < g.sampled[1]))
    return df.groupBy("z", "bx", "by").agg(F.expr("sum(cast(inten as bigint)) div count(*)").alias("mean"))


def mrg_10_volume(s: SparkSession, d: str) -> DataFrame:
    """Planned slices of both sides, aggregated in blocks, as one volume."""
    planes = blocks(s, d).select(F.explode(F.array(F.lit("FW"), F.lit("RV"))).alias("side"), F.col("z").cast("int").alias("index"), "bx", "by", "mean", "max", "min")
    return M.stack_planes(planes, _plan(s, d), ["side", "index"]).select("mz", "by", "bx", "mean", "max", "min")


def mrg_11_every_slice(s: SparkSession, d: str) -> DataFrame:
    """Mean blocks of every third slice name that any tile has."""
    b = blocks(s, d)
    return M.stack_planes(b, M.every_slice(b, "z", 3), ["z"]).select("z", "mz", "by", "bx", "mean")


def detect_end_to_end(s: SparkSession, d: str) -> DataFrame:
    """Tiles of substacks through the whole chain to candidates; each tile is one numpy kernel call."""
    return detect.detect_lines(lines(s, d).select("z", "y", _intensities().alias("inten")), "inten", HEIGHT, WIDTH, detect.Settings(depth=8, extra_margin=1), tile=32)


def _pass(src: str, name: str, axis: str, expr: str, cols: str = "z, y, x, inten") -> str:
    other = {"x": "z, y", "y": "z, x", "z": "y, x"}[axis]
    return f"{name} AS (SELECT {cols}, {expr} FROM {src} WINDOW w AS (PARTITION BY {other} ORDER BY {axis}), q AS (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def _frame(fn: str, c: str, axis: str, r: int) -> str:
    other = {"x": "z, y", "y": "z, x", "z": "y, x"}[axis]
    return f"{fn}({c}) OVER (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


def _box(c: str, axis: str, r: int) -> str:
    return f"({_frame('sum', c, axis, r)} + greatest(0, {r} - (row_number() OVER w - 1)) * first_value({c}) OVER q + greatest(0, {r} - (count(*) OVER q - row_number() OVER w)) * last_value({c}) OVER q) / {2 * r + 1}"


def _gauss(c: str, w: list[float]) -> str:
    r = len(w) // 2
    return " + ".join(f"{k!r} * " + (c if not j else f"coalesce({'lag' if j < 0 else 'lead'}({c}, {abs(j)}) OVER w, 0)") for j, k in zip(range(-r, r + 1), w, strict=True))


def _chain(steps: list[tuple[str, str]], c: str = "v", cols: str = "z, y, x, inten") -> str:
    """steps: (axis, expression with {c}); the last CTE is named last."""
    ctes, src = [VOX, f"p0 AS (SELECT z, y, x, inten, v, {c} AS c FROM vox)"], "p0"
    for i, (axis, e) in enumerate(steps):
        name = "last" if i == len(steps) - 1 else f"p{i + 1}"
        ctes.append(_pass(src, name, axis, e.replace("{c}", "c") + " AS c", cols))
        src = name
    return "WITH " + ", ".join(ctes)


def _sep(f, c: str = "v") -> str:  # noqa: ANN001
    return _chain([(a, f(a)) for a in "xyz"], c)


def _mirror(src: str, n: dict[str, str], weights: dict[str, list[float]], key: str = "") -> str:
    """CTEs of a blur of src (z, y, x, c) in whole numbers, borders mirrored; the last one is named blurred."""
    ctes = []
    for i, a in enumerate("zyx"):
        w = weights[a]
        j = f"(g.{a} + w.j)"
        at = f"CASE WHEN {j} < 0 THEN -{j} - 1 WHEN {j} >= {n[a]} THEN 2 * {n[a]} - 1 - {j} ELSE {j} END"
        rest = " AND ".join(f"s.{b} = g.{b}" for b in [*"zyx", *([key] if key else [])] if b != a)
        more = f"g.{key}, " if key else ""
        values = ", ".join(f"({k - len(w) // 2}, CAST({x!r} AS DOUBLE))" for k, x in enumerate(w))
        name = "blurred" if i == 2 else f"m{i}"
        ctes.append(f"{name} AS (SELECT {more}g.z, g.y, g.x, floor(round(sum(w.k * s.c), 6)) AS c FROM {src} g JOIN (VALUES {values}) w(j, k) ON true JOIN {src} s ON s.{a} = {at} AND {rest} GROUP BY ALL)")
        src = name
    return ", ".join(ctes)


def _r(a: str) -> int:
    return dict(zip("xyz", RADII, strict=True))[a]


def _sig(p: tuple[float, float], a: str) -> list[float]:
    return V.gaussian_weights(p[1] if a == "z" else p[0])


def _grad(c: str, axis: str) -> str:
    o = {"x": "z, y", "y": "z, x", "z": "y, x"}[axis]
    return f"(coalesce(lead({c}) OVER (PARTITION BY {o} ORDER BY {axis}), 0) - coalesce(lag({c}) OVER (PARTITION BY {o} ORDER BY {axis}), 0)) * CAST(0.5 AS DOUBLE)"


def _hess(c: str) -> str:
    return f"""WITH {VOX}, g AS (SELECT z, y, x, inten, v, label, {_grad(c, 'x')} AS gx, {_grad(c, 'y')} AS gy, {_grad(c, 'z')} AS gz FROM vox),
      h AS (SELECT z, y, x, inten, v, label, {_grad('gx', 'x')} AS xx, {_grad('gx', 'y')} AS xy, {_grad('gx', 'z')} AS xz, {_grad('gy', 'y')} AS yy, {_grad('gy', 'z')} AS yz, {_grad('gz', 'z')} AS zz FROM g)"""


def _norm_sql(radii: tuple[int, int, int] = RADII, factor: float = 1.0) -> str:
    _r = dict(zip("xyz", radii, strict=True)).__getitem__

    def side(fn: str, p: str) -> str:
        steps = [(a, _frame(fn, "{c}", a, _r(a))) for a in "xyz"] + [(a, _box("{c}", a, _r(a))) for a in "zyx"]
        ctes, src = [], "p0"
        for i, (axis, e) in enumerate(steps):
            ctes.append(_pass(src, f"{p}{i}", axis, e.replace("{c}", "c") + " AS c"))
            src = f"{p}{i}"
        return ", ".join(ctes)

    return f"""WITH {VOX}, p0 AS (SELECT z, y, x, inten, CAST(inten AS DOUBLE) AS c FROM vox), {side('min', 'e')}, {side('max', 'd')}
      SELECT z, y, x, round(CASE WHEN inten >= {LEAST} THEN CASE WHEN d5.c <> e5.c THEN (inten - e5.c) / (d5.c - e5.c) WHEN inten = e5.c THEN 'nan'::DOUBLE WHEN inten > e5.c THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE 0 END * {factor!r}::DOUBLE, 8) AS norm
      FROM e5 JOIN d5 USING (z, y, x, inten)"""


_DOG = f"""WITH {VOX}, p0 AS (SELECT z, y, x, inten, v AS c FROM vox), """ + ", ".join(
    _pass(f"{p}{i - 1}" if i else "p0", f"{p}{i}", a, _gauss("c", _sig(sig, a)) + " AS c") for p, sig in (("s", S_SMALL), ("l", S_LARGE)) for i, a in enumerate("xyz")
)
_ZERO = "CASE WHEN {n} = 5 THEN {m} ELSE least(0.0, {m}) END"
_CCL = f"""WITH RECURSIVE {VOX}, fg AS (SELECT z, y, x, z * 3200 + y * 64 + x AS id, v FROM vox WHERE v > 0.12),
  d AS (SELECT unnest([-1, 0, 1]) AS o), e AS (SELECT a.id AS a, b.id AS b FROM (SELECT fg.*, dz.o AS i, dy.o AS j, dx.o AS k FROM fg, d dz, d dy, d dx) a
    JOIN fg b ON b.z = a.z + a.i AND b.y = a.y + a.j AND b.x = a.x + a.k),
  lab(id, label) USING KEY (id) AS (SELECT id, id FROM fg UNION
    (SELECT e.b, min(l.label) FROM lab l JOIN e ON e.a = l.id JOIN recurring.lab r ON r.id = e.b WHERE l.label < r.label GROUP BY e.b))"""
_LATER = [d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def _ccl_stacks(least: float, wrap: bool) -> str:
    """Components of the volume and its negative; with wrap neighbours are steps of the linear number."""
    steps = ", ".join(f"({i}, {j}, {k}, {(i * 50 + j) * 64 + k})" for i, j, k in _LATER)
    near = "b.id = a.id + o.step" if wrap else "b.z = a.z + o.i AND b.y = a.y + o.j AND b.x = a.x + o.k"
    return f"""WITH RECURSIVE {VOX}, fg AS (SELECT s.stack, s.no * 1000000000 + z * 3200 + y * 64 + x AS id, z, y, x FROM vox, (VALUES ('bright', 0, 1.0), ('dark', 1, -1.0)) s(stack, no, sign) WHERE v * sign > {least}),
  o(i, j, k, step) AS (VALUES {steps}), e1 AS (SELECT a.id AS a, b.id AS b FROM fg a, o, fg b WHERE a.stack = b.stack AND {near}), e AS (SELECT a, b FROM e1 UNION ALL SELECT b, a FROM e1),
  lab(id, label) USING KEY (id) AS (SELECT id, id FROM fg UNION
    (SELECT e.b, min(l.label) FROM lab l JOIN e ON e.a = l.id JOIN recurring.lab r ON r.id = e.b WHERE l.label < r.label GROUP BY e.b))
  SELECT stack, z, y, x, label % 1000000000 AS label FROM fg JOIN lab USING (id)"""


_BLOCK = f"""WITH {VOX}, b AS (SELECT z, CAST(floor((x - 2) / 6.0) AS INTEGER) AS bx, CAST(floor((y - 1) / 7.0) AS INTEGER) AS "by", inten FROM vox WHERE x >= 2 AND y >= 1),
  a AS (SELECT z, bx, "by", CAST(sum(inten) AS BIGINT) // count(*) AS mean, max(inten) AS max, min(inten) AS min FROM b WHERE bx < 10 AND "by" < 7 GROUP BY ALL)"""

_PLAN = """zz AS (SELECT DISTINCT CAST(z AS INTEGER) AS index FROM vox), p AS (SELECT 'FW' AS side, index FROM zz WHERE index < 7 AND (7 - index) % 2 = 0 UNION ALL SELECT 'RV', index FROM zz WHERE index >= 1 AND (index - 1) % 2 = 0)"""

ORACLE = {
    "flt_01_erosion": _sep(lambda a: _frame("min", "{c}", a, _r(a))) + " SELECT z, y, x, c AS e FROM last",
    "flt_02_dilation": _sep(lambda a: _frame("max", "{c}", a, _r(a))) + " SELECT z, y, x, c AS e FROM last",
    "flt_03_box": _sep(lambda a: _box("{c}", a, _r(a))) + " SELECT z, y, x, round(c, 9) AS b FROM last",
    "flt_04_normalize": _norm_sql(),
    "flt_04_blocks": _norm_sql(RADII, TIELESS),
    "flt_04_normalize_wide": _norm_sql(WIDE, TIELESS),
    "flt_04_blocks_wide": _norm_sql(WIDE, TIELESS),
    "flt_05_copy_threshold": f"WITH {VOX} SELECT z, y, x, CASE WHEN inten >= {LEAST} THEN CAST(inten AS DOUBLE) ELSE 0.0 END AS norm FROM vox",
    "flt_06_zero_erosion": _sep(lambda a: _ZERO.format(n=_frame("count", "{c}", a, 2), m=_frame("min", "{c}", a, 2))) + " SELECT z, y, x, c AS v FROM last",
    "flt_08_gaussian": _sep(lambda a: _gauss("{c}", _sig(S_SMALL, a))) + " SELECT z, y, x, round(c, 9) AS g FROM last",
    "flt_09_dog": _DOG + f" SELECT z, y, x, round((s2.c - l2.c) * {V.dog_factor(*S_SMALL, 1.0)!r}, 9) AS dog FROM s2 JOIN l2 USING (z, y, x, inten)",
    "flt_10_gradient": f"WITH {VOX} SELECT z, y, x, " + ", ".join(f"round({_grad('v', a)}, 10) AS g{a}" for a in "xyz") + " FROM vox",
    "flt_11_hessian": _hess("v") + " SELECT z, y, x, " + ", ".join(f"round({h}, 10) AS {h}" for h in HESS) + " FROM h",
    "flt_12_negative_definite": _hess("inten") + " SELECT z, xx < 0 AND xx * yy - xy * xy > 0 AND xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) < 0 AS pd, count(*) AS n FROM h GROUP BY ALL",
    "flt_14_gaussian_u16": f"WITH {VOX}, p0 AS (SELECT z, y, x, CAST(inten AS DOUBLE) AS c FROM vox), " + _mirror("p0", {"z": "(SELECT max(z) + 1 FROM vox)", "y": "50", "x": "64"}, dict.fromkeys("zyx", V.gaussian_weights(1.0))) + " SELECT z, y, x, c AS g FROM blurred",
    "cls_14_prediction_image": f"""WITH {CELLS}, hit AS (SELECT DISTINCT CAST(floor(lz / 5) AS BIGINT) AS z, CAST(floor(ly / 100) AS BIGINT) AS y, CAST(floor(lx / 100) AS BIGINT) AS x FROM cells WHERE {F1} > 4.5),
      grid AS (SELECT i // 572 AS z, i // 26 % 22 AS y, i % 26 AS x FROM (SELECT unnest(range(11440)) AS i)), p0 AS (SELECT grid.z, grid.y, grid.x, CASE WHEN hit.z IS NULL THEN 0.0::DOUBLE ELSE 5000.0::DOUBLE END AS c FROM grid LEFT JOIN hit ON hit.z = grid.z AND hit.y = grid.y AND hit.x = grid.x), """
    + _mirror("p0", {"z": "20", "y": "22", "x": "26"}, {"z": V.gaussian_weights(1.0), "y": V.gaussian_weights(2.0), "x": V.gaussian_weights(2.0)}) + " SELECT z, y, x, c AS g FROM blurred WHERE c > 0",
    "eva_10_region_image": f"WITH {VOX} SELECT z - 2 AS z, 49 - y - 5 AS y, 63 - x - 10 AS x, inten FROM vox WHERE z >= 2 AND z < 6 AND 49 - y BETWEEN 5 AND 29 AND 63 - x BETWEEN 10 AND 39",
    "eva_13_stages": _DOG + f", dg AS (SELECT z, y, x, (s2.c - l2.c) * {V.dog_factor(*S_SMALL, 1.0)!r} AS dog FROM s2 JOIN l2 USING (z, y, x, inten)), g AS (SELECT z, y, x, dog, {_grad('dog', 'x')} AS gx, {_grad('dog', 'y')} AS gy, {_grad('dog', 'z')} AS gz FROM dg), "
    + f"h AS (SELECT z, y, x, dog, {_grad('gx', 'x')} AS xx, {_grad('gx', 'y')} AS xy, {_grad('gx', 'z')} AS xz, {_grad('gy', 'y')} AS yy, {_grad('gy', 'z')} AS yz, {_grad('gz', 'z')} AS zz FROM g) SELECT z, y - 5 AS y, x - 10 AS x, "
    + ", ".join(f"round({c}, 9) AS {c}" for c in ("dog", *HESS)) + " FROM h WHERE z < 8 AND y BETWEEN 5 AND 29 AND x BETWEEN 10 AND 39",
    "agg_01_09_features": _hess("v") + """ SELECT label, count(*) AS n_voxels, CAST(count(*) % 65536 AS INTEGER) AS size, max(v) AS max_norm, min(v) AS min_norm, max(inten) AS max_intensity, round(sum(v), 6) AS sum_norm,
      round(avg(v), 6) AS mean_norm, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, """ + ", ".join(f"round(sum({h}), 6) AS sum_{h}" for h in HESS) + " FROM h GROUP BY label",
    "agg_10_eigen": _hess("inten") + """, m AS (SELECT z, y, sum(xx) AS xx, sum(xy) AS xy, sum(xz) AS xz, sum(yy) AS yy, sum(yz) AS yz, sum(zz) AS zz FROM h GROUP BY z, y),
      q AS (SELECT *, (xx + yy + zz) / 3 AS q, xy * xy + xz * xz + yz * yz AS off FROM m), p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * off) / 6) AS p FROM q),
      t AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3)))) / 3 AS t FROM p)
      SELECT z, y, round((q + 2 * p * cos(t + 2 * pi() / 3)) * CAST(0.7310585 AS DOUBLE), 3) AS e0, round((q - 2 * p * (cos(t) + cos(t + 2 * pi() / 3))) * CAST(0.7310585 AS DOUBLE), 3) AS e1, round((q + 2 * p * cos(t)) * CAST(0.7310585 AS DOUBLE), 3) AS e2, round(xx + yy + zz, 3) AS trace, round((xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)) * CAST(0.7310585 AS DOUBLE) * 1e-6, 3) AS structureness,
      round((xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) * CAST(0.7310585 AS DOUBLE) * 1e-9, 3) AS det FROM t""",
    "cpu_01_scale_response": f"WITH {VOX} SELECT label, round(avg(v) FILTER (WHERE inten > 6000), 9) AS response FROM vox GROUP BY label",
    "ccl_01_components": _CCL + " SELECT z, y, x, label FROM fg JOIN lab USING (id)",
    "ccl_blocks": _ccl_stacks(0.15, False),
    "ccl_blocks_wrap": _ccl_stacks(0.15, True),
    "ccl_regions": _CCL + " SELECT label, CAST(count(*) AS INTEGER) AS size, max(v) AS max_norm, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, round(sum(v), 6) AS sum_norm FROM fg JOIN lab USING (id) GROUP BY label",
    "mrg_05_rotate_flip": f"WITH {VOX} SELECT z, 49 - (49 - y) AS rx, x AS ry, y AS qx, 63 - (63 - x) AS qy, inten FROM vox",
    "mrg_06_block_agg": _BLOCK + ' SELECT z, bx, "by", mean, max, min FROM a',
    "mrg_07_09_mosaic": _BLOCK + " SELECT z, CAST(19 - ((z % 2) * 10 + bx) AS INTEGER) AS mx, CAST((z // 2 % 2) * 7 + \"by\" AS INTEGER) AS my, CASE WHEN bx = 0 OR \"by\" = 0 THEN 5000 ELSE mean END AS mean FROM a",
    "mrg_02_bounds": f"WITH {CELLS} SELECT side, CASE WHEN side = 'FW' THEN lz * 5 <= 250 ELSE lz * 5 >= 200 END AS ok, count(*) AS n FROM cells GROUP BY ALL",
    "mrg_03_reversed": f"WITH {VOX}, {_PLAN} SELECT side, index, CAST(row_number() OVER (ORDER BY side DESC, index DESC) - 1 AS INTEGER) AS position FROM p",
    "mrg_04_geometry": f"""WITH {VOX}, b AS (SELECT z, CAST(floor((x - 2) * (CAST(3 AS DOUBLE) / 60)) AS INTEGER) AS bx, CAST(floor((y - 1) * (CAST(2 AS DOUBLE) / 48)) AS INTEGER) AS "by", inten FROM vox WHERE x >= 2 AND y >= 1 AND z % 2 = 0)
      SELECT z, bx, "by", CAST(sum(inten) AS BIGINT) // count(*) AS mean FROM b WHERE bx < 3 AND "by" < 2 GROUP BY ALL""",
    "mrg_10_volume": _BLOCK + f', {_PLAN}, k AS (SELECT side, index, CAST(row_number() OVER (ORDER BY side, index) - 1 AS INTEGER) AS mz FROM p) SELECT mz, "by", bx, mean, max, min FROM k JOIN a ON a.z = k.index',
    "mrg_11_every_slice": _BLOCK + ', n AS (SELECT DISTINCT z, dense_rank() OVER (ORDER BY z) - 1 AS i FROM a) SELECT a.z, CAST(i // 3 AS INTEGER) AS mz, "by", bx, mean FROM a JOIN n ON n.z = a.z WHERE i % 3 = 0',
    "mrg_01_plan": f"""WITH {VOX}, z AS (SELECT DISTINCT CAST(z AS INTEGER) AS index FROM vox),
      p AS (SELECT 'FW' AS side, index FROM z WHERE index < 7 AND (7 - index) % 2 = 0 UNION ALL SELECT 'RV', index FROM z WHERE index >= 1 AND (index - 1) % 2 = 0)
      SELECT side, index, CAST(row_number() OVER (ORDER BY side, index) - 1 AS INTEGER) AS position FROM p""",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and k[:4] in ("flt_", "agg_", "cpu_", "ccl_", "mrg_", "dete", "eva_", "cls_")}
