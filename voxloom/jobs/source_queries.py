"""Queries on sources and sinks: ranges of slices, collections, atlas and marker files, flags of classified cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import cells as C
from ..operators import features as FE
from ..sources import datasource, raw
from ..sources import tables as T
from ..sources.shared import fresh_path
from .cell_queries import F1, ID
from .views import ATLAS, CELLS, HEIGHT, VOX, WIDTH, atlas, cells, slice_numbers, table


def _slices(s: SparkSession, d: str) -> DataFrame:
    """The volume's slices as files of two tiles, of which every second is missing; names count in fives."""
    z = slice_numbers(s, d)
    return z.select(F.lit("FW").alias("side"), F.lit("0000").alias("yname"), (F.col("z") % 2).cast("string").alias("xname"), F.lpad((F.col("z") * 5 + 100).cast("string"), 6, "0").alias("zname"))


def src_04_z_range(s: SparkSession, d: str) -> DataFrame:
    return raw.slice_range(_slices(s, d), 1, 4).select("xname", "zname")


def cel_05_slice_z(s: SparkSession, d: str) -> DataFrame:
    """Global z of a tile's own slices, and of the grid in which missing ones are filled in."""
    number, offset = F.col("zname").cast("int").alias("n"), F.col("xname").cast("int") * 10.0
    own = C.slice_global_z(_slices(s, d).select("xname", number), ["xname"], "n", offset, 2.5)
    full = C.slice_global_z(raw.complete_grid(_slices(s, d)).select("xname", number, "is_dummy"), ["xname"], "n", offset, 2.5, completed=True)
    return own.select("xname", "n", F.lit(False).alias("filled"), "global_z").unionByName(full.select("xname", "n", F.lit(True).alias("filled"), "global_z"))


def src_06_collection(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "collection")
    c = cells(s, d).select("side", F.col("iy").cast("string").alias("yname"), F.col("ix").cast("string").alias("xname"), F.col("lx").alias("local_x"), F.col("ly").alias("local_y"), F.col("lz").alias("local_z"), "structureness", "blobness", "intensity", "size")
    raw.write_records(c, path)
    return raw.collection_stats(raw.read_records(s, path))


def src_07_atlas_csv(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "atlas")
    atlas(s, d).select(F.col("x").alias("X(um)"), F.col("y").alias("Y(um)"), F.col("z").alias("Z(um)"), F.col("atlas_id").alias("atlasID")).write.option("header", "true").csv(path)
    return T.read_atlas(s, path).groupBy("atlas_id").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{c}") for c in "xyz"])


def src_13_markers(s: SparkSession, d: str) -> DataFrame:
    """Atlas points as marker files, one for each region; every third region holds markers of a type that doesn't count."""
    path = fresh_path(s, "markers")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("long").cast("string"), F.lit(f"</{name}>"))
    one = F.concat(F.lit("<Marker>"), tag("MarkerX", F.col("x")), tag("MarkerY", F.col("y")), tag("MarkerZ", F.col("z") + F.col("point_id") % 7), F.lit("</Marker>"))
    files = atlas(s, d).groupBy("atlas_id").agg(F.array_join(F.collect_list(one), "").alias("m"))
    doc = F.concat(F.lit("<CellCounter_Marker_File><Marker_Data><Marker_Type>"), tag("Type", F.col("atlas_id") % 3 + 1), F.col("m"), F.lit("</Marker_Type></Marker_Data></CellCounter_Marker_File>"))
    files.select(doc.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return T.read_markers(s, path, 2).groupBy("kind").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(f"s{c}") for c in "xyz"])


def _stack_files(s: SparkSession, d: str) -> str:
    """The volume as slice files of two stacks, which hold every second slice."""
    path = fresh_path(s, "stack-slices")
    lines = table(s, d, "embeddings").select(F.expr("vec_id div 50").alias("z"), F.expr("vec_id % 50").alias("y"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * 10000).cast("int")).alias("v"))
    grid = B.Grid(HEIGHT, WIDTH, (1, HEIGHT, WIDTH), dtype="<u2")
    slices = B.from_lines(B.with_depth(lines, (), F.col("z")), "v", grid)
    out = slices.select(F.lit("FW").alias("side"), F.lit("0").alias("yname"), (F.col("bz") % 2).cast("string").alias("xname"), F.lpad(F.col("bz").cast("string"), 6, "0").alias("zname"), F.col("data").alias("content"))
    datasource.register(s)
    out.write.format("raw_slices").option("path", path).mode("append").save()
    return path


def src_01_04_source(s: SparkSession, d: str) -> DataFrame:
    """Slices of one stack and a range of z through the data source, which opens only their files, in strips of lines."""
    found = datasource.read_slices(s, _stack_files(s, d), WIDTH, max_bytes=20 * WIDTH * 2, xname="1", low=1, high=4)
    return found.groupBy("zname", "z").agg(F.count("*").alias("strips"), F.sum(F.length("content")).alias("bytes"))


def snk_01_committed(s: SparkSession, d: str) -> DataFrame:
    """Candidates, filtered and written as records in the same tasks, then read back; writing twice over leaves one copy."""
    path = fresh_path(s, "committed")
    c = C.candidate(cells(s, d), "lz", "ly", "lx", depth=F.lit(100), margin=8, left=100, top=100, right=100, bottom=100, width=2560, height=2160, min_size=10)
    c = c.select("side", F.col("iy").cast("string").alias("yname"), F.col("ix").cast("string").alias("xname"), F.col("lx").alias("local_x"), F.col("ly").alias("local_y"), F.col("lz").alias("local_z"), "structureness", "blobness", "intensity", "size")
    for _ in range(2):
        datasource.write_records(c, path, "overwrite")
    back = datasource.read_records(s, path)
    return back.groupBy("side", "yname", "xname").agg(F.count("*").alias("n"), F.sum(F.col("local_x").cast("double")).alias("sx"), F.sum("size").alias("total"))


def src_08_09_pages(s: SparkSession, d: str) -> DataFrame:
    """Slices to pages of one file a stack, turned by a quarter, and back to voxel sums by line."""
    path = fresh_path(s, "pages")
    slices = datasource.read_slices(s, _stack_files(s, d), WIDTH)
    pages = datasource.every_page(slices, 0, -1, 2).select(F.concat("xname", F.lit(".tif")).alias("file"), "page", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), "content")
    datasource.write_pages(datasource.rotated(pages, -1), path)
    back = datasource.rotated(datasource.read_pages(s, path), 1)
    grid = B.Grid(HEIGHT, WIDTH, (1, HEIGHT, WIDTH), ("file",), "<u2")
    blocks = B.from_slices(back.select("file", (F.col("page") + 1).alias("depth"), F.col("page").alias("z"), "content"), grid)
    return B.voxels(blocks, grid).groupBy("file", F.col("z").alias("page"), "y").agg(F.sum(F.col("v") * (F.col("x") + 1)).cast("long").alias("total"))


def _flags(s: SparkSession, d: str, positive_only: bool = False) -> DataFrame:
    path = fresh_path(s, "flags")
    c = FE.feature_columns(cells(s, d))
    T.write_flags(c.select(*ID, "side", "iy", "ix", "f1", "lx"), FE.above(F.col("f1"), 4.5), path, ["side", "iy", "ix"])
    return T.read_flags(s, path, positive_only)


def cls_10_flags(s: SparkSession, d: str) -> DataFrame:
    """Flags of every stack, written and read again."""
    return _flags(s, d).groupBy("side", "iy", "ix", "is_positive").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def cls_15_positive_at_load(s: SparkSession, d: str) -> DataFrame:
    """Only positive cells of one side: the flag is a filter of the scan, the side prunes folders."""
    return _flags(s, d, True).where("side = 'FW'").select(*ID, "iy", "ix", "lx")


_SL = f"{VOX}, sl AS (SELECT DISTINCT CAST(z % 2 AS VARCHAR) AS xname, CAST(z * 5 + 100 AS INTEGER) AS n FROM vox)"
ORACLE = {
    "src_01_04_source": f"""WITH {VOX}, f AS (SELECT DISTINCT z, row_number() OVER (ORDER BY z) - 1 AS i FROM (SELECT DISTINCT z FROM vox WHERE z % 2 = 1))
      SELECT lpad(CAST(z AS VARCHAR), 6, '0') AS zname, i AS z, CAST(3 AS BIGINT) AS strips, CAST(6400 AS BIGINT) AS bytes FROM f WHERE i BETWEEN 1 AND 3""",
    "snk_01_committed": f"""WITH {CELLS} SELECT side, CAST(iy AS VARCHAR) AS yname, CAST(ix AS VARCHAR) AS xname, count(*) AS n, sum(lx) AS sx, CAST(sum(size) AS BIGINT) AS total FROM cells
      WHERE lz >= 8 AND lz < 92 AND lx >= 100 AND lx < 2460 AND ly >= 100 AND ly < 2060 AND size >= 10 AND intensity > 0 GROUP BY ALL""",
    "src_08_09_pages": f"""WITH {VOX} SELECT CAST(z % 2 AS VARCHAR) || '.tif' AS file, z // 2 // 2 AS page, y, CAST(sum(inten * (x + 1)) AS BIGINT) AS total FROM vox WHERE z // 2 % 2 = 0 GROUP BY ALL""",
    "src_04_z_range": f"WITH {_SL}, k AS (SELECT xname, n, row_number() OVER (PARTITION BY xname ORDER BY n) AS i FROM sl) SELECT xname, lpad(CAST(n AS VARCHAR), 6, '0') AS zname FROM k WHERE i BETWEEN 2 AND 4",
    "cel_05_slice_z": f"""WITH {_SL}, g AS (SELECT DISTINCT a.xname, b.n FROM sl a, sl b),
      o AS (SELECT xname, n, min(n) OVER (PARTITION BY xname) AS n0, coalesce(nth_value(n, 2) OVER (PARTITION BY xname ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - min(n) OVER (PARTITION BY xname), 1) AS gap FROM sl)
      SELECT xname, n, false AS filled, CAST(xname AS INTEGER) * 10.0::DOUBLE + (n - n0) / gap * 2.5::DOUBLE AS global_z FROM o
      UNION ALL SELECT xname, n, true, CAST(xname AS INTEGER) * 10.0::DOUBLE + (n - min(n) OVER (PARTITION BY xname)) * 2.5::DOUBLE FROM g""",
    "src_06_collection": f"""WITH {CELLS} SELECT side, count(DISTINCT ix * 3 + iy) AS stacks, count(*) AS n, """ + ", ".join(f"CAST({g}(l{a}) AS FLOAT) AS {g}_{a}" for a in "xyz" for g in ("min", "max")) + " FROM cells GROUP BY side",
    "src_07_atlas_csv": f"WITH {ATLAS} SELECT atlas_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM atlas GROUP BY atlas_id",
    "src_13_markers": f"""WITH {ATLAS} SELECT CASE atlas_id % 3 WHEN 1 THEN 'FP' ELSE 'FN' END AS kind, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum((CAST(z AS BIGINT) + point_id % 7) // 2) AS BIGINT) AS sz
      FROM atlas WHERE atlas_id % 3 <> 0 GROUP BY ALL""",
    "cls_10_flags": f"WITH {CELLS} SELECT side, iy, ix, {F1} > 4.5 AS is_positive, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM cells GROUP BY ALL",
    "cls_15_positive_at_load": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, iy, ix, lx FROM cells WHERE side = 'FW' AND {F1} > 4.5",
}
QUERIES = {k: f for k, f in globals().items() if callable(f) and k[:4] in ("src_", "snk_", "cel_", "cls_")}
