"""Raw files: 16-bit slices and packed cell records, laid out as {side}/{y}/{y}_{x}/{z}.bin and {side}/{y}_{x}.bin.

Reading goes through Spark's binaryFile source, so any store that Spark reads will do; listing leaves the contents
alone. Writing goes through pyarrow's file systems, from the tasks, into a folder that all of them share.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches

#: A packed record: six 32-bit floats, a 16-bit size and two bytes of padding; fixed values of the format.
RECORD = np.dtype([("local_x", "<f4"), ("local_y", "<f4"), ("local_z", "<f4"), ("structureness", "<f4"), ("blobness", "<f4"), ("intensity", "<f4"), ("size", "<u2"), ("padding", "<u2")])
#: Records of a file that go to Spark at once.
ROWS_READ = 1 << 16
_NAMES = r"([^/]+)/([^/]+)/\2_([^/]+)/([^/]+)\.bin$"


def _put(path: str, data: bytes) -> None:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, at)  # a task that runs twice at once writes the same file; readers see a whole one


def write_slices(voxels: DataFrame, path: str, height: int, width: int) -> None:
    """voxels: side, yname, xname, z, y, x, v. One file a slice; voxels that aren't given are 0."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        image = np.zeros((height, width), dtype="<u2")
        image[pdf["y"], pdf["x"]] = pdf["v"]
        _put(f"{path}/{r['side']}/{r['yname']}/{r['yname']}_{r['xname']}/{int(r['z']):06d}.bin", image.tobytes())
        return pd.DataFrame({"n": [len(pdf)]})

    voxels.groupBy("side", "yname", "xname", "z").applyInPandas(write, "n long").write.format("noop").mode("overwrite").save()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(path)


def _named(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.regexp_extract("path", _NAMES, i).alias(n) for i, n in enumerate(("side", "yname", "xname", "zname"), 1)])


def list_slices(spark: SparkSession, path: str) -> DataFrame:
    """side, yname, xname, zname of every slice; only the listing is read."""
    return _named(_files(spark, path).select("path")).drop("path")


def slice_range(slices: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """The slices low to high - 1 of each stack, counted from 0 in the order of their names."""
    w = Window.partitionBy("side", "yname", "xname").orderBy("zname")
    i = F.row_number().over(w) - 1
    at = slices.withColumn("__i", i)
    return at.where((F.lit(low is None) | (F.col("__i") >= (low or 0))) & (F.lit(high is None) | (F.col("__i") < (high or 0)))).drop("__i")


def collection_stats(records: DataFrame) -> DataFrame:
    """Stacks, records and the extremes of each coordinate, by side."""
    ends = [g(f"local_{a}").alias(f"{n}_{a}") for a in "xyz" for g, n in ((F.min, "min"), (F.max, "max"))]
    return records.groupBy("side").agg(F.countDistinct("yname", "xname").alias("stacks"), F.count("*").alias("n"), *ends)


def complete_grid(slices: DataFrame) -> DataFrame:
    """Every tile of a side with every slice name of the side; is_dummy marks those without a file."""
    tiles = slices.select("side", "yname", "xname").distinct()
    names = slices.select("side", "zname").distinct()
    full = tiles.join(names, "side")
    return full.join(slices.withColumn("__there", F.lit(True)), ["side", "yname", "xname", "zname"], "left").select("side", "yname", "xname", "zname", F.col("__there").isNull().alias("is_dummy"))


def read_voxels(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Slices as voxel rows; a file cut short gives the pixels that it has."""
    bounded_batches(spark)
    names = ["side", "yname", "xname", "zname"]
    files = _named(_files(spark, path).select("path", "content")).select(*names, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                content = b["content"][i].as_buffer()
                v = np.frombuffer(content, "<u2", len(content) // 2).astype(np.int32)
                y, x = np.divmod(np.arange(len(v)), width)
                same = pa.array(np.full(len(v), i))
                yield pa.RecordBatch.from_arrays([*[b[n].take(same) for n in names], pa.array(y), pa.array(x), pa.array(v)], names=[*names, "y", "x", "v"])

    return files.mapInArrow(run, "side string, yname string, xname string, zname string, y long, x long, v int")


def write_records(cells: DataFrame, path: str, rows_a_file: int = 250_000) -> None:
    """Packed files under {side}/{y}_{x}/. Nothing is shuffled: each task sorts its own rows and writes them as they pass, a stack
    after another, so that it holds one file. A task that runs twice writes the same files."""
    stack, fields = ["side", "yname", "xname"], RECORD.names[:-1]
    bounded_batches(cells.sparkSession)
    c = cells.dropna(subset=stack).select(*stack, *fields).sortWithinPartitions(*stack, *fields)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held, n, done = TaskContext.get().partitionId(), None, [], 0, 0

        def put() -> None:
            nonlocal held, n, done
            if n:
                _put(f"{path}/{now[0]}/{now[1]}_{now[2]}/{part:06d}-{done:06d}.bin", b"".join(held))
                held, n, done = [], 0, done + 1

        for b in batches:
            out = np.zeros(b.num_rows, dtype=RECORD)
            for f in fields:
                out[f] = b[f].to_numpy(zero_copy_only=False)
            keys = list(zip(*[b[k].to_pylist() for k in stack], strict=True))
            start = 0
            while start < len(keys):
                if keys[start] != now:
                    put()
                    now, done = keys[start], 0
                # rows are sorted, so the stack's rows end where its key does
                end = min(bisect.bisect_right(keys, now, start), start + rows_a_file - n)
                held.append(out[start:end].tobytes())
                n, start = n + end - start, end
                if n == rows_a_file:
                    put()
        put()
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    c.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with their stack and their place in the file (cell_seq); stacks without a file have no rows."""
    parts = [F.regexp_extract("path", r"([^/]+)/([^/_]+)_([^/]+)/([^/]+)\.bin$", i).alias(n) for i, n in enumerate(("side", "yname", "xname", "file"), 1)]
    bounded_batches(spark)
    names, fields = ["side", "yname", "xname", "file"], RECORD.names[:-1]
    files = _files(spark, path).select(*parts, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                content = b["content"][i].as_buffer()
                whole = np.frombuffer(content, RECORD, len(content) // RECORD.itemsize)
                for at in range(0, len(whole), ROWS_READ):
                    v = whole[at : at + ROWS_READ]
                    same = pa.array(np.full(len(v), i))
                    columns = [pa.array(np.ascontiguousarray(v[f]).astype(np.int32 if f == "size" else np.float32)) for f in fields]
                    yield pa.RecordBatch.from_arrays([*[b[n].take(same) for n in names], pa.array(np.arange(at, at + len(v))), *columns], names=[*names, "cell_seq", *fields])

    return files.mapInArrow(run, "side string, yname string, xname string, file string, cell_seq long, local_x float, local_y float, local_z float, structureness float, blobness float, intensity float, size int")
