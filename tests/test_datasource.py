"""Data sources: what is read, what is left out, and what repeated, failed and overwriting writes leave."""

import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.sources import datasource as D
from voxloom.sources import raw


def put(path, data=b""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture
def slices(tmp_path):
    top = str(tmp_path / "slices")
    for side, x, names in (("FW", "1", range(8)), ("FW", "2", range(4, 9)), ("RV", "1", range(3))):
        for n in names:
            put(f"{top}/{side}/0/0_{x}/{n * 5:04d}.bin", np.full(12, n, "<u2").tobytes()[: 10 if n == 7 else None])
    put(f"{top}/FW/0/0_1/9999.bin")
    put(f"{top}/_uncommitted/job/FW/0/0_1/0001.bin", b"x" * 24)
    put(f"{top}/FW/notes.bin", b"no slice")
    return top


def test_options_drop_files(slices):
    """Numbers are of the whole stack, and files out of the range aren't in any partition."""
    reader = D.SliceReader({"path": slices, "width": "4", "side": "FW", "xname": "2,7", "low": "1", "high": "3"})
    assert [(os.path.basename(p[0]), p[3][4]) for part in reader.partitions() for p in part.pieces] == [("0025.bin", 1), ("0030.bin", 2)]
    every = D.SliceReader({"path": slices, "width": "4", "max_bytes": "50"})
    assert [len(p.pieces) for p in every.partitions()][:2] == [2, 2] and sum(len(p.pieces) for p in every.partitions()) == 17


def test_slices_in_strips(spark, slices):
    df = D.read_slices(spark, slices, 4, max_bytes=16)
    got = df.where("side = 'FW' and xname = '1'").orderBy("z", "y0").collect()
    assert [(r.zname, r.z, r.y0, len(r.content)) for r in got if r.z >= 6] == [("0030", 6, 0, 16), ("0030", 6, 2, 8), ("0035", 7, 0, 10), ("9999", 8, 0, 0)]
    assert D.read_slices(spark, slices, 4, side="RV", low=2).select("zname").distinct().collect()[0].zname == "0010"
    assert D.read_slices(spark, slices, 4, side="no").count() == 0 and df.where("side = 'no'").count() == 0 and df.count() == 31 and D.read_slices(spark, slices + "/none", 4).count() == 0


CELL = "side string, yname string, xname string, local_x float, local_y float, local_z float, structureness float, blobness float, intensity float, size int"


def cells(spark, n, parts=3):
    rows = [("FW" if i % 3 else "RV", str(i % 2), str(i % 4), float(i), 0.5, 1.0, float("nan"), 0.0, 2.0, i % 70) for i in range(n)]
    return spark.createDataFrame(rows, CELL).repartition(parts)


def keys(df):
    return sorted((r.side, r.yname, r.xname, r.local_x, r["size"]) for r in df.collect())


def test_records_come_back(spark, tmp_path):
    path = str(tmp_path / "cells")
    df = cells(spark, 500)
    D.write_records(df, path)
    assert keys(D.read_records(spark, path)) == keys(df)
    back = D.read_records(spark, path, max_bytes=100)  # three records a partition
    assert keys(back) == keys(df) and back.groupBy("file", "side", "yname", "xname").agg(F.max("cell_seq") - F.count("*")).select(F.max("(max(cell_seq) - count(1))")).first()[0] == -1
    assert keys(D.read_records(spark, path, side="RV", xname="0,3")) == keys(df.where("side = 'RV' and xname in ('0', '3')"))
    D.write_records(df, path)
    assert D.read_records(spark, path).count() == 1000
    D.write_records(df.where("size > 60"), path, "overwrite")
    assert keys(D.read_records(spark, path)) == keys(df.where("size > 60"))
    D.write_records(df.limit(0), path, "overwrite")
    assert D.read_records(spark, path).count() == 0
    raw.write_records(df, f"file://{path}2")  # files of the other writer are read as well
    assert keys(D.read_records(spark, f"file://{path}2")) == keys(df)


def files(path):
    return sorted(f for d, _, names in os.walk(path) for f in names)


def test_attempts_leave_one_copy(tmp_path, monkeypatch):
    """A task that ran twice, one that failed half-way, and a job that was given up."""
    path = str(tmp_path / "cells")
    monkeypatch.setattr(D.TaskContext, "get", lambda: type("Task", (), {"partitionId": staticmethod(lambda: 4)}))
    batch = pa.RecordBatch.from_pydict({"side": ["FW"] * 3, "yname": ["0"] * 3, "xname": ["1", "2", "1"], **{f: [1.0, 2.0, 3.0] for f in D.RECORD.names[:6]}, "size": pa.array([1, 2, 3], pa.int32())})
    writer = D.RecordWriter(path, False, ".bin")
    writer.write(iter([batch]))  # this attempt's message is lost
    good = writer.write(iter([batch]))

    def breaks():
        yield batch
        raise OSError("gone")

    monkeypatch.setattr(D, "HELD_BYTES", 1)
    with pytest.raises(OSError, match="gone"):
        writer.write(breaks())
    assert D._listed(path, ".bin") == [] and len(files(path)) == 6
    writer.commit([good, None])
    assert len(files(path)) == 2 and sum(s for _, s in D._listed(path, ".bin")) == 3 * D.RECORD.itemsize
    other = D.RecordWriter(path, True, ".bin")
    other.abort([other.write(iter([batch]))])
    assert len(files(path)) == 2
    new = D.RecordWriter(path, True, ".bin")
    new.commit([new.write(iter([batch]))])
    assert all(f.startswith(new.job[:12]) for f in files(path)) and len(files(path)) == 2


def test_failed_write_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "cells")
    D.write_records(cells(spark, 40), path)
    before = files(path)
    broken = cells(spark, 400, 4).withColumn("size", F.when(F.col("local_x") == 399, F.raise_error("no").cast("int")).otherwise(F.col("size")))
    with pytest.raises(Exception, match="no"):
        D.write_records(broken, path, "overwrite")
    assert files(path) == before


def tiff(pages, order="<", strip=None):
    """A classic file, its pages cut into strips of so many lines."""
    out, patch = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for p in pages:
        rows = strip or p.shape[0]
        parts = [p[y : y + rows].astype(order + "u2").tobytes() for y in range(0, p.shape[0], rows)]
        at = []
        for part in parts:
            at.append(len(out))
            out += part
        lists = []
        for values in (at, [len(x) for x in parts]):
            lists.append(values[0] if len(values) == 1 else len(out))
            if len(values) > 1:
                out += struct.pack(f"{order}{len(values)}I", *values)
        tags = [(256, 4, 1, p.shape[1]), (257, 3, 1, p.shape[0]), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, len(parts), lists[0]), (277, 3, 1, 1), (278, 4, 1, rows), (279, 4, len(parts), lists[1]), (305, 2, 1, 0)]
        out[patch : patch + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, kind, n, v in tags:
            out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", v, 0) if kind == 3 else struct.pack(order + "I", v))
        patch = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def test_pages_of_images(spark, tmp_path):
    """Either byte order, several strips, pages of different shapes; then written, turned, and back."""
    rng = np.random.default_rng(1)
    a, b = [rng.integers(0, 65536, (5, 7)) for _ in range(3)], [rng.integers(0, 65536, (4, 3)), rng.integers(0, 65536, (2, 2))]
    put(f"{tmp_path}/in/a.tif", tiff(a, "<"))
    put(f"{tmp_path}/in/deep/b.tif", tiff(b, ">", 1))
    put(f"{tmp_path}/in/c.txt", b"no image")
    pages = D.read_pages(spark, f"{tmp_path}/in", max_bytes=80)

    def images(df):
        return {(r.file, r.page): np.frombuffer(r.content, "<u2").reshape(r.height, r.width).tolist() for r in df.collect()}

    want = {("a.tif", k): p.tolist() for k, p in enumerate(a)} | {("deep/b.tif", k): p.tolist() for k, p in enumerate(b)}
    assert images(pages) == want
    reader = D.PageReader({"path": f"{tmp_path}/in", "file": "a.tif", "low": "2"})
    assert sum(len(p.pieces) for p in reader.partitions()) == 1
    turned = D.rotated(pages.where("file = 'a.tif'"), -1)
    D.write_pages(turned, f"{tmp_path}/out")
    assert images(D.read_pages(spark, f"{tmp_path}/out")) == {("a.tif", k): np.rot90(p, -1).tolist() for k, p in enumerate(a)}
    assert images(D.rotated(D.read_pages(spark, f"{tmp_path}/out"), 1)) == {k: v for k, v in want.items() if k[0] == "a.tif"}
    with pytest.raises(Exception, match="differ in shape"):
        D.write_pages(pages, f"{tmp_path}/bad")
    assert files(f"{tmp_path}/bad") == []


def test_what_is_no_page(tmp_path):
    put(f"{tmp_path}/x.tif", b"II*\0")
    system, top = D._system(str(tmp_path))
    with pytest.raises((ValueError, struct.error)):
        D.page_directory(system, f"{top}/x.tif")
    eight = bytearray(tiff([np.ones((2, 2))]))
    at = eight.index(struct.pack("<HHI", 258, 3, 1))
    eight[at + 8] = 8
    put(f"{tmp_path}/y.tif", bytes(eight))
    with pytest.raises(ValueError, match="16-bit"):
        D.page_directory(system, f"{top}/y.tif")


def test_every_page(spark):
    df = spark.range(10).withColumnRenamed("id", "z")
    assert [(r.z, r.page) for r in D.every_page(df, 1, 8, 3).orderBy("z").collect()] == [(1, 0), (4, 1), (7, 2)]
    assert D.every_page(df, 2).count() == 8
