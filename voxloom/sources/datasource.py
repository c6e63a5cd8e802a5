"""Spark data sources: raw slices, packed cell records, and pages of 16-bit TIFF files.

Reading plans partitions from a listing with sizes: large files are cut by byte ranges, small ones share a partition, and
options that name stacks, files or a range of numbers drop files before anything is opened. (They are options, not pushed
filters: Spark keeps pushed filters with the source, where a second query on the same DataFrame meets them.) Writing goes to
names of the attempt; the commit gives the files of successful attempts their final names, so that a task that fails, is
repeated or runs twice leaves one copy. Paths are URIs or local paths that pyarrow's file systems open; on a cluster
they must be shared.

    register(spark)
    spark.read.format("raw_slices").options(path=path, width=2560, side="FW", low=100, high=132).load()
    cells.where(...).write.format("cell_records").option("path", path).mode("append").save()
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .raw import RECORD

#: Bytes that a partition reads, unless the option max_bytes says otherwise; bytes of records that a writing task holds.
MAX_BYTES, HELD_BYTES = 64 << 20, 32 << 20
_ATTEMPTS = "_uncommitted"


def register(spark: SparkSession) -> None:
    for source in (RawSlices, CellRecords, ImagePages):
        spark.dataSource.register(source)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w[\w+.-]+://", path) else f"file://{path}")


def _listed(path: str, ending: str) -> list[tuple[str, int]]:
    """Paths below a folder and their sizes, without attempts and hidden files."""
    system, top = _system(path)
    found = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending)]
    return sorted((n, s) for n, s in names if not any(p[:1] in "_." for p in n[len(top) :].strip("/").split("/")))


def _read(system: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)


@dataclass
class Pieces(InputPartition):
    """Ranges of files: (path, offset, length, what is known of them)."""

    pieces: list[tuple[str, int, int, tuple]]


class _Pruned(DataSourceReader):
    """Options that are applied to the listing: values (divided by commas) of what is known from a file's name, and
    numbers of slices or pages from `low` up to but without `high`."""

    known: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.values = {c: options[c].split(",") for c in self.known if options.get(c) is not None}
        self.low, self.high = int(options.get("low", 0)), int(options.get("high", 1 << 62))

    def kept(self, number: int | None = None, **known: str) -> bool:
        return all(known[c] in v for c, v in self.values.items() if c in known) and (number is None or self.low <= number < self.high)

    def packed(self, pieces: list[tuple[str, int, int, tuple]]) -> list[Pieces]:
        out, held = [], 0
        for p in pieces:
            if not out or held + p[2] > self.max_bytes:
                out.append(Pieces([]))
                held = 0
            out[-1].pieces.append(p)
            held += p[2]
        return out or [Pieces([])]


class SliceReader(_Pruned):
    known = ("side", "yname", "xname", "zname")

    def partitions(self) -> list[Pieces]:
        line = 2 * int(self.options["width"])
        step = max(1, self.max_bytes // line) * line
        stacks: dict[tuple[str, str, str], list[tuple[str, str, int]]] = {}
        for path, size in _listed(self.options["path"], ".bin"):
            if m := re.search(r"([^/]+)/([^/]+)/\2_([^/]+)/([^/]+)\.bin$", path):
                stacks.setdefault(m.group(1, 2, 3), []).append((m[4], path, size))
        out = []
        for (side, y, x), files in sorted(stacks.items()):
            for z, (name, path, size) in enumerate(sorted(files)):
                if self.kept(z, side=side, yname=y, xname=x, zname=name):
                    out += [(path, at, min(step, size - at), (side, y, x, name, z, at // line)) for at in range(0, max(size, 1), step)]
        return self.packed(out)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.options["path"])
        for path, at, length, (side, y, x, name, z, first) in partition.pieces:
            yield pa.RecordBatch.from_arrays([*[pa.array([v]) for v in (side, y, x, name)], pa.array([z], pa.int64()), pa.array([first], pa.int32()), pa.array([_read(system, path, at, length)], pa.binary())], names=["side", "yname", "xname", "zname", "z", "y0", "content"])


class _Attempts(DataSourceArrowWriter):
    """Files under the attempt's own names, and their publication."""

    def __init__(self, path: str, overwrite: bool, ending: str) -> None:
        self.path, self.overwrite, self.ending, self.job = path.rstrip("/"), overwrite, ending, uuid.uuid4().hex

    def put(self, final: str, data: bytes | Iterator[bytes]) -> tuple[str, str]:
        """Write one file; returns its name now and the one that it shall have."""
        system, top = _system(self.path)
        now = f"{_ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(f"{top}/{_ATTEMPTS}/{self.job}", recursive=True)
        with system.open_output_stream(f"{top}/{now}") as f:
            for part in [data] if isinstance(data, bytes) else data:
                f.write(part)
        return now, final

    def commit(self, messages: list[Committed | None]) -> None:
        system, top = _system(self.path)
        old = [p for p, _ in _listed(self.path, self.ending)] if self.overwrite else []
        final = set()
        for now, name in (x for m in messages if m for x in m.files):
            system.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
            system.move(f"{top}/{now}", f"{top}/{name}")
            final.add(f"{top}/{name}")
        for p in old:
            if p not in final:
                system.delete_file(p)
        self._sweep()

    def abort(self, messages: list[Committed | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Whatever attempts without success have left."""
        system, top = _system(self.path)
        if system.get_file_info(f"{top}/{_ATTEMPTS}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{_ATTEMPTS}/{self.job}")


@dataclass
class Committed(WriterCommitMessage):
    files: list[tuple[str, str]]


class SliceWriter(_Attempts):
    """One file a row: side, yname, xname, zname, content."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        files = []
        for b in iterator:
            for i in range(b.num_rows):
                side, y, x, name, content = (b[c][i].as_py() for c in ("side", "yname", "xname", "zname", "content"))
                files.append(self.put(f"{side}/{y}/{y}_{x}/{name}.bin", content or b""))
        return Committed(files)


class RawSlices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_slices"

    def schema(self) -> str:
        return "side string, yname string, xname string, zname string, z long, y0 int, content binary"

    def reader(self, schema: T.StructType) -> SliceReader:
        return SliceReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> SliceWriter:
        return SliceWriter(self.options["path"], overwrite, ".bin")


class RecordReader(_Pruned):
    known = ("side", "yname", "xname")

    def partitions(self) -> list[Pieces]:
        step = max(1, self.max_bytes // RECORD.itemsize) * RECORD.itemsize
        out = []
        for path, size in _listed(self.options["path"], ".bin"):
            m = re.search(r"([^/]+)/([^/_]+)_([^/]+?)(?:/([^/]+))?\.bin$", path)
            if m and self.kept(side=m[1], yname=m[2], xname=m[3]):
                whole = size // RECORD.itemsize * RECORD.itemsize
                out += [(path, at, min(step, whole - at), (m[1], m[2], m[3], m[4] or "")) for at in range(0, whole, step)]
        return self.packed(out)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.options["path"])
        fields = RECORD.names[:-1]
        for path, at, length, names in partition.pieces:
            v = np.frombuffer(_read(system, path, at, length), RECORD)
            same = [pa.array([n] * len(v), pa.string()) for n in names]
            columns = [pa.array(np.ascontiguousarray(v[f]).astype(np.int32 if f == "size" else np.float32)) for f in fields]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(v)) + at // RECORD.itemsize), *columns], names=["side", "yname", "xname", "file", "cell_seq", *fields])


class RecordWriter(_Attempts):
    """Records of each stack that a task meets, in files of their own; filters before the write run in the same task."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        files, held, size = [], {}, 0
        part = TaskContext.get().partitionId()
        for b in iterator:
            keys = list(zip(*[b[c].to_pylist() for c in ("side", "yname", "xname")], strict=True))
            out = np.zeros(b.num_rows, RECORD)
            for f in RECORD.names[:-1]:
                out[f] = b[f].to_numpy(zero_copy_only=False)
            order = sorted(range(len(keys)), key=keys.__getitem__)
            start = 0
            for k in range(1, len(order) + 1):
                if k == len(order) or keys[order[k]] != keys[order[start]]:
                    held.setdefault(keys[order[start]], []).append(out[order[start:k]].tobytes())
                    start = k
            size += out.nbytes
            if size >= HELD_BYTES:
                files += self._flush(held, part, len(files))
                size = 0
        return Committed(files + self._flush(held, part, len(files)))

    def _flush(self, held: dict[tuple, list[bytes]], part: int, done: int) -> list[tuple[str, str]]:
        out = [self.put(f"{side}/{y}_{x}/{self.job[:12]}-{part:06d}-{done + i:04d}.bin", b"".join(rows)) for i, ((side, y, x), rows) in enumerate(held.items())]
        held.clear()
        return out


class CellRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cell_records"

    def schema(self) -> str:
        kinds = ", ".join(f"{f} {'int' if f == 'size' else 'float'}" for f in RECORD.names[:-1])
        return f"side string, yname string, xname string, file string, cell_seq long, {kinds}"

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite, ".bin")


#: Tags of a page's directory; fixed values of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
_KINDS = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 16: "Q"}


def page_directory(system: fs.FileSystem, path: str) -> list[dict[str, Any]]:
    """Place and shape of each page, from the file's headers alone. Pages must hold 16-bit whole numbers in plain strips."""
    with system.open_input_file(path) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"no TIFF file: {path}")
        big = version == 43
        count, entry, pointer = ("Q", 20, "Q") if big else ("H", 12, "I")
        width = struct.calcsize(pointer)
        at = struct.unpack(order + pointer, head[8:16] if big else head[4:8])[0]
        pages = []
        while at:
            n_size = struct.calcsize(count)
            n = struct.unpack(order + count, f.read_at(n_size, at))[0]
            raw = f.read_at(n * entry + width, at + n_size)
            tags = {}
            for i in range(n):
                tag, kind, many = struct.unpack(order + "HH" + pointer, raw[i * entry : i * entry + 4 + width])
                if kind in _KINDS:
                    form = f"{order}{many}{_KINDS[kind]}" if len(_KINDS[kind]) == 1 else f"{order}{2 * many}I"
                    size, value = struct.calcsize(form), raw[i * entry + 4 + width : (i + 1) * entry]
                    tags[tag] = struct.unpack(form, value[:size] if size <= width else f.read_at(size, struct.unpack(order + pointer, value)[0]))
            if tags.get(BITS, (1,))[0] != 16 or tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1 or tags.get(FORMAT, (1,))[0] != 1:
                raise ValueError(f"page {len(pages)} of {path} isn't of plain unsigned 16-bit numbers")
            pages.append({"height": tags[LENGTH][0], "width": tags[WIDTH][0], "strips": list(zip(tags[OFFSETS], tags[COUNTS], strict=True)), "order": order})
            at = struct.unpack(order + pointer, raw[n * entry :])[0]
        return pages


class PageReader(_Pruned):
    known = ("file",)

    def partitions(self) -> list[Pieces]:
        system, top = _system(self.options["path"])
        out = []
        for path, _ in _listed(self.options["path"], ".tif"):
            name = path[len(top) :].strip("/")
            if self.kept(file=name):
                for k, p in enumerate(page_directory(system, path)):
                    if self.kept(k):
                        out.append((path, 0, sum(n for _, n in p["strips"]), (name, k, p)))
        return self.packed(out)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.options["path"])
        for path, _, _, (name, k, p) in partition.pieces:
            data = b"".join(_read(system, path, at, n) for at, n in p["strips"])
            data = np.frombuffer(data, p["order"] + "u2").astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([p["height"]], pa.int32()), pa.array([p["width"]], pa.int32()), pa.array([data], pa.binary())], names=["file", "page", "height", "width", "content"])


def _page(height: int, width: int, at: int, last: bool) -> bytes:
    """A page's directory (large format), behind its pixels that begin at `at`; the next page's directory is one page on."""
    size = 2 * height * width
    tags = [(WIDTH, 4, width), (LENGTH, 4, height), (BITS, 3, 16), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 16, at), (SAMPLES, 3, 1), (ROWS, 4, height), (COUNTS, 16, size), (FORMAT, 3, 1)]
    directory = at + size
    length = 8 + 20 * len(tags) + 8
    body = b"".join(struct.pack("<HHQQ", tag, kind, 1, value) for tag, kind, value in tags)
    return struct.pack("<Q", len(tags)) + body + struct.pack("<Q", 0 if last else directory + length + size)


class PageWriter(_Attempts):
    """One file for each `file`, its pages in the order of the rows; pages of a file have one shape and are streamed."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        rows = ((b["file"][i].as_py(), b["height"][i].as_py(), b["width"][i].as_py(), b["content"][i].as_py()) for b in iterator for i in range(b.num_rows))
        files, waiting = [], next(rows, None)

        def pages(name: str, shape: tuple[int, int]) -> Iterator[bytes]:
            nonlocal waiting
            at = 16
            yield struct.pack("<2sHHHQ", b"II", 43, 8, 0, at + 2 * shape[0] * shape[1])
            while waiting is not None and waiting[0] == name:
                if waiting[1:3] != shape or len(waiting[3]) != 2 * shape[0] * shape[1]:
                    raise ValueError(f"pages of {name} differ in shape, or one is cut short")
                yield waiting[3]
                waiting = next(rows, None)
                directory = _page(*shape, at, waiting is None or waiting[0] != name)
                yield directory
                at += 2 * shape[0] * shape[1] + len(directory)

        while waiting is not None:
            name = waiting[0]
            files.append(self.put(f"{name}", pages(name, waiting[1:3])))
        return Committed(files)


class ImagePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_pages"

    def schema(self) -> str:
        return "file string, page int, height int, width int, content binary"

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], overwrite, ".tif")


def read_slices(spark: SparkSession, path: str, width: int, max_bytes: int = MAX_BYTES, **only: str | int) -> DataFrame:
    """side, yname, xname, zname, z, y0, content: strips of whole lines, y0 the first; a file of up to max_bytes is one strip.

    only: side, yname, xname, zname, low, high; a slice's number z is the one that it has in its whole stack."""
    register(spark)
    return spark.read.format("raw_slices").options(path=path, width=width, max_bytes=max_bytes, **only).load()


def read_records(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, **only: str) -> DataFrame:
    """only: side, yname, xname."""
    register(spark)
    return spark.read.format("cell_records").options(path=path, max_bytes=max_bytes, **only).load()


def write_records(cells: DataFrame, path: str, mode: str = "append") -> None:
    """Cells as packed records. Nothing is shuffled: each task writes the stacks that it has."""
    register(cells.sparkSession)
    rows = cells.select("side", "yname", "xname", *[F.col(f).cast("int" if f == "size" else "float").alias(f) for f in RECORD.names[:-1]])
    rows.write.format("cell_records").option("path", path).mode(mode).save()


def read_pages(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, **only: str | int) -> DataFrame:
    """only: file, low, high (numbers of pages)."""
    register(spark)
    return spark.read.format("image_pages").options(path=path, max_bytes=max_bytes, **only).load()


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """pages: file, page, height, width, content. A file's pages go through one task, one after another."""
    register(pages.sparkSession)
    rows = pages.select("file", F.col("page").cast("int").alias("page"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "content")
    rows.repartition("file").sortWithinPartitions("file", "page").write.format("image_pages").option("path", path).mode(mode).save()


def every_page(slices: DataFrame, first: int = 0, last: int = -1, skip: int = 1) -> DataFrame:
    """Slices z (0, 1, ...) from first up to but without last (below 0: to the end), every skip-th, with their page."""
    kept = slices.where((F.col("z") >= first) & (F.lit(last < 0) | (F.col("z") < last)) & ((F.col("z") - first) % skip == 0))
    return kept.withColumn("page", ((F.col("z") - first) / skip).cast("int"))


def rotated(pages: DataFrame, turns: int) -> DataFrame:
    """Content, height and width turned by quarters, against the clock if turns is positive."""
    schema = pages.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = [np.rot90(np.frombuffer(c, "<u2").reshape(h, w), turns) for c, h, w in zip(b["content"].to_pylist(), b["height"].to_pylist(), b["width"].to_pylist(), strict=True)]
            new = {"content": pa.array([np.ascontiguousarray(i).tobytes() for i in images], pa.binary()), "height": pa.array([i.shape[0] for i in images], pa.int32()), "width": pa.array([i.shape[1] for i in images], pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(n, b[n]) for n in schema.fieldNames()], names=schema.fieldNames())

    from .shared import bounded_batches

    bounded_batches(pages.sparkSession)
    return pages.withColumns({"height": F.col("height").cast("int"), "width": F.col("width").cast("int")}).mapInArrow(run, T.StructType([T.StructField(f.name, T.IntegerType() if f.name in ("height", "width") else f.dataType) for f in schema]))
