"""Media columns: content-addressed payloads in tar shards.

`store` writes the UTF-8 bytes of each text, padded with zero bytes to a positive multiple of 64, as an 8-bit grey PNG
image of 64 samples a row (lossless). Every task appends its images to tar shards of its own in the shared folder;
members are named by the SHA-256 of the image, and a content that a shard holds already is not written again. The rows
carry digest, shard, offset and length; of a content that several tasks have written, all rows name the same place, the
first one. `headers` fills metadata columns with range reads of the first bytes of each
image only; `read_back` reads whole images and computes digests and features from their samples.

Shards are opened with pyarrow's file systems, so the shared folder may be a local one or a remote store. A task that
runs again writes new shards; rows only name shards of the attempt that was committed.

Defined results: null counts as an empty text (64 zero bytes); texts of any length are one image; equal texts give
equal values, their place included; repeated rows repeat; an empty table gives no rows; other columns pass through
`store`, except those named as what it adds.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS_AT_ONCE, arrow_batches, fresh_path, give_back, materialize, private, small_side, table

ROW = 64
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Stored bytes that a task reads back.
TASK_BYTES = 16 << 20
#: Bytes of an image up to the end of its header chunk.
HEADER = 33
PLACE = [T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ROW or (0 if raw else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", first[16:25])


def from_png(image: bytes) -> np.ndarray:
    width, height, _ = png_header(image)
    at, data = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean and spread of the samples, and the shares (in thousandths) of four bands of values."""
    bands = np.add.reduceat(np.bincount(samples.ravel(), minlength=256), [0, 32, 65, 128])
    shares = ",".join(str(int(1000 * b // samples.size)) for b in bands)
    return f"{samples.shape[1]}x{samples.shape[0]}:mean={samples.mean():.3f}:std={samples.std():.3f}:bands={shares}"


class _Shards:
    """Tar shards of one task."""

    def __init__(self, folder: str) -> None:
        self.folder, self.name, self.stream = folder, "", None

    def _next(self) -> None:
        from pyarrow import fs

        self.close()
        self.name = f"{self.folder}/shard-{uuid.uuid4().hex}.tar"
        system, path = fs.FileSystem.from_uri(self.name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.size, self.held = system.open_output_stream(path), 0, {}

    def put(self, digest: str, image: bytes) -> tuple[str, int]:
        if self.stream is None or self.size > SHARD_BYTES:
            self._next()
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.stream.write(head + image + bytes(-len(image) % 512))
            self.held[digest] = self.size + len(head)
            self.size += len(head) + len(image) + -len(image) % 512
        return self.name, self.held[digest]

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(1024))
            self.stream.close()
            self.stream = None


class _Ranges:
    """Range reads; the last shard stays open."""

    def __init__(self) -> None:
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        from pyarrow import fs

        if shard != self.name:
            if self.file is not None:
                self.file.close()
            system, path = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, system.open_input_file(path)
        self.file.seek(int(offset))
        return self.file.read(int(length))


def store(df: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """Write the shards; the result has the input's columns but the text, and n_bytes, digest, shard, offset, length."""
    arrow_batches(df.sparkSession)
    folder = fresh_path(df.sparkSession, name)
    folder = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    df, names = private(df.drop(*[f.name for f in PLACE if f.name != text]))
    text = names.pop(text)
    kept = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b, rows = whole.slice(at, ROWS_AT_ONCE), []
                for t in b[text].to_pylist():
                    data = payload(t)
                    image = to_png(data)
                    digest = hashlib.sha256(image).hexdigest()
                    shard, offset = shards.put(digest, image)
                    rows.append((len((t or "").encode()), digest, shard, offset, len(image)))
                yield pa.RecordBatch.from_arrays([*[b[f.name] for f in kept], *_columns(rows, PLACE)], names=[f.name for f in [*kept, *PLACE]])
        shards.close()
        give_back()

    # written at once: reading the plan again must not write the shards again
    index = materialize(df.mapInArrow(run, T.StructType([*kept, *PLACE])), name + "-index")
    # contents that several tasks have stored get one place; the others' rows stay where they are
    place = F.struct("shard", "offset")
    again = index.groupBy("digest").agg(F.min(place).alias("__place"), F.max(place).alias("__last")).where("__place <> __last").select(F.col("digest").alias("__digest"), "__place")
    out = index.join(small_side(materialize(again, name + "-places"), 100_000), F.col("digest") == F.col("__digest"), "left")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "n_bytes", "digest", F.coalesce("__place.shard", "shard").alias("shard"), F.coalesce("__place.offset", "offset").alias("offset"), "length")


def _columns(rows: list[tuple], fields: list[T.StructField]) -> list[pa.Array]:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    return [pa.array([r[i] for r in rows], kinds[f.dataType]) for i, f in enumerate(fields)]


def spread(index: DataFrame) -> DataFrame:
    """The index dealt out by the bytes that it stands for, in order of place, so that tasks read alike much, forwards."""
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return index.repartitionByRange(n, "shard", "offset", F.xxhash64(*[f.name for f in index.schema.fields if f.name not in ("shard", "offset")])).sortWithinPartitions("shard", "offset")


def headers(index: DataFrame) -> DataFrame:
    """Add width, height and bits from the images' first bytes."""
    index = index.drop("width", "height", "bits")

    fields = [T.StructField(c, T.IntegerType()) for c in ("width", "height", "bits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges()
        for b in batches:
            got = [png_header(ranges.read(s, o, HEADER)) for s, o in zip(b["shard"].to_pylist(), b["offset"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *_columns(got, fields)], names=[*b.schema.names, "width", "height", "bits"])

    return index.mapInArrow(run, T.StructType([*index.schema.fields, *fields]))


def read_back(index: DataFrame) -> DataFrame:
    """Add payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, all from the stored bytes."""
    fields = [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
    index = index.drop(*[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, last, row = _Ranges(), None, ()
        for b in batches:
            rows = []
            for place in zip(*[b[c].to_pylist() for c in ("shard", "offset", "length")], strict=True):
                if place != last:  # of equal places in a row, the image is read once
                    image = ranges.read(*place)
                    samples = from_png(image)
                    data = samples.tobytes()
                    last, row = place, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), features(samples))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*b.columns, *_columns(rows, fields)], names=[*b.schema.names, *[f.name for f in fields]])

    return index.mapInArrow(run, T.StructType([*index.schema.fields, *fields]))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = read_back(headers(spread(index)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "length")


QUERIES = {"op6_media": op6_media}
ORACLE: dict[str, str] = {}
