"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into words (the pattern's matches). A chunk is a run of rows of one task, with a dictionary of its distinct
words; its texts become positions in that dictionary. Dictionaries, not texts, are shuffled: a chunk's words go, packed,
to buckets by their checksum, where each distinct word is encoded once, whatever the number of chunks that have it; the
ids join their chunks again, and texts are put together by position. Decoding joins the ids with the table of token
bytes, a table of fixed size.

The files are rank files: a token's bytes in base 64, a blank, its rank. A chunk holds at most CHUNK_BYTES of text (or
one longer text) and about CHUNK_WORDS words. Buckets start anew every CHUNK_GROUP chunks, so that a word that all
chunks have can't grow a bucket without bound; there such a word is encoded again. The chunks are written first, so that
a repeated task can't cut other chunks, and in buckets of their number, so that the texts' positions aren't shuffled.

Defined results: a null text counts as empty, an empty one has no ids; special tokens are ordinary text; texts and words
of any length are encoded whole; rows without or with repeated keys give a row each; an empty table gives no rows; a
null list of ids decodes to no bytes, an unknown id raises an error; only key and text are carried along, so other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BEYOND_LATIN, LATIN, PATTERN, RUNS, gather, tokenizer_path
from .common import arrow_batches, bucketed, give_back, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text and distinct words that close a chunk, bytes of text whose words are looked up together.
CHUNK_BYTES, CHUNK_WORDS, TOGETHER = 32 << 20, 1 << 19, 8 << 20
#: Buckets of words, chunks that share buckets.
BUCKETS, CHUNK_GROUP = 256, 4096
#: Pair merges of a word are found by scanning up to this length, by a heap beyond.
SCAN = 64


def read_ranks(path: str | None = None) -> bytes:
    return Path(path or tokenizer_path(RANKS)).read_bytes()


class Encoder:
    """Ids of single words."""

    def __init__(self, content: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines() if content else [])}

    def word(self, w: bytes) -> list[int]:
        whole = self.ranks.get(w)
        if whole is not None:
            return [whole]
        return self._scan(w) if len(w) <= SCAN else self._heap(w)

    def _scan(self, w: bytes) -> list[int]:
        """Join the pair of the lowest rank, the first of equals, until none is left."""
        ranks, parts = self.ranks, [w[i : i + 1] for i in range(len(w))]
        pairs = [ranks.get(w[i : i + 2]) for i in range(len(w) - 1)]
        while pairs:
            best = at = None
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
        return [ranks[p] for p in parts]

    def _heap(self, w: bytes) -> list[int]:
        """The same with a heap and links, for time that hardly grows faster than the word."""
        ranks, n = self.ranks, len(w)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(w[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, until = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != until:
                continue  # one of the two was joined meanwhile
            end[i], alive[j] = until, 0
            if until < n:
                before[until] = i
                if (r := ranks.get(w[i : end[until]])) is not None:
                    heapq.heappush(heap, (r, i, end[until]))
            if (k := before[i]) >= 0 and (r := ranks.get(w[k:until])) is not None:
                heapq.heappush(heap, (r, k, until))
        out, at = [], 0
        while at < n:
            out.append(ranks[w[at : end[at]]])
            at = end[at]
        return out


class Codes(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class Words:
    """The dictionary of a chunk."""

    def __init__(self) -> None:
        import regex

        self.codes = Codes()
        self.everywhere = regex.compile(PATTERN)

    def cut(self, s: str, latin: bool) -> list[int]:
        codes = self.codes
        return [codes[w] for w in (LATIN if latin else self.everywhere).findall(s)]

    def positions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of the texts, and the number of words of each text."""
        cut, latin = self.cut, not any(BEYOND_LATIN.search(x) for x in texts)
        each: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        at_blanks = []
        for k, x in enumerate(texts):
            if not x:
                continue
            if x[0] == " " or RUNS.search(x):  # white space runs reach over blanks
                each[k] = np.array(cut(x, latin), np.int32)
            else:
                at_blanks.append(k)
        if at_blanks:  # elsewhere a blank belongs to what follows it, and distinct pieces are cut once
            split = pc.split_pattern(pa.array([texts[k] for k in at_blanks], pa.large_string()), " ")
            coded = split.flatten().dictionary_encode()
            pieces = [cut(" " + x, latin) for x in coded.dictionary.to_pylist()]
            bounds, which = split.offsets.to_numpy(), coded.indices.to_numpy().copy()
            which[bounds[:-1]] = len(pieces) + np.arange(len(at_blanks))  # a text's first piece has no blank before it
            pieces += [cut(x, latin) for x in pc.list_element(split, 0).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            flat, sizes = gather(np.array([c for p in pieces for c in p], np.int32), starts, which)
            ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
            for k, a, b in zip(at_blanks, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                each[k] = flat[a:b]
        return np.concatenate([*each, np.empty(0, np.int32)]).astype(np.int32), np.array([len(e) for e in each], np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers up to 2^32, byte plane by byte plane, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


#: A chunk's rows are parts (keys, words and sizes of their texts) and dictionaries (a bucket's words with their codes).
_PARTS = [("chunk", T.LongType()), ("bucket", T.IntegerType()), ("codes", T.BinaryType()), ("sizes", T.BinaryType()), ("words", T.BinaryType())]


def _chunks(df: DataFrame, chunk_words: int) -> DataFrame:
    """Rows of (key, text) as chunks, written."""
    key = df.schema.fields[0].dataType
    schema = T.StructType([*[T.StructField(n, t) for n, t in _PARTS], T.StructField("keys", T.ArrayType(key))])
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_type = None
        made, size, words = 0, 0, Words()
        chunk = TaskContext.get().partitionId() << 32

        def rows(found: list[tuple], keys: pa.Array | None) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            lists = pa.nulls(len(found), pa.list_(keys_type)) if keys is None else pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([*columns, lists], names=[*[n for n, _ in _PARTS], "keys"])

        def closed() -> Iterator[pa.RecordBatch]:
            each = [w.encode() for w in words.codes]
            bucket = np.array([zlib.crc32(w) for w in each], np.uint32) % BUCKETS
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            found = []
            for b in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
                codes = order[bounds[b] : bounds[b + 1]]
                mine = [each[c] for c in codes.tolist()]
                found.append((chunk + made, b, packed(np.diff(codes, prepend=0)), packed(np.array([len(w) for w in mine])), _zip(b"".join(mine))))
            for k in range(0, len(found), 64):
                yield rows(found[k : k + 64], None)

        for whole in batches:
            keys_type = whole.schema.field(0).type
            texts, start, held = [x or "" for x in whole.column(1).to_pylist()], 0, 0
            for k, x in enumerate(texts):
                held += len(x)
                if held < TOGETHER and k + 1 < len(texts):
                    continue
                codes, sizes = words.positions(texts[start : k + 1])
                yield rows([(chunk + made, None, packed(codes), packed(sizes), None)], whole.column(0).slice(start, k + 1 - start))
                size, start, held = size + held, k + 1, 0
                if size >= CHUNK_BYTES or len(words.codes) >= chunk_words:
                    yield from closed()
                    made, size, words = made + 1, 0, Words()
        if words.codes:
            yield from closed()
        del words
        give_back()

    return bucketed(df.mapInArrow(run, schema), "word-bpe-chunks", "chunk")


_encoders: dict[int, Encoder] = {}


def _encoder(content) -> Encoder:  # noqa: ANN001  (a broadcast variable)
    key = hash(content.value)
    if key not in _encoders:
        _encoders[key] = Encoder(content.value)
    return _encoders[key]


def _encoded(chunks: DataFrame, content) -> DataFrame:  # noqa: ANN001
    """For each chunk and bucket the ids of its words, in the order of its codes."""

    def bucket(rows: pa.Table) -> pa.Table:
        encoder, seen = _encoder(content), {}
        flat, starts = [], [0]
        ids, counts = [], []
        for sizes, words in zip(rows["sizes"].to_pylist(), rows["words"].to_pylist(), strict=True):
            text, ends = _unzip(words), np.cumsum(unpacked(sizes)).tolist()
            which, a = [], 0
            for b in ends:
                w = text[a:b]
                a = b
                k = seen.get(w)
                if k is None:
                    k = seen[w] = len(seen)
                    flat += encoder.word(w)
                    starts.append(len(flat))
                which.append(k)
            got, n = gather(np.array(flat, np.int64), np.array(starts), np.array(which))
            ids.append(packed(got))
            counts.append(packed(n))
        return pa.Table.from_arrays([rows["chunk"], rows["codes"], pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["chunk", "codes", "counts", "ids"])

    group = F.floor((F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(0xFFFFFFFF)) / CHUNK_GROUP)
    dictionaries = chunks.where("bucket is not null").select("chunk", "bucket", "codes", "sizes", "words")
    return dictionaries.groupBy("bucket", group.alias("together")).applyInArrow(bucket, "chunk long, codes binary, counts binary, ids binary")


def _assembled(df: DataFrame, content, fields: list[T.StructField], make: Callable, chunk_words: int) -> DataFrame:  # noqa: ANN001
    """Rows of (key, text) as key and what make() returns for (ids of several texts, number of ids of each)."""
    key = df.schema.fields[0]
    chunks = _chunks(df, chunk_words)
    parts = chunks.where("bucket is null").select("chunk", "codes", "sizes", "keys")
    schema = T.StructType([key, *fields])

    def chunk(parts: pa.Table, found: pa.Table) -> pa.Table:
        new, done = make(), []
        order = [np.cumsum(unpacked(c).astype(np.int32)) for c in found["codes"].to_pylist()]
        counts = [unpacked(c) for c in found["counts"].to_pylist()]
        total = sum(map(len, order))
        size = np.zeros(total, np.int64)
        for o, c in zip(order, counts, strict=True):
            size[o] = c
        starts = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(starts[-1], np.uint32)
        for o, c, ids in zip(order, counts, found["ids"].to_pylist(), strict=True):
            shift = np.repeat(starts[o] - np.cumsum(c.astype(np.int64)) + c, c)
            flat[shift + np.arange(len(shift))] = unpacked(ids)
        del order, counts
        for i in range(parts.num_rows):
            ids, each = gather(flat, starts, unpacked(parts["codes"][i].as_py()))
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(unpacked(parts["sizes"][i].as_py()).astype(np.int64))])]
            done.append(pa.RecordBatch.from_arrays([parts["keys"][i].values, *new(ids, ends)], names=schema.fieldNames()))
        out = pa.Table.from_batches(done) if done else pa.table({f.name: [] for f in schema})
        give_back()
        return out

    return parts.groupBy("chunk").cogroup(_encoded(chunks, content).groupBy("chunk")).applyInArrow(chunk, schema)


class Bytes:
    """The table of token bytes."""

    def __init__(self, content: bytes) -> None:
        ranks = Encoder(content).ranks
        self.table = pa.array([b for b, _ in sorted(ranks.items(), key=lambda x: x[1])], pa.binary())
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must run from 0 without a gap")
        self.sizes = np.diff(np.frombuffer(self.table.buffers()[1], np.int32)).astype(np.int64)

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids, and where each text's bytes begin and end."""
        if not len(ids):
            return memoryview(b""), np.zeros(len(ends), np.int64)
        taken = self.table.take(pa.array(ids))
        return memoryview(taken.buffers()[2]), np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends]


_tables: dict[int, Bytes] = {}


def _bytes(content) -> Bytes:  # noqa: ANN001
    key = hash(content.value)
    if key not in _tables:
        _tables[key] = Bytes(content.value)
    return _tables[key]


def _two(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.col(text).alias("text" if key != "text" else "text_"))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", path: str | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Key and ids of each row."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make() -> Callable:
        return lambda ids, ends: [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.uint32()).cast(pa.int32()))]

    return _assembled(_two(df, key, text), content, [T.StructField(out, T.ArrayType(T.IntegerType()))], make, chunk_words)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the bytes of each list of ids."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    df = df.drop(out)
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_ = _bytes(content)
        for b in batches:
            lists = b[ids]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int64)
            data, at = bytes_.decoded(flat, ends)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bytes(data[a:e]) for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Encode, decode and digest, so that neither ids nor texts travel on."""
    content = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make() -> Callable:
        bytes_ = _bytes(content)

        def new(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
            data, at = bytes_.decoded(ids, ends)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B") if len(ids) else memoryview(b"")
            bounds, places = (4 * ends).tolist(), at.tolist()
            of = lambda view, e: pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(e[:-1], e[1:], strict=True)], pa.string())
            return [pa.array(np.diff(ends), pa.int64()), of(raw, bounds), of(data, places)]

        return new

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _assembled(_two(df, key, text), content, fields, make, chunk_words)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op12_word_bpe": op12_word_bpe}
ORACLE: dict[str, str] = {}
