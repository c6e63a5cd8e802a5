"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that byte-pair encoding of that prefix ends with. An
automaton over the vocabulary lists the tokens that end at each place (the suffixes that are tokens); a candidate is
the one if it is compatible with the last token of the prefix before it, that is, if no merge across their border
comes before the merges that built them. Following the stored last tokens back from the end gives the ids. No merge
queue is run, and time grows with the length of the text times the number of tokens that end at a place.

The tokenizer is a file of the public `tokenizers` kind (byte-level BPE); the driver reads it and broadcasts its
content, of a size that the file fixes.

Defined results: a null text is encoded as an empty one; special tokens in the text are recognised; texts of any length
are encoded whole; repeated rows repeat; an empty table gives no rows; other columns pass through `encode`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, give_back, table, with_columns

#: Pre-tokens of byte-level BPE, a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Within Latin-1 the classes are short enough to be listed, which lets the faster `re` run.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\t-\\r\\x85\\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")
#: Where this matches, white space runs reach over a blank, and the text can't be cut at its blanks.
RUNS = re.compile(r"  |\s (?:\s|$)")
#: Entries kept between the texts of a task, so that memory is bounded: pieces, pre-tokens and pairs.
CACHED_PIECES, CACHED_PRE_TOKENS, CACHED_PAIRS = 20_000, 400_000, 250_000
#: Characters of text whose pieces are encoded together, each distinct one once.
TOGETHER = 4_000_000
#: The same (pre-tokens and pairs, characters) where other stages have left an executor little memory.
SMALL_CACHE, SMALL_TOGETHER = 80_000, 1_000_000
_NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest goes up from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[starts[k]:starts[k + 1]] for each k of which, one after another; and the length of each."""
    sizes = (starts[1:] - starts[:-1])[which]
    first = np.repeat(starts[which] - np.cumsum(sizes) + sizes, sizes)
    return flat[first + np.arange(len(first))], sizes


Piece = tuple[int, ...]


class Cache:
    """Two generations: when the young one is full it becomes the old one, from which what is used again moves back."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most // 2, {}, {}

    def get(self, key: str) -> Piece | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: Piece) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Encoder and decoder of one tokenizer file's content."""

    #: Whether caches and batches are to be small.
    small = False

    def __init__(self, content: str) -> None:
        import ahocorasick
        import regex

        spec = json.loads(content)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.letter = {b: c for b, c in enumerate(letters)}
        of_letter = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        # when a token is made (its merge's place; single letters are there from the start) and of what
        self.made, self.parts, self.joined = dict.fromkeys(vocab.values(), -1), {}, {}
        for place, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            if i in self.parts:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.made[i], self.parts[i] = place, (vocab[a], vocab[b])
            self.joined[vocab[a], vocab[b]] = place
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.vocab, self.everywhere = vocab, regex.compile(PATTERN)
        self.forget()
        self.table = {b: c for b, c in enumerate(letters)}
        # each id in decimals and as bytes
        every = range(max(self.bytes_of, default=-1) + 1)
        self.decimals = pa.array([b"%d" % i for i in every], pa.large_binary())
        self.bytes = pa.array([self.bytes_of.get(i, b"") for i in every], pa.large_binary())
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in every], np.int64)

    def forget(self) -> None:
        """Empty the caches; idle Python workers share an executor's memory with other stages."""
        self.pairs: dict[tuple[int, int], bool] = {}
        self.most_pairs = SMALL_CACHE if self.small else CACHED_PAIRS
        self.pieces, self.pre = Cache(CACHED_PIECES), Cache(SMALL_CACHE if self.small else CACHED_PRE_TOKENS)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of a and b side by side are encoded as just a and b.

        Looks back along what stood at the border: the part made last is taken apart first, the right one if both come
        from the same merge (equal merges run from left to right). A merge of the two parts at the border forbids the
        pair if it comes before both parts are used up.
        """
        until_a = until_b = _NEVER
        while True:
            place = self.joined.get((a, b))
            if place is not None and place < until_a and place <= until_b:
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until_a, a = made_a, self.parts[a][1]
            else:
                until_b, b = made_b, self.parts[b][0]

    def last_tokens(self, s: str) -> list[int]:
        """Ids of one pre-token, given in byte letters."""
        whole = self.vocab.get(s)
        if whole is not None and len(s) == 1:
            return [whole]
        n, pairs = len(s), self.pairs
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (i, size) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get((before, i))
                if ok is None:
                    if len(pairs) >= self.most_pairs:
                        pairs.clear()
                    ok = pairs[before, i] = self.compatible(before, i)
                if not ok:
                    continue
            last[end], back[end] = i, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def pre_tokens(self, s: str) -> list[str]:
        return (self.everywhere if BEYOND_LATIN.search(s) else LATIN).findall(s)

    def pre_token(self, p: str) -> Piece:
        made = self.pre.young.get(p) or self.pre.get(p)
        if made is None:
            made = tuple(self.last_tokens(p.encode().decode("latin-1").translate(self.table)))
            if len(p) <= 64:
                self.pre.put(p, made)
        return made

    def piece(self, s: str) -> Piece:
        made = self.pieces.young.get(s) or self.pieces.get(s)
        if made is None:
            each = [self.pre_token(p) for p in self.pre_tokens(s)]
            made = each[0] if len(each) == 1 else tuple([i for m in each for i in m])
            if len(s) <= 64:
                self.pieces.put(s, made)
        return made

    def encoded(self, text: str) -> list[Piece]:
        """The text in pieces that are encoded each on its own."""
        out: list[Piece] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                i = self.special[part]
                out.append((i,))
            elif part:
                if RUNS.search(part):
                    pieces = self.pre_tokens(part)
                else:  # a blank belongs to what follows it
                    first, *rest = part.split(" ")
                    pieces = ([first] if first else []) + [" " + x for x in rest]
                get, piece = self.pieces.young.get, self.piece
                out += [get(p) or piece(p) for p in pieces]
        return out

    def summaries(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Number of ids, ids as text, and decoded bytes of each text."""
        start = size = 0
        for k, x in enumerate(texts):
            if size and size + len(x) > (SMALL_TOGETHER if self.small else TOGETHER):
                yield from self._together(texts[start:k])
                start, size = k, 0
            size += len(x)
        if start < len(texts):
            yield from self._together(texts[start:])

    def _together(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        each: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
        at_blanks = []
        for k, x in enumerate(texts):
            if not x:
                continue
            if x[0] == " " or RUNS.search(x) or self.cut and self.cut.search(x):
                each[k] = np.array(self.encode(x), np.int64)
            else:
                at_blanks.append(k)
        if at_blanks:
            split = pc.split_pattern(pa.array([texts[k] for k in at_blanks], pa.large_string()), " ")
            coded = split.flatten().dictionary_encode()
            made = [self.piece(" " + x) for x in coded.dictionary.to_pylist()]
            bounds, which = split.offsets.to_numpy(), coded.indices.to_numpy().copy()
            which[bounds[:-1]] = len(made) + np.arange(len(at_blanks))  # a text's first piece has no blank before it
            made += [self.piece(x) for x in pc.list_element(split, 0).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(m) for m in made])])
            flat, sizes = gather(np.array([i for m in made for i in m], np.int64), starts, which)
            ends = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
            for k, a, b in zip(at_blanks, ends[:-1], ends[1:], strict=True):
                each[k] = flat[a:b]
        ids = np.concatenate([*each, np.empty(0, np.int64)])
        ends = np.concatenate([[0], np.cumsum([len(e) for e in each])])
        taken = pa.array(ids)
        written = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.decimals.take(taken)), pa.scalar(b",", pa.large_binary())).to_pylist()
        back = self.bytes.take(taken)
        data = memoryview(back.buffers()[2] or b"") if len(ids) else memoryview(b"")
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends].tolist()
        return [(len(e), w, bytes(data[a:b])) for e, w, a, b in zip(each, written, at[:-1], at[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encoded(text) for i in ids]

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(content) -> Codec:  # noqa: ANN001  (a broadcast variable)
    """One codec in each Python worker, whatever the number of tasks."""
    key = hash(content.value)
    if key not in _codecs:
        _codecs[key] = Codec(content.value)
        give_back()  # what parsing the file took
    return _codecs[key]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _content(spark: SparkSession, path: str | None):  # noqa: ANN202
    return spark.sparkContext.broadcast(Path(path or tokenizer_path()).read_text())


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add the ids of each text."""
    content = _content(df.sparkSession, path)
    df = df.drop(out)

    def make():  # noqa: ANN202
        codec = _codec(content)
        return lambda texts: [pa.array([codec.encode(x or "") for x in texts], pa.list_(pa.int32()))]

    return with_columns(df, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of each list of ids; a null list counts as an empty one."""
    content = _content(df.sparkSession, path)
    df = df.drop(out)

    def make():  # noqa: ANN202
        codec = _codec(content)
        return lambda lists: [pa.array([codec.decode(x or []) for x in lists], pa.string())]

    return with_columns(df, ids, [T.StructField(out, T.StringType())], make)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, small: bool = False) -> DataFrame:
    """Encode, decode and digest in one pass, so that neither ids nor texts travel back. small: less memory, more time."""
    content = _content(df.sparkSession, path)
    kind = df.schema[key].dataType

    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rows = _codec(content), 256 if small else 4096
        codec.small = small
        codec.forget()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part, n, a, c = whole.slice(at, rows), [], [], []
                for count, ids, back in codec.summaries([x or "" for x in part[1].to_pylist()]):
                    n.append(count)
                    a.append(hashlib.sha256(ids).hexdigest())
                    c.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part[0], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()
        give_back()

    fields = [T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return df.select(key, F.col(text)).mapInArrow(run, T.StructType(fields))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLE: dict[str, str] = {}
