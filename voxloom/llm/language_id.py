"""Language ID: a linear-chain conditional random field labels the words of a text.

Each line of a text is a chain of words (runs of letters, lower-cased). A word's score for a language is the sum of
learned weights of its affixes and inner n-grams of one to three letters (hashed) and of the word itself if it is in
the lexicon of the training words; learned transitions tie neighbours. Forward-backward gives each word a distribution
over languages, so that code-switched lines keep their parts; the document's language has the largest mean.

The field is trained by gradient ascent on the likelihood of a sample of at most `train_docs` labelled documents of
`TRAIN_CHARS` characters at most, drawn by language in turn, within a language by a hash of their ids; prediction covers the whole text of every document,
without a shuffle.

Defined results: letters are those of Unicode (category L), so numerals like one half are none; null texts and texts
without letters are `und` with score 0; without training documents everything is `und`; ties go to the first language
in code point order; equal texts get equal results (scores are rounded to six decimals), repeated rows repeat; an empty
table gives no rows; very long texts are handled in pieces of whole lines, a line whole, its chain in overlapping parts; other columns pass
through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import letter_runs, table, with_columns

#: Bounds of the training sample, which the driver holds: documents, and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 800, 50_000
SLOTS = 1 << 15
LEXICON = 4000
EPOCHS = 30
#: Words handled at once, and word types whose scores are kept; both bound the memory of a task.
AT_ONCE, CACHED_TYPES = 100_000, 150_000
#: Words of a chain, and of the neighbours on either side that a part of a longer line is read with.
CHAIN, CONTEXT = 2000, 50
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots (positions x 3, of n-grams of 1 to 3 letters with word borders) and each word's first position.

    Slot 0 stands for an n-gram that would reach beyond its word."""
    text = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(words)), sizes)
    slots = np.zeros((len(c), 3), dtype=np.int64)
    h = np.zeros(len(c), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(3):
            m = len(c) - n
            h = h[:m] * _MIX[1] + (c[n:] + np.uint64(n + 1)) * _MIX[0]
            mixed = (h ^ (h >> np.uint64(29))) * _MIX[2]
            slot = (mixed >> np.uint64(40)) % np.uint64(SLOTS - 1) + np.uint64(1)
            slots[:m, n] = np.where(owner[:m] == owner[n:], slot, 0)
    return slots, starts


class Lines:
    """Chains in order of falling length, so that step t runs over the first `alive[t]` of them."""

    def __init__(self, lengths: np.ndarray) -> None:
        order = np.argsort(-lengths, kind="stable")
        self.sizes = lengths[order]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        longest = int(self.sizes[0]) if len(lengths) else 0
        self.alive = np.searchsorted(-self.sizes, -np.arange(1, longest + 1), side="right")
        self.starts = starts

    def forward_backward(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words and expected transitions. e: words x languages, trans: from x to (both logs)."""
        k = e.shape[1]
        x = np.exp(e - e.max(1, keepdims=True))
        m = np.exp(trans - trans.max())
        a, out, pairs = np.empty_like(x), np.empty_like(x), np.zeros((k, k))
        prev = np.full((len(self.sizes), k), 1.0 / k, dtype=x.dtype)
        for t, n in enumerate(self.alive):
            at = self.starts[:n] + t
            prev = (prev[:n] @ m if t else prev[:n]) * x[at]
            prev = prev / prev.sum(1, keepdims=True)
            a[at] = prev
        beta = np.ones((0, k), dtype=x.dtype)
        for t in range(len(self.alive) - 1, -1, -1):
            n = self.alive[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k), dtype=x.dtype)])
            at = self.starts[:n] + t
            p = a[at] * beta
            out[at] = p / p.sum(1, keepdims=True)
            if t:
                ahead = beta * x[at]
                both = a[at - 1][:, :, None] * m[None] * ahead[:, None, :]
                pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
                beta = ahead @ m.T
                beta = beta / beta.sum(1, keepdims=True)
        return out, pairs

    def posteriors(self, e: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """As forward_backward, without the expected transitions."""
        x = np.exp(e - e.max(1, keepdims=True))
        m = np.exp(trans - trans.max()).astype(x.dtype)
        a = np.empty_like(x)
        k = x.shape[1]
        prev = np.full((len(self.sizes), k), 1.0 / k, dtype=x.dtype)
        for t, n in enumerate(self.alive):
            at = self.starts[:n] + t
            prev = (prev[:n] @ m if t else prev[:n]) * x[at]
            prev /= prev.sum(1, keepdims=True)
            a[at] = prev
        beta = np.ones((0, k), dtype=x.dtype)
        for t in range(len(self.alive) - 1, -1, -1):
            n = self.alive[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k), dtype=x.dtype)])
            at = self.starts[:n] + t
            a[at] *= beta
            if t:
                beta = (beta * x[at]) @ m.T
                beta /= beta.sum(1, keepdims=True)
        return a / a.sum(1, keepdims=True)


def chains(tokens: list[str]) -> tuple[list[str], list[int]]:
    """Words, and the lengths of the lines that hold any."""
    words, lengths, n = [], [], 0
    for t in tokens:
        if t == "\n":
            if n:
                lengths.append(n)
            n = 0
        else:
            words.append(t)
            n += 1
    return words, lengths + [n] * (n > 0)


def overlapping(lengths: np.ndarray, most: int | None = None, context: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of at most `most` words with `context` words on either side in place of longer ones: which words they take,
    their lengths, and which of these words are to be kept, once each, in their order. Far words hardly matter to a word."""
    most, context = most or CHAIN, CONTEXT if context is None else context
    take, cut, keep, start = [], [], [], 0
    for n in lengths.tolist():
        for at in range(0, n, most) if n > most else [0]:
            end = min(n, at + most) if n > most else n
            low, high = max(0, at - context), min(n, end + context)
            take.append(np.arange(start + low, start + high))
            cut.append(high - low)
            mine = np.zeros(high - low, bool)
            mine[at - low : end - low] = True
            keep.append(mine)
        start += n
    return np.concatenate(take), np.array(cut), np.concatenate(keep)


class Field:
    def __init__(self, langs: list[str], grams: np.ndarray, lexicon: dict[str, np.ndarray], trans: np.ndarray) -> None:
        self.langs, self.grams, self.lexicon, self.trans = langs, grams, lexicon, trans

    def emissions(self, types: list[str]) -> np.ndarray:
        slots, starts = gram_slots(types)
        per = self.grams[slots].sum(1)
        e = np.add.reduceat(per, starts, axis=0)
        for i, w in enumerate(types):
            own = self.lexicon.get(w)
            if own is not None:
                e[i] += own
        return e


def fit(texts: list[tuple[str, str]]) -> Field | None:
    """texts: (text, language), in a fixed order. Adam on the conditional log-likelihood of whole lines."""
    langs = sorted({lang for _, lang in texts})
    if not langs:
        return None
    k, words, lengths, gold = len(langs), [], [], []
    for text, lang in texts:
        w, n = chains(letter_runs(text.lower(), lines=True))
        words += w
        lengths += n
        gold += [langs.index(lang)] * len(w)
    if not words:
        return None
    count = Counter(words)
    types = sorted(count)
    at = {w: i for i, w in enumerate(types)}
    ids, gold_ = np.array([at[w] for w in words]), np.array(gold)
    lines = Lines(np.array(lengths))
    slots, starts = gram_slots(types)
    owner = np.repeat(np.arange(len(types)), np.diff(np.append(starts, len(slots))))
    held = sorted((w for w in types if count[w] >= 3), key=lambda w: (-count[w], w))[:LEXICON]
    lex_at = np.array([at[w] for w in held], dtype=np.int64)
    grams, lex, trans = np.zeros((SLOTS, k)), np.zeros((len(held), k)), np.eye(k) * 2.0
    first = np.ones(len(ids), dtype=bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)] = True
    chain_starts = set(np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int).tolist())
    inner = np.array([i for i in range(len(ids)) if i not in chain_starts], dtype=np.int64)
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (gold_[inner - 1], gold_[inner]), 1.0)
    params, scale = [grams, lex, trans], float(len(ids))
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    flat = slots.ravel()
    for step in range(1, EPOCHS + 1):
        e = np.add.reduceat(grams[slots].sum(1), starts, axis=0)
        if len(held):
            e[lex_at] += lex
        post, pairs = lines.forward_backward(e[ids], trans)
        diff = -post
        diff[np.arange(len(ids)), gold_] += 1.0
        per_type = np.column_stack([np.bincount(ids, weights=diff[:, j], minlength=len(types)) for j in range(k)])
        g = np.column_stack([np.bincount(flat, weights=np.repeat(per_type[owner, j], 3), minlength=SLOTS) for j in range(k)])
        g[0] = 0.0
        for i, (p, grad) in enumerate(zip(params, (g, per_type[lex_at], seen_pairs - pairs), strict=True)):
            grad = grad / scale - 1e-6 * p
            m1[i] = 0.9 * m1[i] + 0.1 * grad
            m2[i] = 0.99 * m2[i] + 0.01 * grad**2
            p += 0.1 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-9)
        np.clip(trans, -6, 6, out=trans)
    small = {w: lex[i].astype(np.float32) for i, w in enumerate(held)}
    return Field(langs, grams.astype(np.float32), small, trans)


class Tagger:
    """Labels texts with a field; keeps the scores of word types it has met."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.field.langs)), dtype=np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.at) > CACHED_TYPES:
            self.reset()
        at = self.at
        fresh = sorted({*words} - at.keys())
        if fresh:
            at.update(zip(fresh, range(len(at), len(at) + len(fresh)), strict=True))
            self.scores = np.concatenate([self.scores, self.field.emissions(fresh)])
        return np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))

    def words(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All words, each text's number of words, and the words' distributions over languages."""
        words, lengths, sizes = [], [], []
        for t in texts:
            w, n = chains(letter_runs((t or "").lower(), lines=True))
            words += w
            lengths += n
            sizes.append(len(w))
        if not words:
            return words, np.array(sizes), np.zeros((0, len(self.field.langs)), dtype=np.float32)
        scores, each = self.scores_of(words), np.array(lengths)
        if lengths and max(lengths) > CHAIN:
            take, cut, keep = overlapping(each)
            post = Lines(cut).posteriors(scores[take], self.field.trans)[keep]
        else:
            post = Lines(each).posteriors(scores, self.field.trans)
        return words, np.array(sizes), post

    def scores_of(self, words: list[str]) -> np.ndarray:
        ids = self.ids(words)
        return self.scores[ids]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; long texts go in pieces of whole lines, so that memory is bounded."""
        langs, batch, size = self.field.langs, [], 0
        total, count = np.zeros((len(texts), len(langs))), np.zeros(len(texts), dtype=np.int64)

        def flush() -> None:
            _, sizes, post = self.words([piece for _, piece in batch])
            owner = np.repeat([i for i, _ in batch], sizes)
            for j in range(len(langs)):
                total[:, j] += np.bincount(owner, weights=post[:, j], minlength=len(texts))
            count[:] += np.bincount(owner, minlength=len(texts))

        for i, t in enumerate(texts):
            for piece in pieces(t or "", 5 * AT_ONCE):
                batch.append((i, piece))
                size += len(piece)
                if size > 5 * AT_ONCE:
                    flush()
                    batch, size = [], 0
        if batch:
            flush()
        mean = total / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        scores = np.round(np.minimum(1.0, mean[np.arange(len(texts)), best]), 6) if len(texts) else []
        return [langs[b] if n else "und" for b, n in zip(best, count, strict=True)], [float(x) if n else 0.0 for x, n in zip(scores, count, strict=True)]


def pieces(text: str, most: int) -> Iterator[str]:
    """The text cut at line ends into pieces of `most` characters, or of one line that is longer."""
    at = 0
    while len(text) - at > most:
        end = text.rfind("\n", at, at + most) + 1 or text.find("\n", at + most) + 1 or len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field | None:
    """docs: doc_id, text, lang. Held-out documents and those without a language are not looked at."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS))
    # every language gets an equal part; what a rare one leaves over goes to the others
    ids = usable.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.withColumn("place", place).where(F.col("place") <= train_docs).orderBy("place", F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("doc_id")
    rows = usable.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d")).collect()
    return fit([(r["d"]["text"] or "", r["d"]["lang"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def predict(df: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score."""
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(field)

    def make() -> Callable:
        tagger = Tagger(shared.value) if shared.value else None

        def columns(texts: list[str | None]) -> list[pa.Array]:
            langs, scores = tagger.predict(texts) if tagger else (["und"] * len(texts), [0.0] * len(texts))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return columns

    return with_columns(df, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = train(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", "text"), field)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
