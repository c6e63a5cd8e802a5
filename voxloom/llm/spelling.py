"""Spelling variants: words one edit apart, the likely right form of each, and the end of its chain of forms.

Words of one length, and those one letter longer, that agree outside a short window are a block: an edit falls within
some window of at most WINDOW letters (longer words have WINDOWS windows), so near words share a block, and blocks stay
small without any cap. In a block the products of letter counts (a Gram matrix) give the squared distance of any two
words; a replaced letter makes it two, one more or less makes it one. Pairs at two or less are verified letter by
letter. Small blocks are multiplied together, TILE rows at once; a block of more than CROWDED words is dealt to cells,
each pair of cells a tile of its own.

Pairs aren't emitted: a tile returns for each word the number of its near words and the best form among them.

Defined results: null and empty texts have no words; a null id counts as no text in the checksum; repeated rows count
as often as they come; words of any length are compared whole; ties of forms go to the smallest in code-point order; an
empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, ascii_lower, crc32_sql, give_back, materialize, small_side, table

#: Letters and their number from which a word counts, fixed values of the contract.
LETTERS, SHORTEST = "A-Za-zÀ-ÿ", 7
#: Letters of a window, and windows of long words.
WINDOW, WINDOWS = 4, 8
#: Rows whose products are taken at once, words from which a block is cut into cells of that many.
TILE, CROWDED = 192, 1024
#: How much more frequent a form is than its variant.
RATIO = 10
LATIN1 = "ISO-8859-1"


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words as the contract spells them, one row for each time."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{SHORTEST},}})"), F.lit(1)))
    w = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", ascii_lower(F.col("run")).alias("w"))
    w = w.select("w", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")).alias("h"), F.length("w").alias("n"))
    at = (F.col("h") % F.col("n")).cast("int")
    cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.col("n")))
    return w.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("w")).alias("word")).where(F.length("word") >= SHORTEST)


def counted(words: DataFrame, least: int = 2) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def blocks(words: DataFrame) -> DataFrame:
    """Each word in its blocks, as Latin-1 bytes: among words of its length (`longer` false) and as the longer of two."""
    size = F.length("word")
    each = words.select(F.encode("word", LATIN1).alias("w"), "n", size.alias("size"), F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    base = F.col("size") - F.col("longer").cast("int")
    parts = F.least(F.lit(WINDOWS), F.greatest(F.lit(2), F.ceil(base / WINDOW))).cast("int")
    each = each.select("w", "n", "longer", base.alias("base"), parts.alias("parts")).where("base > 0")
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    start, end = (F.floor(x * F.col("base") / F.col("parts")).cast("int") for x in (F.col("part"), F.col("part") + 1))
    each = each.select("*", start.alias("start"), (end + F.col("longer").cast("int")).alias("end"))
    left, right = F.substring("w", F.lit(1), F.col("start")), F.substring("w", F.col("end") + 1, F.col("base") + 1)
    return each.select(F.xxhash64("base", "part", left, right).alias("block"), "w", "n", "longer", "start")


def _in_tiles(rows: DataFrame, crowded_from: int) -> DataFrame:
    """Crowded blocks dealt to pairs of cells; `cell` is 0 for the first cell of the pair, 1 for the second, null if a tile is a whole block."""
    crowded = materialize(rows.groupBy("block").count().where(F.col("count") > crowded_from).select(F.col("block").alias("block_"), F.ceil(F.col("count") / crowded_from).cast("int").alias("cells")), "spelling-crowded")
    out = rows.join(small_side(crowded), F.col("block") == F.col("block_"), "left").drop("block_")
    mine = F.when(F.col("cells").isNotNull(), F.pmod(F.xxhash64("w"), F.col("cells")).cast("int"))
    out = out.withColumn("mine", mine)
    other = F.explode(F.coalesce(F.sequence(F.lit(0), F.col("cells") - 1), F.array(F.lit(0))))
    out = out.withColumn("other", other)
    low, high = F.coalesce(F.least("mine", "other"), F.lit(0)), F.coalesce(F.when(F.col("mine").isNotNull(), F.greatest("mine", "other")), F.lit(0))
    cell = F.when(F.col("mine").isNull() | (F.col("mine") == F.col("other")), F.lit(-1)).otherwise((F.col("mine") > F.col("other")).cast("int"))
    return out.select("block", low.alias("low"), high.alias("high"), "w", "n", "longer", "start", cell.cast("int").alias("cell"))


def _padded(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, width: int, from_end: bool) -> np.ndarray:
    """Letters of the rows side by side, from the first or from the last letter on; 0 beyond."""
    sizes = starts[rows + 1] - starts[rows]
    at = np.arange(width)
    place = (starts[rows + 1] - 1)[:, None] - at if from_end else starts[rows][:, None] + at
    inside = at < sizes[:, None]
    return np.where(inside, flat[np.where(inside, place, 0)], 0)


#: Letters that are compared side by side at once.
_AT_ONCE = 8 << 20


def _edits(flat: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which pairs (a no longer than b) are one edit apart and seen for the first time, that is, in the first window that fits."""
    ok = np.zeros(len(a), bool)
    sizes = np.diff(starts)
    step = max(1, _AT_ONCE // max(1, int(sizes[b].max(initial=1))))
    for k in range(0, len(a), step):
        i, j, s = a[k : k + step], b[k : k + step], first[k : k + step]
        la, lb = sizes[i], sizes[j]
        width = int(lb.max())
        differ = _padded(flat, starts, i, width, False) != _padded(flat, starts, j, width, False)
        replaced = (la == lb) & (differ.sum(1) == 1)
        before = np.where(differ.any(1), differ.argmax(1), width)
        differ = _padded(flat, starts, i, width, True) != _padded(flat, starts, j, width, True)
        after = np.minimum(np.where(differ.any(1), differ.argmax(1), width), la)
        inserted = (la + 1 == lb) & (before + after >= la)
        ok[k : k + step] = replaced | inserted & ((s == 0) | (s < la - after))
    return ok


def _tile(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, rows: np.ndarray, block: np.ndarray, longer: np.ndarray, cell: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among the rows, of which each block's are together."""
    short = rows[~longer[rows]]
    if not len(short):
        return short, short
    square = (counts * counts).sum(1)
    x, y = counts[short], counts[rows]
    distance = square[short][:, None] + square[rows][None, :] - 2 * (x @ y.T)
    i, j = np.nonzero((distance <= 2) & (block[short][:, None] == block[rows][None, :]))
    a, b = short[i], rows[j]
    keep = (longer[b] | (a < b)) & ((cell[a] < 0) | (cell[a] != cell[b]))
    a, b = a[keep], b[keep]
    ok = _edits(flat, starts, a, b, first[a])
    return a[ok], b[ok]


class Alphabet:
    """Places of letters in a row of counts; all other bytes share the last place."""

    def __init__(self) -> None:
        self.place = np.full(256, 90, np.int64)
        self.place[97:123] = np.arange(26)
        self.place[192:256] = 26 + np.arange(64)

    def counts(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        return np.bincount(row * 91 + self.place[flat], minlength=91 * (len(starts) - 1)).reshape(-1, 91).astype(np.float64)


_OUT = "w binary, n_near long, form binary, form_n long"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by tile: each word's near words in its tile, counted, and the best form."""
    alphabet = Alphabet()

    def work(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        words = t["w"].to_pylist()
        flat = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        low, high, keys = (t[c].to_numpy() for c in ("low", "high", "block"))
        n, longer, cell, first = (t[c].to_numpy(zero_copy_only=False) for c in ("n", "longer", "cell", "start"))
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        block = np.cumsum(new)
        counts = alphabet.counts(flat, starts)
        edges = np.append(np.flatnonzero(new), len(words))
        size = np.diff(edges)
        useful = np.flatnonzero(size > 1)
        found, group, held = [], [], 0
        for k in useful.tolist():
            if group and held + size[k] > TILE:
                found.append(_tile(flat, starts, counts, np.concatenate(group), block, longer, cell, first))
                group, held = [], 0
            group.append(np.arange(edges[k], edges[k + 1]))
            held += size[k]
        if group:
            found.append(_tile(flat, starts, counts, np.concatenate(group), block, longer, cell, first))
        a = np.concatenate([x[0] for x in found] or [np.empty(0, np.int64)]).astype(np.int64)
        b = np.concatenate([x[1] for x in found] or [np.empty(0, np.int64)]).astype(np.int64)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        total = np.bincount(a, minlength=len(words))
        best: dict[int, int] = {}
        fits = n[b] >= RATIO * n[a]
        for i, j in zip(a[fits].tolist(), b[fits].tolist(), strict=True):
            k = best.get(i)
            if k is None or n[j] > n[k] or n[j] == n[k] and words[j] < words[k]:
                best[i] = j
        hit = np.flatnonzero(total).tolist()
        forms = [best.get(i) for i in hit]
        columns = [
            pa.array([words[i] for i in hit], pa.binary()), pa.array(total[hit], pa.int64()),
            pa.array([None if k is None else words[k] for k in forms], pa.binary()), pa.array([None if k is None else int(n[k]) for k in forms], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["w", "n_near", "form", "form_n"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        # the last tile of a batch may go on in the next one
        key = [b[c].to_numpy() for c in ("block", "low", "high")]
        same = np.logical_and.reduce([k == k[-1] for k in key])
        cut = int(np.argmin(same[::-1])) if not same.all() else b.num_rows
        if held and cut == b.num_rows and all(h[c][h.num_rows - 1].as_py() == b[c][0].as_py() for h in held[-1:] for c in ("block", "low", "high")):
            held.append(b)
            continue
        done = pa.Table.from_batches([*held, b.slice(0, b.num_rows - cut)])
        if done.num_rows:
            yield work(done)
        held = [b.slice(b.num_rows - cut)]
    if held:
        yield work(pa.Table.from_batches(held))
    give_back()


def near(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Number of near words, form and its count for each (word, n)."""
    arrow_batches(words.sparkSession)
    tiles = _in_tiles(materialize(blocks(words), "spelling-blocks"), crowded)
    keys = ["block", "low", "high"]
    found = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_near, _OUT)
    found = found.select(F.decode("w", LATIN1).alias("word"), F.lit(None).cast("long").alias("n"), "n_near", F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.decode("form", LATIN1).alias("form"))).alias("best"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,form:string>").alias("best"))
    all_ = own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return all_.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Follow forms to the last. A form is RATIO times as frequent as its word, so chains are short; each round doubles the way."""
    link = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-links")
    rounds = 0 if (most := forms.agg(F.max("form_n")).first()[0]) is None else len(str(most)).bit_length()
    for _ in range(rounds):
        onward = link.select(F.col("word").alias("root"), F.col("root").alias("further"))
        link = materialize(link.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-links")
    return forms.join(link, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    words = materialize(counted(occurrences(docs, key, text), least), "spelling-words")
    return with_roots(materialize(near(words), "spelling-near"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: Near words share the word with one letter left out, at the same place for a replaced letter; DuckDB joins those.
SQL = f"""
with recursive found as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{SHORTEST},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
hashed as (select w, {crc32_sql("(id || ':' || w)")} as h from found),
spelt as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word from hashed),
words as (select word, count(*) as n from spelt where length(word) >= {SHORTEST} group by word having count(*) >= 2),
gone as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (select a.word as a, a.n as an, b.word as b, b.n as bn from gone a join gone b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, a.n, b.word, b.n from gone a join words b on a.rest = b.word
    union select b.word, b.n, a.word, a.n from gone a join words b on a.rest = b.word),
best as (select a, count(*) as n_near, min({{'less': -bn, 'form': b}}) filter (bn >= {RATIO} * an) as f from pairs group by a),
forms as (select word, n, coalesce(n_near, 0) as n_near, f.form as form, -f.less as form_n from words left join best on a = word),
chain as (select word, word as at from forms union all select c.word, f.form from chain c join forms f on f.word = c.at where f.form is not null),
roots as (select c.word, c.at as root from chain c join forms f on f.word = c.at where f.form is null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join roots r on r.word = f.word"""

QUERIES = {"op13_spelling": op13_spelling}
ORACLE = {"op13_spelling": SQL}
