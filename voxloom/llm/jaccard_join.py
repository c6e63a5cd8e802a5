"""N-gram Jaccard join: every pair of texts whose sets of word n-grams overlap enough, as connected components.

1. Each text becomes a set of hashed n-grams. Texts with equal sets are one class, a node from here on.
2. Tiles, without loss: if two sets of sizes s <= t are similar enough, they differ in at most d(s) n-grams. The
   n-grams are dealt by hash into more than d parts, so at least one part that isn't empty is the same in both sets.
   Parts are named by their content and by a band of sizes; the nodes of one size band that share a name are a tile.
3. In a tile, hashed bitmap signatures bound every overlap from above by counting bits. What stays possible forms
   smaller tiles, to which the n-grams travel; there the sorted arrays are intersected, unless a pair is connected
   already, and an edge is emitted only when it connects two components.
4. This runs twice. First each node meets the smallest node of each of its tiles; most near copies are connected then.
   Then only tiles whose nodes still belong to several components are looked at, each set of nodes once, and tiles of
   one smallest node together where their nodes are mostly the same. Nodes that
   are connected with a tile's smallest one meet only the others, so a cluster of copies costs rows in proportion to
   its size. Tiles beyond `CHUNK_ROWS` or `CHUNK_GRAMS` are cut into chunks that meet in pairs.
5. Components of the edges, carried over to all documents of each class.

Nothing is sampled or capped; pairs of chunks have a bounded number of rows and n-grams. (A sample of documents only
tells which names are so common that they are aggregated before the shuffle; either way gives the same tiles.) N-grams
are compared by 64-bit hashes and classes by 128-bit ones.

Defined results: texts without words have 0 n-grams and are linked with nothing; with fewer words than n, the whole
sequence is one n-gram; rows of one id with different texts connect what these are linked with; rows without an id get
no component; an empty table gives no rows; ties don't matter, as a component is named by its smallest id; columns of
the input other than the id and the text are ignored. A text is held whole by one task, with some 30 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import smallest_reached as connected_components
from .common import Steps, arrow_batches, give_back, small_side, table

#: Nodes that meet the smallest node of their tiles together.
STAR_ROWS = 256
#: A tile up to this many nodes and n-grams isn't cut.
CHUNK_ROWS, CHUNK_GRAMS = 1024, 500_000
#: Overlapping tiles of possible links, merged up to so many nodes.
MERGED_ROWS = 4096
#: Digests of sets that a task remembers, so that a set's parts are named once.
MET = 100_000
#: Names that more nodes than this have by a sample's estimate (of so many documents) aren't shuffled by name; at most so many names.
HOT_NODES, SAMPLE_DOCS, HOT_NAMES = 100_000, 20_000, 10_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
        return x ^ (x >> np.uint64(32))


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; words are split at ASCII white space, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest as digest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    m = max(1, len(words) - n + 1)
    with np.errstate(over="ignore"):
        out = np.full(m, min(n, len(words)), dtype=np.uint64)
        for i in range(min(n, len(words))):
            out = _mix(out * _C + h[i : i + m])
    return np.unique(out)


def differing(s: int, percent: int) -> int:
    """Most n-grams in which a set of s and one that is at least as large may differ and still be linked."""
    return (100 - percent) * (100 * s // percent) // 100


class Bands:
    """Bands of sizes [low, next low). A set is named in its own band and, if it can be linked with smaller sets of
    the band below, in that one too."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        low = 1
        while not differing(low, percent):
            low += 1
        self.lows = [low]

    def of(self, s: int) -> list[int]:
        """First sizes of the bands in which a set of s is named, by index."""
        while self.lows[-1] <= s:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * 3 // 2))
        own = int(np.searchsorted(self.lows, s, side="right")) - 1
        found = [own] if own >= 0 else []
        below = own - 1
        while below >= 0 and self.percent * s <= 100 * (self.lows[below + 1] - 1):
            found.append(below)
            below -= 1
        return found

    def names(self, g: np.ndarray) -> np.ndarray:
        """Names of the parts of a set, over all its bands."""
        out = []
        for band in self.of(len(g)):
            d = differing(self.lows[band + 1] - 1, self.percent)
            k = np.uint64(d + 3 + (d + 1) // 12)
            mixed = _mix(g + np.uint64(band + 1))
            part = mixed % k
            order = np.argsort(part, kind="stable")
            part, content = part[order], _mix(mixed[order] ^ _C)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            with np.errstate(over="ignore"):
                total = np.add.reduceat(content, first)
                out.append(_mix(total + _mix(part[first] * _B + np.uint64(band + 1))))
            if len(first) <= d:  # so few parts that a partner as rare could share none of them
                out.append(_mix(np.array([band + 1], dtype=np.uint64) * _C))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """Lists of whole numbers; a null for None."""
    sizes = np.array([0 if a is None else len(a) for a in arrays], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate([*(a for a in arrays if a is not None), np.zeros(0, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([a is None for a in arrays]))


def _described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """row (a number), doc_id, n_grams, h1 and h2 (hash of the set), parts and bits (null without an id, and for a set that the task met before)."""
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("n_grams", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("parts", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        bands, met = Bands(percent), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sizes, keys, parts, bits = [], [], [], []
                for known, t in zip(b["doc_id"].is_valid().to_pylist(), b["text"].to_pylist(), strict=True):
                    g = grams(t, n)
                    key = xxh3_128_digest(g.tobytes())
                    new = known and len(g) > 0 and key not in met
                    if new:
                        if len(met) >= MET:
                            met.clear()
                        met.add(key)
                    sizes.append(len(g))
                    keys.append(key)
                    parts.append(bands.names(g).view(np.int64) if new else None)
                    bits.append(bitmap(g).tobytes() if new else None)
                h = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                yield _batch(schema, [b["row"], b["doc_id"], pa.array(sizes, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), _lists(parts), pa.array(bits, pa.binary())])
        give_back()

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)


def _shared_names(sets: DataFrame, rows: int) -> DataFrame:
    """part, node and low (the part's smallest node) for the names that several nodes have. sets: node, parts."""
    named = sets.select("node", F.explode("parts").alias("part"))
    range_ = [F.min("node").alias("low"), F.max("node").alias("high")]
    hot = None
    if rows > HOT_NODES:
        share = min(1.0, SAMPLE_DOCS / rows)
        seen = sets.sample(share, 5).select(F.explode("parts").alias("part")).groupBy("part").count()
        hot = seen.where(F.col("count") >= max(2.0, HOT_NODES * share)).orderBy(F.desc("count"), "part").limit(HOT_NAMES).select("part").collect()
    if hot:
        hot = F.broadcast(sets.sparkSession.createDataFrame(hot, "part long"))
        common = named.join(hot, "part")
        common = common.join(F.broadcast(common.groupBy("part").agg(*range_)), "part")
        named = named.join(hot, "part", "left_anti")
    w = Window.partitionBy("part")
    found = named.select("part", "node", *[c.over(w).alias(n) for c, n in ((F.min("node"), "low"), (F.max("node"), "high"))])
    if hot:
        found = found.unionByName(common)
    return found.where("low < high").select("part", "node", "low").distinct()


def _distinct_tiles(tiles: DataFrame) -> DataFrame:
    """One tile of those with the same nodes. tiles: tile, node and more."""
    key = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    one = tiles.groupBy("tile").agg(*key).groupBy("m", "x", "y").agg(F.min("tile").alias("tile")).select("tile")
    return tiles.join(one, "tile")


def _cut(tiles: DataFrame, rows: int, n_grams: int | None = None) -> DataFrame:
    """Large tiles as pairs of chunks. tiles: tile, node, label, n, and near: connected with the tile's smallest node.

    Near nodes meet the others only; the others meet all. Chunks are at least half as many as the limits ask for."""
    weight = F.greatest(F.count("*") / rows, F.sum("n") / (n_grams or 1 << 60))
    per = tiles.groupBy("tile", "near").agg(weight.alias("w")).groupBy("tile").agg(F.sum(F.when(F.col("near"), F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("near"), 0.0).otherwise(F.col("w"))).alias("b"))
    whole = F.col("a") + F.col("b") <= 1
    per = per.select("tile", *[F.when(whole, 0).otherwise(F.ceil(2 * F.col(c))).cast("int").alias(c) for c in "ab"])
    x = tiles.join(per, "tile")
    own = F.when(F.col("near"), F.pmod(F.xxhash64("node", F.lit(2)), F.nullif("a", F.lit(0)))).otherwise(F.col("a") + F.pmod(F.xxhash64("node", F.lit(2)), F.nullif("b", F.lit(0))))
    first = F.when(F.col("near"), F.col("a")).otherwise(F.lit(0))
    met = F.when(F.col("a") + F.col("b") > 0, F.sequence(first, F.col("a") + F.col("b") - 1)).otherwise(F.array(F.lit(-1)))
    pair = F.when(F.col("met") < 0, F.col("tile")).otherwise(F.xxhash64("tile", F.least("own", "met"), F.greatest("own", "met")))
    return x.select("tile", "node", "label", "n", own.cast("int").alias("own"), F.explode(met).alias("met")).select(pair.alias("tile"), "node", "label", "n")


def _together(tiles: DataFrame, steps: Steps) -> DataFrame:
    """Tiles of one smallest node become one where that takes no more comparisons, as near copies share many names and
    would meet once for each. tiles: tile, low, node, label, near, which depends on low and node only. Result: without low."""
    # pairs that differ in label can't both be near
    count = [F.count_if("near").alias("a"), F.count_if(~F.col("near")).alias("b")]
    pairs = F.col("b") * (2.0 * F.col("a") + F.col("b"))
    apart = tiles.groupBy("low", "tile").agg(*count).groupBy("low").agg(F.sum(pairs).alias("apart"), F.count("*").alias("tiles"))
    one = tiles.select("low", "node", "label", "near").distinct()
    lows = one.groupBy("low").agg(*count).select("low", pairs.alias("pairs")).join(apart, "low").where("tiles > 1 and pairs <= apart").select("low")
    lows = small_side(steps.write(lows, "jaccard-lows"))
    merged = one.join(lows, "low").withColumn("tile", F.xxhash64("low", F.lit(3)))
    out = ["tile", "node", "label", "near"]
    return steps.write(tiles.join(lows, "low", "left_anti").select(out).union(merged.select(out)), "jaccard-by-low")


def _by_tile(rows: DataFrame, each: Callable, out: str) -> DataFrame:
    """each(tile, node, label, n, payloads) of every tile, as columns of `out`. A tile is in one task, one tile at a time."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in out.split()])

    def results(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [t[c].to_numpy() for c in ("tile", "node", "label", "n")]
        payload, starts = t["payload"], np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        found = []
        for lo, hi in zip(starts, [*starts[1:], len(t)], strict=True):
            if hi - lo > 1:
                found += each(int(cols[0][lo]), *[c[lo:hi] for c in cols[1:]], [np.frombuffer(x, dtype=np.uint64) for x in payload.slice(lo, hi - lo).to_pylist()])
        if found:
            yield _batch(schema, [pa.array(c, pa.int64()) for c in zip(*found, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            tile = t["tile"].to_numpy()
            other = np.flatnonzero(tile != tile[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from results(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from results(rest)
        give_back()

    columns = rows.select("tile", "node", "label", "n", "payload")
    return columns.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, schema)


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, two to four for each n-gram, of 32,768 at most."""
    return min(1 << 15, max(64, 1 << (2 * n - 1).bit_length()))


def bitmap(g: np.ndarray) -> np.ndarray:
    """Hashed signature in 64-bit words; a bitmap of half the width is the two halves or-ed."""
    width = np.uint64(width_of(len(g)))
    at = _mix(g) % width
    out = np.zeros(int(width) // 64, dtype=np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


class Forest:
    """Links found so far; keeps one of each circle out."""

    def __init__(self, n: int) -> None:
        self.parent, self.edges = list(range(n)), []

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def bounded(size: np.ndarray, bits: list[np.ndarray], label: np.ndarray, percent: int) -> Iterator[tuple[int, list[int]]]:
    """For each set, in order of size, the larger ones of other labels that sizes and counted bits don't rule out.

    A bit that differs costs an n-gram that isn't shared, so the overlap is at most half of what both sizes leave.
    Wider bitmaps are folded to the smaller set's width, over as many halvings as linked sizes can be apart."""
    stacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    lengths = np.array([len(b) for b in bits])
    most_times = 1  # a bitmap is two to four times as wide as its set is large, so linked ones are under 200 / percent apart
    while 2 * most_times * percent < 200:
        most_times *= 2
    for w in sorted(set(lengths.tolist())):
        rows = np.flatnonzero((lengths >= w) & (lengths <= most_times * w))
        stacked[w] = rows, np.stack([np.bitwise_or.reduce(b.reshape(-1, w)) for b in (bits[r] for r in rows)])
    ends = np.searchsorted(size, 100 * size // percent, side="right")
    for i in range(len(bits) - 1):
        if ends[i] <= i + 1:
            continue
        rows, m = stacked[len(bits[i])]
        me, lo, hi = np.searchsorted(rows, (i, i + 1, ends[i]))
        if lo >= hi:
            continue
        apart = np.bitwise_count(m[lo:hi] ^ m[me]).sum(1, dtype=np.int64)
        j = rows[lo:hi]
        most = (size[i] + size[j] - apart) // 2
        ok = (100 * most >= percent * (size[i] + size[j] - most)) & (label[j] != label[i])
        if ok.any():
            yield i, j[ok].tolist()


def possible_groups(size: np.ndarray, bits: list[np.ndarray], label: np.ndarray, percent: int) -> list[list[int]]:
    """Groups of sets, by position, connected by pairs of other labels that bit counts leave possible."""
    order = np.argsort(size, kind="stable")
    f = Forest(len(size))
    for i, js in bounded(size[order], [bits[k] for k in order], label[order], percent):
        for j in js:
            f.link(i, j)
    groups: dict[int, list[int]] = {}
    for i in range(len(size)):
        groups.setdefault(f.root(i), []).append(int(order[i]))
    return [g for g in groups.values() if len(g) > 1]


def links(label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges between labels that links connect, by intersecting sorted arrays; no edge within what is connected."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets, label = [sets[k] for k in order], label[order]
    names, at = np.unique(label, return_inverse=True)
    f = Forest(len(names))
    for i, js in bounded(size[order], [bitmap(s) for s in sets], label, percent):
        for j in js:
            if f.root(at[i]) != f.root(at[j]):
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    f.link(int(at[i]), int(at[j]))
    return [(int(names[a]), int(names[b])) for a, b in f.edges]


class _Join:
    """The steps that both rounds share. nodes: node, doc_id, h1, h2; bits: node, n, payload."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, bits: DataFrame, n: int, percent: int, steps: Steps) -> None:
        self.docs, self.nodes, self.bits, self.n, self.percent, self.steps = docs, nodes, bits, n, percent, steps

    def edges(self, tiles: DataFrame, merge: bool = False) -> DataFrame:
        """tiles: tile, node, label, n. Result: a and b, labels that links connect. merge: see _merged."""
        percent, steps = self.percent, self.steps

        def narrow(tile: int, node: np.ndarray, label: np.ndarray, n: np.ndarray, bits: list[np.ndarray]) -> list[tuple]:
            out = []
            for k, g in enumerate(possible_groups(n, bits, label, percent)):
                name = int(_mix(np.array([tile], dtype=np.int64).view(np.uint64) * _B + np.uint64(k)).view(np.int64)[0])
                out += [(name, int(node[i]), int(label[i]), int(n[i])) for i in g]
            return out

        def decide(tile: int, node: np.ndarray, label: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
            return links(label, sets, percent)

        small = steps.write(_by_tile(tiles.join(self.bits.select("node", "payload"), "node"), narrow, "tile node label n"), "jaccard-possible")
        small = self._merged(small) if merge else small
        small = _cut(_distinct_tiles(small).withColumn("near", F.lit(False)), CHUNK_ROWS, CHUNK_GRAMS)
        small = steps.write(small, "jaccard-asked")
        sets = self._sets(steps.write(small.select("node").distinct(), "jaccard-ids"))
        return steps.write(_by_tile(small.join(sets, "node"), decide, "a b").distinct(), "jaccard-edges")

    def _merged(self, small: DataFrame) -> DataFrame:
        """Small tiles that share nodes become one, so that each node's n-grams travel once; not beyond `MERGED_ROWS`."""
        first = small.groupBy("tile").agg(F.min("node").alias("a"))
        star = small.join(first, "tile").select("a", F.col("node").alias("b")).where("a < b").distinct()
        group = connected_components(self.steps.write(star, "jaccard-stars"), "jaccard-merged")
        size = group.groupBy("label").count().where(F.col("count") <= MERGED_ROWS).select(F.col("label").alias("group"))
        group = group.withColumnRenamed("label", "group").join(small_side(self.steps.write(size, "jaccard-sizes")), "group")
        x = small.join(small_side(self.steps.write(group, "jaccard-groups")), "node", "left")
        one = x.where("group is not null").select(F.col("group").alias("tile"), "node", "label", "n").distinct()
        return self.steps.write(one.union(x.where("group is null").select("tile", "node", "label", "n")), "jaccard-together")

    def _sets(self, asked: DataFrame) -> DataFrame:
        """node and payload, the sorted n-grams, of these nodes."""
        n = self.n
        schema = T.StructType([self.docs.schema["doc_id"], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("payload", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from xxhash import xxh3_128_digest

            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    sets = [grams(t, n).tobytes() for t in b["text"].to_pylist()]
                    h = np.frombuffer(b"".join(map(xxh3_128_digest, sets)), dtype=np.int64).reshape(-1, 2)
                    yield _batch(schema, [b["doc_id"], pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(sets, pa.binary())])
            give_back()

        wanted = self.steps.write(self.nodes.join(small_side(asked), "node"), "jaccard-wanted")
        texts = self.docs.select("doc_id", "text").join(small_side(wanted.select("doc_id").distinct()), "doc_id")
        # an id may stand on several rows and texts: the hash tells which is meant
        got = texts.mapInArrow(run, schema).join(small_side(wanted), ["doc_id", "h1", "h2"])
        return got.select("node", "payload").dropDuplicates(["node"])


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """docs: doc_id, text. Result: doc_id, n_grams, component_id (smallest id that links reach).

    percent: from 1 to 99."""
    if not 1 <= percent <= 99:
        raise ValueError(f"percent from 1 to 99, not {percent}")
    arrow_batches(docs.sparkSession)
    steps = Steps(docs.sparkSession)
    described = steps.write(_described(docs, n, percent), "jaccard-sets")
    d = steps.write(described.drop("parts", "bits"), "jaccard-rows")
    classes = d.where("n_grams > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("low_id"), F.count("*").alias("copies"))
    classes = steps.write(classes.where("copies > 1").drop("copies"), "jaccard-classes")

    def with_node(rows: DataFrame) -> DataFrame:
        """Add node, the smallest row of the class, and low_id, the class's smallest id."""
        x = rows.join(small_side(classes), ["h1", "h2"], "left")
        return x.withColumns({"node": F.when(F.col("n_grams") > 0, F.coalesce("node", "row")), "low_id": F.coalesce("low_id", "doc_id")})

    sets = with_node(described.where("parts is not null"))
    named = steps.write(_shared_names(sets.select("node", "parts"), d.count()), "jaccard-names")
    in_tiles = steps.write(named.select("node").distinct(), "jaccard-nodes")
    bits = sets.join(small_side(in_tiles), "node").select("node", F.col("n_grams").alias("n"), F.col("bits").alias("payload"), "doc_id", "h1", "h2").dropDuplicates(["node"])
    bits = steps.write(bits, "jaccard-bits")
    steps.drop(described)
    join = _Join(docs, bits.select("node", "doc_id", "h1", "h2"), bits.select("node", "n", "payload"), n, percent, steps)
    size = bits.select("node", "n")

    # first round: each node with the smallest of its tiles, some of them together
    star = named.where("low < node").select("low", "node").distinct()
    chunks = star.groupBy("low").agg(F.ceil(F.count("*") / STAR_ROWS).alias("chunks"))
    star = star.join(chunks, "low").select(F.xxhash64("low", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("tile"), "node", "low")
    star = star.select("tile", "node").union(star.select("tile", F.col("low").alias("node")).distinct())
    first = join.edges(star.join(size, "node").select("tile", "node", F.col("node").alias("label"), "n"))
    # rows of one id with different texts
    rows = with_node(d)
    many = rows.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    tied = rows.join(small_side(steps.write(many.select("doc_id", "a"), "jaccard-repeated")), "doc_id").where("node > a").select("a", F.col("node").alias("b"))
    first = steps.write(first.union(tied).distinct(), "jaccard-first")
    labels = connected_components(first, "jaccard-labels")

    # second round: tiles of several components, without their smallest nodes
    x = named.withColumnRenamed("part", "tile").join(small_side(labels), "node", "left").select("tile", "node", "low", F.coalesce("label", "node").alias("label"))
    low = F.min_by("label", "node")
    other = F.when(F.col("node") > F.col("low"), F.col("label"))
    open_ = x.groupBy("tile").agg(low.alias("low_label"), F.min(other).alias("x"), F.max(other).alias("y")).where("x < y").select("tile", "low_label")
    x = x.where("node > low").join(open_, "tile").select("tile", "low", "node", "label", (F.col("label") == F.col("low_label")).alias("near"))
    x = _distinct_tiles(_together(steps.write(x, "jaccard-open"), steps)).join(size, "node")
    second = join.edges(steps.write(_cut(x, CHUNK_ROWS), "jaccard-cut"), merge=True)
    further = connected_components(second, "jaccard-further")

    of = rows.join(small_side(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = of.join(small_side(further).toDF("at", "to"), F.col("label") == F.col("at"), "left").withColumn("label", F.coalesce("to", "label"))
    of = steps.write(of.select("doc_id", "n_grams", "label", "low_id"), "jaccard-labelled")
    least = steps.write(of.where("label is not null").groupBy("label").agg(F.min("low_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "jaccard-least")
    out = of.join(small_side(least), "label", "left")
    return out.select("doc_id", "n_grams", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).withColumnRenamed("n_grams", "n_shingles")


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLE: dict[str, str] = {}
