"""Dense volumes as a table of blocks: one row holds a block of voxels as bytes, many stacks side by side.

Columns: the stack's keys, depth (its slices), bz, by, bx (the block's place), data (values in order z, y, x, several
channels one after another). Blocks at the far borders are smaller. Filters get a block with a halo: each block sends
its neighbours the strips that lie within their halo, so a group never holds more than a block and its halo, and what
travels are bytes, not rows of voxels. Components are labelled in each block; labels meet over faces, edges and corners,
and a graph of labels joins them, so a region may reach over any number of blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import bounded_batches, materialize, small_side
from . import kernels as K
from .components import smallest_reached
from .partition import numbered

Box = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]
#: A stack's voxels are numbered below this, and stacks below 2^63 / VOXELS, so that both fit a whole number.
VOXELS = 1 << 40
#: Neighbours that come later in z, y, x.
LATER = [d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


@dataclass(frozen=True)
class Grid:
    height: int
    width: int
    #: voxels of a block along z, y, x
    block: tuple[int, int, int]
    #: columns that name a stack
    keys: tuple[str, ...] = ()
    dtype: str = "<f8"
    channels: int = 1
    #: value of voxels that aren't there; with NaN, local contrast lets lines end where their voxels do
    fill: float = 0.0

    @property
    def marked(self) -> Grid:
        """The grid of two channels: values, and 1 where a voxel is there."""
        return replace(self, dtype="<f8", channels=2, fill=0.0)

    @property
    def place(self) -> list[str]:
        return [*self.keys, "depth", "bz", "by", "bx"]

    def sizes(self, depth: int) -> tuple[int, int, int]:
        return depth, self.height, self.width

    def box(self, at: tuple[int, int, int], depth: int, halo: tuple[int, int, int] = (0, 0, 0)) -> Box:
        """Voxels of a block and its halo within the stack."""
        return tuple((max(0, i * b - h), min(n, (i + 1) * b + h)) for i, b, n, h in zip(at, self.block, self.sizes(depth), halo, strict=True))  # type: ignore[return-value]

    def near(self, at: tuple[int, int, int], depth: int, halo: tuple[int, int, int]) -> Iterator[tuple[int, int, int]]:
        """Blocks whose halo reaches into this one, itself included."""
        own = self.box(at, depth)
        spans = [range(max(0, (a - h) // b), min((n - 1) // b, (e - 1 + h) // b) + 1) for (a, e), b, n, h in zip(own, self.block, self.sizes(depth), halo, strict=True)]
        return itertools.product(*spans)  # type: ignore[return-value]


@dataclass(frozen=True)
class Place:
    """Where a block lies: its voxels, and those of the array that a function was given."""

    own: Box
    given: Box
    depth: int

    def inner(self, v: np.ndarray) -> np.ndarray:
        """The block without its halo."""
        return v[(..., *[slice(a - g, b - g) for (a, b), (g, _) in zip(self.own, self.given, strict=True)])]


def _pieces_schema(df: DataFrame, grid: Grid) -> T.StructType:
    whole = {"depth": T.LongType(), "bz": T.IntegerType(), "by": T.IntegerType(), "bx": T.IntegerType()}
    return T.StructType([*[T.StructField(k, whole.get(k) or df.schema[k].dataType) for k in grid.place], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("piece", T.BinaryType())])


def _batch(keys: list[pa.Array], found: list[tuple], names: list[str], n_keys: int) -> pa.RecordBatch:
    """found: (row of the keys, depth, bz, by, bx, at, piece)."""
    rows = pa.array([f[0] for f in found], pa.int64())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
    columns = [pa.array([f[i + 1] for f in found], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*[k.take(rows) for k in keys[:n_keys]], *columns], names=names)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[tuple[pa.RecordBatch, int, int]]]]:
    """Rows that follow each other with equal keys: the keys, and (batch, first, end) of their rows."""
    same = lambda p, q: all(a == b or (a != a and b != b) for a, b in zip(p, q, strict=True))
    now, held = None, []
    for b in batches:
        keys, first = list(zip(*[b[k].to_pylist() for k in names], strict=True)), 0
        for i, key in enumerate(keys):
            if now is not None and same(key, now):
                continue
            if i > first:
                held.append((b, first, i))
            if held:
                yield now, held
            now, held, first = key, [], i
        if len(keys) > first:
            held.append((b, first, len(keys)))
    if held:
        yield now, held


def _dealt(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with equal keys follow each other in one partition; Python reads them as a stream, not group by group."""
    return rows.repartition(*names).sortWithinPartitions(*names)


def _assembled(key: tuple, held: list[tuple[pa.RecordBatch, int, int]], grid: Grid, halo: tuple[int, int, int]) -> tuple[np.ndarray, Place]:
    """The array (channels, z, y, x) of a block and its halo from its pieces; what no piece covers is the grid's fill."""
    depth, at = key[-4], key[-3:]
    given = grid.box(at, depth, halo)
    v = np.full((grid.channels, *[b - a for a, b in given]), grid.fill, np.dtype(grid.dtype))
    low = [a for a, _ in given]
    for b, first, end in held:
        for where, data in zip(b["at"].slice(first, end - first), b["piece"].slice(first, end - first), strict=True):
            (z, y, x), shape = (where := where.values.to_numpy().reshape(-1, 6))[0, :3] - low, where[0, 3:]
            part = np.frombuffer(data.as_buffer(), grid.dtype)
            if len(where) > 1:  # lines of one length that begin at one x
                v[:, where[:, 0] - low[0], where[:, 1] - low[1], x : x + shape[2]] = part.reshape(grid.channels, len(where), shape[2])
            else:
                v[:, z:, y:, x:][:, : shape[0], : shape[1], : shape[2]] = part.reshape(grid.channels, *shape)
    return v, Place(grid.box(at, depth), given, depth)


#: Bytes and rows of results that a task gathers before it hands them on.
SEND_BYTES, SEND_ROWS = 4 << 20, 1024


def _sent(rows: Iterator[tuple[tuple, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (keys, values) as batches of bounded size."""
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for key, values in rows:
        held.append((*key, *values))
        size += sum(len(v) for v in values if isinstance(v, bytes))
        if size >= SEND_BYTES or len(held) >= SEND_ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _strips(v: np.ndarray, key: tuple, grid: Grid, halo: tuple[int, int, int]) -> Iterator[tuple[tuple, tuple]]:
    """A block's array (channels, z, y, x) as the strips of it that lie within the halo of each block near it."""
    depth, at = key[-4], key[-3:]
    own = grid.box(at, depth)
    for to in grid.near(at, depth, halo):
        cut = [(max(a, p), min(e, q)) for (a, e), (p, q) in zip(own, grid.box(to, depth, halo), strict=True)]
        part = v[(slice(None), *[slice(p - a, q - a) for (p, q), (a, _) in zip(cut, own, strict=True)])]
        yield (*key[:-3], *to), ([*[p for p, _ in cut], *part.shape[1:]], np.ascontiguousarray(part).tobytes())


def _gather(rows: DataFrame, grid: Grid, halo: tuple[int, int, int], fn: Callable[[np.ndarray, Place], dict], fields: str, then: tuple[Grid, tuple[int, int, int]] | None = None) -> DataFrame:
    """fn turns a block's array and its place into columns; a row of them stays with the block's keys.

    rows: pieces, or whole blocks where no halo is wanted. then: the grid of fn's data and the halo of the step that follows;
    the result is the pieces for it, cut by the same task."""
    bounded_batches(rows.sparkSession)
    own = T.StructType.fromDDL(fields)
    pieces = "piece" in rows.columns
    schema = _pieces_schema(rows, grid) if then else T.StructType([*[rows.schema[k] for k in grid.place], *own.fields])
    kinds = [pa.int32() if f.name in ("bz", "by", "bx") else pa.list_(pa.int32()) if f.name == "at" else _arrow(f.dataType) for f in schema.fields[len(grid.keys) :]]
    names = schema.fieldNames()

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, Place]]:
        if pieces:
            for key, held in _runs(batches, grid.place):
                yield key, *_assembled(key, held, grid, halo)
            return
        for b in batches:
            for key, data in zip(zip(*[b[k].to_pylist() for k in grid.place], strict=True), b["data"], strict=True):
                box = grid.box(key[-3:], key[-4])
                yield key, np.frombuffer(data.as_buffer(), grid.dtype).reshape(grid.channels, *[e - a for a, e in box]), Place(box, box, key[-4])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        for key, v, place in arrays(batches):
            out = fn(v, place)
            if then:
                shape = [e - a for a, e in place.own]
                yield from _strips(np.frombuffer(out["data"][0], then[0].dtype).reshape(then[0].channels, *shape), key, *then)
            else:
                for values in zip(*[out[f.name] for f in own.fields], strict=True):
                    yield key, values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            sent = pa.schema([*[first.schema.field(k) for k in grid.keys], *map(pa.field, names[len(grid.keys) :], kinds)])
            yield from _sent(results(itertools.chain([first], batches)), sent)

    return (_dealt(rows, grid.place) if pieces else rows.select(*grid.place, "data")).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary(), T.IntegerType(): pa.int32()}[kind]


def _blocks_of(pieces: DataFrame, grid: Grid) -> DataFrame:
    return _gather(pieces, grid, (0, 0, 0), lambda v, _: {"data": [v.tobytes()]}, "data binary")


#: Bytes of lines that are cut together.
LINE_BYTES = 1 << 20


def _as(values: np.ndarray, dtype: str) -> np.ndarray:
    """Numbers of another kind; whole ones that it doesn't hold are an error."""
    kind = np.dtype(dtype)
    if kind.kind in "iu" and len(values) and not (values.min() >= np.iinfo(kind).min and values.max() <= np.iinfo(kind).max):
        raise OverflowError(f"a line holds numbers that {kind} doesn't")
    return values.astype(kind)


def from_lines(lines: DataFrame, values: str, grid: Grid, halo: tuple[int, int, int] | None = None) -> DataFrame:
    """lines: keys, depth, z, y and an array of a line's values along x. Lines that aren't there hold the grid's fill.

    halo: that of the step that follows; the result is the pieces for it instead of blocks."""
    bounded_batches(lines.sparkSession)
    names = [*grid.place, "at", "piece"]
    sides, reach = grid.block, halo or (0, 0, 0)
    most = max(1, min(1024, LINE_BYTES // (8 * grid.width)))

    def over(c: int, axis: int, n: int) -> range:
        """Blocks along an axis whose halo holds a coordinate."""
        b, h = sides[axis], reach[axis]
        return range(max(0, (c - h) // b), min((n - 1) // b, (c + h) // b) + 1)

    def pieces(b: pa.RecordBatch) -> Iterator[tuple]:
        """Lines of one length for one block go together."""
        raw = b["__line"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = _as(b["__line"].flatten().to_numpy(zero_copy_only=False), grid.dtype)
        start, length = np.cumsum(raw) - raw, np.minimum(raw, grid.width)
        z, y, depth = (b[c].to_numpy() for c in ("z", "y", "depth"))
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(length.tolist(), depth.tolist(), *[b[k].to_pylist() for k in grid.keys], strict=True)):
            for to in itertools.product(over(int(z[i]), 0, key[1]), over(int(y[i]), 1, grid.height)):
                groups.setdefault((key, to), []).append(i)
        for (key, to), found in groups.items():
            at, n, (_, h) = np.array(found), key[0], (0, reach[2])
            block = flat[start[at][:, None] + np.arange(n)]
            for i in range((n - 1 + h) // sides[2] + 1 if n else 0):
                low, high = max(0, i * sides[2] - h), min(n, (i + 1) * sides[2] + h)
                if i <= (grid.width - 1) // sides[2] and low < high:
                    where = np.column_stack([z[at], y[at], *[np.full(len(at), c) for c in (low, 1, 1, high - low)]])
                    yield found[0], key[1], *to, i, where.ravel().tolist(), np.ascontiguousarray(block[:, low:high]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
                yield _batch([b[k] for k in grid.keys], list(pieces(b)), names, len(grid.keys))

    rows = lines.select(*grid.keys, F.col("depth").cast("long").alias("depth"), F.col("z").cast("int").alias("z"), F.col("y").cast("int").alias("y"), F.col(values).alias("__line"))
    out = rows.mapInArrow(run, _pieces_schema(rows, grid))
    return _blocks_of(out, grid) if halo is None else out


def from_slices(slices: DataFrame, grid: Grid, stored: str = "<u2") -> DataFrame:
    """slices: keys, depth, z and the content of a raw slice, or of strips of lines that begin at y0. A short one gives the
    pixels that it has."""
    bounded_batches(slices.sparkSession)
    names = [*grid.place, "at", "piece"]
    bz, by, bx = grid.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                depth, z = b["depth"][i].as_py(), b["z"][i].as_py()
                raw = b["content"][i].as_buffer() or b""
                first = b["y0"][i].as_py()
                n = min((grid.height - first) * grid.width, len(raw) // np.dtype(stored).itemsize)
                image = np.zeros(-(-n // grid.width) * grid.width, np.dtype(grid.dtype))
                image[:n] = np.frombuffer(raw, stored, n)
                image = image.reshape(-1, grid.width)
                found = []
                for row in range(first // by, -(-(first + len(image)) // by) if n else 0):
                    low, high = max(first, row * by), min(first + len(image), (row + 1) * by)
                    for x in range(0, grid.width, bx):
                        part = image[low - first : high - first, x : x + bx]
                        found.append((i, depth, z // bz, row, x // bx, [z, low, x, 1, *part.shape], part.tobytes()))
                yield _batch([b[k] for k in grid.keys], found, names, len(grid.keys))

    rows = slices.select(*grid.keys, F.col("depth").cast("long").alias("depth"), F.col("z").cast("int").alias("z"), F.col("y0").cast("int").alias("y0") if "y0" in slices.columns else F.lit(0).alias("y0"), "content")
    return _blocks_of(rows.mapInArrow(run, _pieces_schema(rows, grid)), grid)


def from_voxels(voxels: DataFrame, value: str, grid: Grid) -> DataFrame:
    """voxels: keys, depth, z, y, x and a value. Voxels that aren't there are 0."""
    bounded_batches(voxels.sparkSession)
    at = [F.floor(F.col(c) / b).cast("int").alias(f"b{c}") for c, b in zip("zyx", grid.block, strict=True)]
    rows = voxels.select(*grid.keys, F.col("depth").cast("long").alias("depth"), *at, *[F.col(c).cast("long").alias(c) for c in "zyx"], F.col(value).cast("double").alias("__v"))
    schema = T.StructType([*[rows.schema[k] for k in grid.place], T.StructField("data", T.BinaryType())])

    def run(t: pa.Table) -> pa.Table:
        box = grid.box(tuple(t[c][0].as_py() for c in ("bz", "by", "bx")), t["depth"][0].as_py())
        v = np.zeros([b - a for a, b in box], np.dtype(grid.dtype))
        v[tuple(t[c].to_numpy() - a for c, (a, _) in zip("zyx", box, strict=True))] = t["__v"].to_numpy()
        return pa.Table.from_arrays([*[t[k].slice(0, 1) for k in grid.place], pa.array([v.tobytes()], pa.binary())], names=schema.fieldNames())

    return rows.groupBy(*grid.place).applyInArrow(run, schema)


def exchange(blocks: DataFrame, grid: Grid, halo: tuple[int, int, int]) -> DataFrame:
    """Each block, and for every neighbour the strip of it that lies within the neighbour's halo."""
    return _gather(blocks, grid, (0, 0, 0), lambda v, _: {"data": [v.tobytes()]}, "data binary", (grid, halo))


def with_halo(blocks: DataFrame, grid: Grid, halo: tuple[int, int, int], fn: Callable[[np.ndarray, Place], dict], fields: str, then: tuple[Grid, tuple[int, int, int]] | None = None) -> DataFrame:
    """fn sees the array (channels, z, y, x) of each block with its halo, cut at the stack's borders, and gives columns.

    blocks may be the pieces for this halo already, from a step that cut its results for it; without a halo nothing moves."""
    ready = "piece" in blocks.columns or not any(halo)
    return _gather(blocks if ready else exchange(blocks, grid, halo), grid, halo, fn, fields, then)


def filtered(blocks: DataFrame, grid: Grid, halo: tuple[int, int, int], fn: Callable[[np.ndarray], np.ndarray], then: tuple[Grid, tuple[int, int, int]] | None = None) -> DataFrame:
    """fn maps an array with its halo to one of any number of channels; the blocks' own part stays, as doubles."""
    return with_halo(blocks, grid, halo, lambda v, p: {"data": [np.ascontiguousarray(p.inner(fn(v)), "<f8").tobytes()]}, "data binary", then)


#: An exchange along all axes at once is taken up to this many voxels for each voxel of a block, else one along each axis.
MOST_COPIES = 4.0


def first_halo(grid: Grid, r: tuple[int, int, int], small: tuple[int, int, int]) -> tuple[int, int, int]:
    """The halo that local contrast asks for at first (radii along x, y, z)."""
    if 0 in r or 0 in small:
        return (0, 0, 0)
    halo = tuple(a + b for a, b in zip(r, small, strict=True))[::-1]
    copies = np.prod([(b + 2 * h) / b for b, h in zip(grid.block, halo, strict=True)])
    return halo if copies <= MOST_COPIES else (0, 0, r[0])  # type: ignore[return-value]


def normalize(blocks: DataFrame, grid: Grid, r: tuple[int, int, int], small: tuple[int, int, int], least: float, then: tuple[Grid, tuple[int, int, int]] | None = None) -> DataFrame:
    """Local contrast of each voxel (radii along x, y, z). Wide radii go axis by axis, so that halos don't multiply.

    Where the grid's fill is NaN, lines end where their voxels do, and the result is of the marked grid. blocks may be the
    pieces for `first_halo`; then: the grid of the result and the halo of the step that follows."""
    ragged = bool(np.isnan(grid.fill))
    marked = (lambda n, v: np.concatenate([n, ~np.isnan(v)])) if ragged else (lambda n, v: n)
    if 0 in r or 0 in small:
        return filtered(blocks, grid, (0, 0, 0), lambda v: marked(np.where(v >= least, v.astype(float), 0.0), v), then)
    halo = tuple(a + b for a, b in zip(r, small, strict=True))[::-1]
    if first_halo(grid, r, small) == halo:
        whole = K.normalize_within if ragged else K.normalize
        return filtered(blocks, grid, halo, lambda v: marked(whole(v.astype(float), r, small, least), v), then)
    only = lambda axis, n: tuple(n if i == axis else 0 for i in range(3))
    # channels: the value, the erosion and the dilation; axes x and y, then both steps along z, then y and x for the box
    wide = replace(grid, dtype="<f8", channels=3)
    # sums of whole numbers are exact, so with NaN only the ratio is rounded
    running, voxels_of_box = (K.running_within, np.prod([2 * k + 1 for k in small])) if ragged else (K.running, 1)

    def shrink(v: np.ndarray, axis: int, k: int) -> np.ndarray:
        low, high = (v[1], v[2]) if len(v) == 3 else (v[0].astype(float),) * 2
        return np.stack([v[0].astype(float), running(low, axis, k, np.minimum), running(high, axis, k, np.maximum)])

    def mean(v: np.ndarray, axis: int, k: int) -> np.ndarray:
        return np.stack([v[0], *(running(c, axis, k, np.add) / (1 if ragged else 2 * k + 1) for c in v[1:])])

    out = filtered(blocks, grid, only(2, r[0]), lambda v: shrink(v, 2, r[0]), (wide, only(1, r[1])))
    out = filtered(out, wide, only(1, r[1]), lambda v: shrink(v, 1, r[1]), (wide, only(0, r[2] + small[2])))
    out = filtered(out, wide, only(0, r[2] + small[2]), lambda v: mean(shrink(v, 0, r[2]), 0, small[2]), (wide, only(1, small[1])))
    out = filtered(out, wide, only(1, small[1]), lambda v: mean(v, 1, small[1]), (wide, only(2, small[0])))

    def contrast(v: np.ndarray) -> np.ndarray:
        v = mean(v, 2, small[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            return marked(np.where(v[0] >= least, (v[0] * voxels_of_box - v[1]) / (v[2] - v[1]), 0.0)[None], v[:1])

    return filtered(out, wide, only(2, small[0]), contrast, then)


def voxels(blocks: DataFrame, grid: Grid, out: str = "v") -> DataFrame:
    """Rows (keys, z, y, x, value) of one channel's blocks; of a marked grid the voxels that are there."""
    bounded_batches(blocks.sparkSession)
    schema = T.StructType([*[blocks.schema[k] for k in grid.keys], *T.StructType.fromDDL(f"z long, y long, x long, `{out}` double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                box = grid.box(tuple(b[c][i].as_py() for c in ("bz", "by", "bx")), b["depth"][i].as_py())
                at = np.indices([e - a for a, e in box]).reshape(3, -1)
                v = np.frombuffer(b["data"][i].as_buffer(), grid.dtype).astype(float)
                if grid.channels == 2:
                    v, there = v.reshape(2, -1)
                    at, v = at[:, there != 0], v[there != 0]
                same = pa.array(np.full(len(v), i))
                yield pa.RecordBatch.from_arrays([*[b[k].take(same) for k in grid.keys], *[pa.array(x + a) for x, (a, _) in zip(at, box, strict=True)], pa.array(v)], names=schema.fieldNames())

    return blocks.mapInArrow(run, schema)


def local_labels(mask: np.ndarray, place: Place, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the stack of a block's foreground voxels, ascending, and for each the smallest of its part of a region."""
    inside = np.flatnonzero(mask.ravel())
    label = K.label_block(inside, *mask.shape[1:])

    def number(i: np.ndarray) -> np.ndarray:
        z, y, x = np.unravel_index(i, mask.shape)
        return ((z + place.own[0][0]) * grid.height + y + place.own[1][0]) * grid.width + x + place.own[2][0]

    return number(inside), number(label)


def _shells(parts: DataFrame, grid: Grid) -> DataFrame:
    """Labelled voxels on a block's faces, for itself (towards later neighbours) and for its earlier neighbours."""
    names = [*grid.place, "lin", "label"]
    schema = T.StructType([*[parts.schema[k] for k in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, keep = [], []
            for i in range(b.num_rows):
                lin, label = (np.frombuffer(b[c][i].as_buffer(), np.int64) for c in ("lin", "label"))
                depth, at = b["depth"][i].as_py(), tuple(b[c][i].as_py() for c in ("bz", "by", "bx"))
                box = grid.box(at, depth)
                coord = np.unravel_index(lin, grid.sizes(depth))
                sides = {(a, s): coord[a] == (box[a][1] - 1 if s > 0 else box[a][0]) for a in range(3) for s in (-1, 1)}
                own = np.zeros(len(lin), bool)
                for d in LATER:
                    for sign in (1, -1):
                        to = tuple(p + sign * s for p, s in zip(at, d, strict=True))
                        if any(not 0 <= p <= (n - 1) // k for p, n, k in zip(to, grid.sizes(depth), grid.block, strict=True)):
                            continue
                        on = np.logical_and.reduce([sides[a, sign * s] for a, s in enumerate(d) if s])
                        if sign > 0:
                            own |= on
                        elif on.any():
                            keep.append(i)
                            found.append((depth, *to, lin[on].tobytes(), label[on].tobytes()))
                if own.any():
                    keep.append(i)
                    found.append((depth, *at, lin[own].tobytes(), label[own].tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            which = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b[k].take(which) for k in grid.keys], *[pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds)]], names=names)

    return parts.select(*names).mapInArrow(run, schema)


def _meeting(shells: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of labels that touch over a block's faces."""
    schema = T.StructType([*[shells.schema[k] for k in grid.keys], *T.StructType.fromDDL("a long, b long").fields])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        for key, held in _runs(batches, grid.place):
            lin, label = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for b, first, end in held for x in b[c].slice(first, end - first)]) for c in ("lin", "label"))
            lin, first = np.unique(lin, return_index=True)
            label = label[first]
            i, j = K.touching(lin, grid.height, grid.width)
            found = np.column_stack([label[i], label[j]])
            for pair in np.unique(found[found[:, 0] != found[:, 1]], axis=0).tolist():
                yield key[: len(grid.keys)], tuple(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _sent(pairs(itertools.chain([first], batches)), pa.schema([*[first.schema.field(k) for k in grid.keys], ("a", pa.int64()), ("b", pa.int64())]))

    return _dealt(shells, grid.place).mapInArrow(run, schema)


def labelled_voxels(parts: DataFrame, grid: Grid, border: bool = False) -> DataFrame:
    """Rows (keys, lin, label) of blocks with labels; border: only voxels at a slice's rim."""
    schema = T.StructType([*[parts.schema[k] for k in grid.keys], *T.StructType.fromDDL("lin long, label long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lin, label = (np.frombuffer(b[c][i].as_buffer(), np.int64) for c in ("lin", "label"))
                if border:
                    y, x = np.divmod(lin % (grid.height * grid.width), grid.width)
                    rim = (x == 0) | (x == grid.width - 1) | (y == 0) | (y == grid.height - 1)
                    lin, label = lin[rim], label[rim]
                same = pa.array(np.full(len(lin), i))
                yield pa.RecordBatch.from_arrays([*[b[k].take(same) for k in grid.keys], pa.array(lin), pa.array(label)], names=schema.fieldNames())

    return parts.select(*grid.keys, "lin", "label").mapInArrow(run, schema)


def _wrapped(parts: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of labels that touch only because a row runs on into the next, and a slice into the next."""
    rim = materialize(labelled_voxels(parts, grid, True), "rim")
    y, x = F.expr(f"(lin div {grid.width}) % {grid.height}"), F.col("lin") % grid.width
    steps = [(dy, dx, (dz * grid.height + dy) * grid.width + dx) for dz, dy, dx in LATER]
    over = lambda c, s, n: (c == 0) if s < 0 else (c == n - 1) if s > 0 else F.lit(False)
    out = F.filter(F.array(*[F.when(over(y, dy, grid.height) | over(x, dx, grid.width), F.col("lin") + step) for dy, dx, step in steps]), lambda e: e.isNotNull())
    from_ = rim.select(*grid.keys, F.col("label").alias("a"), F.explode(out).alias("lin"))
    return from_.join(rim.select(*grid.keys, "lin", F.col("label").alias("b")), [*grid.keys, "lin"]).where("a <> b").select(*grid.keys, "a", "b").distinct()


def unpacked(rows: DataFrame, keys: tuple[str, ...], columns: dict[str, type]) -> DataFrame:
    """Rows that hold columns of numbers as bytes, one row a number again."""
    kinds = {np.int64: T.LongType(), np.float64: T.DoubleType()}
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(c, kinds[t]) for c, t in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = [pa.array(np.frombuffer(b[c][i].as_buffer(), t)) for c, t in columns.items()]
                same = pa.array(np.full(len(found[0]), i))
                yield pa.RecordBatch.from_arrays([*[b[k].take(same) for k in keys], *found], names=schema.fieldNames())

    return rows.select(*keys, *columns).mapInArrow(run, schema)


def numbered_stacks(blocks: DataFrame, grid: Grid) -> DataFrame:
    """Each stack's keys with a number (`stack_no`)."""
    if not grid.keys:
        return blocks.sparkSession.range(1).select(F.col("id").alias("stack_no"))
    return materialize(numbered(blocks.select(*grid.keys).distinct(), list(grid.keys), out="stack_no"), "stacks")


def joined_labels(parts: DataFrame, grid: Grid, wrap: bool = False) -> DataFrame:
    """parts: written blocks with `lin` and `label` (bytes of 64-bit numbers). Result: keys, label, final of all labels
    that meet others; the final label is the smallest voxel number of the whole region."""
    deepest = parts.agg(F.max("depth")).first()[0] or 0
    if deepest * grid.height * grid.width > VOXELS:
        raise ValueError("a stack has more voxels than its numbers allow")
    edges = _meeting(_shells(parts, grid), grid)
    if wrap:
        edges = edges.unionByName(_wrapped(parts, grid))
    stacks = numbered_stacks(parts, grid)
    edges = edges.join(small_side(stacks), list(grid.keys)) if grid.keys else edges.withColumn("stack_no", F.lit(0).cast("long"))
    node = lambda c: (F.col("stack_no") * VOXELS + F.col(c)).alias(c)
    reached = smallest_reached(edges.select(node("a"), node("b")), "blocks")
    out = reached.select(F.expr(f"node div {VOXELS}").alias("stack_no"), (F.col("node") % VOXELS).alias("label"), (F.col("label") % VOXELS).alias("final"))
    return materialize(out.join(small_side(stacks), "stack_no").select(*grid.keys, "label", "final"), "joined-labels")


def relabelled(rows: DataFrame, joined: DataFrame, grid: Grid) -> DataFrame:
    """Rows (keys, label, ...) with the final label."""
    return rows.join(joined, [*grid.keys, "label"], "left").withColumn("label", F.coalesce("final", "label")).drop("final")


def label_blocks(blocks: DataFrame, grid: Grid, foreground: Callable[[np.ndarray], np.ndarray], wrap: bool = False) -> DataFrame:
    """Components of all stacks: keys, z, y, x, label (the smallest voxel number of the region in its stack)."""

    def label(v: np.ndarray, place: Place) -> dict:
        lin, label = local_labels(foreground(v[0]), place, grid)
        return {"lin": [lin.tobytes()], "label": [label.tobytes()]}

    parts = materialize(with_halo(blocks, grid, (0, 0, 0), label, "lin binary, label binary"), "block-labels")
    out = relabelled(labelled_voxels(parts, grid), joined_labels(parts, grid, wrap), grid)
    page = grid.height * grid.width
    return out.select(*grid.keys, F.expr(f"lin div {page}").alias("z"), F.expr(f"lin % {page} div {grid.width}").alias("y"), (F.col("lin") % grid.width).alias("x"), "label")


def with_depth(df: DataFrame, keys: tuple[str, ...], z: Column) -> DataFrame:
    """Add each stack's number of slices."""
    if not keys:
        return df.withColumn("depth", F.lit((df.agg(F.max(z)).first()[0] or 0) + 1).cast("long"))
    return df.join(small_side(materialize(df.groupBy(*keys).agg((F.max(z) + 1).cast("long").alias("depth")), "depths")), list(keys))
