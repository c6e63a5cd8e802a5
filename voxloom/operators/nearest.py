"""Nearest neighbours of points, within a bound or without.

Points of one place share their answer, so places are searched: of the searched points of a place the smallest id counts,
and rows get the answer of their place by a join. Only where a point may not be its own neighbour does each row ask.

Space is cut into cubes, a whole number of bounds wide. A searched point is repeated for the cubes whose surroundings
reach it (one to eight), an asking point stays in its own cube, so both sides of every neighbourhood meet in one cube.
Points are counted first: a crowded cube is dealt to tiles of bounded numbers of asking and of searched points, and
the best of the tiles is kept by an aggregation. In a tile the searched points are sorted along one axis; blocks of
asking points look at strips of them outwards and stop when the next strip is farther than what they have found. No
pairs are emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialize, small_side

AXES = ("z", "y", "x")
CUBE = ["cz", "cy", "cx"]
#: Asking and searched points of one tile; asking points that a cube should hold.
ASKED, FOUND, AIM = 20_000, 50_000, 5_000
#: Asking points that look together, searched points of a strip.
BLOCK, STRIP = 256, 512


def _strips(q: np.ndarray, ids: np.ndarray, t: np.ndarray, keys: np.ndarray, bound: float, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Position in q and squared distance of the nearest of q for each of t; -1 and infinity beyond the bound.

    q is ordered by id, so that of equal distances the first position is the one to take."""
    spread = q.max(0) - q.min(0)
    axis = int(spread.argmax())
    order = np.argsort(q[:, axis], kind="stable")
    at = q[order, axis]
    near, best = np.full(len(t), -1), np.full(len(t), np.inf)
    asking = np.argsort(t[:, axis], kind="stable")
    for start in range(0, len(t), BLOCK):
        a = asking[start : start + BLOCK]
        p, lo, hi = t[a], t[a[0], axis], t[a[-1], axis]
        left, right = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
        pos, d = np.full(len(a), -1), np.full(len(a), bound**2 * (1 + 1e-12) + 1e-300)

        def look(i: int, j: int) -> None:
            nonlocal pos, d
            s = np.sort(order[i:j])
            dist = ((p[:, None, :] - q[None, s, :]) ** 2).sum(2)
            if apart:
                dist[keys[a][:, None] == ids[None, s]] = np.inf
            k = dist.argmin(1)
            got, who = dist[np.arange(len(a)), k], s[k]
            closer = (got < d) | (got == d) & ((pos < 0) | (who < pos))
            pos, d = np.where(closer, who, pos), np.where(closer, got, d)

        for i in range(left, right, STRIP):
            look(i, min(i + STRIP, right))
        while left > 0 and (lo - at[left - 1]) ** 2 <= d.max():
            look(max(0, left - STRIP), left)
            left = max(0, left - STRIP)
        while right < len(at) and (at[right] - hi) ** 2 <= d.max():
            look(right, min(right + STRIP, len(at)))
            right = min(right + STRIP, len(at))
        near[a], best[a] = pos, np.where(pos >= 0, d, np.inf)
    return near, best


def _plain(df: DataFrame, c: str, name: str) -> DataFrame:
    """New columns, as points and found may be one table; only rows with whole coordinates."""
    df = df.select(F.col(c).alias(name), *[F.col(a).cast("double").alias(a) for a in AXES])
    for a in AXES:
        df = df.where(F.col(a).isNotNull() & ~F.isnan(a))
    return df


def _smallest(found: DataFrame, id_: str, apart: bool) -> DataFrame:
    """Each place of the searched points with its smallest id, with `apart` also with the next one."""
    f = _plain(found, id_, "near_id")
    low = f.groupBy(*AXES).agg(F.min("near_id").alias("near_id"))
    if apart:
        more = f.join(low.withColumnRenamed("near_id", "__low"), list(AXES)).where("near_id <> __low").groupBy(*AXES).agg(F.min("near_id").alias("near_id"))
        low = low.unionByName(more)
    return materialize(low.select("near_id", *AXES), "searched-places")


def _places(points: DataFrame, key: str) -> DataFrame:
    """Each place of the points with a number (`key`)."""
    places = _plain(points, key, "key").select(*AXES).distinct()
    return materialize(places.select(F.monotonically_increasing_id().alias("key"), *AXES), "asking-places")


def _attached(points: DataFrame, places: DataFrame, got: DataFrame, how: str) -> DataFrame:
    """points with the near_id and near_d2 of their place."""
    near = materialize(places.join(got, "key").select(*[F.col(a).alias(f"__{a}") for a in AXES], "near_id", "near_d2"), "near-places")
    same = F.lit(True)
    for a in AXES:
        same = same & (points[a].cast("double") == F.col(f"__{a}"))
    return points.join(small_side(near), same, how).drop(*[f"__{a}" for a in AXES])


def with_nearest(points: DataFrame, key: str, found: DataFrame, id_: str, bound: float, inclusive: bool = False) -> DataFrame:
    """All points with near_id and near_d2, null where no neighbour is in the bound."""
    places = _places(points, key)
    return _attached(points, places, _search(places, _smallest(found, id_, False), bound, inclusive, False), "left")


def nearest_within(points: DataFrame, key: str, found: DataFrame, id_: str, bound: float, inclusive: bool = False, apart: bool = False) -> DataFrame:
    """points: key, x, y, z; found: id_, x, y, z. Result: key, near_id, near_d2, for points with a neighbour in the bound.

    Ties go to the smallest id. With `apart`, a point isn't its own neighbour (key and id_ are the same ids). Points
    with a coordinate that is null or NaN have no neighbour and are none."""
    if apart:
        return _search(_plain(points, key, "key"), _smallest(found, id_, True), bound, inclusive, True)
    places, points = _places(points, key), points.select(F.col(key).alias("key"), *AXES)
    got = _search(places, _smallest(found, id_, False), bound, inclusive, False)
    return _attached(points, places, got, "inner").select("key", "near_id", "near_d2")


def _search(p: DataFrame, f: DataFrame, bound: float, inclusive: bool, apart: bool) -> DataFrame:
    """p: key, z, y, x; f: near_id, z, y, x. Result: key, near_id, near_d2."""
    schema = T.StructType([p.schema["key"], f.schema["near_id"], T.StructField("near_d2", T.DoubleType())])
    n, *ends = p.agg(F.count("*"), *[g(a) for a in AXES for g in (F.min, F.max)]).first()
    if not n:
        return p.sparkSession.createDataFrame([], schema)
    volume = 1.0
    for lo, hi in zip(ends[::2], ends[1::2], strict=True):
        volume *= max(1.0, (hi - lo) / bound)
    width = bound * max(2, min(64, round((AIM * volume / n) ** (1 / 3))))
    for a in AXES:
        p = p.withColumn(f"c{a}", F.floor(F.col(a) / width).cast("long"))
        f = f.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(a) - bound) / width).cast("long"), F.floor((F.col(a) + bound) / width).cast("long"))))
    count = F.count("*")
    tiles = p.groupBy(*CUBE).agg(F.ceil(count / ASKED).cast("int").alias("a")).join(f.groupBy(*CUBE).agg(F.ceil(count / FOUND).cast("int").alias("b")), CUBE)
    tiles = materialize(tiles, "cubes")
    cut = (tiles.agg(F.max("b")).first()[0] or 1) > 1
    by = [*CUBE, "i", "j"]
    part = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    p = p.join(small_side(tiles), CUBE).withColumn("i", part("key", "a")).withColumn("j", upto("b")).drop("a", "b")
    f = f.join(small_side(tiles), CUBE).withColumn("j", part("near_id", "b")).withColumn("i", upto("a")).drop("a", "b")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": [], "near_id": [], "near_d2": []})
        b = b.sort_values("near_id", kind="stable")
        keys, ids = a["key"].to_numpy(), b["near_id"].to_numpy()
        near, d2 = _strips(b[list(AXES)].to_numpy(dtype=float), ids, a[list(AXES)].to_numpy(dtype=float), keys, bound, apart)
        best = pd.DataFrame({"key": keys, "near_id": ids[np.maximum(near, 0)], "near_d2": d2})
        return best[best["near_d2"] <= bound**2] if inclusive else best[best["near_d2"] < bound**2]

    got = p.groupBy(*by).cogroup(f.groupBy(*by)).applyInPandas(search, schema)
    if cut:
        got = got.groupBy("key").agg(F.min(F.struct("near_d2", "near_id")).alias("m")).select("key", "m.near_id", "m.near_d2")
    return got


def nearest_any(points: DataFrame, key: str, found: DataFrame, id_: str, bound: float, apart: bool = False) -> DataFrame:
    """As nearest_within, without a bound: places without a neighbour ask again with twice the bound."""
    searched = _smallest(found, id_, apart)
    if not searched.limit(1).count():
        return nearest_within(points, key, found, id_, bound, apart=apart)
    asking = materialize(_plain(points, key, "key"), "asking") if apart else _places(points, key)
    widest = searched.select(*AXES).unionByName(asking.select(*AXES)).agg(*[(F.max(a) - F.min(a)).alias(a) for a in AXES]).first()
    most = 2 * sum(widest[a] or 0 for a in AXES) + 1
    out, rest = None, asking
    while True:
        got = materialize(_search(rest, searched, bound, False, apart), "nearest")
        out = got if out is None else out.unionByName(got)
        rest = materialize(rest.join(got, "key", "left_anti"), "asking")
        if bound > most or not rest.limit(1).count():
            break
        bound *= 2
    if apart:
        return out
    return _attached(points.select(F.col(key).alias("key"), *AXES), asking, out, "inner").select("key", "near_id", "near_d2")
