"""Operators against numpy and against what must hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.functions.numeric import log10_total, ratio, with_eigenvalues
from voxloom.operators import cells, components, features, kernels, merge, nearest, partition, windows


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(3).integers(0, 12000, (6, 9, 11)).astype(float)


def rows(spark, v):
    z, y, x = (a.ravel() for a in np.indices(v.shape))
    return spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x, "v": v.ravel()}))


def dense(df, c, shape):
    out = np.zeros(shape)
    for r in df.select("z", "y", "x", c).collect():
        out[r["z"], r["y"], r["x"]] = r[c]
    return out


def test_filters_agree_with_kernels(spark, volume):
    df, s = rows(spark, volume), volume.shape
    assert np.array_equal(dense(windows.erode(df, "v", "e", (2, 3, 1)), "e", s), kernels.erode(volume, (2, 3, 1)))
    assert np.allclose(dense(windows.box_mean(df, "v", "e", (2, 3, 1)), "e", s), kernels.box(volume, (2, 3, 1)))
    assert np.allclose(dense(windows.normalize(df, "v", "e", (2, 2, 1), (2, 1, 1), 5000), "e", s), kernels.normalize(volume, (2, 2, 1), (2, 1, 1), 5000), equal_nan=True)
    assert np.allclose(dense(windows.difference_of_gaussians(df, "v", "e", (1.5, 0.8), (2.2, 1.2)), "e", s), kernels.difference_of_gaussians(volume, (1.5, 0.8), (2.2, 1.2)))


def test_hessian_of_a_constant_is_zero_inside(volume):
    h = kernels.hessian(np.ones((7, 7, 7)))
    assert all(np.all(a[2:-2, 2:-2, 2:-2] == 0) for a in h)


def test_components(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((9, 8, 7)) < 0.15
    z, y, x = np.nonzero(mask)
    fg = spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x}))
    got = {(r.z, r.y, r.x): r.label for r in components.label_components(fg, 8, 7, slab=2).collect()}
    index = np.flatnonzero(mask.ravel())
    want = dict(zip(zip(z.tolist(), y.tolist(), x.tolist()), kernels.label_block(index, 8, 7).tolist()))
    assert got == want


def test_eigenvalues(spark):
    m = np.random.default_rng(1).normal(size=(60, 3, 3))
    m = m + m.transpose(0, 2, 1)
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    at = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    df = spark.createDataFrame(pd.DataFrame({n: m[:, i, j] for n, (i, j) in zip(names, at)} | {"k": range(60)}))
    got = with_eigenvalues(df, names).orderBy("k").select("e0", "e1", "e2").collect()
    assert np.allclose(np.array(got), np.linalg.eigvalsh(m))


def test_numeric_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (None, 1.0), (float("nan"), 2.0)], "a double, b double")
    assert [r[0] for r in df.select(log10_total(F.col("a"))).collect()] == [-1.7976931348623157e308, 0.0, 0.0, 0.0, 0.0]
    got = [r[0] for r in df.where("b = 0").select(ratio(F.col("a"), F.col("b"))).collect()]
    assert np.isnan(got[0]) and got[1:] == [float("inf"), float("-inf")]


def test_density_is_a_histogram(spark):
    v = np.random.default_rng(2).random((4000, 3)) * [19.3, 21.7, 25.2]
    got = features.density(spark.createDataFrame(pd.DataFrame(v, columns=list("zyx"))), ("z", "y", "x"))
    n = np.floor(v.max(0)).astype(int)
    want = np.histogramdd(v, bins=n, range=[(0, k - 1) for k in n])[0]
    have = np.zeros(want.shape)
    for r in got.collect():
        have[r.b0, r.b1, r.b2] = r.n
    assert np.array_equal(have, want)


@pytest.mark.parametrize("case", [(1, 1, 0, 9, 5, 1), (1, 1, 5, 9, 0, 2), (-1, -1, 0, -9, 5, 3), (-1, -1, 5, 0, 0, 4), (-1, 1, 3, 1, 5, 5), (1, -1, 3, 9, 5, 6)])
def test_merge_cases(spark, case):
    fw, rv, first, last, other, number = case
    got, sides, strips = merge.case_of(fw, rv, first, last, other)
    assert got == number
    sl = spark.createDataFrame([(s, i) for s in ("FW", "RV") for i in range(10)], "side string, index int")
    plan = [(r["side"], r["index"]) for r in merge.plan_slices(sl, {"FW": 6, "RV": 2}, {"FW": 2, "RV": 3}, sides, strips, sides[0]).orderBy("position").collect()]
    assert (sides[0], {"FW": 6, "RV": 2}[sides[0]]) in plan and (sides[1], {"FW": 6, "RV": 2}[sides[1]]) not in plan
    assert [s for s, _ in plan] == sorted((s for s, _ in plan), key=sides.index)


def test_merge_without_a_way():
    with pytest.raises(NotImplementedError):
        merge.case_of(1, -1, 0, 3, 5)
    with pytest.raises(TypeError):
        merge.case_of(1, 1, 5, 9, 5)


def test_merge_bounds():
    inf = float("inf")
    assert merge.z_bounds(("FW", "RV"), {"FW": 3.0, "RV": 5.0}, False) == {"FW": (-inf, 3.0), "RV": (5.0, inf)}
    assert merge.z_bounds(("RV", "FW"), {"FW": 3.0, "RV": 5.0}, False) == {"RV": (-inf, 5.0), "FW": (3.0, inf)}
    assert merge.z_bounds(("FW", "RV"), {}, True) == {"FW": (-inf, inf), "RV": (-inf, inf)}


def test_downscale():
    x, y, m = 10 / 102, 8 / 81, (10, 5, 8, 4)
    d = merge.downscale(-1.0, 5.0, 10.0, 120, 90, m)
    assert (d.sampled, d.actual, d.skip_z, d.margins) == ((10, 8), (x, y), 2, (10 * x, 5 * y, 8 * x, 4 * y))
    assert merge.downscale(1.0, 5.0, 10.0, 120, 90, m, merge.FLIP_X, merge.FLIP_Y).margins == (8 * x, 4 * y, 10 * x, 5 * y)
    d = merge.downscale(1.0, 5.0, 10.0, 120, 90, m, merge.ROTATE_CCW)
    assert (d.sampled, d.actual, d.margins) == ((8, 10), (y, x), (5 * x, 8 * y, 4 * x, 10 * y))
    assert merge.downscale(1.0, 5.0, 10.0, 120, 90, m, merge.ROTATE_CW).margins == (4 * x, 10 * y, 5 * x, 8 * y)


def test_substacks_need_room(spark):
    with pytest.raises(ValueError):
        partition.substacks(spark.range(3).withColumnRenamed("id", "z"), "z", F.lit(3), 16, 8)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    p, t = rng.random((300, 3)) * 100, rng.random((200, 3)) * 100
    mk = lambda a: spark.createDataFrame(pd.DataFrame(a, columns=list("zyx")).assign(id=range(len(a))))
    d = ((p[:, None] - t[None]) ** 2).sum(2)
    got = {r.key: r.near_id for r in nearest.nearest_within(mk(p), "id", mk(t), "id", 9.0).collect()}
    assert got == {i: int(d[i].argmin()) for i in range(300) if d[i].min() < 81}
    all_ = {r.key: r.near_id for r in nearest.nearest_any(mk(p), "id", mk(t), "id", 5.0).collect()}
    assert all_ == {i: int(d[i].argmin()) for i in range(300)}


def test_candidates_keep_nan(spark):
    df = spark.createDataFrame([(10.0, 50.0, 50.0, 20, float("nan")), (10.0, 50.0, 50.0, 20, 0.0), (float("nan"), 50.0, 50.0, 20, 1.0), (2.0, 50.0, 50.0, 20, 1.0)], "z double, y double, x double, size int, intensity double")
    assert cells.candidate(df, "z", "y", "x", depth=F.lit(32), margin=8, left=1, top=1, right=1, bottom=1, width=99, height=99, min_size=10).count() == 2


@pytest.mark.parametrize("tiles", [(20_000, 50_000), (50, 30)])
@pytest.mark.parametrize("apart", [False, True])
def test_nearest_in_one_cube(spark, monkeypatch, tiles, apart):
    """All points in one cube, with many ties; whole or dealt to small tiles."""
    monkeypatch.setattr(nearest, "ASKED", tiles[0])
    monkeypatch.setattr(nearest, "FOUND", tiles[1])
    rng = np.random.default_rng(6)
    q = rng.integers(0, 9, (400, 3)).astype(float)
    t = q if apart else rng.integers(0, 9, (300, 3)).astype(float)
    frame = lambda v: spark.createDataFrame(pd.DataFrame(v, columns=["z", "y", "x"]).assign(id=range(len(v))))
    nan = spark.createDataFrame([(None, 1.0, 1.0, 9000), (float("nan"), 1.0, 1.0, 9001)], "z double, y double, x double, id long")
    got = {r.key: (r.near_id, r.near_d2) for r in nearest.nearest_within(frame(t).unionByName(nan), "id", frame(q).unionByName(nan), "id", 100.0, apart=apart).collect()}
    d = ((t[:, None] - q[None]) ** 2).sum(2)
    if apart:
        np.fill_diagonal(d, np.inf)
    assert got == {i: (int(d[i].argmin()), d[i].min()) for i in range(len(t))}
    assert nearest.nearest_within(frame(t).limit(0), "id", frame(q), "id", 1.0).count() == 0 and nearest.nearest_within(frame(t), "id", frame(q).limit(0), "id", 1.0).count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
def test_nearest_at_the_bound(spark, inclusive):
    a = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 50.0, 0.0, 0.0)], "id long, z double, y double, x double")
    b = spark.createDataFrame([(7, 3.0, 4.0, 0.0), (8, 0.0, 0.0, -5.0), (9, 56.0, 0.0, 0.0)], "id long, z double, y double, x double")
    got = [(r.key, r.near_id) for r in nearest.nearest_within(a, "id", b, "id", 5.0, inclusive=inclusive).collect()]
    assert got == ([(0, 7)] if inclusive else [])


def test_components_with_wrap(spark):
    """Steps in the linear number, which also reach over a row's and a slice's end."""
    rng = np.random.default_rng(9)
    for mask in (rng.random((12, 4, 5)) < 0.12, np.isin(np.arange(240), (7 * 20 + 19, 9 * 20)).reshape(12, 4, 5)):
        z, y, x = np.nonzero(mask)
        fg = spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "x": x}))
        got = {(r.z, r.y, r.x): r.label for r in components.label_components(fg, 4, 5, slab=4, wrap=True).collect()}
        index = np.flatnonzero(mask.ravel())
        assert got == dict(zip(zip(z.tolist(), y.tolist(), x.tolist()), kernels.label_block(index, 4, 5, True).tolist()))
    with pytest.raises(ValueError):
        components.label_components(fg, 4, 5, slab=2, wrap=True)


def test_zero_matrix(spark):
    from voxloom.functions.numeric import blobness

    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    df = spark.createDataFrame([(0.0,) * 6, (1e-31,) * 6, (2.0, 0.0, 0.0, 1.0, 0.0, 3.0), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], ", ".join(f"{n} double" for n in names)).coalesce(1)
    got = with_eigenvalues(df, names).select("e0", "e1", "e2", blobness(F.col("e0"), F.col("e1"), F.col("e2")).alias("b")).collect()
    assert [tuple(r) for r in got[:3]] == [(0.0, 0.0, 0.0, 0.0)] * 2 + [(2.0, 1.0, 3.0, 4.5)] and np.isnan(got[3].b)


def test_lookup(spark):
    df, keys = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    assert sorted((r.k or 0, r.v or "", r.found) for r in cells.lookup(df, keys, "k").collect()) == [(0, "", False), (1, "a", True), (2, "", False)]
    assert cells.lookup(df.where("k = 1"), keys, "k", "error").count() == 1
    with pytest.raises(Exception, match="no such k"):
        cells.lookup(df, keys, "k", "error").collect()


def test_mirrored_blur(spark, volume):
    """Against mirroring with numpy, one axis after the other, cut to whole numbers."""
    v, sigma = volume, (0.8, 1.0, 2.0)
    want = v
    for axis, s in enumerate(sigma):
        w = windows.gaussian_weights(s)
        r = len(w) // 2
        padded = np.pad(want, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        want = np.floor(np.round(sum(k * np.take(padded, range(j, j + v.shape[axis]), axis=axis) for j, k in enumerate(w)), 6))
    assert np.array_equal(dense(windows.blur_whole(rows(spark, v), "v", "g", sigma), "g", v.shape), want)


PARAMS = """{"devID": 0, "input_image_info": {"width": 44, "height": 40, "left_margin": 1, "right_margin": 1, "top_margin": 1, "bottom_margin": 1}, "coordinate_info": {"scale_x": 1, "scale_y": 1, "scale_z": 1},
  "HDoG_param": {"depth": 16, "extra_depth_margin": 3, "radius_norm": {"xy_large": 3, "z_large": 1}, "min_intensity": 1000, "gamma_n": 1.0, "sigma_dog": {"xy_small": 1.0, "z_small": 0.6, "xy_large": 1.5, "z_large": 0.9}, "min_size": 4}}"""


def test_detection_in_tiles(spark):
    """Tiles of two stacks at once find what whole slices of each stack find."""
    from voxloom.jobs import detect

    s = detect.Settings.from_json(PARAMS)
    assert (s.depth, s.radii, s.edges, s.min_size, s.mean_intensity) == (16, (3, 3, 1), (1, 1, 1, 1), 4, False)
    with pytest.raises(KeyError):
        detect.Settings.from_json(PARAMS.replace("min_size", "least_size"))
    rng, spots = np.random.default_rng(8), np.indices((3, 3, 3)).reshape(3, -1) - 1
    both, want = None, []
    for name, depth in (("a", 33), ("b", 24)):
        v = rng.integers(0, 900, (depth, 40, 44)).astype(float)
        for z, y, x in ((z, y, x) for z in range(4, depth - 3, 9) for y in range(5, 38, 10) for x in range(5, 42, 10)):
            z, y, x = z + rng.integers(-1, 2), y + rng.integers(-2, 3), x + rng.integers(-2, 3)
            v[z + spots[0], y + spots[1], x + spots[2]] += 3000
        df = rows(spark, v).withColumn("name", F.lit(name))
        both = df if both is None else both.unionByName(df)
        # the whole volume, substack by substack, without Spark
        length, step = depth, s.depth - 2 * s.margin
        for z0 in range(0, length - s.margin, step):
            block = np.zeros((s.depth, 40, 44))
            part = v[z0 : z0 + s.depth]
            block[: len(part)] = part
            f = detect.block_features(block, s)
            f = f[(f.cz >= s.margin) & (f.cz < min(s.depth, length - z0) - s.margin) & (f.cy >= 1) & (f.cy < 39) & (f.cx >= 1) & (f.cx < 43) & (f.n_voxels >= 4) & (f.max_norm > 0)]
            want += [(name, round(r.cz + z0, 6), round(r.cy, 6), round(r.cx, 6), int(r.n_voxels), round(r.max_norm, 6)) for r in f.itertuples()]
    got = detect.detect(both, "v", 40, 44, s, ("name",), tile=16).collect()
    assert sorted((r.name, round(r.z, 6), round(r.y, 6), round(r.x, 6), r.size, round(r.intensity, 6)) for r in got) == sorted(want) and len(want) > 20


@pytest.mark.parametrize("small", [100_000, 0])
def test_as_of(spark, monkeypatch, small):
    monkeypatch.setattr(cells, "SMALL_POINTS", small)
    rng = np.random.default_rng(2)
    at, points = rng.integers(0, 1000, 300), np.unique(rng.integers(100, 900, 40))
    df = spark.createDataFrame(pd.DataFrame({"k": range(300), "v": at.astype(float)}))
    p = spark.createDataFrame(pd.DataFrame({"off": points.astype(float), "name": [f"n{x}" for x in points]}))
    got = {r.k: r.off for r in cells.greatest_at_most(df, "v", p, "off", ["off", "name"]).collect()}
    assert got == {k: float(points[points <= x].max()) for k, x in enumerate(at.tolist()) if x >= points[0]}
