"""Blocks, labels over faces, detection, numbering, as-of joins, mixtures and sparse volumes against plain numpy."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import PARAMS, dense, rows

from voxloom.jobs import cpu_mode, detect
from voxloom.operators import blocks as B
from voxloom.operators import cells, evaluate, features, kernels, mixture, partition, windows
from voxloom.sources import raw


def lines(spark, v, **keys):
    z, y = (a.ravel() for a in np.indices(v.shape[:2]))
    df = spark.createDataFrame(pd.DataFrame({"z": z, "y": y, "v": list(v.reshape(-1, v.shape[2]).tolist()), "depth": v.shape[0]}))
    return df.withColumns({k: F.lit(x) for k, x in keys.items()})


def test_blocks_hold_a_volume(spark, tmp_path):
    """From lines, voxels and slices; blocks at the borders are smaller; what isn't given is 0."""
    rng = np.random.default_rng(1)
    v = rng.integers(0, 60000, (7, 11, 13)).astype(float)
    grid = B.Grid(11, 13, (3, 4, 5), ("name",))
    some = lines(spark, v, name="a").where("not (z = 2 and y = 3)").unionByName(lines(spark, v[:2], name="b"))
    want = v.copy()
    want[2, 3] = 0
    got = B.voxels(B.from_lines(some, "v", grid), grid)
    assert np.array_equal(dense(got.where("name = 'a'"), "v", v.shape), want) and np.array_equal(dense(got.where("name = 'b'"), "v", (2, 11, 13)), v[:2])
    points = rows(spark, v).withColumns({"name": F.lit("a"), "depth": F.lit(7)}).where("v > 9000")
    assert np.array_equal(dense(B.voxels(B.from_voxels(points, "v", grid), grid), "v", v.shape), np.where(v > 9000, v, 0))
    slices = spark.createDataFrame([("a", 3, z, bytes(v[z].astype("<u2").tobytes()[: 100 if z == 1 else None])) for z in range(3)], "name string, depth long, z long, content binary")
    cut = v[:3].copy()
    cut[1].ravel()[50:] = 0
    short = B.Grid(11, 13, (2, 6, 6), ("name",), "<u2")
    assert np.array_equal(dense(B.voxels(B.from_slices(slices, short), short), "v", cut.shape), cut)
    assert B.voxels(B.from_lines(some.limit(0), "v", grid), grid).count() == 0


@pytest.mark.parametrize("radii", [((2, 1, 1), (1, 2, 1)), ((9, 6, 4), (3, 7, 2)), ((0, 1, 1), (1, 1, 1))])
def test_contrast_on_blocks(spark, radii):
    """One exchange of halos or one along each axis; radii beyond blocks and beyond the volume."""
    v = np.random.default_rng(2).integers(0, 12000, (6, 14, 17)).astype(float)
    grid = B.Grid(14, 17, (2, 5, 4))
    got = B.voxels(B.normalize(B.from_lines(lines(spark, v), "v", grid), grid, *radii, 5000), grid)
    assert np.allclose(dense(got, "v", v.shape), kernels.normalize(v, *radii, 5000), equal_nan=True)


def labels_of(mask, wrap):
    index = np.flatnonzero(mask.ravel())
    z, y, x = np.unravel_index(index, mask.shape)
    return dict(zip(zip(z.tolist(), y.tolist(), x.tolist()), kernels.label_block(index, *mask.shape[1:], wrap).tolist()))


def snake(shape):
    """One region that winds through the whole volume."""
    mask = np.zeros(shape, bool)
    for z in range(0, shape[0], 2):
        for y in range(0, shape[1], 2):
            mask[z, y] = True
            if y + 1 < shape[1]:
                mask[z, y + 1, -1 if y % 4 == 0 else 0] = True
        if z + 1 < shape[0]:
            mask[z + 1, 0, 0] = True
    return mask


@pytest.mark.parametrize("wrap", [False, True])
def test_labels_over_faces(spark, wrap):
    rng = np.random.default_rng(3)
    stacks = {"sparse": rng.random((9, 8, 7)) < 0.15, "dense": rng.random((5, 8, 7)) < 0.4, "snake": snake((7, 8, 7)), "corners": np.isin(np.arange(448), (0, 7 * 8 + 7 + 1, 447, 6, 48, 55)).reshape(8, 8, 7), "none": np.zeros((3, 8, 7), bool)}
    df = None
    for name, mask in stacks.items():
        one = lines(spark, mask.astype(float), name=name, label="mine")
        df = one if df is None else df.unionByName(one)
    for block in ((2, 3, 3), (1, 1, 1), (20, 20, 20)):
        grid = B.Grid(8, 7, block, ("name",))
        got: dict = {k: {} for k in stacks}
        for r in B.label_blocks(B.from_lines(df, "v", grid), grid, lambda v: v > 0, wrap).collect():
            got[r.name][r.z, r.y, r.x] = r.label
        assert got == {k: labels_of(m, wrap) for k, m in stacks.items()}, block


def whole(v, s, edges=1):
    """Candidates of one stack, substack by substack, without Spark."""
    out = []
    for z0 in range(0, len(v) - s.margin, s.depth - 2 * s.margin):
        block = np.zeros((s.depth, *v.shape[1:]))
        part = v[z0 : z0 + s.depth]
        block[: len(part)] = part
        f = detect.block_features(block, s)
        h, w = v.shape[1:]
        f = f[(f.cz >= s.margin) & (f.cz < min(s.depth, len(v) - z0) - s.margin) & (f.cy >= edges) & (f.cy < h - edges) & (f.cx >= edges) & (f.cx < w - edges) & (f.n_voxels >= s.min_size) & (f.max_norm > 0)]
        out += [(round(r.cz + z0, 6), round(r.cy, 6), round(r.cx, 6), int(r.n_voxels), round(r.max_norm, 6)) for r in f.itertuples()]
    return sorted(out)


def found(df):
    return sorted((round(r.z, 6), round(r.y, 6), round(r.x, 6), r.size, round(r.intensity, 6)) for r in df.collect())


def test_detection_of_wide_regions(spark, tmp_path):
    """Ridges longer than a block and its halo count once and whole, from rows and from files of slices."""
    s = replace(detect.Settings.from_json(PARAMS), radii=(0, 0, 0))
    along = np.floor(4000 * (1 - ((np.arange(44) - 21) / 30) ** 2))  # slices hold whole numbers
    v = np.random.default_rng(4).integers(0, 20, (20, 40, 44)).astype(float)
    for k in range(3):
        v[8 + k % 2, 6 + 12 * k, 3:41] += along[3:41]
        v[12, 4:36, 8 + 12 * k] += 3 * along[4:36]
    want = whole(v, s)
    assert max(r[3] for r in want) > 30
    grid_rows = rows(spark, v)
    for tile in (7, 16):
        assert found(detect.detect(grid_rows, "v", 40, 44, s, tile=tile)) == want
    named = grid_rows.select(F.lit("FW").alias("side"), F.lit("1").alias("yname"), F.lit("2").alias("xname"), "z", "y", "x", "v")
    raw.write_slices(named, f"file://{tmp_path}/slices", 40, 44)
    got = detect.detect_files(spark, f"file://{tmp_path}/slices", 40, 44, s, tile=16)
    assert found(got) == want and got.select("side", "yname", "xname").distinct().count() == 1


def test_other_mode(spark):
    """Against numpy on the whole array."""
    v = np.random.default_rng(5).integers(0, 12000, (9, 12, 14)).astype(float)
    r, least, small, large = (2, 2, 1), 3000, (1.0, 0.6), (1.5, 0.9)

    def mean(a):  # zeros beyond the border
        for axis, k in zip((2, 1, 0), r):
            p = np.pad(a, [(k, k) if i == axis else (0, 0) for i in range(3)])
            a = np.lib.stride_tricks.sliding_window_view(p, 2 * k + 1, axis=axis).mean(-1)
        return a

    norm = (v >= least) * v / (mean(kernels.dilate(v, r)) - mean(kernels.erode(v, r)))
    dog = kernels.difference_of_gaussians(norm, small, large)
    gz, gy, gx = np.gradient(dog)
    h = {"xx": np.gradient(gx, axis=2), "xy": np.gradient(gx, axis=1), "xz": np.gradient(gx, axis=0), "yy": np.gradient(gy, axis=1), "yz": np.gradient(gy, axis=0), "zz": np.gradient(gz, axis=0)}
    mask = kernels.negative_definite(tuple(h.values()))
    label = np.zeros(v.shape, int)
    index = np.flatnonzero(mask.ravel())
    label.ravel()[index] = 1 + np.unique(kernels.label_block(index, *v.shape[1:]), return_inverse=True)[1]
    grid = B.Grid(12, 14, (4, 5, 5))
    got = cpu_mode.features(B.from_lines(lines(spark, v), "v", grid), grid, r, least, small, large).orderBy("index").collect()
    assert [g["index"] for g in got] == list(range(label.max())) and len(got) > 10
    for g in got:
        at = label == g["index"] + 1
        z, y, x = np.nonzero(at)
        m = {k: a[at].sum() for k, a in h.items()}
        e = np.linalg.eigvalsh([[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]])
        assert np.allclose([g["size"], g["intensity"], g["centroid_z"], g["centroid_y"], g["centroid_x"], g["structureness"]], [at.sum(), norm[at].max(), z.mean(), y.mean(), x.mean(), (e**2).sum()], rtol=1e-6)
    # the first mode differs at borders: derivatives there take the outside for 0
    assert not np.allclose(kernels.hessian(dog)[0], h["xx"]) and np.allclose(kernels.hessian(dog)[0][2:-2, 2:-2, 2:-2], h["xx"][2:-2, 2:-2, 2:-2])


def test_running_windows(spark):
    """Any radius on lines that begin anywhere, in rows and in arrays."""
    rng = np.random.default_rng(6)
    v = rng.integers(0, 1000, (5, 6, 23)).astype(float)
    df = rows(spark, v).withColumns({"z": F.col("z") + 5, "x": F.col("x") + 8})
    for r in ((1, 2, 1), (30, 4, 9), (5, 100, 2)):
        want = [v] * 3
        for axis, k in zip((2, 1, 0), r):
            view = [np.lib.stride_tricks.sliding_window_view(np.pad(a, [(k, k) if i == axis else (0, 0) for i in range(3)], mode="edge"), 2 * k + 1, axis=axis) for a in want]
            want = [view[0].min(-1), view[1].max(-1), view[2].mean(-1)]
        got = [windows.erode(df, "v", "e", r), windows.dilate(df, "v", "e", r), windows.box_mean(df, "v", "e", r)]
        for g, w, array in zip(got, want, (kernels.erode(v, r), kernels.dilate(v, r), kernels.box(v, r))):
            assert np.allclose(dense(g.withColumns({"z": F.col("z") - 5, "x": F.col("x") - 8}), "e", v.shape), w, rtol=1e-12) and np.allclose(array, w, rtol=1e-12)


def test_numbers_without_a_window(spark):
    """As row_number would, in groups of very unequal size, with nulls and equal rows."""
    rng = np.random.default_rng(7)
    g, v = np.where(rng.random(5000) < 0.8, 0, rng.integers(1, 40, 5000)), rng.integers(0, 60, 5000)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v, "__row": "mine"})).selectExpr("nullif(g, 3) g", "nullif(v, 7) v", "__row").repartition(6)
    got = partition.numbered(df, ["v"], ["g"]).collect()
    assert len(got) == 5000
    for key in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == key), key=lambda r: r.rn)
        assert [r.rn for r in mine] == list(range(len(mine)))
        assert [r.v for r in mine] == sorted((r.v for r in mine), key=lambda x: (x is not None, x))
    every = partition.numbered(df, ["v", "g"]).agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(every) == (0, 4999, 5000)
    assert partition.every_nth(df, 10, ["v"], ["g"]).count() == sum(-(-n // 10) for n in np.unique(np.where(g == 3, 99, g), return_counts=True)[1])
    assert partition.numbered(df.limit(0), ["v"], ["g"]).count() == 0


@pytest.mark.parametrize("small", [100_000, 0])
def test_as_of_edges(spark, monkeypatch, small):
    """Ties, nulls, no number, all rows beyond the last point, points that are none: one result whatever the size."""
    monkeypatch.setattr(cells, "SMALL_POINTS", small)
    points = spark.createDataFrame([(1.0, "a", None), (1.0, "b", 1), (1.0, "b", None), (float("nan"), "n", 1), (None, "m", 1), (4.0, "c", 5)], "off double, name string, k int")
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 1.0, 3.9, 4.0, 1e9, None, float("nan")] + [100.0] * 3000)], "id long, v double").repartition(5)
    got = {r.id: (r.off, r.name, r.k) for r in cells.greatest_at_most(df, "v", points, "off", ["off", "name", "k"]).collect()}
    last = (4.0, "c", 5)
    assert got == {1: (1.0, "b", 1), 2: (1.0, "b", 1), 3: last, 4: last, 6: last} | {i: last for i in range(7, 3007)}
    none = cells.greatest_at_most(df, "v", points.where("name in ('n', 'm')"), "off", ["off", "name"])
    assert none.count() == 0 and none.columns == ["id", "v", "off", "name"]
    whole_numbers = spark.createDataFrame([(5,), (9,)], "v int")
    assert sorted(r.name for r in cells.greatest_at_most(whole_numbers, "v", points, "off", ["name"]).collect()) == ["c", "c"]


def plain_mixture(x, k, along, rounds):
    """The same inference with whole matrices of responsibilities."""
    n, d = x.shape
    mean, cov = x.mean(0), np.cov(x.T)
    cuts = mean[along] + x[:, along].std() * (2 * np.arange(1, k) / k - 1)
    r = np.eye(k)[(x[:, along][:, None] >= cuts).sum(1)]
    bounds = []
    for _ in range(rounds):
        nk = r.sum(0) + mixture.TINY
        xk = r.T @ x / nk[:, None]
        beta, free = 1 + nk, d + nk
        m = (mean + nk[:, None] * xk) / beta[:, None]
        w = []
        for i in range(k):
            s = (r[:, i, None] * (x - xk[i])).T @ (x - xk[i]) / nk[i] + mixture.RIDGE * np.eye(d)
            w.append((cov + nk[i] * s + nk[i] / beta[i] * np.outer(xk[i] - mean, xk[i] - mean)) / free[i])
        a, b = 1 + nk, 1 / k + np.array([nk[i + 1 :].sum() for i in range(k)])
        psi = np.vectorize(mixture.digamma)
        weight = psi(a) - psi(a + b) + np.array([(psi(b) - psi(a + b))[:i].sum() for i in range(k)])
        log = np.empty((n, k))
        for i in range(k):
            centred = x - m[i]
            square = np.einsum("ni,ij,nj->n", centred, np.linalg.inv(w[i]), centred)
            lam = sum(mixture.digamma((free[i] - j) / 2) for j in range(d)) + d * np.log(2)
            log[:, i] = weight[i] - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(w[i])[1] + d * np.log(free[i]) + square) + 0.5 * (lam - d / beta[i])
        with np.errstate(divide="ignore", invalid="ignore"):
            bounds.append(-np.nansum(r * np.log(r)))
        r = np.exp(log - log.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
    return m, nk - mixture.TINY, r


@pytest.mark.parametrize("components", [1, 2, 4])
def test_mixture(spark, components):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal((0, 100, 5), (1, 2, 0.5), (300, 3)), rng.normal((4, 112, 5), (0.5, 1, 1), (200, 3))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(500)))
    model = mixture.fit(df, list("abc"), components, "b", rounds=12, tolerance=0.0)
    means, counts, shares = plain_mixture(x, components, 1, 12)
    assert np.allclose(model.means, means, rtol=1e-7) and np.allclose(model.counts, counts, atol=1e-5)
    got = np.array([r.r for r in model.with_responsibilities(df).orderBy("id").collect()])
    assert np.allclose(got, shares, atol=1e-6)
    assert np.all(np.diff(model.bounds) > -1e-6) and not model.converged
    assert [r.component for r in model.predict(df).orderBy("id").collect()] == shares.argmax(1).tolist()


def test_mixture_ends_and_prunes(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(9, 1, (300, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    model = mixture.fit(df, ["a", "b"], 3, "a")
    assert model.converged and len(model.bounds) < 100
    few = model.pruned(200)
    assert len(few.counts) == 2 and few.largest("a") == int(few.means[:, 0].argmax()) and set(r.component for r in few.predict(df).select("component").distinct().collect()) == {0, 1}
    assert mixture.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-9) and mixture.digamma(0.5) == pytest.approx(-1.9635100260214235, abs=1e-8)
    with pytest.raises(ValueError):
        mixture.fit(df.limit(0), ["a", "b"], 2, "a")


@pytest.mark.parametrize("shape", [(6, 9, 11), (2, 1, 3)])
def test_sparse_blur(spark, shape):
    """As the dense blur, on volumes that are smaller than the kernel too."""
    rng = np.random.default_rng(10)
    v = np.where(rng.random(shape) < 0.1, rng.integers(1, 9, shape) * 5000, 0).astype(float)
    v[0, 0, 0] = 5000
    sigma, want = {"z": 1.0, "y": 2.0, "x": 1.5}, v
    for axis, s in enumerate(sigma.values()):
        w = windows.gaussian_weights(s, 3.0)
        r = len(w) // 2
        p = np.pad(want, [(r, r) if i == axis else (0, 0) for i in range(3)], mode="symmetric")
        want = np.floor(np.round(sum(k * np.take(p, range(j, j + shape[axis]), axis=axis) for j, k in enumerate(w)), 6))
    points = rows(spark, v).where("v > 0").withColumn("kind", F.lit("a"))
    both = points.unionByName(points.where("z = 0").withColumn("kind", F.lit("b")))
    out = evaluate.sparse_blur(both, "v", dict(zip("zyx", shape)), sigma, ("kind",), truncate=3.0)
    assert np.array_equal(dense(out.where("kind = 'a'"), "v", shape), want) and out.where("v <= 0").count() == 0
    assert evaluate.extents(both.limit(0)) == {"z": 1, "y": 1, "x": 1}


def plain_tree(x, y, depth):
    """Greedy splits at midpoints by Gini impurity; a function from rows to labels."""
    share = y.mean() if len(y) else 0
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
    best = None
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                gain = gini(y) - gini(y[low]) - gini(y[~low])
                if best is None or gain > best[0] + 1e-12:
                    best = gain, f, t
    if best is None or best[0] <= 1e-12:
        return lambda r: np.full(len(r), float(share > 0.5))
    _, f, t = best
    low = x[:, f] <= t
    left, right = plain_tree(x[low], y[low], depth - 1), plain_tree(x[~low], y[~low], depth - 1)
    return lambda r: np.where(r[:, f] <= t, left(r), right(r))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_on_components(spark, seed):
    """Components as numpy's but for their signs; the tree as the greedy one over all midpoints."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 3)) @ np.array([[3, 1, 0], [0, 2, 0.5], [0.2, 0, 0.7]]) + [10, -4, 7]
    y = (np.abs(x[:, 0] - 10) + 0.3 * x[:, 1] + rng.normal(0, 0.4, 60) > 1).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(label=y, id=range(60)))
    model = features.boundary_tree(list("abc"), "label", bins=64).fit(df.where("id < 50"))
    out = model.transform(df).orderBy("id").collect()
    got = np.array([r.components.toArray() for r in out])
    centred = x - x[:50].mean(0)
    _, vectors = np.linalg.eigh(np.cov(centred[:50].T))
    want = centred @ vectors[:, ::-1]
    signs = np.sign((got * want).sum(0))
    assert np.allclose(got, want * signs)
    assert [r.prediction for r in out] == plain_tree(got[:50], y[:50], 2)(got).tolist()
    assert np.mean([r.prediction for r in out[:50]] == y[:50]) > 0.75


def test_lines_go_together(spark):
    """Lines are cut for a halo at once, those of one block in one piece; blocks with their halo are those of an exchange."""
    v = np.random.default_rng(9).integers(0, 99, (7, 11, 13)).astype(float)
    df, grid, halo = lines(spark, v, name="a").coalesce(1), B.Grid(11, 13, (3, 4, 5), ("name",)), (1, 2, 3)
    pieces = B.from_lines(df, "v", grid, halo)
    assert pieces.count() == 27
    fn = lambda a, p: {"data": [np.ascontiguousarray(a).tobytes()]}
    rows = lambda t: {(r.bz, r.by, r.bx): bytes(r.data) for r in B.with_halo(t, grid, halo, fn, "data binary").collect()}
    got = rows(pieces)
    assert len(got) == 27 and got == rows(B.from_lines(df, "v", grid))
    assert got[1, 1, 1] == np.ascontiguousarray(v[2:7, 2:10, 2:13]).tobytes()
    with pytest.raises(Exception, match="OverflowError"):
        B.from_lines(df.withColumn("v", F.transform("v", lambda x: x + 999)), "v", B.Grid(11, 13, (3, 4, 5), ("name",), "<i1")).count()
