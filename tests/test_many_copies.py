"""Tables that repeat their rows: the work grows with what differs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxloom.llm import common, jaccard_join
from voxloom.operators import mixture, nearest
from voxloom.sources import raw


def test_nearest_searches_places(spark, monkeypatch):
    """Places are searched once, however many rows lie there; every row gets its place's answer, rows without a place none."""
    rng = np.random.default_rng(11)
    t, q = rng.integers(0, 9, (40, 3)).astype(float), rng.integers(0, 9, (30, 3)).astype(float)
    many = lambda v, k: spark.createDataFrame(pd.DataFrame(np.repeat(v, k, 0), columns=list("zyx")).assign(id=range(len(v) * k)))
    seen, search = [], nearest._search
    monkeypatch.setattr(nearest, "_search", lambda p, f, *a: seen.append((p.count(), f.count())) or search(p, f, *a))
    lost = spark.createDataFrame([(None, 1.0, 1.0, 9000), (float("nan"), 1.0, 1.0, 9001)], "z double, y double, x double, id long")
    got = nearest.with_nearest(many(t, 7).unionByName(lost), "id", many(q, 5).unionByName(lost), "id", 3.0, inclusive=True)
    d = ((t[:, None] - q[None]) ** 2).sum(2)
    want = {i * 7 + k: (5 * int(d[i].argmin()), d[i].min()) if d[i].min() <= 9 else (None, None) for i in range(40) for k in range(7)}
    assert {r.id: (r.near_id, r.near_d2) for r in got.collect()} == want | {9000: (None, None), 9001: (None, None)}
    assert seen == [(len(np.unique(t, axis=0)), len(np.unique(q, axis=0)))]


def test_records_pass_in_parts(spark, tmp_path):
    """Equal rows of one stack fill files of bounded length; reading hands them on in parts."""
    df = spark.range(0, 1000, 1, 2).selectExpr("'FW' side", "'1' yname", "'2' xname", "5f local_x", "6f local_y", "7f local_z", "1f structureness", "2f blobness", "3f intensity", "9 size")
    raw.write_records(df, f"file://{tmp_path}/r", rows_a_file=150)
    assert sorted(f.stat().st_size // 28 for f in tmp_path.glob("r/FW/1_2/*.bin")) == [50, 50] + [150] * 6
    back = raw.read_records(spark, f"file://{tmp_path}/r")
    assert back.count() == 1000 and back.groupBy("file").agg(F.countDistinct("cell_seq").alias("n"), F.count("*").alias("m")).where("n <> m").count() == 0


def test_near_groups_meet_once(spark, monkeypatch):
    """Unlike texts that share many part names meet in a few tiles, not once for each name; links are those of brute force."""
    rng, n = np.random.default_rng(5), 150
    words = [[f"w{j}" if keep else f"x{i}y{j}" for j, keep in enumerate(rng.permutation(200) >= 24)] for i in range(n)]
    for i in range(0, n, 10):
        words[i + 1] = [*words[i][:-3], "a", "b", "c"]
    counts, write = {}, common.Steps.write

    def spy(self, df, name):
        out = write(self, df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(common.Steps, "write", spy)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, 1, 80).collect()}
    sets, want = [set(w) for w in words], list(range(n))
    for i in range(n):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert got == dict(enumerate(want)) and len(set(want)) == n - n // 10
    assert counts["jaccard-open"][0] > 30 * n and counts["jaccard-cut"][0] < 15 * n, counts


def test_gaussians_count_equal_rows(spark):
    """Two Gaussians are the same of a table and of its copies dealt in another way, and those of plain numpy; what is fitted are distinct rows."""
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal((0, 0, 0), (1, 1, 0.3), (300, 3)), rng.normal((0, 1, 2), (1, 1, 0.3), (200, 3))]), 1)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    copies = df.crossJoin(spark.range(7)).drop("id").repartition(5, "b")
    rows = [mixture.counted(t, list("abc")).cache() for t in (df, copies)]
    assert rows[0].count() == rows[1].count() == len(np.unique(x, axis=0)) and rows[1].agg(F.sum("weight")).first()[0] == 3500
    one, many = (mixture.gaussians(t, list("abc"), 2, short=2, rounds=8) for t in rows)
    assert np.allclose(one.means, many.means, atol=1e-9) and np.allclose(one.counts * 7, many.counts) and np.isclose(one.bounds[-1], many.bounds[-1])

    def plain(axis, rounds):
        r, bounds = np.eye(2)[(x[:, axis] >= x[:, axis].mean()).astype(int)], []
        for i in range(rounds + 1):
            n, m = r.sum(0), r.T @ x / r.sum(0)[:, None]
            c = [(r[:, k, None] * (x - m[k])).T @ (x - m[k]) / n[k] + mixture.RIDGE * np.eye(3) for k in range(2)]
            p = np.stack([n[k] / len(x) * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m[k], np.linalg.inv(c[k]), x - m[k])) / np.sqrt(np.linalg.det(2 * np.pi * c[k])) for k in range(2)], 1)
            r = p / p.sum(1, keepdims=True)
            bounds.append(np.log(p.sum(1)).mean())
        return m, bounds[rounds - 1]

    best = max(range(3), key=lambda a: plain(a, 2)[1])
    means, bound = plain(best, 8)
    assert best == 2 and np.allclose(one.means, means, atol=1e-6) and np.isclose(one.bounds[-1], bound)
