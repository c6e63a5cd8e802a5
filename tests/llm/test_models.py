"""Operators with models, the similarity join, and the pipeline."""

import random
import time

import harness
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import jaccard_join, language_id, toxicity
from voxloom.llm.common import letter_runs

random.seed(8)


def words(n, pool):
    return " ".join(random.choice(pool) for _ in range(n))


def components_by_hand(texts, n, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    s = [grams(t) for t in texts]
    p = list(range(len(s)))

    def root(i):
        while p[i] != i:
            i = p[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            k = len(s[i] & s[j])
            if s[i] and s[j] and 100 * k >= percent * (len(s[i]) + len(s[j]) - k):
                a, b = root(i), root(j)
                p[max(a, b)] = min(a, b)
    return [(len(x), root(i)) for i, x in enumerate(s)]


def near_copies():
    pool = [f"w{i}" for i in range(3000)]
    base, texts = words(160, pool), [None, "", " \n", "one", "ONE", "a b", "a b c d", "a b c d", "x " * 30_000]
    for _ in range(170):  # chains of edits, all around the threshold
        w = base.split()
        for _ in range(random.randint(0, 5)):
            w[random.randrange(len(w))] = random.choice(pool)
        texts.append(" ".join(w))
    passage = words(60, pool)
    texts += [passage + " " + words(random.randint(5, 90), pool) for _ in range(60)]
    texts += [words(random.randint(1, 12), pool[:12]) for _ in range(80)]
    return texts + texts[20:40]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, n, percent):
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit("mine"))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, n, percent).collect())
    assert [(b, c) for _, b, c in got] == components_by_hand(texts, n, percent)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A b\tc d e")], "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.jaccard_components(df).collect()]
    assert sorted(got, key=str) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_without_id_first(spark):
    """A row without an id stands for no others: its copies keep their links to near copies."""
    text, low = " ".join(f"w{i}" for i in range(60)), (1 << 53) + 1
    near = text.replace("w59", "other")
    rows = [(None, text), (low, text), (low + 2, text), (low + 4, near)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
        assert got == {None: None, low: low, low + 2: low, low + 4: low}


def test_parts_lose_no_link():
    rng, bands = np.random.default_rng(1), jaccard_join.Bands(85)
    for _ in range(400):
        s = int(rng.integers(6, 120))
        a = np.unique(rng.integers(0, 1 << 60, s).astype(np.uint64))
        out = int(rng.integers(0, 1 + len(a) // 8))
        b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 60, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)]))
        k = len(np.intersect1d(a, b))
        if 100 * k >= 85 * (len(a) + len(b) - k):
            assert np.intersect1d(bands.names(a), bands.names(b)).size


def test_bits_bound_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(40)]
    size = np.array(sorted(map(len, sets)))
    sets.sort(key=len)
    got = {(i, j) for i, js in jaccard_join.bounded(size, [jaccard_join.bitmap(s) for s in sets], np.arange(40), 30) for j in js}
    for i in range(40):
        for j in range(i + 1, 40):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 30 * (len(sets[i]) + len(sets[j]) - k) and 100 * len(sets[i]) >= 30 * len(sets[j]):
                assert (i, j) in got


@pytest.mark.parametrize("percent", [10, 30, 45, 80])
def test_bits_of_unequal_sizes(percent):
    """Sets that hold one another, as far apart in size as links allow."""
    rng = np.random.default_rng(3)
    for s in (17, 33, 63, 64, 65, 129, 1000):
        large = np.unique(rng.integers(0, 1 << 60, 100 * s // percent).astype(np.uint64))
        sets = [large[:s], large]
        bits, size = [jaccard_join.bitmap(x) for x in sets], np.array([s, len(large)])
        assert [(i, js) for i, js in jaccard_join.bounded(size, bits, np.arange(2), percent)] == [(0, [1])]
        assert jaccard_join.links(np.array([7, 5]), sets, percent) == [(5, 7)] or jaccard_join.links(np.array([7, 5]), sets, percent) == [(7, 5)]
        assert jaccard_join.possible_groups(size, bits, np.arange(2), percent) and not jaccard_join.links(np.array([7, 7]), sets, percent)


def test_percent_is_checked(spark):
    for percent in (0, 100):
        with pytest.raises(ValueError):
            jaccard_join.jaccard_components(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=percent)


EN, DE = [f"th{a}{b}" for a in "aeiou" for b in ("ing", "er", "ed", "ly")], [f"sch{a}{b}" for a in "aeiou" for b in ("ung", "keit", "lich", "ße")]


def test_language(spark):
    rows = [(i, words(30, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language_id.train(df)
    probe = [None, "", "12 !?", words(20, EN), words(20, DE), words(20, EN), "thaing\n" * 3000, words(9000, DE)]
    d = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string").withColumn("score", F.lit("mine"))
    out = language_id.predict(d, field).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "de", "en", "en", "de"]
    assert all(0 <= r.score <= 1 for r in out) and out[0].score == 0
    assert language_id.predict(d.limit(0), field).count() == 0
    assert {r.lang_pred for r in language_id.predict(d, language_id.train(df.limit(0))).collect()} == {"und"}
    tagger = language_id.Tagger(field)
    got, _, post = tagger.words([words(12, EN) + "\n" + words(12, DE)])
    assert [field.langs[k] for k in post.argmax(1)] == ["en"] * 12 + ["de"] * 12 and len(got) == 24


def test_letters(spark):
    """Numerals are no letters; marks end a word."""
    field = language_id.train(spark.createDataFrame([(i, words(20, EN), "en") for i in range(20)], "doc_id long, text string, lang string"))
    got = language_id.Tagger(field).predict(["½ ² Ⅳ ①", "½²Ⅳ", "中文 Ⅳ", None, "x"])
    assert got[0] == ["und", "und", "en", "und", "en"] and got[1][:2] == [0.0, 0.0]
    assert letter_runs("aÜ½b²c Ⅳd\n中1文_x", lines=True) == ["aÜ", "b", "c", "d", "\n", "中", "文", "x"] and letter_runs("aÜ½b\n") == ["aÜ", "b"]


def test_language_pieces(spark, monkeypatch):
    """Long texts in pieces of whole lines give what they give at once."""
    rows = [(i, words(30, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(80)]
    tagger = language_id.Tagger(language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    texts = ["\n".join(words(9, EN if k % 3 else DE) for k in range(50)), words(400, DE), "\n\n", words(3, EN)]
    whole = tagger.predict(texts)
    monkeypatch.setattr(language_id, "AT_ONCE", 20)
    assert tagger.predict(texts)[0] == whole[0] and np.allclose(tagger.predict(texts)[1], whole[1], atol=2e-6)
    for t in texts:
        cut = list(language_id.pieces(t, 100))
        assert "".join(cut) == t and all(len(c) <= 100 or "\n" not in c[:-1] for c in cut)


def test_language_long_line(spark):
    """A line of many words in overlapping parts: scores as of the whole chain, time as of lines."""
    rows = [(i, words(30, EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(80)]
    tagger = language_id.Tagger(language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    line = " ".join(words(40, EN if k % 2 else DE) for k in range(160))
    found, _, post = tagger.words([line + "\nthaing", "thaing"])
    scores = tagger.scores_of(found)
    whole = language_id.Lines(np.array([6400, 1, 1])).posteriors(scores, tagger.field.trans)
    assert len(found) == 6402 and np.abs(post - whole).max() < 1e-3
    take, cut, keep = language_id.overlapping(np.array([3, 7, 1]), 3, 1)
    assert take[keep].tolist() == list(range(11)) and cut.tolist() == [3, 4, 5, 2, 1]
    many = [words(10, EN) for _ in range(30_000)]
    took = []
    for text in ("\n".join(many), " ".join(many)):
        start = time.perf_counter()
        tagger.predict([text])
        took.append(time.perf_counter() - start)
    assert took[1] < 2 * took[0] + 0.5


def test_language_rare(spark):
    """A language of one document in a hundred is drawn and predicted."""
    rows = [(i, words(20, ["zq" + w for w in EN]) if i % 100 == 0 else words(20, EN if i % 2 else DE), "zz" if i % 100 == 0 else "en" if i % 2 else "de") for i in range(900)]
    field = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=30)
    assert field.langs == ["de", "en", "zz"]
    assert language_id.Tagger(field).predict([words(20, ["zq" + w for w in EN])])[0] == ["zz"]


def test_language_held_out(spark):
    """The sample leaves held-out documents aside; on these, accuracy is high. Source and id don't count."""
    import zlib

    docs = spark.read.parquet(f"{harness.DATA}/sf0.01/documents.parquet")
    out = language_id.op5_language_id(spark, f"{harness.DATA}/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.lang is not None and r.text and any(c.isalpha() for c in r.text)]
    right = sum(r.lang == r.lang_pred for r in held) / len(held)
    print(f"held-out accuracy of op5 on sf0.01: {right:.4f} of {len(held)}")
    assert right > 0.97
    # a language that only held-out documents have isn't learned
    rows = [(i, words(10, EN), "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else "en") for i in range(60)]
    assert language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["en"]


def test_forward_backward():
    """Against summing over all label sequences."""
    rng = np.random.default_rng(3)
    e, trans = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    total = np.zeros((4, 3))
    for p in np.ndindex(3, 3, 3, 3):
        total[np.arange(4), p] += np.exp(sum(e[t, p[t]] for t in range(4)) + sum(trans[p[t], p[t + 1]] for t in range(3)))
    want = total / total.sum(1, keepdims=True)
    lines = language_id.Lines(np.array([4]))
    assert np.allclose(lines.posteriors(e, trans), want) and np.allclose(lines.forward_backward(e, trans)[0], want)


def test_toxicity(spark):
    bad = ["idiot", "vequon", "vequix", "vequal"]
    rows, labels = [], []
    for i in range(300):
        t = words(25, EN)
        if i % 5 == 0:
            t += " " + random.choice(bad[:3])
        rows.append((i, t + (" ###" * 20 if i % 7 == 0 else "")))
        labels.append((i, int(i % 7 != 0), int(i % 5 == 0)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = toxicity.train(docs, lab)
    probe = [None, "", words(25, EN), words(25, EN) + " IDIOT!", words(200, EN) + " vequnew", words(25, EN)]
    d = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string").withColumn("toxic", F.lit("mine"))
    out = toxicity.score(d, models).orderBy("doc_id").collect()
    assert [r.toxic for r in out] == [False, False, False, True, True, False]
    assert len(models[1].dense) == len(models[0].dense) + 1  # the second model sees the first one's probability
    assert toxicity.score(d.limit(0), models).count() == 0
    assert not any(r.toxic for r in toxicity.score(d, toxicity.train(docs, lab.limit(0))).collect())


def test_chain_out_of_fold():
    """The later model gets, for each row, the probability of a model that was fitted without the row's fold."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int64) for _ in range(80)]
    dense = rng.normal(size=(80, 2))
    labels = np.column_stack([[float(3 in r) for r in rows], [float(7 in r) for r in rows]])
    models = toxicity.fit_chain(rows, dense, labels)
    fold, early = np.arange(80) % toxicity.FOLDS, np.zeros(80)
    sample = toxicity.Sample(rows, dense)
    for k in range(toxicity.FOLDS):
        m = toxicity.Linear(sample, dense, labels[:, 0], fold != k)
        for i in np.flatnonzero(fold == k):
            z = sum(m.weights.get(int(f), 0.0) for f in rows[i]) + ((dense[i] - m.center) / m.scale) @ m.dense + m.bias
            early[i] = 1 / (1 + np.exp(-z))
    both = np.column_stack([dense, early])
    want = toxicity.Linear(toxicity.Sample(rows, dense), both, labels[:, 1], np.ones(80, dtype=bool))
    assert np.allclose(models[1].center, want.center) and np.allclose(models[1].dense, want.dense) and models[1].weights.keys() == want.weights.keys()
    assert all(abs(models[1].weights[f] - want.weights[f]) < 1e-9 for f in want.weights)


def test_toxicity_held_out(spark):
    """Accuracy on labelled documents that the models weren't fitted on."""
    d = f"{harness.DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    fit, rest = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0").dropna()
    out = toxicity.score(docs.join(rest, "doc_id").withColumnRenamed("toxic", "gold"), toxicity.train(docs, fit)).collect()
    found = [sum(r.toxic == (r.gold == 1) for r in out if r.gold == g) / max(1, sum(r.gold == g for r in out)) for g in (0, 1)]
    print(f"held-out toxicity on sf0.1: clean left alone {found[0]:.4f}, toxic caught {found[1]:.4f}, of {len(out)}")
    assert found[0] > 0.97 and found[1] > 0.9


def test_pipeline_names_and_empty(spark, tmp_path):
    """Columns of any name pass all stages but the last; null, empty and repeated rows and empty tables don't stop one."""
    import corpus_pipeline as cp

    names = ["head", "key", "size", "score", "toxic", "taken", "row", "k", "label", "p_toxic", "lang_pred", "n_grams", "component_id", "__0"]
    rows = [(i, words(30, EN if i % 2 else DE), "en" if i % 2 else "de", f"s{i % 2}", 0) for i in range(60)]
    rows += [rows[3], rows[3], (None, words(20, EN), None, None, None), (None, None, None, None, None), (70, "", "en", "s0", 0)]
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)] + [(61, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind).withColumns({n: F.lit(f"my {n}") for n in names})
        for i, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < 4:
                assert out.columns == docs.columns
                out.write.parquet(f"{tmp_path}/{len(data)}-{name}")
                docs = spark.read.parquet(f"{tmp_path}/{len(data)}-{name}")
                assert all(r[n] == f"my {n}" for r in docs.collect() for n in names)
            else:
                assert out.count() == docs.count()
                if name == "jaccard_join":
                    assert docs.where("doc_id = 3").count() <= 1 and docs.where("text is null or text = ''").count() == 0


def brute_mix(rows):
    """rows: (doc_id, source, text). Times that each document is taken, by sorting keys within sources."""
    import hashlib
    import math
    import re

    size = {i: len((t or "").split()) for i, _, t in rows}
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = [sum(size[i] for i, x, _ in rows if x == s) for s in sources]
    from voxloom.llm.mixing import water_fill

    times = {}
    for s, n, target in zip(sources, total, water_fill(total, [1.0 + i % 3 for i in range(len(sources))])):
        epochs = min(3, int(target // n)) if n else 0
        keyed = []
        for i, x, t in rows:
            if x == s:
                u = (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                w = round(0.1 + 0.9 * len(re.findall("[^\\W\\d_]", t)) / len(t), 3) if t else 0.1
                keyed.append((-math.log(u) / w, i))
        before = 0
        for _, i in sorted(keyed):
            times[i] = epochs + (before + size[i] / 2 <= target - epochs * n)
            before += size[i]
    return times


def test_pipeline_mixing_and_encoding(spark, tmp_path):
    """The last two stages against brute force."""
    import hashlib
    from collections import Counter

    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    from voxloom.llm import bpe

    rows = [(i, f"s{i % 4}" if i % 9 else None, words(1 + i % 17, EN)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = cp.mix_sources(spark, docs, "").cache()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: k for i, k in brute_mix(rows).items() if k})
    t = Tokenizer.from_file(bpe.tokenizer_path())
    text = {i: x for i, _, x in rows}
    for r in cp.encode(spark, mixed, "").collect():
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_shared_folder(spark):
    from types import SimpleNamespace

    from voxloom.llm.common import shared_dir

    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=dict, master="spark://host:7077"), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        shared_dir(far)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rows = []
    for i in range(120):
        pool = EN if i % 2 else DE
        rows.append((i, words(40, pool) + (" idiot moron" if i % 6 == 0 else ""), "en" if i % 2 else "de", f"s{i % 3}", 0))
    rows += [(200 + i, rows[i][1] + " thaing", *rows[i][2:]) for i in range(1, 12)] + [(300, None, "en", "s0", 0), (301, "12 34", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, docs = {r[0]: r[1] for r in rows}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in docs.collect()}
        if name == "toxicity":
            assert ids == {i for i, *_ in rows if i > 299 or (i % 200) % 6}
        elif name == "language_id":
            assert not ids & {300, 301} and 1 in ids
        elif name == "jaccard_join":
            assert ids == {i for i in kept if i < 200 and i % 6}
    assert cp.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_near_duplicates_by_row(spark):
    """One row of each group stays where ids are missing or repeated."""
    import corpus_pipeline as cp

    base, solo, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "bst")
    rows = [(None, base), (5, base), (5, base), (6, base + " more"), (None, solo), (None, solo), (7, third), (7, base + " x"), (8, ""), (8, ""), (None, ""), (None, "")]
    want = [(5, base), (7, third), (8, ""), (None, ""), (None, ""), (None, solo)]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    out = cp.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
