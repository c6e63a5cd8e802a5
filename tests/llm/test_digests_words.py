"""Merkle manifest, byte-level BPE by distinct words and spelling variants against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import merkle, spelling, word_bpe


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(leaves):
    """Root, and for each leaf its siblings from the leaf up, with the digits of its place."""
    at, paths = list(leaves), [[] for _ in leaves]
    owners = [[i] for i in range(len(leaves))]
    while len(at) > 1:
        runs = [range(k, min(k + 3, len(at))) for k in range(0, len(at), 3)]
        for run in runs:
            for k in run:
                for i in owners[k]:
                    paths[i].append(([at[j] for j in run if j < k], [at[j] for j in run if j > k]))
        owners = [[i for k in run for i in owners[k]] for run in runs]
        at = [sha(*[at[k] for k in run]) for run in runs]
    return at[0], paths


def brute_manifest(rows):
    """(doc_id, source, lang, n_chars, text) to what the query returns."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
    roots = {s: brute_tree([brute_leaf(*r) for r in groups[s]]) for s in order}
    root, tops = brute_tree([roots[s][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for k, r in enumerate(groups[s]):
            path = roots[s][1][k] + tops[g]
            bare = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = brute_leaf(*r[:4], r[4].replace("\n", "")) if bare else brute_leaf(*r)
            for left, right in path:
                at = sha(*left, at, *right)
            out.append((r[0], brute_leaf(*r), roots[s][0], root, sha(*[x for left, right in path for x in (*left, *right)]), at, at == root))
    return Counter(out)


def table_of(spark, tmp_path, rows, parts=3):
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int, g_ int, path string"
    df = spark.createDataFrame([(*r, "mine", 1, 2, "x") for r in rows], schema).repartition(parts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ROWS = [(i, [None, "", "b", "a", "ä", "Z"][(i * i) % 6], None if i % 5 == 0 else "en", i if i % 3 else None, [None, "", "one\ntwo\n", "plain", "ü\n" * 40, "x" * 9000][i % 6]) for i in range(300)]


@pytest.mark.parametrize("rows", [ROWS + ROWS[:40] + [ROWS[2]] * 90 + [(None, "a", None, None, "n\n"), (None, "a", None, None, None), (None, "a", None, None, None)], ROWS[:1], ROWS[:2], [(i, "one", "en", 1, "t\n") for i in range(82)], []])
def test_merkle(spark, tmp_path, rows):
    out = merkle.op11_merkle(spark, table_of(spark, tmp_path, rows))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, out.collect())) == (brute_manifest(rows) if rows else Counter())


def test_merkle_requests(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.build(df)
    every = {(r.gid, r.rank): r for r in merkle.prove(m).collect()}
    asked = spark.createDataFrame([(0, 0), (2, 17), (3, 4), (99, 0)], "gid long, rank long")
    some = {(r.gid, r.rank): r for r in merkle.prove(m, asked).collect()}
    assert some == {k: v for k, v in every.items() if k in {(0, 0), (2, 17), (3, 4)}} and len(some) == 3
    records = {r.digest: r.children for r in m.records().collect()}
    assert all(sha(*c) == d for d, c in records.items()) and m.root in records
    assert m.records().count() == len(records)
    assert merkle.build(df.limit(0)).records().count() == 0


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, word_bpe.read_ranks().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    r = random.Random(5)
    letters = "ab cdé'st \n\t  ½²Ⅳ①世界и́\x1c\x1f\x85\xa0 ​᠎ 😀,.!-AZ019ªº×÷"
    fixed = [None, "", " ", "\n", "a ", "  a", " \na", "a \n b", "don't we'll I'm", "\x1c\x1d a", "<|endoftext|> a", "x" * 70_000, "ab" * 40_000, "w " * 40_000, "the cat " * 9]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk_words", [word_bpe.CHUNK_WORDS, 40])
def test_word_bpe(spark, tiktoken_encoding, chunk_words):
    rows = [*enumerate(odd_texts(800)), (None, "no key"), (None, "no key"), (3, "a b"), (2**53 + 1, "big")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, chunk string").repartition(3)

    def want(i, text):
        ids = tiktoken_encoding.encode_ordinary(text or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert Counter(map(tuple, word_bpe.digests(df, chunk_words=chunk_words).collect())) == Counter(want(*r) for r in rows)
    back = word_bpe.decode(word_bpe.encode(df, chunk_words=chunk_words)).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in back) == Counter((i, tuple(tiktoken_encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)


def test_word_bpe_edges(spark, tiktoken_encoding):
    empty = spark.createDataFrame([], "id string, body string")
    assert word_bpe.digests(empty, "id", "body").count() == 0 and word_bpe.encode(empty, "id", "body").columns == ["id", "ids"]
    lists = spark.createDataFrame([(1, None), (2, []), (3, [5, 6])], "k int, ids array<int>").withColumn("decoded", F.lit(1))
    assert [bytes(r.decoded) for r in word_bpe.decode(lists).orderBy("k").collect()] == [b"", b"", tiktoken_encoding.decode_bytes([5, 6])]


def test_merges_agree(tiktoken_encoding):
    """Scanning and the heap join the same pairs, on bytes of any kind."""
    encoder, r = word_bpe.Encoder(word_bpe.read_ranks()), random.Random(1)
    for _ in range(300):
        w = bytes(r.choice(b"aabbcdethin \xc3\xa4\xff\x00") for _ in range(r.randint(1, 80)))
        assert encoder._scan(w) == encoder._heap(w) == tiktoken_encoding._encode_single_piece(w) or w in encoder.ranks


def brute_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    return {w: n for w, n in count.items() if n > 1}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(words):
    found = {w: [v for v in words if one_edit(w, v)] for w in words}
    forms = {}
    for w, near in found.items():
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(found[w]), words.get(forms[w])))
    return Counter(out)


def similar_words(seed, n):
    r, out = random.Random(seed), []
    for _ in range(n):
        w = "".join(r.choice("abcé÷z") for _ in range(r.choice([7, 7, 8, 9, 12, 13, 17, 33, 40])))
        out.append(w)
        for _ in range(6):
            i, kind = r.randrange(len(w)), r.random()
            w = w[:i] + (r.choice("abcé÷z") if kind < 0.7 else "") + w[i + (kind < 0.5) :]
            out.append(w)
    return out + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababab", "q" * 400, "q" * 401, "q" * 399 + "r"]


@pytest.mark.parametrize("crowded", [spelling.CROWDED, 3])
def test_near_words(spark, crowded):
    r = random.Random(2)
    words = {w: r.choice([2, 3, 30, 31, 400, 5000]) for w in similar_words(1, 120) if len(w) >= 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    out = spelling.with_roots(spelling.near(df, crowded)).select("word", "form", "root", "n", "n_near", "form_n")
    assert Counter(map(tuple, out.collect())) == brute_variants(words)


def test_spelling(spark, tmp_path):
    words = similar_words(3, 30)
    rows = [(i, " ".join(words[(i * 7 + k) % len(words)].upper() if k % 3 else words[(i + k * k) % len(words)] for k in range(30)) + ("-Größere1" if i % 2 else "\n")) for i in range(150)]
    rows += [(None, None), (None, "alphabet alphabet"), (5, ""), (7, "short w"), rows[3], rows[3], (9, "n" * 100_000 + " " + "n" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = spelling.op13_spelling(spark, str(tmp_path))
    assert Counter(map(tuple, out.collect())) == brute_variants(brute_words(rows))
    assert spelling.group_variants(df.limit(0)).count() == 0
