"""Other columns pass through Python operators as they are: large ids beside nulls, late dates, lists, clashing names."""

import datetime

import pytest
from pyspark.sql import functions as F

from voxloom.llm import bpe, html_extract, media

BIG = 2**53 + 1
LATE = datetime.datetime(9999, 12, 31, 23, 59, 59)


def table(spark, text="text"):
    rows = [(BIG, "one two", LATE, [1, None], "a"), (None, None, None, None, None), (BIG + 2, "", LATE, [], "b"), (7, "one two", LATE, [3], "c")]
    df = spark.createDataFrame(rows, f"doc_id long, {text} string, at timestamp, list array<int>, digest string")
    return df.withColumns({"__place": F.lit(1), "__digest": F.lit("d"), "__0": F.lit(2), "row": F.lit(3)}).coalesce(1)


def kept(df, columns):
    return sorted((tuple(None if v is None else tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


COLUMNS = ["doc_id", "at", "list", "__place", "__digest", "__0", "row"]


@pytest.mark.parametrize("apply", [
    lambda df: media.read_back(media.headers(media.spread(media.store(df)))),
    lambda df: html_extract.extract(df, "text", "main"),
    lambda df: bpe.decode(bpe.encode(df)),
])
def test_columns_pass(spark, apply):
    df = table(spark)
    out = apply(df)
    assert kept(out, COLUMNS) == kept(df, COLUMNS)
    assert apply(df.limit(0)).count() == 0


def test_media_of_nulls(spark):
    out = media.read_back(media.store(table(spark))).collect()
    assert {r.doc_id: r.n_bytes for r in out} == {BIG: 7, None: 0, BIG + 2: 0, 7: 7}
    assert len({r.payload_sha256 for r in out}) == 2


def test_pages_of_any_id(spark):
    df = spark.createDataFrame([(BIG, "u", "<p>x</p>"), (None, None, None), (3, "v", "")], "page_id long, url string, html string").coalesce(1)
    assert {(r.page_id, r.url, r.text) for r in html_extract._extract_only(df).collect()} == {(BIG, "u", "x"), (None, None, ""), (3, "v", "")}


def test_bpe_nulls(spark):
    out = bpe.decode(bpe.encode(table(spark)).withColumn("ids", F.when(F.col("doc_id") == 7, F.lit(None)).otherwise(F.col("ids")))).collect()
    assert {r.doc_id: r.decoded for r in out} == {BIG: "one two", None: "", BIG + 2: "", 7: ""}


def test_bpe_small_memory(spark):
    """Small caches and batches give the same ids and texts."""
    df = spark.createDataFrame([(i, f"text {i % 7} of some {i}words " * (i % 40)) for i in range(700)], "doc_id long, text string").coalesce(2)
    both = [sorted(map(tuple, bpe.digests(df, small=small).collect())) for small in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 700


W = "word " * 30


@pytest.mark.parametrize("kind", ["widget", "promo", "sidebar", "related", "newsletter", "banner"])
@pytest.mark.parametrize("inside", ["", "article", "main"])
def test_marked_blocks_that_hold_the_text(kind, inside):
    """Several marked blocks of equal length, which together are the text; a menu of links beside them goes."""
    blocks = "".join(f'<div class="{kind}"><p>{c} {W}</p></div>' for c in "abc")
    body = f"<{inside}>{blocks}</{inside}>" if inside else blocks
    page = f'<body><div class="menu"><a href="x">a menu</a><a href="y">more of it</a></div>{body}</body>'
    assert html_extract.main_text(page) == "\n".join(f"{c} {W}".strip() for c in "abc")


def test_marked_blocks_beside_the_text():
    side = f'<div class="sidebar"><p>{W}</p></div><div class="widget"><p>{W}</p></div>'
    assert html_extract.main_text(f"<body><article><p>x {W * 2}</p></article>{side * 4}</body>") == f"x {W * 2}".strip()
    assert html_extract.main_text(f'<body><div class="text"><p>x {W * 3}</p></div>{side}</body>') == f"x {W * 3}".strip()


def test_header_of_the_main_part():
    page = f"<body><header>site</header><main><header><h1>Head</h1></header><p>{W}</p></main></body>"
    assert html_extract.main_text(page) == f"Head\n{W}".strip()
