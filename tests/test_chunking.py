import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import chunking as c


def texts(text, **options):
    return [text[a:b] for a, b in c.cascade(text, **options)]


def test_lines():
    assert c.cascade("段落一\n段落二", 8) == [(0, 3), (4, 7)]


def test_blank_line_keeps_short_lines_together():
    assert texts("甲\n乙\n\n丙") == ["甲\n乙", "丙"]


def test_sentences():
    assert texts("第一句。第二句。", tokens=6) == ["第一句。", "第二句。"]


def test_windows():
    assert texts("甲乙丙丁戊己庚辛", chars=3, tokens=5) == ["甲乙丙", "丁戊己", "庚辛"]


def test_surrogate_pair_is_not_parted(spark):
    pages = spark.createDataFrame([("d", 0, None, "ab🙂cd")], "document_id string, ordinal int, page_number int, text string")
    rows = [(r["text"], r["start_offset"], r["end_offset"]) for r in c.chunk_pages(pages, 3).orderBy("start_offset").collect()]
    assert rows == [("ab🙂", 0, 4), ("cd", 4, 6)]


def test_over_budget_fails_its_page_only(spark):
    pages = spark.createDataFrame([("a", 0, None, "long"), ("b", 0, 1, None), ("c", 0, 2, "x")], "document_id string, ordinal int, page_number int, text string")
    rows = c.chunk_pages(pages, counter=lambda t: 1000 if t and t[0] in "long" else 3)
    assert [(r["document_id"], r["kind"]) for r in c.budget_failures(rows).collect()] == [("a", "overBudget")]
    assert [r["text"] for r in rows.where("failure is null").collect()] == ["x"]
    with pytest.raises(c.OverBudget):
        c.cascade("xy", count=lambda t: 1000)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。.\n 　甲🙂;", max_size=80), st.integers(2, 12))
def test_chunks_are_slices_in_order(text, chars):
    at = 0
    for a, b in c.cascade(text, chars):
        assert at <= a < b and text[a:b].strip(c.SPACES) == text[a:b]
        assert c.units(text[a:b]) <= chars + 1
        at = b


def test_version_and_ids(spark):
    assert c.chunker_version() == "w3-cascade-1" and c.chunker_version(8, 16) == "w3-cascade-1-c8-t16"
    rows = spark.createDataFrame([("d", 0, None, 0, "t")], "document_id string, ordinal int, page_number int, position int, text string")
    assert c.with_chunk_ids(rows).first()["chunk_id"] == "d-w3-cascade-1-chars-c120-t128-o0-pna-i0"


def test_chunks_and_formulas_in_sql(spark):
    """The table function and the formulas give what the operators give."""
    from pyspark.sql import functions as F

    from quarry.functions.stats import wilson
    from quarry.operators import sql

    sql.register(spark)
    pages = spark.createDataFrame([("a", 0, None, "甲\n乙\n\n丙"), ("b", 0, 2, "ab🙂cd. ef🙂"), ("c", 0, None, ""), ("d", 0, None, None)], "document_id string, ordinal int, page_number int, text string")
    got = spark.sql("SELECT document_id, c.start_offset, c.end_offset, c.chunk, c.tokens FROM {pages} p, LATERAL chunk_text(p.text, 3, 7) c", pages=pages)
    want = c.chunk_pages(pages, 3, 7).select("document_id", "start_offset", "end_offset", "text", "tokens")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 3
    assert [r["failure"] for r in spark.sql("SELECT failure FROM chunk_text('abc', 5, 1)").collect()] == ["overBudget"]
    pairs = spark.createDataFrame([(5, 10), (9, 10), (0, 0), (0, 4)], "s long, n long")
    ci = wilson(F.col("s"), F.col("n"))
    for r in pairs.select(F.expr("wilson_low(s, n)").alias("a"), F.expr("wilson_high(s, n)").alias("b"), ci["low"].alias("c"), ci["high"].alias("d")).collect():
        assert (r["a"], r["b"]) == pytest.approx((r["c"], r["d"]), abs=1e-12)
    assert spark.sql("SELECT rrf('text', 2) + rrf('keyword', 1) AS x").first()["x"] == pytest.approx(0.5 / 62 + 0.3 / 61)
