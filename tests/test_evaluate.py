import pytest
from pyspark.sql import functions as F

from quarry.functions.stats import chance_of_hit, poisson_binomial_tail, wilson
from quarry.operators import bench, evaluate


def test_wilson(spark):
    got = spark.createDataFrame([(5, 10), (9, 10), (0, 0)], "s int, n int").select(wilson(F.col("s"), F.col("n")).alias("w")).collect()
    assert tuple(got[0]["w"]) == pytest.approx((0.236593, 0.763407), abs=1e-6)
    assert tuple(got[1]["w"]) == pytest.approx((0.595850, 0.982124), abs=1e-6)
    assert tuple(got[2]["w"]) == (0.0, 0.0)


def test_chance(spark):
    row = spark.range(1).select(chance_of_hit(F.lit(51), F.lit(1), 5).alias("a"), chance_of_hit(F.lit(3), F.lit(3), 5).alias("b"), chance_of_hit(F.lit(3), F.lit(0), 5).alias("c")).first()
    assert tuple(row) == pytest.approx((0.098039, 1.0, 0.0), abs=1e-6)


def test_poisson_binomial(spark):
    trials = spark.createDataFrame([(f"k{k}", p) for k in range(4) for p in (0.5, 0.25)], "arm string, chance double")
    observed = spark.createDataFrame([(f"k{k}", k) for k in range(4)] + [("e", 1)], "arm string, hits int")
    got = {r["arm"]: r["p_value"] for r in poisson_binomial_tail(trials, observed).collect()}
    assert tuple(got[k] for k in ("k0", "k1", "k2", "k3", "e")) == pytest.approx((1.0, 0.625, 0.125, 0.0, 1.0))


def test_poisson_binomial_of_many_trials(spark):
    """Repeated and distinct chances over all groups of the convolution: the same as one trial after another."""
    chances = [0.1] * 150 + [0.5] * 7 + [i / 400 for i in range(200)] + [0.0, 1.0]
    exact = [1.0]
    for p in chances:
        exact = [(exact[i] if i < len(exact) else 0.0) * (1 - p) + (exact[i - 1] * p if i else 0.0) for i in range(len(exact) + 1)]
    trials = spark.createDataFrame([("a", p) for p in chances], "arm string, chance double")
    for hits in (1, 60, 90, 200, len(chances)):
        got = poisson_binomial_tail(trials, spark.createDataFrame([("a", hits)], "arm string, hits int")).first()["p_value"]
        assert got == pytest.approx(sum(exact[hits:]), abs=1e-12)


def test_shuffle_agrees_with_closed_form(spark):
    rows = spark.createDataFrame([("q", "A1", i, i == 7) for i in range(1, 11)], "question_id string, arm string, rank int, matched boolean")
    exact, drawn = evaluate.chance_shuffle(rows).first(), evaluate.chance_shuffle(rows, draws=2000).first()
    assert exact["chance"] == pytest.approx(0.5) and drawn["chance"] == pytest.approx(0.5, abs=0.05)


def test_coverage(spark):
    index = spark.createDataFrame([("d", i, f"body {i}") for i in range(6)], "document_key string, chunk_index int, body string")
    labels = spark.createDataFrame([("two", "d", [1, 2], "body 1"), ("three", "d", [1, 2, 3], "x"), ("four", "d", [1, 2, 3, 4], "body 1"), ("gone", "d", [9], "y")], "question_id string, document_key string, chunk_indexes array<int>, evidence_text string")
    got = {r["question_id"]: (r["some_window"], r["every_window"], r["exists_all"]) for r in evaluate.neighborhood_coverage(labels, index).collect()}
    assert got == {"two": (True, True, True), "three": (True, False, True), "four": (False, False, True), "gone": (False, False, False)}


def test_locations(spark):
    rows = spark.createDataFrame([("q", ["d.md#page=null;textUnit=utf16CodeUnit;start=12;end=40", "d.md", "d.md#title"])], "question_id string, evidence_locations array<string>")
    got = [(r["doc"], r["kind"], r["page"], r["span_start"], r["span_end"]) for r in evaluate.parse_locations(rows).orderBy("position").collect()]
    assert got == [("d.md", "span", None, 12, 40), ("d.md", "file", None, None, None), ("d.md", "metadata", None, None, None)]


def test_sections_and_clauses(spark):
    docs = spark.createDataFrame([("m/d.md", "# t\n## A one\nx🙂\n### B two\ny\n## C three\n")], "document_key string, text string")
    got = [(r["level"], r["heading"], r["start"], r["end"]) for r in bench.parse_sections(docs).orderBy("position").collect()]
    assert got == [(2, "A one", 4, 29), (3, "B two", 17, 29), (2, "C three", 29, 40)]
    row = spark.createDataFrame([("向量检索把每个问题变成向量，然后逐个比较（结果。",), ("这是一段非常完整的中文描述是",)], "b string").select(bench.clause_of(F.col("b")).alias("c")).collect()
    assert [r["c"] for r in row] == ["向量检索把每个问题变成向量", None]


def test_negatives(spark):
    chunks = spark.createDataFrame([("手机号 here",)], "body string")
    rows = spark.createDataFrame([(0, "甲的手机号"), (1, "乙的报价"), (2, "乙的报价"), (3, "无")], "position int, question string")
    assert [r["question"] for r in bench.verified_negatives(rows, chunks).collect()] == ["乙的报价"]


def test_ngrams_keep_code_points(spark):
    from quarry.functions.text import char_bigrams, ngrams

    row = spark.createDataFrame([("a🙂b",), ("x",), ("",), (None,)], "t string").select(ngrams("t", 2).alias("n"), char_bigrams("t").alias("c")).collect()
    assert [r["n"] for r in row] == [["a🙂", "🙂b"], [], [], []] and row[0]["c"] == ["a🙂", "🙂b"]
