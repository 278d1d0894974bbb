"""Joins by position, sections, spectral tails and joins by file name: against brute force, with plans that hold at scale."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions.stats import poisson_binomial_tail
from quarry.operators import bench, evaluate
from quarry.operators.intervals import overlap_join

SPANS = "doc string, id int, s int, e int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_overlaps_against_brute_force(spark, width):
    rng = random.Random(width)

    def some(n, empty):
        out = []
        for i in range(n):
            s = rng.randrange(60)
            out.append((rng.choice("ab"), i, s, s + rng.choice([0, 1, 2, 7, 14, 40]) if empty else s + rng.choice([1, 7, 30])))
        return out

    left, right = [*some(40, True), ("a", 98, 7, 14), (None, 99, 0, 9), ("a", 97, 3, None)], [*some(30, True), ("a", 98, 14, 21), ("a", 97, 0, 7), ("b", 96, 9, 3)]
    got = overlap_join(spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS).toDF("doc", "r_id", "r_s", "r_e"), ["doc"], ("s", "e"), ("r_s", "r_e"), width)
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in (a[3], b[3]) and b[2] <= b[3] and a[2] < b[3] and b[2] < a[3])
    assert sorted((r["id"], r["r_id"]) for r in got.collect()) == want


def test_a_large_document_makes_few_candidates(spark):
    """10^5 chunks and 10^4 sections of one document: the join's rows before the test of the ends are a few for each chunk."""
    chunks = spark.range(100_000).select(F.lit("d").alias("doc"), F.col("id"), (F.col("id") * 120).alias("s"), (F.col("id") * 120 + 118).alias("e"))
    sections = spark.range(10_000).select(F.lit("d").alias("doc"), F.col("id").alias("section"), (F.col("id") * 1200).alias("a"), (F.col("id") * 1200 + 1200).alias("b"))
    found = overlap_join(chunks, sections, ["doc"], ("s", "e"), ("a", "b"))
    assert found.count() == 100_000
    cut = lambda df, s, e: df.select(F.explode(F.sequence(F.floor(F.col(s) / 4096), F.floor((F.col(e) - 1) / 4096))).alias("bin"))
    candidates = cut(chunks, "s", "e").join(cut(sections, "a", "b"), "bin").count()
    assert candidates <= 600_000 and "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)


def test_sections_by_stack(spark):
    rng = random.Random(4)
    levels = [rng.choice([2, 3, 4]) for _ in range(300)]
    text = "".join(f"{'#' * n} h{i}\n{'x' * rng.randrange(9)}🙂\n" for i, n in enumerate(levels))
    got = bench.parse_sections(spark.createDataFrame([("d", text)], "document_key string, text string")).orderBy("position").collect()
    starts, total = [r["start"] for r in got], len(text) + text.count("🙂")
    for i, r in enumerate(got):
        assert r["level"] == levels[i] and r["end"] == next((starts[j] for j in range(i + 1, 300) if levels[j] <= levels[i]), total)
    for make in (lambda i: 2 + (i > 0), lambda i: 2 + i % 3):
        long = "".join(f"{'#' * make(i)} h{i}\n" for i in range(200_000))
        docs = spark.createDataFrame([("d", long)], "document_key string, text string").cache()
        docs.count()
        start = time.perf_counter()
        assert bench.parse_sections(docs).count() == 200_000 and time.perf_counter() - start < 20


def exact_tail(chances, hits):
    import numpy as np

    p = np.ones(1)
    for q in chances:
        p = np.r_[p * (1 - q), 0] + np.r_[0, p * q]
    return [float(p[max(0, h) :].sum()) for h in hits]


@pytest.mark.parametrize("chances", [
    [0.3], [0.0] * 5, [1.0] * 5, [0.5, 0.5], [1e-6] * 900 + [1 - 1e-9] * 30, [0.5] * 1000, [i / 5000 for i in range(5000)], [0.001 * (1 + i % 5) for i in range(3000)],
])
def test_spectral_tail_is_exact(spark, chances):
    mean = sum(chances)
    hits = sorted({0, 1, -1, int(mean), int(mean) + 1, int(mean * 0.9), int(mean * 1.1) + 2, int(mean) + 40, len(chances), len(chances) + 1})
    trials = spark.createDataFrame([("a", p) for p in chances], "arm string, chance double")
    observed = spark.createDataFrame([("a", h) for h in hits] + [("none", 3)], "arm string, hits int")
    got = {(r["arm"], r["hits"]): r["p_value"] for r in poisson_binomial_tail(trials, observed).collect()}
    assert got.pop(("none", 3)) == 1.0
    assert [got["a", h] for h in hits] == pytest.approx(exact_tail(chances, hits), abs=1e-11)


def test_spectral_tail_of_a_million_trials(spark):
    trials = spark.range(1_000_000).select(F.lit("a").alias("arm"), (F.col("id") / 1_000_000).alias("chance"))
    found = poisson_binomial_tail(trials, spark.createDataFrame([("a", 500_000), ("a", 501_000)], "arm string, hits int"))
    assert "Python" not in plan_of(found) and "Pandas" not in plan_of(found)
    got = [r["p_value"] for r in found.orderBy("hits").collect()]
    deviation = (1_000_000 / 6) ** 0.5
    from statistics import NormalDist

    want = [1 - NormalDist(499_999.5, deviation).cdf(h - 0.5) for h in (500_000, 501_000)]
    assert got == pytest.approx(want, abs=1e-5)


def test_gold_chunks_meet_by_file_name(spark):
    locations = spark.createDataFrame([(1, "x/k/a.txt", 0, 10), (2, "k/a.txt", 0, 10), (3, "y/b.txt", 0, 10), (4, "other.txt", 0, 10), (5, "k/a.txt", 5, 9)], "question_id int, doc string, span_start int, span_end int").withColumn("position", F.lit(0)).withColumn("kind", F.lit("span"))
    index = spark.createDataFrame([(7, "k/a.txt", "b.txt", 0, 1), (3, "k\\a.txt", None, 4, 2), (9, "k/c.txt", "c.txt", 2, 1)], "row_id long, document_key string, file_name string, chunk_index int, page_number int").withColumn("space", F.lit("documentText")).withColumn("start_offset", F.lit(0)).withColumn("end_offset", F.lit(10))
    found = evaluate.gold_chunk(locations, index)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 4, 2), (2, 4, 2), (3, 0, 1)]
    keys = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert "_name" in keys


def test_latency_needs_no_window(spark):
    rows = spark.createDataFrame([("A", 0, 900, 1, 1), ("A", 1, 10, 2, 1), ("A", 2, 30, 3, 1), ("B", 5, 70, 1, 1)], "arm string, position int, encode_ms int, store_ms int, fuse_ms int")
    found = evaluate.latency_summary(rows)
    assert {r["arm"]: (r["n"], r["encode_p50"], r["store_p50"]) for r in found.collect()} == {"A": (3, 20.0, 2.0), "B": (1, 70.0, 1.0)}
    assert "Window" not in plan_of(found)


def test_clauses_fetch_bodies_by_row(spark):
    """No body goes through the join on terms."""
    clause = "向量检索把每个问题变成向量"
    gold = spark.createDataFrame([("d", 0, clause + "，然后。"), ("e", 0, "这一句在两处都出现过的呢，好。")], "document_key string, chunk_index int, body string")
    chunks = spark.createDataFrame([(1, clause + "，然后。"), (2, "这一句在两处都出现过的呢，好。"), (3, "又这一句在两处都出现过的呢。")], "row_id long, body string")
    found = bench.verbatim_questions(gold, chunks)
    assert [r["question"] for r in found.collect()] == [clause]
    exchanges = [line for line in plan_of(found).splitlines() if "Exchange" in line and "_term" in line]
    assert all("body" not in line for line in exchanges)
