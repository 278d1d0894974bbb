import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import blocks, vectors
from quarry.plans import fixtures


def table_of(spark, v):
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "row_id long, vec array<double>")
    return rows.select("row_id", F.lit("s").alias("space"), F.lit("").alias("relative_path"), F.lit(None).cast("int").alias("page_number"), F.lit(0).cast("long").alias("start_offset"), "vec")


@pytest.mark.parametrize("few", [10**6, 0])
def test_a_task_hands_on_its_best_only(spark, monkeypatch, few):
    """Rows that are ranked at the end grow with the tasks, not with the pairs of blocks; blocks of queries are not copied for an exchange."""
    monkeypatch.setattr(blocks, "BROADCAST_QUERIES", few)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 5)
    made = []
    monkeypatch.setattr(vectors, "products", lambda *a: made.append(blocks.products(*a)) or made[-1])
    rows = table_of(spark, np.random.default_rng(5).normal(size=(400, 4)).round(2)).repartition(3)
    assert vectors.cosine_topk(rows, rows.select(F.col("row_id").alias("query_id"), "space", "vec"), 2).count() == 800
    slices = 3 if few else 8  # two for each of four cores
    assert made[0].count() <= 400 * 2 * slices
    assert "slot" not in made[0]._jdf.queryExecution().toString()


def test_equal_vectors_tie_by_row_wherever_they_lie(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 13)
    v = np.tile(np.random.default_rng(6).normal(size=(11, 64)).astype(np.float32), (9, 1))
    rows = table_of(spark, v).repartition(3)
    got = {}
    for r in vectors.cosine_topk(rows, rows.select(F.col("row_id").alias("query_id"), "space", "vec"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["row_id"]
    s = v[:11].astype(float) @ v[:11].astype(float).T
    for q, found in got.items():
        order = sorted(range(99), key=lambda i: (-s[i % 11, q % 11], i))[:5]
        assert [found[k + 1] for k in range(5)] == order


def test_rounding_comes_before_the_rank(spark):
    rows = table_of(spark, [[0.12346], [0.12348], [0.1], [-0.12346]])
    asked = spark.createDataFrame([(7, "s", [1.0])], "query_id long, space string, vec array<double>")
    assert [(r["row_id"], r["score"]) for r in vectors.cosine_topk(rows, asked, 2, digits=4).orderBy("rank").collect()] == [(0, 0.1235), (1, 0.1235)]


def test_hits_of_vectors_with_many_copies(spark, tmp_path):
    """Fifty copies of each vector: the ten of least number, as the SQL orders them."""
    v = np.tile(np.random.default_rng(7).normal(size=(6, 64)).astype(np.float32), (50, 1))
    spark.createDataFrame([(i, [float(x) for x in r], i % 10) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in fixtures.hits(spark, str(tmp_path)).where("arm in ('A0', 'A1')").select("question_id", "arm", "rank", (F.regexp_extract("document_key", r"(\d+)", 1).cast("int") * 5 + F.col("chunk_index")).alias("h")).collect():
        got.setdefault((r["question_id"], r["arm"]), {})[r["rank"]] = r["h"]
    assert len(got) == 600
    for (q, arm), found in got.items():
        part = v[:6, : 32 if arm == "A0" else 64].astype(float)
        s = part @ part.T
        order = sorted((i for i in range(300) if i % 11 and i != q), key=lambda i: (-round(s[i % 6, q % 6], 6), i))[:10]
        assert [found[k + 1] for k in range(10)] == order


@pytest.mark.parametrize("given", [False, True])
@pytest.mark.parametrize("few", [10**6, 0])
def test_bigrams_by_brute_force(spark, monkeypatch, few, given):
    """Terms of bodies or given postings, broadcast or dealt, a filter before the cut, equal scores at the cut: a task hands on k rows a query at most."""
    from quarry.operators import index, query, search

    monkeypatch.setattr(blocks, "BROADCAST_QUERIES", few)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)
    made = []
    monkeypatch.setattr(search, "products", lambda *a: made.append(blocks.products(*a)) or made[-1])
    rng = np.random.default_rng(8)
    bodies = ["".join(rng.choice(list("一丁七万 a"), size=rng.integers(0, 14))) for _ in range(120)]
    rows = [(i, f"d{i}", f"c{i}", f"p{i % 3}", None if i % 4 == 0 else i % 5, i % 2, b) for i, b in enumerate(bodies)]
    table = spark.createDataFrame(rows, "row_id long, document_id string, chunk_id string, relative_path string, page_number int, start_offset int, body string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(["一丁七万", "万七丁一丁", "a", "丁丁", "七一 万万一"])), "query_id long, query string")
    found = search.bigram_search(index.build_postings(table) if given else None, table, query.keyword_plan(asked), 4, F.col("start_offset") == 1)
    got = {(r["query_id"], r["row_id"], round(r["score"], 9), r["rank"]) for r in found.collect()}
    pairs = lambda t: {x + y for x, y in zip(t, t[1:]) if not {x, y} & set(" a")}
    want = set()
    for q, text in enumerate(["一丁七万", "万七丁一丁", "a", "丁丁", "七一 万万一"]):
        scored = [(-len(pairs(text) & pairs(b)) / len(pairs(text)), path, page is None, page or 0, off, i) for i, _, _, path, page, off, b in rows if off == 1 and pairs(text) & pairs(b)]
        want |= {(q, s[-1], round(-s[0], 9), k + 1) for k, s in enumerate(sorted(scored)[:4])}
    assert got == want
    assert made[0].count() <= 4 * 5 * (made[0].rdd.getNumPartitions() if few else 8)


def test_lists_without_a_match_are_not_drawn(spark, monkeypatch):
    """A thousand lists of no match take no draws; lists with one have those of the seeded generator, one after another."""
    import random
    import time
    import zlib

    from quarry.operators import evaluate

    hits = spark.range(4000).select((F.col("id") % 400).alias("question_id"), F.lit("A1").alias("arm"), F.floor(F.col("id") / 400).cast("int").alias("rank"), ((F.col("id") % 400 == 7) & (F.col("id") < 800) | (F.col("id") % 400 == 9)).alias("matched"))
    began = time.time()
    got = {r["question_id"]: r for r in evaluate.chance_shuffle(hits, draws=20_000).collect()}
    assert time.time() - began < 30
    rng, marks, wins = random.Random(zlib.crc32(b"7|A1")), [True, True] + [False] * 8, 0
    for _ in range(20_000):
        rng.shuffle(marks)
        wins += any(marks[:5])
    assert got[7]["chance"] == wins / 20_000 and (got[9]["chance"], got[9]["observed"]) == (1.0, 1)
    assert {r["chance"] for q, r in got.items() if q not in (7, 9)} == {0.0} and len(got) == 400
