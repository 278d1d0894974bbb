import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import index, query, search, vectors

INDEX = "row_id long, document_id string, chunk_id string, space string, relative_path string, page_number int, chunk_index int, start_offset long, body string, modality string, extension string, modified_at timestamp, vec array<float>"


def rows_of(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = {"row_id": i, "document_id": "d", "chunk_id": f"c{i}", "space": "documentText", "relative_path": "a.txt", "page_number": None, "chunk_index": i, "start_offset": i, "body": "", "modality": "text", "extension": ".txt", "modified_at": None, "vec": [1.0, 0.0]}
        full.append(tuple((base | r)[c.split()[0]] for c in INDEX.split(", ")))
    return spark.createDataFrame(full, INDEX)


def asked(spark, vec=(1.0, 0.0)):
    return spark.createDataFrame([(1, "documentText", list(vec))], "query_id long, space string, vec array<float>")


def test_tie_order(spark):
    rows = rows_of(spark, [{"relative_path": "b.txt", "page_number": 1, "start_offset": 5}, {"start_offset": 0}, {"page_number": 1, "start_offset": 9}, {"page_number": 1, "start_offset": 2}])
    assert [r["row_id"] for r in vectors.cosine_topk(rows, asked(spark), 4).orderBy("rank").collect()] == [3, 2, 1, 0]


@pytest.mark.parametrize("k", [3, 550])
def test_ties_at_the_cut(spark, k):
    rows = rows_of(spark, [{"start_offset": 700 - i, "vec": [0.5, 0.0]} for i in range(700)] + [{"relative_path": "z.txt", "vec": [0.9, 0.0]}]).repartition(7)
    got = [r["start_offset"] for r in vectors.cosine_topk(rows, asked(spark), k).orderBy("rank").collect()]
    assert len(got) == k and got[1:] == list(range(1, k))


def test_filter_before_limit(spark):
    rows = rows_of(spark, [{"extension": ".pdf", "relative_path": "n/b.pdf"}, {"relative_path": "notes/a.txt", "vec": [0.1, 0.0]}])
    only = vectors.cosine_topk(rows, asked(spark), 1, index.storage_filter([".txt"], "notes"))
    assert [r["row_id"] for r in only.collect()] == [1]
    assert vectors.cosine_topk(rows, asked(spark), 1, index.storage_filter([])).count() == 0
    assert rows.where(index.storage_filter(modified_after="2026-03-01")).count() == 0


def test_bigrams(spark):
    rows = rows_of(spark, [{"body": "离线检索"}, {"body": "线a检"}, {"body": ""}])
    assert sorted(r["term"] for r in index.build_postings(rows).collect()) == sorted(["离线", "线检", "检索"])
    found = search.bigram_search(index.build_postings(rows), rows, query.keyword_plan(spark.createDataFrame([(1, "离线检")], "query_id long, query string")))
    assert [(r["row_id"], r["score"]) for r in found.collect()] == [(0, 1.0)]


def test_trigram_and_like(spark):
    rows = rows_of(spark, [{"body": "Offline retrieval pipeline works"}, {"body": "100% a_b"}])
    q = lambda *t: spark.createDataFrame(list(enumerate(t)), "query_id long, query string")
    assert {(r["query_id"], r["row_id"]) for r in search.trigram_search(rows, q("RIEVAL", "val pip", "nope")).collect()} == {(0, 0), (1, 0)}
    assert {(r["query_id"], r["row_id"]) for r in search.like_search(rows, q("%", "_B", "of")).collect()} == {(0, 1), (1, 1), (2, 0)}


def test_glossary(spark):
    got = query.glossary_terms(spark.createDataFrame([("人行道上有人",), ("哪张图里有人在厨房做披萨",), ("文档 Tika",), ("plain",)], "query string")).collect()
    assert got[0]["glosses"] == ["sidewalk", "person"] and got[1]["clip_query"] == "person kitchen pizza"
    assert got[2]["latin_spans"] == ["Tika"] and got[3]["clip_query"] == "plain"
    assert len(query.GLOSSARY) == 128


def hits(spark, lists):
    rows = [(1, ch, i + 1, 0, d, d, d, None, 0) for ch, docs in lists.items() for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "query_id long, channel string, rank int, row_id long, document_id string, chunk_id string, relative_path string, page_number int, start_offset long")


def test_rrf(spark):
    got = search.rrf_fuse(hits(spark, {"text": ["a", "b"], "keyword": ["b", "c"]})).orderBy("rank").collect()
    assert [r["document_id"] for r in got] == ["b", "a", "c"]
    assert got[0]["score"] == pytest.approx(0.5 / 62 + 0.3 / 61, abs=1e-12) and got[0]["channels"] == ["keyword", "text"]
    image = search.rrf_fuse(hits(spark, {"text": [f"t{i}" for i in range(6)], "image": [f"i{i}" for i in range(6)]})).orderBy("rank").limit(5)
    assert [r["document_id"] for r in image.collect()] == ["t0", "t1", "i0", "t2", "i1"]
    one = [tuple(r) for r in search.rrf_fuse(hits(spark, {"text": list("abc"), "image": list("cab")}).repartition(1)).orderBy("rank").collect()]
    many = [tuple(r) for r in search.rrf_fuse(hits(spark, {"text": list("abc"), "image": list("cab")}).repartition(8)).orderBy("rank").collect()]
    assert one == many


def test_neighbourhood(spark):
    rows = rows_of(spark, [{"body": b, "page_number": p, "chunk_index": i, "start_offset": o} for b, p, i, o in (("before", 2, 0, 0), ("hit", 2, 1, 8), ("after", 2, 2, 20), ("other", 3, 3, 30))])
    got = search.expand_neighborhood(rows.where("body = 'hit'").select(F.lit(1).alias("query_id"), "document_id", "chunk_id", "start_offset"), rows).first()
    assert got["snippet"] == "before\nhit\nafter" and got["start_offset"] == 8


def test_replacement_keeps_other_documents(spark):
    cols = "row_id long, document_id string, document_key string"
    old = spark.createDataFrame([(1, "old", "k"), (2, "other", "o"), (3, "old", "k")], cols)
    new = spark.createDataFrame([(4, "new", "k"), (5, "new", "k")], cols)
    rows, outcome = index.replace_documents(old, new)
    assert sorted(r["row_id"] for r in rows.collect()) == [2, 4, 5]
    assert tuple(outcome.first()) == (2, 2)


def test_recipe_conflict(spark):
    rows = spark.createDataFrame([("d", "m", h, "p", "1", "c", 3) for h in ("h1", "h2")], "document_id string, model_id string, content_hash string, parser_name string, parser_version string, chunker_version string, dim int")
    assert index.generations_from_batch(rows).first()["conflict"]


def test_image_json_round_trip(spark):
    rows = spark.createDataFrame([('{"format":"png","width":2,"height":3}',), ('{"old":"x"}',)], "image_json string")
    a, b = index.unpack_image(rows).collect()
    assert a["image_asset"]["width"] == 2 and a["image_raw"] is None and b["image_asset"] is None and b["image_raw"] == {"old": "x"}


def test_vectors_round_trip_and_rejects(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 2), ([3.0], 2)], "vec array<float>, dim int")
    good, bad = vectors.decode_vectors(vectors.encode_vectors(rows, "vec").drop("vec"), "vectorB64", "dim")
    assert [r["vec"] for r in good.collect()] == [[1.0, 2.0]] and bad.count() == 1
    unit, rejected = vectors.l2_normalize(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan")],), ([],)], "vec array<double>"), "vec")
    assert unit.first()["vec"] == pytest.approx([0.6, 0.8]) and rejected.count() == 3
    pooled = vectors.mean_pool(spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1.0, 0.0]), ([1.0], [1.0]), ([1.0, 2.0], [0.0])], "h array<double>, m array<double>"), "h", "m", 2).collect()
    assert pooled[0]["pooled"] == [1.0, 2.0] and [r["failure"] for r in pooled] == [None, "badOutput", "badOutput"]


def test_requests(spark):
    rows = [(" q ", 5, "a\\.\\b", "2024-02-29", "pdf"), ("", 5, "", None, None), ("q", 0, "", None, None), ("q", 1, "c:/x", None, None), ("q", 1, "../x", None, None), ("q", 1, "", "2023-02-29", None)]
    got = query.normalize_requests(spark.createDataFrame(rows, "query string, top_k int, path_prefix string, modified_after string, file_type string")).collect()
    assert [r["reason"] for r in got] == [None, "emptyQuery", "topK", "absolutePath", "parentPath", "date"]
    assert got[0]["clean_prefix"] == "a/b" and got[0]["extensions"] == [".pdf"]


@pytest.mark.parametrize("few", [200, 0])
def test_substrings_of_few_and_many_questions(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW_QUERIES", few)
    rows = rows_of(spark, [{"row_id": i, "body": b} for i, b in enumerate(["abc def", "ABC", "xabcx defg", "none", "", "def"])])
    q = spark.createDataFrame([(0, "abc"), (1, "DEF"), (2, "abc def"), (3, "ab"), (4, "zzz"), (5, "abc")], "query_id long, query string")
    found = search.trigram_search(rows, q)
    assert sorted((r["query_id"], r["row_id"]) for r in found.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (1, 5), (2, 0), (5, 0), (5, 1), (5, 2)]
    short = search.like_search(rows, spark.createDataFrame([(0, "C"), (1, "ef"), (2, "xy"), (3, "def"), (4, "c ")], "query_id long, query string"))
    assert sorted((r["query_id"], r["row_id"]) for r in short.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (1, 5), (4, 0)]
    for plan in (found, short):
        assert "CartesianProduct" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("few", [10**6, 0])
def test_vector_products_block_by_block(spark, monkeypatch, few):
    """Blocks of a few rows, broadcast or dealt: the same as one matrix product; no window over one group and nothing collected."""
    from quarry.operators import blocks, evaluate

    monkeypatch.setattr(blocks, "BROADCAST_QUERIES", few)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5)).round(2)
    v[40] = v[3]
    table = spark.createDataFrame([(i, f"p{i % 4}", [float(x) for x in r]) for i, r in enumerate(v)], "row_id long, relative_path string, vec array<double>").select("row_id", "relative_path", F.lit("s").alias("space"), F.lit(None).cast("int").alias("page_number"), F.lit(0).cast("long").alias("start_offset"), "vec").repartition(3)
    s = v @ v.T
    got = vectors.cosine_topk(table, table.select(F.col("row_id").alias("query_id"), "space", "vec"), 6)
    want = {(q, i, k + 1) for q in range(60) for k, i in enumerate(sorted(range(60), key=lambda i: (-s[i, q], f"p{i % 4}", i))[:6])}
    assert {(r["query_id"], r["row_id"], r["rank"]) for r in got.collect()} == want
    other = {r["vec_id"]: r["other_cosine"] for r in vectors.nearest_other(table.select(F.col("row_id").alias("vec_id"), "vec")).collect()}
    assert all(abs(other[q] - max(s[i, q] for i in range(60) if i != q)) < 1e-9 for q in range(60))
    pairs = table.select(F.col("row_id").alias("i"), F.col("vec").alias("image_vec"), F.reverse("vec").alias("caption_vec"))
    c = v @ v[:, ::-1].T
    ranks = {r["query"]: r["rank"] for r in evaluate.cross_modal_ranks(pairs).collect()}
    assert ranks == {i: 1 + sum(j != i and (c[i, j] > c[i, i] + 1e-12 or abs(c[i, j] - c[i, i]) <= 1e-12 and j < i) for j in range(60)) for i in range(60)}
