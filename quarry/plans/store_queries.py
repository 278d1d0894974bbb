"""Registered queries of sources, sinks and the incremental index, over files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import index, vectors
from ..sources import datasource, files, records, staged, store
from ..streaming import incremental
from . import fixtures as fx
from .queries import registered, rounded


def folder(spark, name: str) -> str:
    path = f"{staged.shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    staged.delete_at_end(spark, path)
    return path


@registered("SELECT item_id, strlen(text)+1 AS size_bytes, sha256(text||chr(10)) AS sha FROM benchmark WHERE item_id%2=0")
def s1_scan_files(spark, sf_dir):
    """A file for each benchmark item, half of them with an extension that the scan leaves out."""
    path, items = folder(spark, "files"), fx.table(spark, sf_dir, "benchmark")
    items.where("item_id % 2 = 0").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    items.where("item_id % 2 = 1").select("item_id", F.col("text").alias("value")).write.mode("append").partitionBy("item_id").option("compression", "gzip").text(path)
    found = files.scan_files(spark, path)
    return found.select(F.regexp_extract("relative_path", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), "size_bytes", F.sha2("content", 256).alias("sha"))


def _round_trip(spark, name, df):
    path = folder(spark, name)
    df.write.json(path)
    return path


@registered("SELECT item_id, CASE WHEN item_id%7=0 THEN 'emptyQuestion' END AS kind, CASE WHEN item_id%7>0 THEN sha256(text) END AS sha FROM benchmark")
def s2_read_labels(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 7 == 0, " ").otherwise(F.col("text")).alias("question"), F.lit(True).alias("answerable"))
    good, bad = records.read_labels(spark, _round_trip(spark, "labels", rows))
    kept = good.select(F.col("id").cast("long").alias("item_id"), F.lit(None).cast("string").alias("kind"), F.sha2("question", 256).alias("sha"))
    return kept.unionByName(bad.select(F.get_json_object("value", "$.id").cast("long").alias("item_id"), "kind", F.lit(None).cast("string").alias("sha")))


@registered(f"WITH {fx.HITS} SELECT question_id, arm, rank::BIGINT AS rank, document_key, round(score,6) AS score FROM hits")
def s2_read_probe_rows(spark, sf_dir):
    one = F.struct(F.col("rank").alias("rank"), F.col("document_key").alias("documentKey"), F.col("score").alias("score"))
    rows = fx.hits(spark, sf_dir).groupBy(F.col("question_id").cast("string").alias("id"), "arm").agg(F.collect_list(one).alias("hits")).withColumn("question", F.concat(F.lit("q"), "id"))
    good, _ = records.read_probe_rows(spark, _round_trip(spark, "probes", rows))
    return rounded(good.select(F.col("id").cast("long").alias("question_id"), "arm", F.explode("hits").alias("h")).select("question_id", "arm", F.col("h.rank").cast("long").alias("rank"), F.col("h.documentKey").alias("document_key"), "h.score"), "score")


@registered("WITH p AS (SELECT c.conv_id, c.text AS question, list(DISTINCT a.text) AS answers FROM conversations c JOIN conversations a ON a.conv_id=c.conv_id AND a.role='assistant' WHERE c.turn=0 GROUP BY 1,2) SELECT count(*) AS pairs, sum(len(answers))::BIGINT AS answers, sum(length(question))::BIGINT AS chars FROM p WHERE trim(question)<>'' AND len(list_filter(answers, lambda x: trim(x)<>''))>0")
def s2_read_pairs(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    said = turns.where("role = 'assistant' and text is not null").groupBy("conv_id").agg(F.collect_set("text").alias("answers"))
    good, _ = records.read_pairs(spark, _round_trip(spark, "pairs", turns.where("turn = 0").select("conv_id", F.col("text").alias("question")).join(said, "conv_id")))
    return good.agg(F.count("*").alias("pairs"), F.sum(F.size("answers")).alias("answers"), F.sum(F.char_length("question")).alias("chars"))


@registered("SELECT page_id, CASE WHEN page_id%9=0 THEN 'emptyCaption' END AS kind FROM pages")
def s2_read_captions(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_name"), F.when(F.col("page_id") % 9 > 0, F.col("url")).otherwise("").alias("caption"))
    good, bad = records.read_captions(spark, _round_trip(spark, "captions", rows))
    return good.select(F.col("file_name").cast("long").alias("page_id"), F.lit(None).cast("string").alias("kind")).unionByName(bad.select(F.get_json_object("value", "$.file_name").cast("long").alias("page_id"), "kind"))


@registered("SELECT vec_id, CASE WHEN vec_id%8=0 THEN 'corruptVector' END AS kind, CASE WHEN vec_id%8>0 THEN round(list_sum(embedding::DOUBLE[]),4) END AS total FROM embeddings")
def s3_vector_round_trip(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").withColumn("dim", F.size("embedding") + F.when(F.col("vec_id") % 8 == 0, 1).otherwise(0))
    good, bad = vectors.decode_vectors(vectors.encode_vectors(rows, "embedding").drop("embedding"), "vectorB64", "dim")
    total = F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4)
    return good.select("vec_id", F.lit(None).cast("string").alias("kind"), total.alias("total")).unionByName(bad.select("vec_id", "kind", F.lit(None).cast("double").alias("total")))


@registered(f"WITH {fx.CHUNKS} SELECT row_id, document_id, space, body, content_hash FROM chunks")
def s4_write_and_read_index(spark, sf_dir):
    path = folder(spark, "index")
    rows = fx.chunks(spark, sf_dir)
    store.write_index(spark, path, rows, index.generations_from_batch(rows.withColumn("dim", F.size("vec"))).where("not conflict").drop("conflict"))
    return store.read_index(spark, path)["chunks"].select("row_id", "document_id", "space", "body", "content_hash")


@registered(f"WITH {fx.FILES} SELECT 'files' AS part, relative_path AS name, length(text)::BIGINT AS chars FROM files WHERE extension='.md' UNION ALL SELECT 'skipped', relative_path, -1 FROM files WHERE extension='.pdf' UNION ALL SELECT 'totals', NULL, sum(length(text))::BIGINT FROM files WHERE extension='.md'")
def s5_write_manifest(spark, sf_dir):
    rows, path = fx.files(spark, sf_dir), folder(spark, "manifest")
    selected = rows.where("relative_path like '%.md'").select(F.col("relative_path").alias("source"), F.char_length("text").cast("long").alias("chars"), F.lit(1).alias("lines"))
    records.write_manifest(selected, rows.where("relative_path like '%.pdf'").select(F.col("relative_path").alias("path")), path)
    read = lambda part, name, schema: spark.read.schema(schema).json(f"{path}/{part}").select(F.lit(part).alias("part"), name.alias("name"), F.coalesce("chars", F.lit(-1)).alias("chars"))
    return read("files", F.col("source"), "source string, chars long").unionByName(read("skipped", F.col("path"), "path string, chars long")).unionByName(read("totals", F.lit(None).cast("string"), "chars long"))


@registered("SELECT item_id, length(text)::BIGINT AS chars FROM benchmark")
def s5_write_eval_jsonl(spark, sf_dir):
    path = folder(spark, "eval")
    records.write_eval_jsonl(fx.table(spark, sf_dir, "benchmark"), path)
    return spark.read.schema("item_id long, text string").json(path).select("item_id", F.char_length("text").cast("long").alias("chars"))


POOL_SQL = "SELECT vec_id, CASE WHEN vec_id%10=0 THEN 'badOutput' END AS failure, CASE WHEN vec_id%10>0 THEN round((embedding[1]+2*embedding[1])/2,5) END AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings)"


@registered(POOL_SQL)
def v1_mean_pool(spark, sf_dir):
    """Three token vectors, the last masked: the row's vector, its double, and another."""
    e = fx.table(spark, sf_dir, "embeddings")
    dim = len(e.select("embedding").first()[0])
    tokens = F.concat(F.col("embedding").cast("array<double>"), F.transform(F.col("embedding").cast("array<double>"), lambda x: 2 * x), F.col("embedding").cast("array<double>"))
    mask = F.when(F.col("vec_id") % 10 == 0, F.array(*map(F.lit, (0.0, 0.0, 0.0)))).otherwise(F.array(*map(F.lit, (1.0, 1.0, 0.0))))
    return vectors.mean_pool(e.select("vec_id", tokens.alias("h"), mask.alias("m")), "h", "m", dim).select("vec_id", "failure", F.round(F.element_at("pooled", 1), 5).alias("first"))


@registered("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN vec_id%10=0 THEN 'badOutput' WHEN vec_id%15=1 THEN 'timeout' ELSE 'ok' END AS kind FROM embeddings) GROUP BY 1")
def v6_embedding_report(spark, sf_dir):
    rows = v1_mean_pool(spark, sf_dir)
    return vectors.embedding_report(rows.select(F.coalesce("failure", F.when(F.col("vec_id") % 15 == 1, "timeout")).alias("failure_kind")))


@registered("SELECT page_id, page_id%4>0 AS sound, CASE WHEN page_id%4>0 THEN length(html) ELSE -1 END::BIGINT AS width, CASE WHEN page_id%4=0 THEN url END AS old FROM pages")
def m11_image_json(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    asset = F.struct(F.lit("png").alias("format"), F.char_length("html").alias("width"), F.lit(3).alias("height"))
    packed = index.pack_image(pages.withColumn("image_asset", asset)).withColumn("image_json", F.when(F.col("page_id") % 4 == 0, F.to_json(F.struct(F.col("url").alias("old")))).otherwise(F.col("image_json")))
    out = index.unpack_image(packed.drop("image_asset"))
    return out.select("page_id", F.col("image_asset").isNotNull().alias("sound"), F.coalesce(F.col("image_asset.width"), F.lit(-1)).cast("long").alias("width"), F.col("image_raw")["old"].alias("old"))


@registered(f"""WITH {fx.FILES}, f AS (SELECT * FROM files WHERE trim(text)<>''), w1 AS (SELECT content_hash, min(relative_path) AS relative_path FROM f GROUP BY 1),
 w2 AS (SELECT sha256(text||chr(10)||'more') AS content_hash, min(relative_path) AS relative_path FROM f WHERE doc_id%10=0 GROUP BY 1)
 SELECT content_hash AS document_id, relative_path FROM w1 WHERE relative_path NOT IN (SELECT relative_path FROM f WHERE doc_id%10=0) UNION ALL SELECT * FROM w2""")
def m12_incremental_index_stream(spark, sf_dir):
    """All documents as files; then every tenth one changed; read from the index."""
    docs = fx.files(spark, sf_dir)
    root, arriving, progress = (folder(spark, x) for x in ("index", "arriving", "progress"))
    put = lambda df: df.select("relative_path", "text", F.sha2("text", 256).alias("content_hash"), F.lit("plain").alias("parser_name"), F.lit("1").alias("parser_version"), "modified_at").write.mode("append").parquet(arriving)
    changed = docs.where("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit("\nmore"))).withColumn("modified_at", F.expr("modified_at + interval 1 year"))
    for batch in (docs, changed):
        put(batch)
        incremental.incremental_index_stream(spark, arriving, root, progress).awaitTermination()
    return store.read_index(spark, root)["chunks"].select("document_id", "relative_path").distinct()


def _gunzipped():
    """A parser of compressed text that takes texts of an even length only: the others are its corrupt files."""

    def parse(content: bytes) -> str:
        import gzip

        text = gzip.decompress(content).decode().rstrip("\n")
        if len(text) % 2:
            raise ValueError("odd length")
        return text

    return incremental.Options(parsers={".gz": incremental.Parser("gunzip", "1", parse)})


@registered("""WITH f AS (SELECT item_id, text, trim(text)<>'' AND (item_id%2=0 OR length(text)%2=0) AS sound FROM benchmark)
 SELECT item_id, CASE WHEN sound THEN 'indexed' WHEN trim(text)='' THEN 'noChunks' ELSE 'corruptedInput' END AS status FROM f UNION ALL SELECT -1, concat(count(*) FILTER (sound), ' reused, ', count(*) FILTER (NOT sound), ' failed') FROM f""")
def m12_index_directory(spark, sf_dir):
    """A file for each benchmark item, every other one compressed; a stream indexes them, then a run over the folder finds what is unchanged."""
    path, root, items = folder(spark, "files"), folder(spark, "index"), fx.table(spark, sf_dir, "benchmark")
    put = lambda rest, **how: items.where(f"item_id % 2 = {rest}").select("item_id", F.col("text").alias("value")).write.mode("append").options(**how).partitionBy("item_id").text(path)
    put(0)
    put(1, compression="gzip")
    options = _gunzipped()
    incremental.index_files_stream(spark, path, root, folder(spark, "progress"), options).awaitTermination()
    again = incremental.index_directory(spark, path, root, options)
    tables = store.read_index(spark, root)
    item = F.regexp_extract("relative_path", r"item_id=(\d+)/", 1).cast("long").alias("item_id")
    found = tables["keys"].select(F.col("document_key").alias("relative_path"), F.lit("indexed").alias("status")).unionByName(tables["failures"].select("relative_path", F.col("failure_kind").alias("status")))
    return found.select(item, "status").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("item_id"), F.lit(f"{again['reused']} reused, {again['failed']} failed").alias("status")))


@registered(f"WITH {fx.CHUNKS} SELECT row_id, document_id, body FROM chunks WHERE row_id//5%2=0")
def m3_clear_index(spark, sf_dir):
    """The whole index, cleared, then written again with half of the documents."""
    rows, root = fx.chunks(spark, sf_dir).withColumn("dim", F.size("vec")), folder(spark, "index")
    store.write_index(spark, root, rows)
    store.clear_index(spark, root)
    left = store.read_index(spark, root)
    store.write_index(spark, root, rows.where("row_id div 5 % 2 = 0"))
    return store.read_index(spark, root)["chunks"].select("row_id", "document_id", "body").unionByName(left["chunks"].select("row_id", "document_id", "body"))


@registered(f"WITH {fx.CHUNKS} SELECT row_id, document_id, body FROM chunks UNION ALL SELECT -3, 'conflict', 'version 3'")
def s4_racing_writers(spark, sf_dir):
    """Two writers start from one version and write different buckets: both land. A third one, of buckets that have changed since, is told so."""
    rows, root = fx.chunks(spark, sf_dir).withColumn("bucket", store.bucket_of("document_id")), folder(spark, "index")
    base = store.write_tables(spark, root, None, {"chunks": (rows.where("bucket = 0"), [0])})
    low, high = range(1, store.BUCKETS // 2), range(store.BUCKETS // 2, store.BUCKETS)
    for part in (low, high):
        store.write_tables(spark, root, base, {"chunks": (rows.where(F.col("bucket").between(part[0], part[-1])), part)})
    try:
        told = store.write_tables(spark, root, base, {"chunks": (rows.limit(0), low)}).number
    except store.Conflict:
        told = "conflict"
    done = spark.range(1).select((-F.lit(store.current_version(spark, root)).cast("long")).alias("row_id"), F.lit(str(told)).alias("document_id"), F.lit(f"version {store.current_version(spark, root)}").alias("body"))
    return store.read_index(spark, root)["chunks"].select("row_id", "document_id", "body").unionByName(done)


@registered(f"WITH {fx.CHUNKS} SELECT row_id, relative_path FROM chunks WHERE starts_with(relative_path,'p1/')")
def m10_path_ranges(spark, sf_dir):
    """The chunks below one folder, from the files of the index whose paths meet it."""
    root = folder(spark, "index")
    store.write_index(spark, root, fx.chunks(spark, sf_dir).withColumn("dim", F.size("vec")))
    return store.read_below(spark, root, "p1").select("row_id", "relative_path")


@registered(f"WITH {fx.CHUNKS} SELECT row_id, document_id, body FROM chunks WHERE document_id IN ('d3','d17')")
def s4_index_source(spark, sf_dir):
    """Two documents through the data source of the index: it reads their buckets."""
    root = folder(spark, "index")
    store.write_index(spark, root, fx.chunks(spark, sf_dir).withColumn("dim", F.size("vec")))
    datasource.register(spark)
    return spark.read.format("quarry_index").load(root).where("document_id in ('d3', 'd17')").select("row_id", "document_id", "body")
