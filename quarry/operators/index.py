"""The chunk index: postings, replacement, generations, reuse, reports and filters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import han_bigrams, slashes

RECIPE = ("content_hash", "parser_name", "parser_version", "chunker_version")
IMAGE = "struct<format:string,width:int,height:int,colorMode:string,orientation:int>"


def build_postings(chunks: DataFrame, *also: str) -> DataFrame:
    """Distinct (term, chunk_rowid), and the columns `also`, of chunks (row_id, body) with a row for each row_id; terms are distinct in a row, so nothing is shuffled."""
    return chunks.select(F.explode(han_bigrams(F.coalesce("body", F.lit("")))).alias("term"), F.col("row_id").alias("chunk_rowid"), *also)


def replaced_documents(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids of the index that a batch replaces: its own, and older ones that share a document_key."""
    ids = batch.select("document_id").distinct()
    by_key = index.join(batch.select("document_key").distinct(), "document_key", "left_semi").select("document_id")
    return index.join(ids, "document_id", "left_semi").select("document_id").union(by_key).distinct()


def replace_documents(index: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the new index, one row with rows_written and documents_touched)."""
    victims = replaced_documents(index, batch)
    kept = index.join(victims, "document_id", "left_anti").select(*index.columns)
    touched = batch.select("document_id").union(victims).distinct()
    outcome = batch.agg(F.count("*").alias("rows_written")).crossJoin(touched.agg(F.count("*").alias("documents_touched")))
    return kept.unionByName(batch.select(*index.columns)), outcome


def delete_documents(ids: DataFrame, *tables: DataFrame, key: str = "document_id") -> list[DataFrame]:
    """The tables without the rows of ids."""
    return [t.join(ids.select(key).distinct(), key, "left_anti") for t in tables]


def delete_postings(postings: DataFrame, index: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings without those of chunks of the ids."""
    gone = index.join(ids.select("document_id").distinct(), "document_id", "left_semi").select(F.col("row_id").alias("chunk_rowid"))
    return postings.join(gone, "chunk_rowid", "left_anti").select(*postings.columns)


def clear_index(*tables: DataFrame) -> list[DataFrame]:
    return [t.limit(0) for t in tables]


def generations_from_batch(pairs: DataFrame) -> DataFrame:
    """One row per (document_id, model_id) with a full recipe; `conflict` where a group has several."""
    full = pairs
    for c in RECIPE:
        full = full.where(F.trim(F.coalesce(c, F.lit(""))) != "")
    recipe = F.struct(*RECIPE, F.col("dim").alias("vector_dim"))
    grouped = full.groupBy("document_id", "model_id").agg(F.min(recipe).alias("r"), F.max(recipe).alias("_hi"))
    return grouped.select("document_id", "model_id", "r.*", (F.col("r") != F.col("_hi")).alias("conflict"))


def upsert_generations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or overwrite on (document_id, model_id)."""
    keys = ["document_id", "model_id"]
    return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)


def _matches(prefix: str, chunker: Column, dim: int) -> Column:
    g = lambda c: F.col(f"{prefix}.{c}")
    same = (g("content_hash") == F.col("f.content_hash")) & (g("parser_name") == F.col("f.parser_name")) & (g("parser_version") == F.col("f.parser_version"))
    return F.coalesce(same & (g("chunker_version") == chunker) & (g("vector_dim") == dim), F.lit(False))


def plan_reuse(files: DataFrame, generations: DataFrame, text_model: str, image_model: str, chunker_version: str, text_dim: int = 384, image_dim: int = 512, force: bool = False) -> DataFrame:
    """files (document_id, content_hash, parser_name, parser_version, has_text, has_image) with action reuse or index."""
    f = files.alias("f")
    of = lambda model, name: generations.where(F.col("model_id") == model).alias(name)
    joined = f.join(of(text_model, "t"), F.col("f.document_id") == F.col("t.document_id"), "left").join(of(image_model, "i"), F.col("f.document_id") == F.col("i.document_id"), "left")
    named = F.lit(True)
    for c in RECIPE[:3]:
        named = named & (F.trim(F.coalesce(F.col(f"f.{c}"), F.lit(""))) != "")
    some = F.col("f.has_text") | F.col("f.has_image")
    text_ok = ~F.col("f.has_text") | _matches("t", F.lit(chunker_version), text_dim)
    image_ok = ~F.col("f.has_image") | _matches("i", F.lit("none"), image_dim)
    reuse = ~F.lit(force) & some & named & text_ok & image_ok
    return joined.select("f.*", F.when(reuse, "reuse").otherwise("index").alias("action"))


def index_report(outcomes: DataFrame) -> DataFrame:
    """One row from outcomes (outcome in written, reused, failed; chunks)."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return outcomes.agg(F.count("*").alias("documents"), n("written"), n("reused"), n("failed"), F.coalesce(F.sum(F.when(F.col("outcome") == "written", F.col("chunks"))), F.lit(0)).alias("chunks_written"))


def index_progress(outcomes: DataFrame, ranges: int = 256) -> DataFrame:
    """Running counts after each file of a run, by path. A run is counted in ranges of paths, shifted by the counts of the ranges before; their
    bounds are at most `ranges` paths, chosen by hash."""
    share = max(1, outcomes.count() // ranges)
    bounds = sorted(r[0] for r in outcomes.where(F.col("relative_path").isNotNull() & (F.pmod(F.xxhash64("relative_path"), F.lit(share)) == 0)).select("relative_path").distinct().orderBy(F.xxhash64("relative_path")).limit(ranges).collect())
    given = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<string>")
    flags = {"processed": F.lit(1), **{k: (F.col("outcome") == k).cast("int") for k in ("written", "reused", "failed")}}
    rows = outcomes.select("run_id", "relative_path", F.size(F.filter(given, lambda b: b <= F.coalesce("relative_path", F.lit("")))).alias("_range"), *[f.alias(k) for k, f in flags.items()])
    of = Window.partitionBy("run_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("run_id", "_range").agg(*[F.sum(k).alias(f"_{k}") for k in flags])
    before = sums.select(F.col("run_id").alias("_run"), F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_{k}").over(of), F.lit(0)).alias(f"_{k}") for k in flags])
    within = Window.partitionBy("run_id", "_range").orderBy("relative_path").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(before, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_range") == F.col("_at")))
    return joined.select("run_id", "relative_path", *[(F.col(f"_{k}") + F.sum(k).over(within)).alias(k) for k in flags])


def index_stats(index: DataFrame, postings: DataFrame) -> DataFrame:
    chunks = index.agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.count_if(F.col("space") == "documentText").alias("text_rows"), F.count_if(F.col("space") == "clipShared").alias("image_rows"))
    return chunks.crossJoin(postings.agg(F.count("*").alias("posting_rows")))


def document_chunks(index: DataFrame, ids: DataFrame) -> DataFrame:
    """All chunks of the documents, in reading order per document (`position`)."""
    by = Window.partitionBy("document_id").orderBy(F.asc_nulls_last("page_number"), "chunk_index", "start_offset", "row_id")
    return index.join(ids.select("document_id").distinct(), "document_id", "left_semi").withColumn("position", F.row_number().over(by))


def _utc(moment: str) -> Column:
    """The moment of an ISO date or time; without an offset it is taken as UTC, whatever the session's zone."""
    when = datetime.fromisoformat(moment)
    return F.timestamp_micros(F.lit(int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)))


def storage_filter(extensions: Iterable[str] | None = None, path_prefix: str | None = None, modified_after: str | None = None, modality: str | None = None) -> Column:
    """AND of the given conditions; an empty set of extensions passes nothing, None is no condition."""
    out = F.lit(True)
    if extensions is not None:
        wanted = [e.lower() for e in extensions]
        out = out & (F.lower("extension").isin(*wanted) if wanted else F.lit(False))
    if path_prefix:
        prefix, path = path_prefix.replace("\\", "/").rstrip("/"), slashes("relative_path")
        out = out & ((path == prefix) | path.startswith(prefix + "/"))
    if modified_after is not None:
        out = out & F.coalesce(F.col("modified_at") > _utc(modified_after), F.lit(False))
    if modality is not None:
        out = out & (F.col("modality") == modality)
    return out


def pack_image(df: DataFrame, asset: str = "image_asset") -> DataFrame:
    return df.withColumn("image_json", F.to_json(F.col(asset)))


def unpack_image(df: DataFrame) -> DataFrame:
    """Add image_asset; JSON without format, width and height stays as `image_raw`, a map."""
    parsed = F.from_json("image_json", IMAGE)
    sound = parsed["format"].isNotNull() & parsed["width"].isNotNull() & parsed["height"].isNotNull()
    return df.withColumn("image_asset", F.when(sound, parsed)).withColumn("image_raw", F.when(~F.coalesce(sound, F.lit(False)), F.from_json("image_json", "map<string,string>")))
