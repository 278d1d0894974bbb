"""Incremental indexing of files, in batches and streams, whose state is the index itself.

A file goes through scan, decoding or a parser, chunking and, where a function for it is given, vectors. Whatever fails is a row: a file that cannot be read, parsed, cut or embedded
leaves what the index holds of it as it is, is listed in the index's table `failures`, and stops no other. That table, the reports and the rows are
one commit. A batch reads the buckets of its paths and documents only, however large the index: the table `keys` names the
document of a path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import is_blank
from ..operators import chunking, index, ingest
from ..sources import files as sources
from ..sources import store

INCOMING = "relative_path string, text string, content_hash string, parser_name string, parser_version string, modified_at timestamp"
MODEL = "text-chunks"
ATTEMPTS = 20
READ_LIMIT = 1 << 30
OUTCOMES = "relative_path string, outcome string, chunks long, error_message string"
ROWS = ["row_id", "document_id", "chunk_id", "space", "relative_path", "document_key", "file_name", "extension", "page_number", "chunk_index", "start_offset", "end_offset", "body", "modality", "modified_at", "content_hash", "parser_name", "parser_version", "chunker_version", "model_id"]


@dataclass(frozen=True)
class Parser:
    """A format: what its files' bytes say, as text; it raises where it cannot tell."""

    name: str
    version: str
    parse: Callable[[bytes], str]


@dataclass(frozen=True)
class Options:
    """How files become rows. embed takes rows (row_id, body, ..) and adds `vec`, an array of floats, null where it fails; dim is its length."""

    parsers: Mapping[str, Parser] | None = None
    counter: Callable[[str], int] = chunking.count_chars
    embed: Callable[[DataFrame], DataFrame] | None = None
    dim: int = 0
    model: str = MODEL
    force: bool = False


DEFAULT = Options()
PLAIN = (".txt", ".md")


def parsed_files(files: DataFrame, parsers: Mapping[str, Parser] | None = None) -> DataFrame:
    """INCOMING, failure_kind and error_message of files (relative_path, size_bytes, modified_at, content): text is decoded, other formats go to the parser of their extension,
    and what has none is unsupported. A file without content could not be read."""
    parsers = dict(parsers or {})
    described = ingest.describe_files(files)
    names = {e: (p.name, p.version) for e, p in parsers.items()} | {e: ("plain", "1") for e in PLAIN if e not in parsers}
    of = lambda i: F.coalesce(*[F.when(F.col("extension") == e, F.lit(n[i])) for e, n in names.items()])
    named = ingest.decode_text(described).withColumn("parser_name", of(0)).withColumn("parser_version", of(1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for extension, content in zip(batch["extension"], batch["content"], strict=True):
                try:
                    said.append((parsers[extension].parse(bytes(content)), None))
                except Exception as error:  # a parser may fail in any way; the file's row says how
                    said.append((None, f"{type(error).__name__}: {error}"))
            batch = batch.drop(columns=["content", "extension"])
            batch["text"], batch["error_message"] = [s[0] for s in said], [s[1] for s in said]
            yield batch

    meta = ["relative_path", "content_hash", "parser_name", "parser_version", "modified_at"]
    kind = F.when(F.col("content").isNull(), "unknown").when(F.col("parser_name").isNull(), "unsupportedFormat")
    message = F.when(F.col("content").isNull(), "The file cannot be read.").when(F.col("parser_name").isNull(), F.concat(F.lit("No parser for "), "extension", F.lit(".")))
    own = F.col("extension").isin(*parsers) & F.col("content").isNotNull() if parsers else F.lit(False)
    plain = named.where(~own).select(*meta, F.when(kind.isNull(), F.col("body")).alias("text"), kind.alias("failure_kind"), message.alias("error_message"))
    if not parsers:
        return plain
    schema = f"{', '.join(f'{c} timestamp' if c == 'modified_at' else f'{c} string' for c in meta)}, text string, error_message string"
    told = named.where(own).select(*meta, "extension", "content").mapInPandas(run, schema)
    return plain.unionByName(told.withColumn("failure_kind", F.when(F.col("error_message").isNotNull(), "corruptedInput")))


def latest_files(files: DataFrame) -> DataFrame:
    """The last version of each path (by modified_at, then hash), with document_id and whether it repeats the content of an earlier path of the batch."""
    for name in ("failure_kind", "error_message"):
        files = files if name in files.columns else files.withColumn(name, F.lit(None).cast("string"))
    names = [*[c.split()[0] for c in INCOMING.split(", ")][1:], "failure_kind", "error_message"]
    last = files.groupBy("relative_path").agg(F.max_by(F.struct(*names), F.struct("modified_at", F.col("failure_kind").isNull(), "content_hash")).alias("f")).select("relative_path", "f.*")
    sound = ingest.mark_duplicate_content(last.where("failure_kind is null").drop("error_message"))
    failed = last.where("failure_kind is not null").withColumn("is_duplicate", F.lit(False))
    return sound.unionByName(failed).withColumn("document_id", F.coalesce("content_hash", F.sha2("relative_path", 256)))


def chunk_rows(files: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Index rows of files (document_id, relative_path, text, content_hash, parser_name, parser_version, modified_at), and one row with `failure` for each that has none or some that fail;
    document_id is unique."""
    pages = files.select("document_id", F.lit(0).alias("ordinal"), F.lit(None).cast("int").alias("page_number"), "text")
    cut = chunking.chunk_pages(pages, counter=options.counter)
    named = chunking.with_chunk_ids(chunking.with_chunk_index(cut.where("failure is null")).withColumn("position", F.col("chunk_index")))
    meta = files.select("document_id", "relative_path", "content_hash", "parser_name", "parser_version", "modified_at")
    name = F.element_at(F.split("relative_path", "/"), -1)
    added = {"row_id": F.xxhash64("document_id", "chunk_id"), "space": F.lit("documentText"), "document_key": F.col("relative_path"), "file_name": name, "extension": F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)), "body": F.col("text"), "modality": F.lit("text")}
    added |= {"chunker_version": F.lit(chunking.chunker_version()), "model_id": F.lit(options.model)}
    rows = named.join(meta, "document_id").withColumns(added).select(*ROWS)
    if options.embed is None:
        rows = rows.withColumn("dim", F.lit(0)).withColumn("failure", F.lit(None).cast("string"))
    else:
        sound = (F.size("vec") == options.dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
        rows = options.embed(rows).select(*ROWS, "vec", F.lit(options.dim).alias("dim"), F.when(~F.coalesce(sound, F.lit(False)), "badOutput").alias("failure"))
    failed = cut.where("failure is not null").select("document_id", "failure")
    empty = files.where(is_blank("text")).select("document_id", F.lit("noChunks").alias("failure"))
    return rows.unionByName(failed.unionByName(empty), allowMissingColumns=True)


def outcomes_of(latest: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """OUTCOMES: one row for each path of the batch. asked are its sound files with their `action`, chunks the rows of those to index."""
    told = chunks.groupBy("document_id").agg(F.min("failure").alias("failure"), F.count("row_id").alias("chunks"))
    done = asked.join(told, "document_id", "left")
    outcome = F.when(F.col("action") == "reuse", "reused").when(F.col("failure").isNotNull() | F.col("chunks").isNull(), "failed").otherwise("written")
    sound = done.select("relative_path", outcome.alias("outcome"), F.when(outcome == "written", F.col("chunks")).alias("chunks"), F.when(outcome == "failed", F.coalesce("failure", F.lit("noChunks"))).alias("error_message"), F.when(outcome == "failed", F.coalesce("failure", F.lit("noChunks"))).alias("failure_kind"))
    status = ingest.outcome_of(F.col("failure_kind"), F.lit(None))
    rest = latest.where("is_duplicate or failure_kind is not null").select("relative_path", F.when(F.col("is_duplicate"), "skipped").otherwise(status).alias("outcome"), F.lit(None).cast("long").alias("chunks"), "error_message", "failure_kind")
    return sound.unionByName(rest)


def apply_batch(spark: SparkSession, files: DataFrame, index_dir: str, options: Options = DEFAULT, stream: tuple[str, int] | None = None) -> dict[str, int]:
    """One batch of files (INCOMING; failure_kind and error_message of those that could not be parsed): reuse what is unchanged, chunk the rest, replace it in the buckets it touches. Returns
    the report. Running it twice changes nothing; a batch of a stream (its name and number) that is committed already is left out. Where another writer
    was first in the same buckets, the batch is worked out anew.

    A file of the same content as an earlier path of the batch, or as a document of the index, is not indexed again; what its path held before goes.
    """
    for attempt in range(ATTEMPTS):
        base = store.latest(spark, index_dir)
        if stream and base and base.batches.get(stream[0], -1) >= stream[1]:
            return base.report
        try:
            return _applied(spark, files, index_dir, base or store.Version(), options, stream)
        except store.Conflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError


def _applied(spark: SparkSession, files: DataFrame, index_dir: str, base: store.Version, options: Options, stream: tuple[str, int] | None) -> dict[str, int]:
    held = []

    def kept(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    read = lambda **wanted: store.read_tables(spark, index_dir, base, wanted)
    try:
        latest = kept(latest_files(files))
        paths = store.buckets_in(latest, "relative_path")
        if not paths:
            return {}
        asked = latest.where("not is_duplicate and failure_kind is null").withColumn("has_text", ~is_blank("text")).withColumn("has_image", F.lit(False))
        if "generations" in base.schemas:
            known = read(generations=store.buckets_in(asked, "document_id"))["generations"]
            asked = index.plan_reuse(asked, known, options.model, options.model, chunking.chunker_version(), text_dim=options.dim, force=options.force)
        else:
            asked = asked.withColumn("action", F.lit("index"))
        if "keys" in base.schemas:
            # A document that the path it was indexed under leaves is indexed anew if another path of the batch still has its content.
            now = latest.select(F.col("relative_path").alias("document_key"), F.col("document_id").alias("_now"))
            left = read(keys=paths)["keys"].join(now, "document_key").where("document_id <> _now").select("document_id").distinct().withColumn("_left", F.lit(True))
            asked = asked.join(left, "document_id", "left").withColumn("action", F.when(F.col("_left"), "index").otherwise(F.col("action"))).drop("_left")
        asked = kept(asked)
        chunks = kept(chunk_rows(asked.where("action = 'index'"), options))
        outcomes = kept(outcomes_of(latest, asked, chunks))
        report = index.index_report(outcomes.where("outcome <> 'skipped'")).first().asDict()
        bad = chunks.where("failure is not null").select("document_id").distinct()
        batch = kept(chunks.where("failure is null").drop("failure").join(bad, "document_id", "left_anti").withColumn("bucket", store.bucket_of("document_id")))

        # What a path held before goes, also where it now repeats another document; what a failed file held stays.
        gone = batch.select("document_id").distinct()
        if "keys" in base.schemas:
            now = latest.join(outcomes.where("outcome <> 'failed' and (failure_kind is null)").select("relative_path"), "relative_path").select(F.col("relative_path").alias("document_key"), F.col("document_id").alias("_now"))
            gone = gone.union(read(keys=paths)["keys"].join(now, "document_key").where("document_id <> _now").select("document_id")).distinct()
        gone = kept(gone)
        touched = store.buckets_in(gone, "document_id")
        tables = {}
        if touched:
            new = {"chunks": batch.select(*[c for c in batch.columns if c != "bucket"]), "generations": index.generations_from_batch(batch).where("not conflict").drop("conflict"), "keys": batch.select("document_key", "document_id").distinct()}
            moved = kept(new["keys"])
            if "chunks" in base.schemas:
                old = read(chunks=touched, generations=touched)
                moved = kept(new["keys"].union(old["chunks"].join(gone, "document_id", "left_semi").select("document_key", "document_id")).distinct())
                old |= read(keys=store.buckets_in(moved, "document_key"))
                new = {name: df.join(gone, "document_id", "left_anti").unionByName(new[name], allowMissingColumns=True) for name, df in old.items()}
            rows = new["chunks"].withColumn("bucket", store.bucket_of("document_id"))
            tables = {"chunks": (rows, touched), "postings": (index.build_postings(rows, "bucket"), touched), "generations": (new["generations"].withColumn("bucket", store.bucket_of("document_id")), touched)}
            tables["keys"] = (new["keys"].withColumn("bucket", store.bucket_of("document_key")), store.buckets_in(moved, "document_key"))

        fields = [c.split()[0] for c in store.FAILURES.split(", ")]
        failing = kept(latest.drop("failure_kind", "error_message").join(outcomes.where("outcome = 'failed'").select("relative_path", "failure_kind", "error_message"), "relative_path").select(*fields))
        before = read(failures=paths)["failures"] if "failures" in base.schemas else spark.createDataFrame([], store.FAILURES)
        ours = before.join(latest.select("relative_path"), "relative_path", "left_semi").select(*fields)
        differ = store.buckets_in(failing.exceptAll(ours).unionByName(ours.exceptAll(failing)), "relative_path")
        if differ:
            rows = before.join(latest.select("relative_path"), "relative_path", "left_anti").select(*fields).unionByName(failing).withColumn("bucket", store.bucket_of("relative_path"))
            tables["failures"] = (rows.where(F.col("bucket").isin(*differ)), differ)
        if any(buckets for _, buckets in tables.values()):
            store.write_tables(spark, index_dir, base, tables, report, dict([stream]) if stream else None)
        return report
    finally:
        for df in held:
            df.unpersist()


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...], streaming: bool = False, max_depth: int = 32) -> DataFrame:
    """(relative_path, size_bytes, modified_at, content) of the files below root, in a batch or as a stream: each once with its content, and once without, which is what is left of
    a file that is too large to read or cannot be read."""
    reader = spark.readStream if streaming else spark.read
    found = reader.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if streaming:
        found = found.schema("path string, modificationTime timestamp, length long, content binary")
    found = found.load(root)
    columns = ["relative_path", "size_bytes", "modified_at"]
    whole = sources.admitted(found.where(F.col("length") <= READ_LIMIT), root, extensions, max_depth).select(*columns, "content")
    listed = sources.admitted(found, root, extensions, max_depth, with_content=False).select(*columns, F.lit(None).cast("binary").alias("content"))
    return whole.unionByName(listed)


def _extensions(options: Options) -> tuple[str, ...]:
    return (*PLAIN, *(options.parsers or {}))


def index_directory(spark: SparkSession, root: str, index_dir: str, options: Options = DEFAULT, extensions: tuple[str, ...] | None = None) -> dict[str, int]:
    """Index the files below root in one job and return the report; files that have not changed since are reused."""
    found = read_files(spark, root, extensions or _extensions(options))
    return apply_batch(spark, parsed_files(found, options.parsers), index_dir, options)


def index_files_stream(spark: SparkSession, root: str, index_dir: str, checkpoint: str, options: Options = DEFAULT, extensions: tuple[str, ...] | None = None) -> StreamingQuery:
    """Index files as they arrive below root; stops when all that is there has been taken."""
    found = read_files(spark, root, extensions or _extensions(options), streaming=True)
    return _started(spark, found, index_dir, checkpoint, options, lambda df: parsed_files(df, options.parsers))


def incremental_index_stream(spark: SparkSession, in_dir: str, index_dir: str, checkpoint: str, options: Options = DEFAULT) -> StreamingQuery:
    """Index parsed files as they arrive in in_dir (Parquet, INCOMING); stops when all that is there has been taken."""
    return _started(spark, spark.readStream.schema(INCOMING).parquet(in_dir), index_dir, checkpoint, options, lambda df: df)


def _started(spark: SparkSession, stream: DataFrame, index_dir: str, checkpoint: str, options: Options, parsed: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    def take(df: DataFrame, number: int) -> None:
        apply_batch(spark, parsed(df), index_dir, options, (checkpoint, number))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
