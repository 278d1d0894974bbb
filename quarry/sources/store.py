"""The persisted index: Parquet folders by bucket, behind numbered pointers, so readers never see half a document.

Rows of a document lie in the bucket of its id (chunks, postings, generations), rows of a path in the bucket of the path (keys, failures). A
writer puts the buckets it touches into a folder of its own and then commits a pointer, which names for every bucket of every table the
folder that holds it. Pointer n + 1 is created only if it is absent: of two writers one is later, takes up the other's
pointer and, if that left the buckets it has replaced as they were, adds its own buckets to it; else it gets a Conflict, and starts anew from what the
index holds now. No commit is lost, and none needs a lock.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import index

BY_DOCUMENT, BY_PATH = ("chunks", "postings", "generations"), ("keys", "failures")
TABLES = (*BY_DOCUMENT, *BY_PATH)
BUCKETS = 64
POINTERS_KEPT, FILE_ROWS = 32, 1_000_000
FAILURES = "relative_path string, failure_kind string, error_message string, content_hash string, modified_at timestamp"


class Conflict(RuntimeError):
    """Another writer has replaced buckets that this one read."""


@dataclass(frozen=True)
class Version:
    """What a pointer says: for each `table/bucket` the folder that holds it, of chunks also the files with their least and largest path, the tables' schemas, the report of
    the run, and the last batch of each stream."""

    number: int = 0
    buckets: int = BUCKETS
    held: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    report: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    files: dict[str, list[list[str]]] = field(default_factory=dict)


def bucket_of(key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _filesystem(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the pointers that are kept, newest first; at most POINTERS_KEPT and those of writers at work."""
    return sorted((int(n.removesuffix(".json")) for n in _names(spark, f"{root}/current") if n.endswith(".json") and n[0] != "."), reverse=True)


def _pointer(root: str, number: int) -> str:
    return f"{root}/current/{number:020d}.json"


def version(spark: SparkSession, root: str, number: int) -> Version:
    fs, path = _filesystem(spark, _pointer(root, number))
    stream = fs.open(path)
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> Version | None:
    """The newest version; None before the first."""
    found = _pointers(spark, root)
    return version(spark, root, found[0]) if found else None


def current_version(spark: SparkSession, root: str) -> int | None:
    found = _pointers(spark, root)
    return found[0] if found else None


def _link_if_absent(spark: SparkSession, made, target) -> None:
    """On a local disk, where a rename replaces what is there: a hard link is created only if its name is free."""
    file = spark._jvm.java.io.File
    spark._jvm.java.nio.file.Files.createLink(file(target.toUri().getPath()).toPath(), file(made.toUri().getPath()).toPath())


def _rename_if_absent(spark: SparkSession, made, target) -> None:
    options = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    none = spark._jvm.java.lang.reflect.Array.newInstance(options, 1)
    spark._jvm.java.lang.reflect.Array.set(none, 0, options.getEnumConstants()[0])  # NONE: fail if the target exists
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(made, target, none)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with the text, whole or not at all; False if it is there already."""
    fs, target = _filesystem(spark, path)
    made = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(made)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        (_link_if_absent if fs.getScheme() == "file" else _rename_if_absent)(spark, made, target)
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(made, False)


def commit(spark: SparkSession, root: str, base: Version | None, replaced: set[str], new: dict[str, str], schemas: dict[str, str], report: dict[str, int] | None = None, batches: dict[str, int] | None = None, files: dict[str, list[list[str]]] | None = None) -> Version:
    """Commit the folders of `new`, which take the place of the buckets `replaced` of base; later commits that left these alone are kept, others are a Conflict."""
    base = base or Version()
    while True:
        now = latest(spark, root) or Version()
        if any(now.held.get(k) != base.held.get(k) for k in replaced):
            raise Conflict(f"buckets changed between versions {base.number} and {now.number}")
        held = {k: v for k, v in now.held.items() if k not in replaced} | new
        made = Version(now.number + 1, now.buckets, held, now.schemas | schemas, report or {}, now.batches | (batches or {}), {k: f for k, f in now.files.items() if k not in replaced} | (files or {}))
        if put_if_absent(spark, _pointer(root, made.number), json.dumps(asdict(made))):
            for number in _pointers(spark, root)[POINTERS_KEPT:]:
                fs, path = _filesystem(spark, _pointer(root, number))
                fs.delete(path, False)
            return made


def write_tables(spark: SparkSession, root: str, base: Version | None, tables: dict[str, tuple[DataFrame, Iterable[int] | None]], report: dict[str, int] | None = None, batches: dict[str, int] | None = None) -> Version:
    """Write buckets of tables and commit them. Each table has a `bucket` column and comes with the numbers of the buckets that are written anew, with all
    their rows; None: all buckets. Within a bucket rows are in order of path, in files of at most FILE_ROWS, whose ranges of paths the pointer keeps."""
    mine = uuid.uuid4().hex
    replaced, new, schemas, ranges = set(), {}, {}, {}
    for name, (df, touched) in tables.items():
        touched = set(range(BUCKETS) if touched is None else touched)
        if not touched:
            continue
        replaced |= {f"{name}/{b}" for b in touched}
        schemas[name] = df.drop("bucket").schema.json()
        path = f"{root}/data/{mine}/{name}"
        order = [c for c in ("relative_path", "document_key") if c in df.columns][:1]
        df.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(path)
        new |= {f"{name}/{n.removeprefix('bucket=')}": mine for n in _names(spark, path) if n.startswith("bucket=")}
        if name == "chunks" and "relative_path" in df.columns:
            ranges = _path_ranges(spark, path)
    return commit(spark, root, base, replaced, new, schemas, report, batches, ranges)


def _path_ranges(spark: SparkSession, path: str) -> dict[str, list[list[str]]]:
    """Of each bucket of chunks its files (name, least path, largest path): one row for each file that was written."""
    if not _names(spark, path):
        return {}
    rows = spark.read.schema("relative_path string, bucket int").parquet(path).groupBy("bucket", F.col("_metadata.file_name").alias("file")).agg(F.min("relative_path").alias("low"), F.max("relative_path").alias("high"))
    found: dict[str, list[list[str]]] = {}
    for r in rows.collect():
        found.setdefault(f"chunks/{r['bucket']}", []).append([r["file"], r["low"], r["high"]])
    return found


def write_index(spark: SparkSession, root: str, chunks: DataFrame, generations: DataFrame | None = None) -> Version:
    """Write chunks (document_id, document_key, row_id, body, ..) as a whole new index, with the tables that follow from them."""
    if generations is None:
        generations = index.generations_from_batch(chunks).where("not conflict").drop("conflict")
    rows = chunks.withColumn("bucket", bucket_of("document_id"))
    keys = chunks.select("document_key", "document_id").distinct().withColumn("bucket", bucket_of("document_key"))
    failures = spark.createDataFrame([], FAILURES).withColumn("bucket", F.lit(0))
    return write_tables(spark, root, latest(spark, root), {"chunks": (rows, None), "postings": (index.build_postings(rows, "bucket"), None), "generations": (generations.withColumn("bucket", bucket_of("document_id")), None), "keys": (keys, None), "failures": (failures, None)})


def read_tables(spark: SparkSession, root: str, of: Version, wanted: dict[str, Iterable[int] | None]) -> dict[str, DataFrame]:
    """Tables of a version, of each the buckets wanted; None: all."""
    tables = {}
    for name, buckets in wanted.items():
        only = None if buckets is None else set(buckets)
        paths = [f"{root}/data/{folder}/{name}/bucket={k.split('/')[1]}" for k, folder in sorted(of.held.items()) if k.startswith(f"{name}/") and (only is None or int(k.split("/")[1]) in only)]
        schema = StructType.fromJson(json.loads(of.schemas[name])) if name in of.schemas else FAILURES if name == "failures" else StructType()
        tables[name] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return tables


def read_index(spark: SparkSession, root: str, buckets: list[int] | None = None) -> dict[str, DataFrame] | None:
    """The tables of the newest version, or some buckets of those kept by document; None before the first."""
    now = latest(spark, root)
    return now and read_tables(spark, root, now, {name: buckets if name in BY_DOCUMENT else None for name in TABLES})


def read_documents(spark: SparkSession, root: str, document_ids: list[str]) -> DataFrame:
    """The chunks of some documents, from the buckets of these alone."""
    ids = spark.createDataFrame([(i,) for i in document_ids], "document_id string")
    now = latest(spark, root) or Version()
    return read_tables(spark, root, now, {"chunks": buckets_in(ids, "document_id")})["chunks"].join(F.broadcast(ids), "document_id", "left_semi")


def read_below(spark: SparkSession, root: str, path_prefix: str) -> DataFrame:
    """The chunks whose path is path_prefix or lies below it, from the files whose range of paths meets it."""
    now, prefix = latest(spark, root) or Version(), path_prefix.replace("\\", "/").rstrip("/")
    first, beyond = prefix, prefix + "0"  # the character after the slash
    paths = []
    for key, folder in sorted(now.held.items()):
        name, bucket = key.split("/")
        if name == "chunks":
            place = f"{root}/data/{folder}/{name}/bucket={bucket}"
            of = now.files.get(key)
            paths += [place] if of is None else [f"{place}/{file}" for file, low, high in of if low is None or high >= first and low < beyond]
    schema = StructType.fromJson(json.loads(now.schemas["chunks"])) if "chunks" in now.schemas else StructType()
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.where(index.storage_filter(path_prefix=path_prefix)) if schema.names else rows


def buckets_in(rows: DataFrame, key: str) -> list[int]:
    """The buckets of a column's values: at most BUCKETS numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(key)).distinct().collect())


def clear_index(spark: SparkSession, root: str) -> Version | None:
    """A version without rows: the schemas stay, `vacuum` frees the folders. None where there is no index."""
    now = latest(spark, root)
    return now and commit(spark, root, now, set(now.held), {}, {})


def vacuum(spark: SparkSession, root: str, keep: int = 2, min_age_s: float = 86_400) -> int:
    """Delete the bucket folders that none of the last `keep` versions holds and that are older than min_age_s, as a writer at work may still commit
    younger ones; returns their number."""
    used = {(folder, k) for number in _pointers(spark, root)[:keep] for k, folder in version(spark, root, number).held.items()}
    gone, before = 0, (time.time() - min_age_s) * 1000
    for mine in _names(spark, f"{root}/data"):
        for name in _names(spark, f"{root}/data/{mine}"):
            fs, folder = _filesystem(spark, f"{root}/data/{mine}/{name}")
            for status in fs.listStatus(folder):
                bucket = status.getPath().getName().removeprefix("bucket=")
                if status.isDirectory() and (mine, f"{name}/{bucket}") not in used and status.getModificationTime() <= before:
                    gone += bool(fs.delete(status.getPath(), True))
    return gone
