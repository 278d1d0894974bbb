"""Files to documents: metadata, decoding, duplicate content, outcomes and reports."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dotted_extension, is_blank, slashes, trim_spaces, utf16_length

# Media types by extension, outcome by failure kind.
MIME = {".txt": "text/plain", ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png"}
SKIPPED_KINDS = ("unsupportedFormat", "permissionDenied", "cancelled")
FAILED_KINDS = ("corruptedInput", "dependencyUnavailable", "timeout", "unknown")
HASH_LIMIT = 10 * 1024 * 1024


def describe_files(files: DataFrame, max_bytes: int = HASH_LIMIT) -> DataFrame:
    """Add names, type, content hash (null above max_bytes) and id to files (relative_path, size_bytes, content)."""
    path = slashes("relative_path")
    extension = dotted_extension(F.element_at(F.split(path, "/"), -1))
    mime = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    out = files.withColumn("relative_path", path).withColumn("file_name", F.element_at(F.split(path, "/"), -1)).withColumn("extension", extension).withColumn("mime_type", F.try_element_at(mime, extension))
    digest = F.when(F.col("size_bytes") <= max_bytes, F.sha2("content", 256))
    return out.withColumn("content_hash", digest).withColumn("id", F.coalesce("content_hash", F.sha2("relative_path", 256)))


def _replaced(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement for what maps to nothing: two bytes where a lead byte 0x81-0xFE has one after it, else one."""
    pair = 0x81 <= error.object[error.start] <= 0xFE and error.start + 1 < len(error.object)
    return "\ufffd", error.start + 1 + pair


codecs.register_error("gbk-pairs", _replaced)


def _gbk(data: bytes) -> str:
    return data.decode("gbk", "gbk-pairs")


@F.pandas_udf(T.StringType())
def decode_gbk(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else _gbk(bytes(x)))


def decode_text(files: DataFrame, max_bytes: int = HASH_LIMIT) -> DataFrame:
    """Add body, warnings and outcome to files with content: byte-order marks, then strict UTF-8, then GBK; cut at max_bytes."""
    cut = F.octet_length("content") > max_bytes
    raw = F.when(cut, F.substring("content", 1, max_bytes)).otherwise(F.col("content"))
    out = files.withColumn("_raw", raw).withColumn("_cut", cut)
    head = lambda n: F.hex(F.substring("_raw", 1, n))
    utf16 = lambda skip: F.substring("_raw", skip + 1, 1 << 30)
    even = lambda b: F.expr(f"substring({b}, 1, octet_length({b}) - octet_length({b}) % 2)")
    kind = F.when(head(3) == "EFBBBF", "bom8").when(head(2) == "FFFE", "le").when(head(2) == "FEFF", "be").when(F.is_valid_utf8(F.col("_raw")), "utf8")
    trimmed = F.lit(None).cast("binary")
    for back in (3, 2, 1):  # a cut inside a sequence of up to four bytes
        shorter = F.expr(f"substring(_raw, 1, octet_length(_raw) - {back})")
        trimmed = F.when(F.is_valid_utf8(shorter), shorter).otherwise(trimmed)
    out = out.withColumn("_kind", kind).withColumn("_fit", F.when(F.col("_cut") & F.col("_kind").isNull(), trimmed))
    out = out.withColumn("_kind", F.coalesce("_kind", F.when(F.col("_fit").isNotNull(), "fit").otherwise("gbk"))).withColumn("_tail", F.when(F.col("_kind").isin("le", "be"), utf16(2)))
    text = (
        F.when(F.col("_kind") == "bom8", F.try_validate_utf8(F.substring("_raw", 4, 1 << 30).cast("string")))
        .when(F.col("_kind") == "le", F.decode(even("_tail"), "UTF-16LE"))
        .when(F.col("_kind") == "be", F.decode(even("_tail"), "UTF-16BE"))
        .when(F.col("_kind") == "utf8", F.col("_raw").cast("string"))
        .when(F.col("_kind") == "fit", F.col("_fit").cast("string"))
        .otherwise(decode_gbk(F.when(F.col("_kind") == "gbk", F.col("_raw"))))
    )
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    warnings = F.array_compact(F.array(F.when(F.col("_kind") == "gbk", "encoding-fallback:gbk"), F.when(F.col("_cut"), F.concat(F.lit("truncated:"), F.lit(max_bytes).cast("string")))))
    return out.withColumn("body", body).withColumn("warnings", warnings).withColumn("outcome", F.when(F.col("_cut"), "partial").otherwise("ok")).drop("_raw", "_cut", "_kind", "_fit", "_tail")


def dispatch_parser(metadata: DataFrame, registry: DataFrame) -> DataFrame:
    """Add parser_name and parser_version by extension (the least `position` of registry wins); none: failure unsupportedFormat."""
    first = registry.groupBy("extension").agg(F.min_by(F.struct("parser_name", "parser_version"), "position").alias("p")).select("extension", "p.*")
    joined = metadata.join(F.broadcast(first), "extension", "left")
    return joined.withColumn("failure_kind", F.when(F.col("parser_name").isNull(), "unsupportedFormat"))


def mark_duplicate_content(metadata: DataFrame) -> DataFrame:
    """Per content hash the first file by path stays; the others are skipped and name it. Pre-aggregated: no window over a hot hash."""
    first = metadata.where("content_hash is not null").groupBy("content_hash").agg(F.min("relative_path").alias("first_path"))
    joined = metadata.join(first, "content_hash", "left")
    duplicate = F.col("first_path") != F.col("relative_path")
    return joined.withColumn("is_duplicate", F.coalesce(duplicate, F.lit(False))).withColumn("error_message", F.when(duplicate, F.concat(F.lit("Duplicate content of "), "first_path", F.lit(".")))).drop("first_path")


def outcome_of(kind: Column, outcome: Column) -> Column:
    return F.when(kind.isin(*SKIPPED_KINDS), "skipped").when(kind.isNotNull(), "failed").otherwise(F.coalesce(outcome, F.lit("ok")))


def classify_outcome(ingest: DataFrame) -> DataFrame:
    """Add status from failure_kind and outcome, and whether the row can be indexed."""
    status = outcome_of(F.col("failure_kind"), F.col("outcome"))
    return ingest.withColumn("status", status).withColumn("indexable", status.isin("ok", "partial"))


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "skipped", "failed")]]


def ingestion_report(ingest: DataFrame) -> DataFrame:
    """One row: counts by status, and whether the run is clean."""
    return ingest.agg(*_counts()).withColumn("is_clean", F.col("failed") == 0)


def observed_ingest(ingest: DataFrame, report: Observation) -> DataFrame:
    """The same rows; once they are written, report.get has the counts of ingestion_report. They come with the write: no second pass."""
    return ingest.observe(report, *_counts())


@F.pandas_udf(T.StringType())
def decode_references(text: pd.Series) -> pd.Series:
    """Character references: the five named ones, nbsp, decimal and hexadecimal."""
    import re

    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

    def one(m):
        name = m.group(1)
        if name[0] != "#":
            return named.get(name, m.group(0))
        try:
            return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
        except (ValueError, OverflowError):
            return m.group(0)

    pattern = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-z]+);")
    return text.map(lambda x: None if x is None else pattern.sub(one, x))


def split_xhtml_pages(docs: DataFrame, html: str) -> DataFrame:
    """One row (page_number, text) per `<div class="...page...">`, its text up to the next; without any the whole is one page."""
    mark = r"(?i)<div\b[^>]*?\bclass\s*=\s*[\"'](?:[^\"']*\s)?page(?:\s[^\"']*)?[\"'][^>]*>"
    parts = F.split(F.coalesce(F.col(html), F.lit("")), mark, -1)
    pages = F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    rows = docs.select("*", F.posexplode(pages).alias("_n", "_part"))
    plain = F.regexp_replace(F.regexp_replace("_part", r"(?i)<br\s*/?>|</p\s*>", "\n"), r"<[^>]*>", "")
    text = trim_spaces(F.regexp_replace(decode_references(plain), "\r\n?", "\n"))
    return rows.withColumn("page_number", F.col("_n") + 1).withColumn("text", text).drop("_n", "_part")


def document_stats(documents: DataFrame) -> DataFrame:
    """Add has_text, page_count, is_image_only and char_count (UTF-16) to documents (text, pages, image_asset flag has_image)."""
    has_text = ~is_blank("text")
    pages = F.when(F.size("pages") > 0, F.size("pages")).when(has_text, 1).otherwise(0)
    return documents.withColumn("has_text", has_text).withColumn("page_count", pages).withColumn("is_image_only", F.col("has_image") & ~has_text).withColumn("char_count", utf16_length(F.coalesce("text", F.lit(""))))


def library_run_rollup(ingest: DataFrame, index_outcomes: DataFrame, cancelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(file rows with their final status and warning, one row with the run's label)."""
    queued = F.when(F.col("indexable"), "queued").when((F.col("status") == "failed") | (F.col("failure_kind") == "permissionDenied"), "failed").otherwise("skipped")
    joined = ingest.join(index_outcomes.select("relative_path", F.col("outcome").alias("index_outcome")), "relative_path", "left")
    settled = F.when((queued == "queued") & F.col("index_outcome").isNotNull(), F.col("index_outcome")).when((queued == "queued") & F.lit(cancelled), "cancelled").otherwise(queued)
    files = joined.select("relative_path", settled.alias("status"), (F.col("status") == "partial").alias("warning"))
    n = lambda c: F.count_if(c)
    counts = files.agg(n(F.col("status").isin("indexed", "reused")).alias("usable"), n(F.col("status") == "failed").alias("failed"), n(F.col("warning")).alias("warnings"), n(F.col("status").isin("indexed", "reused", "queued")).alias("indexable"))
    label = F.when(F.lit(cancelled), "cancelled").when((F.col("failed") > 0) & (F.col("usable") > 0), "partial-fail").when(F.col("failed") > 0, "failed").when(F.col("warnings") > 0, "warnings").when(F.col("indexable") == 0, "nothing indexable").otherwise("done")
    return files, counts.withColumn("label", label)


def latest_run_per_root(runs: DataFrame) -> DataFrame:
    newest = Window.partitionBy("root").orderBy(F.desc("finished_at"))
    return runs.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


