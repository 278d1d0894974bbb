"""JSON-lines readers and writers with fixed schemas; rejected rows keep their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "id string, family string, question string, relevantDocumentId string, relevantDocumentIds array<string>, evidenceLocation string, evidenceLocations array<string>, evidenceText string, referenceAnswer string, answerable boolean, crossPage boolean, crossChunk boolean, modality string, lexOverlap double, goldChunkIndex int, goldChars int, sourceFile string, sectionHeading string, split string, chunkIndexes array<int>, parserExtractedText boolean, negativeSource string, headingTemplate string"
HIT = "struct<rank:int,documentKey:string,relativePath:string,fileName:string,pageNumber:int,chunkIndex:int,startOffset:int,endOffset:int,score:double,channels:array<string>,modality:string,snippet:string>"
PROBE = f"id string, split string, arm string, question string, encodeMs int, storeMs int, fuseMs int, hits array<{HIT}>"
PAIRS = "question string, answers array<string>"
CAPTIONS = "file_name string, caption string"


def _read(spark: SparkSession, path: str, schema: str, needed: Column, kind: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", schema).alias("r"))
    good = F.coalesce(needed, F.lit(False))
    return lines.where(good).select("r.*"), lines.where(~good).select("value", F.lit(kind).alias("kind"))


def _given(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"r.{name}"), F.lit(""))) != ""


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read(spark, path, LABELS, _given("question"), "emptyQuestion")


def read_probe_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read(spark, path, PROBE, _given("question"), "emptyQuestion")


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    answered = F.exists(F.coalesce("r.answers", F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    return _read(spark, path, PAIRS, _given("question") & answered, "emptyAnswer")


def read_captions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read(spark, path, CAPTIONS, _given("file_name") & _given("caption"), "emptyCaption")


def write_manifest(selected: DataFrame, skipped: DataFrame, path: str) -> None:
    """Selected and skipped files and the totals as JSON lines in three folders."""
    selected.write.json(f"{path}/files")
    skipped.write.json(f"{path}/skipped")
    selected.agg(F.count("*").alias("files"), F.sum("chars").alias("chars"), F.sum("lines").alias("lines")).write.json(f"{path}/totals")


def write_eval_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)
