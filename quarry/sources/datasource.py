"""The stored index as a data source of Spark: spark.read.format("quarry_index").load(root).where("document_id = '..'").

The option `table` names one of the index's tables (default: chunks). Filters of equality and IN on the key by which the table is laid out choose buckets before anything is read; each folder of a bucket is
a partition, read in Arrow batches. Paths are those that pyarrow's file systems open. register() also allows filters to reach the source.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

KEYS = {"chunks": "document_id", "generations": "document_id", "keys": "document_key", "failures": "relative_path"}


def spark_bucket(key: str, buckets: int) -> int:
    """The bucket that Spark's xxhash64 gives a string."""
    import xxhash

    h = xxhash.xxh64_intdigest(key.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def newest(root: str) -> dict:
    """The newest pointer of the index."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
    names = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/current")) if f.base_name.endswith(".json") and f.base_name[0] != "."]
    with system.open_input_stream(max(names)) as stream:
        return json.loads(stream.read())


@dataclass
class Folder(InputPartition):
    path: str


class IndexReader(DataSourceReader):
    def __init__(self, root: str, table: str, schema: StructType, pointer: dict):
        self.root, self.table, self.schema, self.pointer, self.wanted = root, table, schema, pointer, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (KEYS.get(self.table),):
                values = [f.value] if isinstance(f, EqualTo) else f.value
                found = {spark_bucket(v, self.pointer["buckets"]) for v in values if v is not None}
                self.wanted = found if self.wanted is None else self.wanted & found
            yield f  # Spark applies all of them to what is read

    def partitions(self) -> list[InputPartition]:
        held = {k.split("/")[1]: folder for k, folder in self.pointer["held"].items() if k.startswith(f"{self.table}/")}
        return [Folder(f"{self.root}/data/{folder}/{self.table}/bucket={b}") for b, folder in sorted(held.items()) if self.wanted is None or int(b) in self.wanted]

    def read(self, partition: Folder | None):
        if partition is None:  # no bucket is left: Spark asks once nevertheless
            return
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        found = ds.dataset(partition.path if "://" in partition.path else partition.path.removeprefix("file:"), format="parquet", exclude_invalid_files=False)
        for batch in found.to_batches(columns=[n for n in schema.names if n in found.schema.names]):
            columns = [batch.column(batch.schema.get_field_index(f.name)).cast(f.type) if f.name in batch.schema.names else pa.nulls(len(batch), f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_index"

    @property
    def _table(self) -> str:
        return self.options.get("table", "chunks")

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(newest(self.options["path"])["schemas"][self._table]))

    def reader(self, schema: StructType) -> IndexReader:
        return IndexReader(self.options["path"], self._table, schema, newest(self.options["path"]))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexSource)
