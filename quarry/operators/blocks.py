"""Products of vector sets, block by block: rows are packed into blocks, and every block of queries meets every block of rows once.

Nothing passes through the driver. Blocks of rows are packed where the rows are; blocks of queries are a small table that
is broadcast while it is small. Otherwise groups of query blocks meet slices of the rows as a Cartesian product of their partitions:
each side is shuffled once and read again for every partition of the other, never copied, and a task holds one group of query blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, BROADCAST_QUERIES, GROUP_BLOCKS = 1024, 20_000, 64

Pairs = Iterator[tuple[tuple[str, int], dict[str, pa.Array], dict[str, pa.Array]]]


def fields(struct: pa.Array) -> dict[str, pa.Array]:
    return {f.name: struct.field(i) for i, f in enumerate(struct.type)}


def matrix(vectors: pa.Array) -> np.ndarray:
    """Equally long vectors as a matrix of doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def packed(rows: DataFrame) -> DataFrame:
    """(space, rows): blocks of at most BLOCK_ROWS rows of one space."""
    columns = [c for c in rows.columns if c != "space"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch.column("space").to_numpy(zero_copy_only=False)
            for space in dict.fromkeys(spaces.tolist()):
                of = batch.filter(pa.array(spaces == space)).select(columns)
                for a in range(0, len(of), BLOCK_ROWS):
                    part = of.slice(a, BLOCK_ROWS).to_struct_array()
                    block = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part]))
                    yield pa.RecordBatch.from_arrays([pa.array([space], pa.string()), block], ["space", "rows"])

    kinds = ",".join(f"{n}:{k}" for n, k in rows.dtypes if n != "space")
    return rows.select("space", *columns).mapInArrow(run, f"space string, rows array<struct<{kinds}>>")


def each(score: Callable[[dict, dict], pa.RecordBatch]) -> Callable[[Pairs], Iterator[pa.RecordBatch]]:
    """The work of products() that looks at one pair of blocks at a time."""
    return lambda pairs: (score(rows, asked) for _, rows, asked in pairs)


class Best:
    """The best k rows for each query of one block (ids) in tie order, of all rows seen so far; what can no longer be among them is left out at once."""

    def __init__(self, ids: pa.Array, k: int):
        self.ids, self.k, self.most = ids, k, k * len(ids)
        self.floor, self.parts, self.waiting = np.full(len(ids), np.finfo(float).min), [], 0  # floor: the score of the k-th so far

    def above(self, scores: np.ndarray, slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Row and query of the scores (rows by queries, -inf for none) that can be among the best."""
        floor = self.floor
        if len(scores) > self.k and (floor == np.finfo(float).min).any():
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        return np.nonzero(scores >= np.maximum(floor - slack, np.finfo(float).min))

    def take(self, rows: dict[str, pa.Array], at: np.ndarray, of: np.ndarray, s: np.ndarray) -> None:
        at, of, s = at[keep := s >= self.floor[of]], of[keep], s[keep]
        if len(at) > 4 * self.most:  # many equal scores: cut within the block first
            page = rows["page_number"].cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False)
            place = np.empty(len(page), np.int64)
            place[np.lexsort((rows["row_id"].to_numpy(), rows["start_offset"].to_numpy(), page, np.array(rows["relative_path"].to_pylist())))] = np.arange(len(page))
            order = np.lexsort((place[at], -s, of))
            order = order[_places(of[order]) < self.k]
            at, of, s = at[order], of[order], s[order]
        if len(at):
            taken = pa.array(at)
            self.parts.append(pa.table({"of": pa.array(of), "score": pa.array(s)} | {c: v.take(taken) for c, v in rows.items()}))
            self.waiting += len(at)
            if self.waiting > self.most:
                self.cut()

    def cut(self) -> pa.Table:
        found = pa.concat_tables(self.parts)
        of, s = found["of"].to_numpy(), found["score"].to_numpy()
        order = np.lexsort((-s, of))
        last = order[_places(of[order]) == self.k - 1]
        self.floor[of[last]] = s[last]
        found = found.filter(pa.array(s >= self.floor[of]))
        if (np.bincount(found["of"].to_numpy(), minlength=1) > self.k).any():  # equal scores at the cut
            found = found.sort_by([(c, "descending" if c == "score" else "ascending") for c in ("of", "score", "relative_path", "page_number", "start_offset", "row_id")])  # nulls come last
            found = found.filter(pa.array(_places(found["of"].to_numpy()) < self.k))
        self.parts, self.waiting = [found], 0
        return found

    def batches(self) -> list[pa.RecordBatch]:
        """(query_id, the columns of the rows, score)"""
        if not self.parts:
            return []
        found = self.cut()
        shown = [c for c in found.column_names if c not in ("of", "score")]
        return pa.table([self.ids.take(found["of"].combine_chunks()), *(found[c] for c in [*shown, "score"])], ["query_id", *shown, "score"]).combine_chunks().to_batches()


def _places(ordered: np.ndarray) -> np.ndarray:
    """For each element of a sorted array, how many equal ones stand before it."""
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return np.arange(len(ordered)) - np.repeat(first, np.diff(np.r_[first, len(ordered)]))


def best(of: Callable[[dict], Best]) -> Callable[[Pairs], Iterator[pa.RecordBatch]]:
    """The work of products() that keeps the best rows of a task for each query; of(queries) makes the keeper of a block, with a method see(rows)."""

    def work(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        keepers: dict[tuple[str, int], Best] = {}
        for block, rows, asked in pairs:
            if block not in keepers:
                keepers[block] = of(asked)
            keepers[block].see(rows)
        for keeper in keepers.values():
            yield from keeper.batches()

    return work


def products(rows: DataFrame, queries: DataFrame, work: Callable[[Pairs], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work makes of the pairs of blocks of one space that a task sees: (name of the query block, rows, queries), the latter dictionaries of Arrow
    columns. rows and queries have a `space` column and an id first after it."""
    n = queries.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    columns = [c for c in queries.columns if c != "space"]
    asked = queries.groupBy("space", F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*columns)).alias("asked"))
    if n <= BROADCAST_QUERIES:
        pairs = packed(rows).join(F.broadcast(asked), "space")
    else:
        groups = -(-blocks // GROUP_BLOCKS)
        cores = rows.sparkSession.sparkContext.defaultParallelism
        slices = max(-(-rows.count() // (GROUP_BLOCKS * BLOCK_ROWS)), -(-2 * cores // groups))  # two tasks a core at least
        pairs = packed(rows.repartition(slices)).join(asked.repartition(groups).hint("shuffle_replicate_nl"), "space")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked() -> Pairs:
            for batch in batches:
                for i in range(len(batch)):
                    yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), fields(batch.column(2)[i].values), fields(batch.column(3)[i].values)

        yield from work(unpacked())

    return pairs.select("space", "block", "rows", "asked").mapInArrow(run, schema)
