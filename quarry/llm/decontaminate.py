"""Benchmark decontamination by greedy string tiling.

A seed is a hash of `min_match` words in a row, running Karp-Rabin over word hashes. Documents are read once: what they
share with any item is found through a bitmap of all items' seeds (2^GATE_BITS bits, whatever the number of items; it lets
through too much, never too little), and only the words under such seeds go on, stretch by stretch. Their seeds, counted
by document, are joined with the items' seeds. To be found, an item must have at least `coverage` of its words under
shared seeds, so its most frequent seeds that cover fewer words than that need not meet anything: an item meets the
documents of its other, rarer seeds. Each document and item that meet are tiled: seeds of one diagonal make maximal
matches, the longest unmarked match becomes a tile, what it cuts is shortened and considered again, until no match of
`min_match` words is left. An item is found in a document if tiles cover at least `coverage` of its words, in whatever
order its parts stand.

Where words repeat so much that the seeds of a document make more than `LISTED` pairs, the same tiles are found length
by length instead, from the longest that both still hold free: memory then grows with the two texts, not their product.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Edge cases: null or empty texts and items match nothing;
an item of fewer than `min_match` words is one seed as a whole; repeated documents are judged row by row,
repeated items reported once per row; no items or no documents give no rows; extra columns stay as they are.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Prefix, mix, stored, texts, word_hashes

MIN_MATCH, COVERAGE = 5, 0.6
LISTED = 2_000_000
GATE_BITS = 26  # the bitmap of the items' seeds has 8 MB
GROUP = 256  # items that meet a document go in groups of so many, each with the document's shared words
FOUND = "doc_id long, item_id long, item_words int, covered_words int, coverage double, n_tiles int, longest_tile int"
KR = np.uint64(0x9E3779B97F4A7C15)
BREAK = np.uint64(0)  # stands between two stretches of shared words; no word has this hash


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k word hashes."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * KR + h[j : len(h) - k + 1 + j]
    return mix(out)


def tile(runs: list[tuple[int, int, int]], n_item: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length) from maximal matches."""
    heap = [(-length, i, j) for i, j, length in runs]
    heapq.heapify(heap)
    item, doc, tiles = bytearray(n_item), set(), []
    while heap:
        length, i, j = heapq.heappop(heap)
        free, best, start = 0, [], 0
        for t in range(-length + 1):
            if t < -length and not item[i + t] and j + t not in doc:
                if not free:
                    start = t
                free += 1
            elif free:
                best.append((start, free))
                free = 0
        if best == [(0, -length)]:
            tiles.append((i, j, -length))
            item[i : i - length] = b"\1" * -length
            doc.update(range(j, j - length))
        else:
            for a, n in best:
                if n >= min_match:
                    heapq.heappush(heap, (-n, i + a, j + a))
    return tiles


def _free_runs(free: np.ndarray, prefix: Prefix, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of so many words of which none is marked."""
    upto = np.r_[0, np.cumsum(free)]
    start = np.flatnonzero(upto[length:] - upto[:-length] == length) if length <= len(free) else np.empty(0, np.int64)
    return start, prefix.runs(start, start + length)


def tiles_by_length(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """The tiles that `tile` makes of all maximal matches of two texts (word hashes), without listing the matches."""
    free = np.ones(len(item), bool), np.ones(len(doc), bool)
    prefix = Prefix(item), Prefix(doc)
    tiles, most = [], min(len(item), len(doc))

    def shared(length):
        (i, hi), (j, hj) = (_free_runs(f, p, length) for f, p in zip(free, prefix, strict=True))
        own = np.unique(hi)
        if not len(own) or not len(hj):
            return i[:0], hi[:0], j[:0], hj[:0]
        both = own[np.minimum(np.searchsorted(own, hj), len(own) - 1)] == hj
        j, hj = j[both], hj[both]
        met = np.isin(hi, hj)
        return i[met], hi[met], j, hj

    while most >= min_match:
        low, high = min_match - 1, most  # the longest length at which both share a free run lies in (low, high], or is none
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)[0]) else (low, middle - 1)
        if low < min_match:
            break
        i, hi, j, hj = shared(low)
        order = np.argsort(hj, kind="stable")
        j, hj = j[order], hj[order]
        at = {}  # where to go on among the document's runs of one hash: a run once marked stays so
        for start, value in zip(i.tolist(), hi, strict=True):
            if free[0][start : start + low].all():
                k, end = at.get(value) or (int(np.searchsorted(hj, value, "left")), int(np.searchsorted(hj, value, "right")))
                while k < end and not (free[1][j[k]] and free[1][j[k] + low - 1] and free[1][j[k] : j[k] + low].all()):
                    k += 1
                at[value] = (k, end)
                if k < end:
                    tiles.append((start, int(j[k]), low))
                    free[0][start : start + low] = False
                    free[1][j[k] : j[k] + low] = False
        most = low - 1
    return tiles


def _counters(times: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each of times, one after the other."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


class Items:
    """Some benchmark items with their seeds, by seed length."""

    def __init__(self, rows: list[tuple[int, bytes]], min_match: int):
        self.items = [(item_id, h, min(min_match, len(h))) for item_id, text in rows if len(h := word_hashes(text.lower()))]
        self.sizes = np.array([len(h) for _, h, _ in self.items], np.int64)
        seeds = defaultdict(list)
        for n, (_, h, k) in enumerate(self.items):
            seeds[k] += [(int(s), n, i) for i, s in enumerate(window_hashes(h, k))]
        self.by_length = {}
        for k, rows_of in seeds.items():
            rows_of.sort()
            keys = np.array([r[0] for r in rows_of], np.uint64)
            gate = np.zeros(1 << 20, bool)
            gate[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[k] = (keys, np.array([r[1:] for r in rows_of], np.int64), gate)

    def found(self, h: np.ndarray, coverage: float) -> list[tuple]:
        """(item_id, words, covered, coverage, tiles, longest) of the items found in a document's word hashes."""
        out = []
        for k, (keys, places, gate) in self.by_length.items():
            windows = window_hashes(h, k)
            at = np.flatnonzero(gate[(windows >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(keys, windows[at], "left")
            met = keys[np.minimum(low, len(keys) - 1)] == windows[at]
            at, low = at[met], low[met]
            if not len(at):
                continue
            # The items' side of the seeds: each key met once, with all its places; then what items they could cover enough of.
            first, which = np.unique(low, return_inverse=True)
            times = np.searchsorted(keys, keys[first], "right") - first
            rows = np.repeat(first, times) + _counters(times)
            n, i = places[rows, 0], places[rows, 1]
            order = np.lexsort((i, n))
            sorted_n, sorted_i = n[order], i[order]
            ends = np.r_[sorted_n[1:] != sorted_n[:-1], True]
            covers = np.where(ends, k, np.minimum(np.r_[sorted_i[1:], 0] - sorted_i, k))
            upto = np.cumsum(covers)[ends]
            some, most = sorted_n[ends], np.diff(np.r_[0, upto])
            some = some[most >= coverage * self.sizes[some]]
            wanted = np.isin(n, some)
            if not len(some):
                continue
            times = np.add.reduceat(wanted, np.cumsum(times) - times, dtype=np.int64)
            n, i = n[wanted], i[wanted]
            if times[which].sum() > LISTED:
                found = {int(x): tiles_by_length(self.items[x][1], h, k) for x in some.tolist()}
            else:
                j = np.repeat(at, times[which])
                rows = np.repeat((np.cumsum(times) - times)[which], times[which]) + _counters(times[which])
                n, i = n[rows], i[rows]
                order = np.lexsort((i, j - i, n))
                n, i, j = n[order], i[order], j[order]
                fresh = np.r_[True, (n[1:] != n[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)]
                starts = np.flatnonzero(fresh)
                lengths = np.diff(np.r_[starts, len(n)]) + k - 1
                matches = defaultdict(list)
                for s, length in zip(starts.tolist(), lengths.tolist(), strict=True):
                    matches[int(n[s])].append((int(i[s]), int(j[s]), length))
                found = {x: tile(runs, len(self.items[x][1]), k) for x, runs in matches.items()}
            for x, tiles in found.items():
                item_id, words, _ = self.items[x]
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(words):
                    out.append((item_id, len(words), covered, covered / len(words), len(tiles), max(t[2] for t in tiles)))
        return out


def _batch(names: str, kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names.split())


def item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """The seeds of items (item, item_text): their place, length in words, and the item's words."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                h = word_hashes(text.lower())
                k = min(min_match, len(h))
                seeds = window_hashes(h, k) if k else h
                for column, value in zip(out, ([item] * len(seeds), [len(h)] * len(seeds), [k] * len(seeds), range(len(seeds)), seeds.view(np.int64).tolist()), strict=True):
                    column += value
            yield _batch("item words k at seed", [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], out)

    return items.select("item", "item_text").mapInArrow(run, "item long, words long, k int, at long, seed long")


def gate_of(seeds: DataFrame) -> np.ndarray:
    """The bitmap of the seeds' first GATE_BITS bits: at most 2^GATE_BITS / 64 rows come to the driver."""
    place = F.shiftrightunsigned("seed", 64 - GATE_BITS)
    rows = seeds.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")).toArrow()
    gate = np.zeros(1 << (GATE_BITS - 6), np.uint64)
    gate[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return gate


def passes(gate: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    place = seeds >> np.uint64(64 - (gate.size * 64).bit_length() + 1)
    return (gate[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def shared_part(h: np.ndarray, gate: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The words under seeds that pass the gate, in order, with a BREAK where words between were left out."""
    edges = np.zeros(len(h) + 1, np.int64)
    for k in lengths:
        at = np.flatnonzero(passes(gate, window_hashes(h, k)))
        edges[at] += 1
        edges[at + k] -= 1
    at = np.flatnonzero(np.cumsum(edges)[:-1])
    return np.insert(h[at], np.flatnonzero(np.diff(at) > 1) + 1, BREAK)


def shared_words(docs: DataFrame, gate: np.ndarray, lengths: list[int]) -> DataFrame:
    """(doc_id, digest, shared) of the rows of docs that may hold a seed: hashes of the words under seeds, eight bytes each."""
    block = docs.sparkSession.sparkContext.broadcast(gate)

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for doc_id, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                part = shared_part(word_hashes(text.lower()), block.value, lengths)
                if len(part):
                    for column, value in zip(out, (doc_id, digest, part.tobytes()), strict=True):
                        column.append(value)
            yield _batch("doc_id digest shared", [pa.int64(), pa.int64(), pa.binary()], out)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(run, "doc_id long, digest long, shared binary")


def document_seeds(shared: DataFrame, gate: np.ndarray, lengths: list[int]) -> DataFrame:
    """(row, seed): each seed of a row's shared words that passes the gate, once."""
    block = shared.sparkSession.sparkContext.broadcast(gate)

    def run(batches):
        for batch in batches:
            rows, seeds = [], []
            for row, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                windows = [window_hashes(np.frombuffer(words, np.uint64), k) for k in lengths]
                own = np.unique(np.concatenate([w[passes(block.value, w)] for w in windows]))
                rows.append(np.full(len(own), row, np.int64))
                seeds.append(own.view(np.int64))
            yield _batch("row seed", [pa.int64(), pa.int64()], [np.concatenate(x) if x else [] for x in (rows, seeds)])

    return shared.select("row", "shared").mapInArrow(run, "row long, seed long")


def rare_seeds(counted: DataFrame, coverage: float) -> DataFrame:
    """(item, seed): seeds of which a document must hold one to hold the item. counted has an item's seeds (item, words, k, at, seed) that documents hold, and in how many (n)."""

    def run(batches):
        for batch in batches:
            out = [[], []]
            for row in batch.to_pylist():
                passed, k, need = set(), row["k"], coverage * row["words"]
                for seed in sorted(row["seeds"], key=lambda x: (-x["n"], x["at"])):
                    under = set(range(seed["at"], seed["at"] + k))
                    if len(passed) + len(under - passed) < need:
                        passed |= under
                    else:
                        out[0].append(row["item"])
                        out[1].append(seed["seed"])
            yield _batch("item seed", [pa.int64(), pa.int64()], out)

    return counted.groupBy("item", "words", "k").agg(F.collect_list(F.struct("at", "seed", "n")).alias("seeds")).mapInArrow(run, "item long, seed long").distinct()


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float, min_match: int) -> DataFrame:
    """FOUND and the digest of the document's text."""
    items = stored(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text")).where("item_text is not null"), "items")
    seeds = stored(item_seeds(items, min_match), "item-seeds")
    lengths = sorted(r[0] for r in seeds.select("k").distinct().collect())  # min_match at most
    gate = gate_of(seeds)
    shared = stored(shared_words(docs, gate, lengths).withColumn("row", F.monotonically_increasing_id()), "shared")
    held = document_seeds(shared, gate, lengths)
    rare = stored(rare_seeds(seeds.join(held.groupBy("seed").agg(F.count("*").alias("n")), "seed"), coverage), "rare-seeds")
    met = held.join(rare, "seed").select("row", "item").distinct()
    parts = met.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("row").orderBy("item")) - 1) / GROUP))
    asked = parts.join(items, "item").groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "item_text")).alias("asked"))

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        for batch in batches:
            hits = []
            for doc_id, digest, words, of in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                some = Items([(x["item_id"], x["item_text"].encode()) for x in of], min_match)
                hits += [(digest, doc_id, *x) for x in some.found(np.frombuffer(words, np.uint64), coverage)]
            yield _batch("digest doc_id item_id item_words covered_words coverage n_tiles longest_tile", kinds, list(zip(*hits, strict=True)) if hits else [[]] * len(kinds))

    return asked.join(shared, "row").select("doc_id", "digest", "shared", "asked").mapInArrow(run, "digest long, " + FOUND)


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """One row for each document and item found in it."""
    return _found(docs, benchmark, coverage, min_match).drop("digest")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents in which no item is found, with all their columns. Those found are few and stored; rows meet them by id and digest of the text, in a broadcast if their table is small."""
    found = stored(_found(docs, benchmark, coverage, min_match).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct(), "contaminated")
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    kept = named.join(found, doc_id.cast("long").eqNullSafe(F.col("_doc")) & F.xxhash64(text.cast("string")).eqNullSafe(F.col("_digest")), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
