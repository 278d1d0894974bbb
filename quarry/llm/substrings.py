"""Substring dedup by De Bruijn compaction.

Each window of `window` words belongs to its k-mer of least hash, wherever the window stands. Windows in a row that share it
are an edge of the graph: the k-mer is where it hangs, all words of those windows its content. Only edges at k-mers of two
or more documents can repeat. Edges that repeat are joined to their successors; where every occurrence of one is followed by
the other, and every occurrence of the other preceded by it, the path does not branch, and pointer doubling through stored
joins contracts such paths to their heads. A whole path has one least document, and all others lose it at once.

Where different contents hang at one k-mer they may share some windows: the least holder of each such content is taken
apart into windows, at its source coordinates, which are compared one by one; no other document needs to be, as a
window's least holder is also the least holder of the edge it lies in.

Nothing is removed on hashes of words alone: each span carries a 128-bit digest of the words at its coordinates in the least
document, and is removed if the words at its own coordinates have that digest. Removed is each word covered by a window
that also starts in a document of smaller id.

Edge cases: null text has no words; texts shorter than a window lose nothing; repeats inside one document and
rows of one doc_id are not copies of each other; a null doc_id neither loses words nor makes others lose any;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, stored, texts, word_hashes, words_of

WINDOW, K = 50, 16
PLACE = 24
EDGES = "doc_id long, lo int, hi int, vertex long, content long, next_vertex long, next_content long"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def edges_of(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(lo, hi, vertex, content): windows starting in lo..hi share their least k-mer."""
    n = len(h)
    if n < window:
        return None
    prefix = Prefix(h)
    at = np.arange(n - k + 1)
    kmers = prefix.runs(at, at + k)
    keys = kmers >> np.uint64(PLACE) << np.uint64(PLACE) | at.astype(np.uint64)
    place = (_sliding_min(keys, window - k + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    hi = np.r_[lo[1:] - 1, len(place) - 1]
    return lo, hi, kmers[place[lo]], prefix.runs(lo, hi + window)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def document_edges(docs: DataFrame, window: int, k: int) -> DataFrame:
    """All edges of all documents, with the edge that follows. A text of 2**PLACE words or more is taken in overlapping parts."""
    most = (1 << PLACE) - 1
    names = ["doc_id", "lo", "hi", "vertex", "content"]

    def run(batches):
        for batch in batches:
            parts = [[np.empty(0, kind)] for kind in (np.int64, np.int32, np.int32, np.int64, np.int64)]
            last = [np.empty(0, bool)]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if doc_id is None:
                    continue
                h = word_hashes(text)
                for a in range(0, max(1, len(h)), most - window):
                    if (found := edges_of(h[a : a + most], window, k)) is not None:
                        lo, hi, vertex, content = found
                        for part, x in zip(parts, (np.full(len(lo), doc_id, np.int64), (lo + a).astype(np.int32), (hi + a).astype(np.int32), _long(vertex), _long(content)), strict=True):
                            part.append(x)
                        last.append(np.arange(len(lo)) == len(lo) - 1)
            columns, ends = [np.concatenate(x) for x in parts], np.concatenate(last)
            following = [pa.array(np.r_[c[1:], 0][: len(c)], mask=ends) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *following], [*names, "next_vertex", "next_content"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, EDGES)


class Words:
    """The words of a text and the digests of runs of them."""

    def __init__(self, text: bytes):
        self.words = words_of(text)
        self.joined = b" ".join(self.words)
        self.end = np.cumsum([len(w) + 1 for w in self.words]).tolist()

    def digest(self, lo: int, hi: int) -> bytes | None:
        """Of the words lo to hi, hi excluded; null where the text ends before."""
        return hashlib.blake2b(self.joined[self.end[lo - 1] if lo else 0 : self.end[hi - 1] - 1], digest_size=16).digest() if hi <= len(self.words) else None


def read_sources(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(doc_id, at, vertex, content, digest) of spans (doc_id, lo, hi, vertex, content), read at their places in the texts: one row and digest for a
    span of a content, one for each window of a span without."""
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "vertex", "content")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(listed, "doc_id").select("doc_id", "text", *[f"spans.{x}" for x in ("lo", "hi", "vertex", "content")])
    names, kinds = ["doc_id", "at", "vertex", "content", "digest"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, text, *of in zip(batch.column(0).to_pylist(), texts(batch.column(1)), *(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                words = Words(text)
                for lo, hi, vertex, content in zip(*of, strict=True):
                    for a, b in [(lo, hi + 1)] if content is not None else [(at, at + 1) for at in range(lo, hi + 1)]:
                        for column, x in zip(out, (doc_id, a, vertex, content, words.digest(a, b + window - 1)), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(run, "doc_id long, at int, vertex long, content long, digest binary").where("digest is not null")


KEY, NEXT = ["vertex", "content"], ["next_vertex", "next_content"]


def compacted(held: DataFrame) -> DataFrame:
    """(vertex, content, least, windows) of the heads of nonbranching paths of repeated edges; windows counts those of the whole path.

    held has for each edge its occurrences n, those that have a successor, and the least and the largest successor. An edge follows another on an unbranched
    path if it always follows, and has no more occurrences: so no path is a cycle.
    """
    edges = held.where("least < most")
    after = edges.where((F.col("n_next") == F.col("n")) & (F.col("first_next") == F.col("last_next"))).select(*[F.col(c).alias(f"of_{c}") for c in KEY], F.col("n").alias("of_n"), F.col("windows").alias("offset"), "first_next.*")
    links = after.join(edges.select(*[F.col(c).alias(x) for c, x in zip(KEY, NEXT, strict=True)], "n"), NEXT).where("of_n = n")
    # Each edge but a head points to one before it on its path, and how many windows lie between their starts.
    back = stored(links.select(*[F.col(x).alias(c) for c, x in zip(KEY, NEXT, strict=True)], F.col("of_vertex").alias("to_vertex"), F.col("of_content").alias("to_content"), "offset"), "pointers")
    while True:
        far = back.select(F.col("vertex").alias("to_vertex"), F.col("content").alias("to_content"), F.col("to_vertex").alias("v"), F.col("to_content").alias("c"), F.col("offset").alias("more"))
        joined = back.join(far, ["to_vertex", "to_content"], "left")
        back = stored(joined.select(*KEY, F.coalesce("v", "to_vertex").alias("to_vertex"), F.coalesce("c", "to_content").alias("to_content"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("v").isNotNull().alias("moved")), "pointers")
        if back.where("moved").isEmpty():
            break
    ends = back.join(edges.select(*KEY, "windows"), KEY).groupBy(F.col("to_vertex").alias("vertex"), F.col("to_content").alias("content")).agg(F.max(F.col("offset") + F.col("windows")).alias("whole"))
    return edges.join(back, KEY, "left_anti").join(ends, KEY, "left").select(*KEY, "least", F.coalesce("whole", "windows").alias("windows"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, lo, hi, digest): the windows starting in lo..hi also start in a document of smaller id, if the words they cover have the digest."""
    edges = stored(document_edges(docs, window, k), "edges")
    vertices = edges.groupBy("vertex").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.min("content") != F.max("content")).alias("branches")).where("least < most").select("vertex", "branches")
    vertices = stored(vertices, "vertices")  # a plain table on both sides lets Spark split a hot vertex
    repeated = stored(edges.join(vertices, "vertex"), "repeated")
    following = F.when(F.col("next_vertex").isNotNull(), F.struct(*NEXT))
    held = repeated.groupBy(*KEY).agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("hi") - F.col("lo") + 1).cast("long").alias("windows"), F.count("*").alias("n"), F.count("next_vertex").alias("n_next"),
        F.min(following).alias("first_next"), F.max(following).alias("last_next"), F.min(F.struct("doc_id", "lo", "hi")).alias("first"), F.first("branches").alias("branches"),
    )
    held = stored(held, "held")
    heads = stored(compacted(held), "heads")
    paths = stored(repeated.join(heads, KEY).select("doc_id", "lo", (F.col("lo") + F.col("windows") - 1).cast("int").alias("hi"), *KEY, "least"), "paths")
    sources = paths.where("doc_id = least").groupBy(*KEY).agg(F.min(F.struct("doc_id", "lo", "hi")).alias("first")).select("first.*", *KEY)
    apart = held.where("branches").select("first.*", "vertex", F.lit(None).cast("long").alias("content"))
    read = stored(read_sources(docs, sources.unionByName(apart), window), "sources")
    of_paths = read.where("content is not null").groupBy(*KEY).agg(F.min(F.struct("doc_id", "at", "digest"))["digest"].alias("digest"))
    whole = paths.where("doc_id > least").join(stored(of_paths, "digests"), KEY).select("doc_id", "lo", "hi", "digest")
    windows = read.where("content is null")
    first = stored(windows.groupBy("vertex", "digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("vertex", "digest", "least"), "first")
    single = windows.join(first, ["vertex", "digest"]).where("doc_id > least").select("doc_id", F.col("at").alias("lo"), F.col("at").alias("hi"), "digest")
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs; kept is the words left, joined by one space."""
    return _cleaned(docs, window, k, "kept string", lambda kept: pa.array([x.decode() for x in kept], pa.string()))


def repeat_report(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """As remove_repeats, with the digest of the words left in their place."""
    return _cleaned(docs, window, k, "kept_sha256 string", lambda kept: pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))


def _cleaned(docs: DataFrame, window: int, k: int, field: str, column) -> DataFrame:
    spans = repeated_spans(docs, window, k).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "digest")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(spans, "doc_id", "left").select("doc_id", "text", "spans.lo", "spans.hi", "spans.digest")

    def run(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, *of in zip(texts(batch.column(1)), *(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                if of[0]:
                    read = Words(text)
                    words, n = read.words, len(read.words)
                    steps = np.zeros(n + 1, np.int32)
                    for lo, hi, digest in zip(*of, strict=True):
                        if read.digest(lo, hi + window) == digest:
                            steps[lo] += 1
                            steps[hi + window] -= 1
                    keep = np.cumsum(steps[:-1]) == 0
                    words = [w for w, k_ in zip(words, keep.tolist(), strict=True) if k_]
                else:
                    words = words_of(text)
                    n = len(words)
                counts.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), column(kept)], ["doc_id", "n_words", "n_removed", field.split()[0]])

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {field}")
