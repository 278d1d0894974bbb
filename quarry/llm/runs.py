"""Periodic runs of words by seeds on diagonals.

A run is a stretch of words in which words `period` apart are equal, that no neighbour extends; period is the least such. Runs
of at least `least` words and `times` periods are wanted. Within a run of period q, the text and the text q words on
agree on at least (times - 1) * q words: the guaranteed overlap. Lags are taken in octaves: for lags in [s, 2s) the grams indexed
have 3s words, the least overlap any run of these lags must have, at every place of the text. Grams are named by doubling (a
gram's name is the pair of the names of its halves), so equal names are equal words, not equal hashes.

In a run of least period q the next occurrence of a gram of its octave is exactly q words on: one in between would give
the gram, which is longer than the sum of the two distances or of their remainders, a period that divides q, and so the run a
lesser one. So each occurrence is paired with its next one only, and pairs grow with the text, whatever repeats in it. Pairs of
one lag that stand in a row are one diagonal: each next pair is covered by what the first has reached, and extends it by a word. A
diagonal's first pair opens a run, its last pair ends it.

One document is worked on in one task, in memory that grows with its words; the octaves end when no gram of a length recurs.

Edge cases: null and empty texts have no words and no run; repeated rows are judged row by row; a null doc_id marks no text as altered; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, words_of

LEAST, TIMES = 6, 4
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def pair_names(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, next) of every pair of names: equal pairs have one name, and next is the place of the pair's next occurrence, or -1."""
    key = first * (int(second.max()) + 1) + second if len(second) else first
    order = np.argsort(key, kind="stable")
    in_order = key[order]
    same = in_order[1:] == in_order[:-1]
    names, following = np.empty(len(key), np.int64), np.full(len(key), -1)
    names[order] = np.cumsum(np.r_[False, ~same][: len(key)])
    following[order[:-1][same]] = order[1:][same]
    return names, following


def find_runs(numbers: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period), by start, then period, of all runs of least words and times periods; times is at least 4."""
    assert times >= 4
    n, lag = len(numbers), 1
    found = [np.empty((0, 3), np.int64)]
    names = numbers  # of grams of `lag` words, at every place
    while times * lag <= n and n >= least:
        double, following = pair_names(names[:-lag], names[lag:])  # grams of 2 * lag words
        if not (following >= 0).any():
            break
        size = n - 3 * lag + 1
        _, following = pair_names(double[:size], names[2 * lag : 2 * lag + size])  # grams of 3 * lag words
        at = np.flatnonzero(following >= 0)
        period = following[at] - at
        inside = (period >= lag) & (period < 2 * lag)
        at, period = at[inside], period[inside]
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        opens = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])][: len(at)])
        ends = np.r_[opens[1:], len(at)][: len(opens)] - 1
        length = at[ends] + period[ends] + 3 * lag - at[opens]
        whole = length >= np.maximum(least, times * period[opens])
        found.append(np.stack([at[opens], length, period[opens]], axis=1)[whole])
        names, lag = double, 2 * lag
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def longest_repeated(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; of equal ones that of least start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words left if every run keeps its first period only."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the report takes them: every tenth document, by the checksum of its number, repeats a stretch of its own from some word on to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, start, length, period) of all runs of all documents."""

    def run(batches):
        for batch in batches:
            ids, found = [], [np.empty((0, 3), np.int64)]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                rows = find_runs(word_numbers(words_of(text)), least, times)
                ids += [doc_id] * len(rows)
                found.append(rows)
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(rows[:, c]) for c in range(3))], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, text) of every row of docs, of every run the first period only; texts without a run stay as they are."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of((text or "").encode())
                rows = find_runs(word_numbers(words), least, times)
                out.append(b" ".join(collapsed(words, rows)).decode() if len(rows) else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


def run_report(docs: DataFrame, altered=with_planted_period) -> DataFrame:
    """RUNS of every row of docs: the number of runs, the one repeated most, and the digests of all runs and of the words left; altered gives the words of a
    document that are looked at."""
    names = [x.split()[0] for x in RUNS.split(", ")]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names[1:]]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = altered(doc_id, words_of(text))
                rows = find_runs(word_numbers(words))
                best = longest_repeated(rows)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in rows.tolist())
                values = len(rows), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, rows))).hexdigest()
                for column, x in zip(out, values, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(out, names[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RUNS)
