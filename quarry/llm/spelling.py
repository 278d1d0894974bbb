"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Each letter is hashed to one of `symbols` symbols (its code point modulo their number), so a word becomes a reduced word. Two words one edit
apart have reduced words at most one edit apart. The full one-edit neighbourhood of each reduced word (itself, all deletions,
replacements and insertions of symbols, each distinct string once) is joined with the reduced vocabulary; it is 15 strings a letter for eight
symbols, whatever the alphabet. Strings travel as 64-bit hashes, which come from prefix sums in one step each, so the neighbourhood
of a very long word is no quadratic amount of text. A hash or a symbol shared by chance only adds a candidate: candidates that agree in the first or last
two letters (one edit leaves one of the two alone) and in all but two bits of a mask of letters go on, and are verified on the
original words. A pair of words meets once in each direction.

A word's form is its nearest more frequent word: of the near words the one of largest count, if that is `times` the word's own. The
chain of forms ends in its root, found by pointer doubling; counts at least double along it, so it has no cycle.

Edge cases: null texts have no words; repeated rows count again; ties between near words go to the one first in code-point order; a
null doc_id alters no word; words of any length take part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stored, texts

LEAST_LETTERS, LEAST_COUNT, TIMES = 5, 3, 2
SYMBOLS = 8
HELD_WORDS = 200_000
CHUNK = 1 << 16
BASE = 0x9E3779B97F4A7C15


def with_typo(prefix: int, word: str) -> str:
    """One letter of one of 97 words of a document goes; prefix is the checksum of its number and a colon."""
    h = zlib.crc32(word.encode(), prefix)
    at = h % len(word)
    return word if h % 97 else word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, altered=with_typo) -> DataFrame:
    """(word, n) of the words of least_letters letters that occur least_count times; altered makes the word to count of a run of letters, and no longer one. Tasks hand on
    sums of at most HELD_WORDS words and those of one text."""
    runs = re.compile(f"[a-z\u00c0-\u00ff]{{{least_letters},}}")  # of lower-cased texts; shorter runs cannot become words

    def run(batches):
        counts: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = Counter(runs.findall(text.lower().decode()))  # of bytes only A-Z are lower-cased
                if doc_id is None:
                    for word, n in found.items():
                        counts[word] = counts.get(word, 0) + n
                else:
                    prefix = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in found.items():
                        word = altered(prefix, word)
                        counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long").where(F.char_length("word") >= least_letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Reduced:
    """Reduced forms of words of one length (a row of letters each): hashes of them and of their neighbours. A string's hash is the sum of its symbols' numbers times
    powers of BASE, and its length."""

    def __init__(self, letters: np.ndarray, symbols: int):
        u = np.uint64
        self.words, self.n = letters.shape
        self.symbols, self.at = symbols, letters % symbols
        self.numbers = mix(np.arange(1, symbols + 1, dtype=u) * u(0xD1342543DE82EF95))
        self.power = np.cumprod(np.r_[u(1), np.full(self.n, BASE, u)], dtype=u)
        self.here = self._sums(self.at, 0)
        self.later = self._sums(self.at, 1)  # each symbol one place on
        self.earlier = np.pad(self._sums(self.at[:, 1:], 0), ((0, 0), (1, 0)))  # each but the first one place back

    def _sums(self, at: np.ndarray, place: int) -> np.ndarray:
        return np.pad(np.cumsum(self.numbers[at] * self.power[place : place + at.shape[1]], axis=1, dtype=np.uint64), ((0, 0), (1, 0)))

    def keys(self) -> np.ndarray:
        return mix(self.here[:, -1] + np.uint64(self.n))

    def neighbours(self):
        """(word, keys) of all distinct strings at most one edit from each reduced word, in parts."""
        u, n, symbols = np.uint64, self.n, np.arange(self.symbols)
        yield np.arange(self.words), self.keys()
        for a in range(0, n + 1, CHUNK):
            i = np.arange(a, min(a + CHUNK, n))
            first = self.at[:, i] != self.at[:, np.maximum(i - 1, 0)]  # of equal symbols in a row the first goes
            first[:, i == 0] = True
            if n > 1:
                word, _ = np.nonzero(first)
                yield word, mix((self.here[:, i] + self.earlier[:, n : n + 1] - self.earlier[:, i + 1] + u(n - 1))[first])
            other = self.at[:, i, None] != symbols
            swapped = (self.here[:, -1:] - self.numbers[self.at[:, i]] * self.power[i])[:, :, None] + self.numbers * self.power[i, None]
            yield np.nonzero(other)[0], mix(swapped[other] + u(n))
            i = np.arange(a, min(a + CHUNK, n + 1))
            new = np.ones((self.words, len(i), self.symbols), bool)  # a symbol is put in behind those that equal it
            new[:, i < n] = self.at[:, i[i < n], None] != symbols
            put = (self.here[:, i] + self.later[:, n : n + 1] - self.later[:, i])[:, :, None] + self.numbers * self.power[i, None]
            yield np.nonzero(new)[0], mix(put[new] + u(n + 1))


def marks_of(letters: np.ndarray) -> np.ndarray:
    """Of words of one length: the first two letters and the last two, of which one edit leaves a pair alone, and a mask of which it changes two bits at most."""
    u = np.uint64
    mask = np.bitwise_or.reduce(u(1) << (letters % 32).astype(u), axis=1)
    first, second, third, last = ((letters[:, c] & 255).astype(u) for c in (0, min(1, letters.shape[1] - 1), max(-2, -letters.shape[1]), -1))
    return first << u(56) | second << u(48) | third << u(40) | last << u(32) | mask


def keys_of(words: DataFrame, symbols: int, neighbours: bool) -> DataFrame:
    """(key, id, marks) of words (id, word): of the reduced word, or of its whole neighbourhood. Words of one length are worked on together, CHUNK strings or one word at
    a time."""
    names = ["key", "id", "marks"]

    def run(batches):
        for batch in batches:
            ids, held = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            sizes = np.array([len(w) for w in held], np.int64)
            for n in np.unique(sizes[sizes > 0]).tolist():
                of_size, step = np.flatnonzero(sizes == n), max(1, CHUNK // (n * symbols))
                for a in range(0, len(of_size), step):
                    some = of_size[a : a + step]
                    letters = np.frombuffer("".join([held[w] for w in some.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(some), n).astype(np.int64)
                    reduced, marks = Reduced(letters, symbols), marks_of(letters).view(np.int64)
                    for word, keys in reduced.neighbours() if neighbours else [(np.arange(len(some)), reduced.keys())]:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[some[word]]), pa.array(marks[word])], names)

    return words.select("id", "word").mapInArrow(run, "key long, id long, marks long")


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter; the first difference is found by halving."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # a[:low] agrees
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n) for each pair of words (word, n) one edit apart, in both directions."""
    named = stored(words.withColumn("id", F.monotonically_increasing_id()), "words")  # stored, so a number stays with its word
    around, home = (keys_of(named, symbols, around).alias(name) for around, name in ((True, "x"), (False, "y")))
    c = F.col
    differ = c("x.marks").bitwiseXOR(c("y.marks"))
    alike = (F.bit_count(differ.bitwiseAND(0xFFFFFFFF)) <= 2) & ((F.shiftrightunsigned(differ, 48) == 0) | (F.shiftrightunsigned(differ, 32).bitwiseAND(0xFFFF) == 0))
    met = stored(around.join(home, (c("x.key") == c("y.key")) & (c("x.id") != c("y.id")) & alike).select(c("x.id").alias("a"), c("y.id").alias("b")), "candidates")

    def check(batches):
        for batch in batches:
            keep = [one_edit(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    left, right = (named.select(c("id").alias(i), c("word").alias(w), c("n").alias(n)) for i, w, n in (("a", "word", "n"), ("b", "near", "near_n")))
    pairs = met.join(left, "a").join(right, "b").select("word", "n", "near", "near_n")
    return pairs.mapInArrow(check, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): the last of the chain, by pointer doubling through stored tables."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, symbols: int = SYMBOLS, times: int = TIMES, **words_as) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary of docs (doc_id, text)."""
    words = stored(vocabulary(docs, **words_as), "vocabulary")
    order = F.struct((-F.col("near_n")).alias("n"), "near")
    best = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(order).alias("best"))
    joined = words.join(best, "word", "left")
    frequent = -F.col("best.n") >= times * F.col("n")
    named = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")), "forms")
    return named.join(roots(named.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
