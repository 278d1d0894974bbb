"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Statistics of whole texts are taken in Arrow batches. The list is grown on a bounded sample of labelled
documents (`sample_rows`) that pass the base rule, one rule at a time: a conjunction of thresholds grows while it gains, is pruned on
held-out rows, and the rows it covers leave. The list is emitted as one ordered Spark conditional expression.

Edge cases: null or empty text has zero words and fails the base rule; labels with a null id or verdict are
ignored and a document labelled twice counts as bad if either label is; with no labels, or labels of one
verdict only, the list is empty and everything that passes the base rule is kept. Extra columns of the input
stay out of the statistics; `filter_documents` keeps them all and never adds any.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_marks", "n_lines")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
SPACES, SYMBOLS, MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS = UPPER + bytes(range(97, 123))


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts named in COUNTS, of one whole text."""
    words = words_of(text)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    continued = _count(text, bytes(range(0x80, 0xC0)))
    return (
        len(words), len(text) - continued - _count(text, SPACES), _count(text, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        _count(text, UPPER), _count(text, LETTERS), _count(text, DIGITS), _count(text, MARKS), len(lines),
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            rows = [text_stats(t) for t in texts(batch.column(1))]
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STATS_SCHEMA)


def _over(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """The interpretable statistics that rules may test, from COUNTS; none grows with a text's length, so long clean texts are safe."""
    return {
        "symbols_per_word": _over("n_symbols", "n_words"),
        "marks_per_word": _over("n_marks", "n_words"),
        "chars_per_word": _over("word_chars", "n_words"),
        "upper_share": _over("n_upper", "n_letters"),
        "digits_share": _over("n_digits", "word_chars"),
        "repeat_share": _over("n_repeat_words", "n_words"),
        "dup_line_share": _over("n_dup_lines", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """If all (feature, at_least, threshold) hold, then the verdict is `bad`."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, at_least, threshold in self.tests:
            out = out & (columns[name] >= threshold if at_least else columns[name] <= threshold)
        return out

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, at_least, threshold in self.tests:
            v = x[:, names.index(name)]
            out &= v >= threshold if at_least else v <= threshold
        return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], max_tests: int) -> tuple[tuple[str, bool, float], ...]:
    tests: list[tuple[str, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(tests) < max_tests and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = (1e-9, None)
        for j, name in enumerate(names):
            order = np.argsort(x[inside, j], kind="stable")
            values, marks = x[inside, j][order], bad[inside][order]
            cuts = np.flatnonzero(values[1:] != values[:-1])
            if not len(cuts):
                continue
            below_p = np.cumsum(marks)[cuts]
            below_n = cuts + 1 - below_p
            for at_least, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, at_least, float((values[cuts[k]] + values[cuts[k] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside = Rule(tuple(tests)).covers(x, names)
    return tuple(tests)


def _prune(tests: tuple, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    def worth(k: int) -> float:
        c = Rule(tests[:k]).covers(x, names)
        p, n = bad[c].sum(), (~bad[c]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return Rule(tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))])


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, max_tests: int = 4, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Sequential covering: rules for `bad` rows, each at least so precise on all rows that are left."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and bad[left].sum() >= least and (~bad[left]).any():
        grow, held = left & (part != 0), left & (part == 0)
        if not bad[grow].any() or not (tests := _grow(x[grow], bad[grow], names, max_tests)):
            break
        rule = _prune(tests, x[held], bad[held], names)
        covered = rule.covers(x, names) & left
        if covered.sum() < least or bad[covered].mean() < precision:
            rule = Rule(tests)
            covered = rule.covers(x, names) & left
            if covered.sum() < least or bad[covered].mean() < precision:
                break
        rules.append(rule)
        left &= ~covered
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, **options) -> list[Rule]:
    """Learn from the `sample_rows` labelled documents of smallest id hash; the driver gets their statistics only."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    voted = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    voted = voted.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels of absent documents take no place in the sample
    share = max(1, voted.count() // (4 * sample_rows))  # keeps what the limit looks at bounded
    chosen = voted.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    verdict = {r["doc_id"]: r["quality"] for r in chosen}
    if len(set(verdict.values())) < 2:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in verdict], "doc_id long")
    columns = features()
    rows = document_stats(docs.join(F.broadcast(ids), "doc_id", "left_semi")).where(~base_failed()).select("doc_id", *[c.alias(k) for k, c in columns.items()]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    if not rows:
        return []
    names = list(columns)
    x = np.array([[float(r[n]) for n in names] for r in rows])
    return learn_rules(x, np.array([verdict[r["doc_id"]] == 0 for r in rows]), names, **options)


def verdict_column(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: name of the first rule that holds, else null."""
    columns, out = features(), None
    for i, rule in enumerate(rules):
        test, says = rule.column(columns), F.lit(f"rule_{i}")
        out = F.when(test, says) if out is None else out.when(test, says)
    return F.lit(None).cast("string") if out is None else out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> DataFrame:
    """One row per document: counts, base_failed, the rule that rejects it (null: none) and kept."""
    rules = fit_rules(docs, labels, sample_rows)
    return document_stats(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict_column(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def filter_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> DataFrame:
    """The documents that are kept, with all their columns."""
    rules = fit_rules(docs, labels, sample_rows)
    names = docs.columns

    def run(batches):
        at = names.index("text")
        for batch in batches:
            rows = [text_stats(t) for t in texts(batch.column(at))]
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]
            packed = pa.StructArray.from_arrays(columns, list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*(f"c{i}" for i in range(len(names))), "stats"])

    schema = ", ".join(chain((f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes)), ["stats struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"]))
    with_stats = docs.mapInArrow(run, schema).select(*[f"c{i}" for i in range(len(names))], "stats.*")
    kept = with_stats.where(~base_failed() & verdict_column(rules).isNull())
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
