"""Spelling variants, line dedup and periodic runs against brute force, and on nulls, empty tables, ties, repeats, very long texts and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lines, runs, spelling

DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- spelling variants


def brute_near(a, b):
    """Whether b is among all strings one edit from a, made by position."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in words if brute_near(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: x for w, x in form.items() if words[x] >= 2 * words[w]}
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def variant_rows(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abdeÀéÿ×", k=rng.randint(4, 9))) for _ in range(12)]
    vocabulary = list(stems)
    for _ in range(160):
        w = rng.choice(vocabulary)
        i = rng.randrange(len(w))
        vocabulary.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeiouü") + w[i:], w[:i] + rng.choice("aeiouü") + w[i + 1 :]]) or "x")
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    rows = [(i, rng.choice([" ", "-", "\n", "1"]).join(rng.choices(vocabulary, weights, k=120))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "12 µ !"), (None, rows[0][1]), rows[3], (3, rows[4][1].upper())]


@pytest.mark.parametrize("symbols", [8, 2])
def test_variants_against_brute_force(spark, symbols):
    rows = variant_rows(symbols)
    found = spelling.spelling_variants(spark.createDataFrame(rows, DOCS).repartition(4), symbols=symbols).collect()
    want = brute_variants(rows)
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert sum(r["form"] is not None for r in found) > 10 and any(r["root"] != r["form"] for r in found if r["form"])


def test_variants_edges(spark):
    assert spelling.spelling_variants(empty(spark)).count() == 0
    tied = [(None, "bcdefg " * 2 + "bcdef " * 4 + "bcdeg " * 4 + "bcdegg bcdegg")]
    named = lambda df: {r["word"]: (r["form"], r["root"], r["n"], r["n_near"]) for r in df.collect()}
    docs = spark.createDataFrame(tied, DOCS).withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("id", F.lit(None).cast("string"))
    assert named(spelling.spelling_variants(docs)) == {"bcdef": (None, "bcdef", 4, 1), "bcdeg": (None, "bcdeg", 4, 1)}
    assert named(spelling.spelling_variants(docs, least_count=2))["bcdefg"] == ("bcdef", "bcdef", 2, 3)  # bcdef and bcdeg tie


def test_variants_of_very_long_words(spark):
    """A word of 20,000 letters has 300,000 neighbours; they are never written out."""
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh", k=20_000))
    other = long[:7000] + "z" + long[7000:]
    rows = spark.createDataFrame([(None, f"{long} {long} {long} {other} {other} {other} {other} {other} {other}")], DOCS)
    found = {len(r["word"]): (len(r["form"] or ""), r["n_near"]) for r in spelling.spelling_variants(rows).collect()}
    assert found == {20_000: (20_001, 1), 20_001: (0, 1)}


@pytest.mark.parametrize("symbols", [1, 2, 5])
def test_reduced_neighbourhood_is_full_and_distinct(symbols):
    rng = random.Random(symbols)
    key = lambda s: int(spelling.Reduced(np.array([s], np.int64), symbols).keys()[0]) if s else None
    for n in range(1, 9):
        words = [[rng.randrange(symbols) for _ in range(n)] for _ in range(3)]
        owner, made = (np.concatenate(x) for x in zip(*spelling.Reduced(np.array(words, np.int64), symbols).neighbours(), strict=True))
        for k, word in enumerate(words):
            want = {tuple(word)} | {tuple(word[:i] + word[i + 1 :]) for i in range(n)} | {(*word[:i], c, *word[i + d :]) for d in (0, 1) for i in range(n + 1 - d) for c in range(symbols)}
            keys = made[owner == k].tolist()
            assert len(keys) == len(set(keys)) and set(keys) == {key(list(w)) for w in want if w}


def test_pairs_are_met_by_key_only(spark):
    """No cross join: the neighbourhood meets the vocabulary by an equi-join on the key."""
    words = spark.createDataFrame([("abcde", 3), ("abcdf", 9)], "word string, n long")
    plan = spelling.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- line dedup


def brute_lines(rows, least_chars, least_docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        gone = lambda x: doc_id is not None and len(holders.get(key(x), ())) >= least_docs and doc_id < max(holders[key(x)])  # noqa: B023, E731
        kept = [x for x in all_lines if not gone(x)]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def line_rows(seed):
    rng = random.Random(seed)
    pool = ["Accept all the Cookies", "  accept all the cookies\t", "ÉCOUTEZ la suite", "écoutez la suite", "short", "", " ", "x ", "Accept all the Cookies\r"] + [f"a line numbered {i}" for i in range(20)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.choice([1, 4, 30, 200])))) for i in range(50)]
    return [*rows, (50, None), (51, ""), (52, "\n"), (None, rows[0][1]), rows[5], (6, rows[7][1])]


@pytest.mark.parametrize(("least_chars", "least_docs"), [(10, 5), (16, 2), (1, 20)])
def test_lines_against_brute_force(spark, least_chars, least_docs):
    rows = line_rows(least_docs)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("position", F.lit("x")).withColumn("form", F.lit(1)).withColumn("line", F.lit(None).cast("string"))
    found = lines.line_report(docs, least_chars, least_docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_lines(rows, least_chars, least_docs)
    assert any(r["n_dropped"] for r in found)


def test_line_bitmaps(spark):
    """Only words that lose a line are in a bitmap; bits that are set stay."""
    often = "the same line in every document"
    rows = [(i, "\n".join([often] * 3 + [f"own {i} {j}" for j in range(200)] + [often])) for i in range(6)]
    found = lines.keep_bitmaps(spark.createDataFrame(rows, DOCS), 20, 5).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 1, 2, 3, 4]
    for r in found:
        assert r["n_dropped"] == 4 and [(w["word"], ~w["bits"] & (1 << 64) - 1) for w in r["kept"]] == [(0, 7), (3, 1 << 203 % 64)]
    assert lines.keep_bitmaps(empty(spark)).count() == 0 and lines.line_report(empty(spark)).count() == 0


def test_a_line_of_very_many_documents_is_dealt_out(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that every document of the table holds\n"), F.col("id").cast("string")).alias("text"))
    assert lines.line_report(rows).where("n_dropped = 1").count() == 2999
    plan = lines.frequent_lines(lines.long_lines(rows, 40), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") >= 1 and plan.count("Exchange hashpartitioning") <= 1  # streamed where it was dealt by range; one more exchange for the sums


def test_lines_of_a_very_long_text(spark):
    """200,000 lines in one text, half of them frequent: time grows with the lines."""
    long = "\n".join(f"this line stands in every one of the six documents {i // 2}" if i % 2 else f"own {i}" for i in range(200_000))
    docs = spark.createDataFrame([(i, long) for i in range(6)], DOCS)
    start = time.perf_counter()
    found = lines.line_report(docs).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in found} == {i: 100_000 * (i < 5) for i in range(6)} and time.perf_counter() - start < 60
    assert found[0]["n_lines"] == 200_000 and {r["kept_sha256"] for r in found if r["doc_id"] < 5} == {sha("\n".join(long.split("\n")[::2]))}


def test_lines_run_in_the_jvm(spark):
    plan = lines.remove_lines(spark.createDataFrame(line_rows(1), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- periodic runs


def brute_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            if i > start and len(stretch) >= max(least, times * q) and not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                out.append((start, len(stretch), q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = [rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randrange(len(words) + 1)
            block = rng.choices("abc", k=rng.randint(1, 9))
            words[a:a] = (block * 8)[: rng.randint(len(block), 7 * len(block))]
        yield words


def test_runs_against_brute_force():
    for words in run_texts(1, 1500):
        assert [tuple(r) for r in runs.find_runs(runs.word_numbers(words)).tolist()] == brute_runs(words), words


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a, old = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [old[a + (i - a) % p] if i >= a else old[i] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    return doc_id, len(found), *best, found and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept))


def test_run_report_against_brute_force(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(run_texts(2, 300))]
    rows += [(300, None), (301, ""), (302, " \t"), (None, "a b " * 9), rows[3], (3, rows[4][1]), (303, "Ａ é " * 30)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("x")).withColumn("period", F.lit(None).cast("int"))
    found = runs.run_report(docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted((brute_report(*r) for r in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in found) > 50
    assert runs.run_report(empty(spark)).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (2, " kept  as it is "), (3, None), (4, "z z\nz z z z")], DOCS)
    assert {tuple(r) for r in runs.periodic_runs(docs).collect()} == {(1, 1, 15, 3), (4, 0, 6, 1)}
    assert dict(map(tuple, runs.collapse_runs(docs).collect())) == {1: "x a b c y", 2: " kept  as it is ", 3: None, 4: "z"}


@pytest.mark.parametrize("words", [lambda n: np.zeros(n, np.int64), lambda n: np.random.default_rng(3).integers(0, 2, n), lambda n: np.arange(n) % (n // 5), lambda n: np.array([bin(i).count("1") % 2 for i in range(n)], np.int64)], ids=["one word", "two words", "long period", "overlap-free"])
def test_runs_of_very_long_texts(words):
    """Texts of hot words: pairs grow with the text, not with the square of a word's occurrences."""
    start = time.perf_counter()
    found = runs.find_runs(words(300_000))
    assert time.perf_counter() - start < 20
    assert all(length >= max(6, 4 * period) for _, length, period in found.tolist())
