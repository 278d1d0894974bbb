"""Corpus selection and benchmark construction: sections, questions, negatives, splits and section scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chance_of_hit, wilson
from ..functions.text import HAN, char_bigrams, jaccard, utf16_length
from ..sources.staged import stored
from .evaluate import null_test
from .intervals import overlap_join

# Limits, marks and wordings of the benchmark.
MAX_QUESTION_CHARS = 110
MIN_GOLD_CHARS, MAX_GOLD_CHARS = 40, 120
CLAUSE_CHARS = (8, 40)  # Han characters
GOLD_MARKS = "。；，:："
CLAUSE_MARKS = "，。；：,;:"
HANGING_ENDS = ("的", "和", "与", "或", "在", "从", "把", "被", "是")
QUESTION_WITH_TITLE = "{title} 里「{heading}」这一节讲的内容是什么？"
QUESTION_WITHOUT_TITLE = "「{heading}」这一节讲的内容是什么？"
NEGATIVE_PROBES = ("手机号", "报价", "ISO 标准编号", "随机种子")


def select_corpus(files: DataFrame, roots: list[str], suffixes: list[str], patterns: list[tuple[str, str]], min_chars: int = 800, min_pdf_bytes: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(selected, skipped with reason) of files (relative_path, size_bytes, text); the first pattern that occurs in a path gives the reason."""
    inside = F.lit(False)
    for r in roots:
        inside = inside | F.col("relative_path").startswith(r.rstrip("/") + "/") | F.lit(r == "")
    kind = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    rows = files.where(inside & F.concat(F.lit("."), kind).isin(*suffixes)).withColumn("kind", kind)
    reason = F.lit(None).cast("string")
    for pattern, why in reversed(patterns):
        reason = F.when(F.contains("relative_path", F.lit(pattern)), why).otherwise(reason)
    short = F.when((kind == "pdf") & (F.col("size_bytes") < min_pdf_bytes), "pdf-too-small").when((kind == "md") & (F.char_length("text") < min_chars), "too-short")
    rows = rows.withColumn("reason", F.coalesce(reason, short))
    selected = rows.where("reason is null").select(F.col("relative_path").alias("source"), F.regexp_replace("relative_path", "/", "__").alias("snapshot"), F.sha2("text", 256).alias("sha256"), F.char_length("text").alias("chars"), (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1).alias("lines"), "kind")
    return selected, rows.where("reason is not null").select(F.col("relative_path").alias("path"), "reason")


def corpus_snapshot_digest(files: DataFrame, tiers: list[int]) -> DataFrame:
    """Per tier: files of rank up to the tier (files has `tier_rank`), and one SHA-256 over their sorted name and hash lines."""
    each = files.withColumn("tier", F.explode(F.array(*map(F.lit, tiers)))).where(F.col("tier_rank") <= F.col("tier"))
    line = F.concat_ws("\t", "name", "sha")
    return each.groupBy("tier").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def parse_sections(documents: DataFrame) -> DataFrame:
    """Sections of documents (document_key, text): heading level 2 to 4, start to the next of its level or above, in UTF-16 units."""
    pattern = re.compile(r"^(#{2,4})\s+(.+?)\s*$", re.M)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["document_key"], batch["text"], strict=True):
                text = text or ""
                units = lambda a, b: b - a + sum(ord(c) > 0xFFFF for c in text[a:b])  # noqa: B023, E731
                at, seen, found = 0, 0, []
                for m in pattern.finditer(text):
                    seen, at = seen + units(at, m.start()), m.start()
                    found.append((len(m.group(1)), m.group(2), seen))
                total = seen + units(at, len(text))
                ends, open_ = [total] * len(found), []  # a heading closes all open ones of its level and below
                for i, (level, _, start) in enumerate(found):
                    while open_ and found[open_[-1]][0] >= level:
                        ends[open_.pop()] = start
                    open_.append(i)
                rows += [(key, i, level, heading, start, end) for i, ((level, heading, start), end) in enumerate(zip(found, ends, strict=True))]
            yield pd.DataFrame(rows, columns=["document_key", "position", "level", "heading", "start", "end"]).astype({c: "int32" for c in ("position", "level", "start", "end")})

    return documents.select("document_key", "text").mapInPandas(run, "document_key string, position int, level int, heading string, start int, end int")


def heading_uniqueness(sections: DataFrame) -> DataFrame:
    """Per heading: occurrences, documents, eligible (once overall), repeated in one document."""
    return sections.groupBy("heading").agg(F.count("*").alias("occurrences"), F.count_distinct("document_key").alias("documents")).withColumn("eligible", F.col("occurrences") == 1).withColumn("in_several", F.col("documents") > 1).withColumn("repeated_within", F.col("occurrences") > F.col("documents"))


def usable_gold(body: Column) -> Column:
    """40 to 120 characters of prose: no fence, no table row, no heading, some clause mark."""
    b = F.trim(body)
    return F.char_length(b).between(MIN_GOLD_CHARS, MAX_GOLD_CHARS) & ~F.contains(b, F.lit("```")) & ~b.rlike(r"^[|#]") & b.rlike(f"[{GOLD_MARKS}]")


def heading_questions(sections: DataFrame, chunks: DataFrame, per_doc: int = 8, with_title: bool = True) -> DataFrame:
    """One labelled question per unique heading whose section holds usable chunks; gold is the middle one. At most per_doc per document, in order."""
    eligible = sections.join(heading_uniqueness(sections).where("eligible").select("heading"), "heading").where(F.char_length("heading").between(4, 40) & F.col("heading").rlike(f"[{HAN}]"))
    usable = chunks.where(usable_gold(F.col("body"))).select("document_key", "chunk_index", "start_offset", "end_offset", "body")
    inside = overlap_join(usable, eligible, ["document_key"], ("start_offset", "end_offset"), ("start", "end")).where((F.col("start_offset") >= F.col("start")) & (F.col("end_offset") <= F.col("end")))
    by = Window.partitionBy("document_key", "position")
    middle = inside.withColumn("_r", F.row_number().over(by.orderBy("start_offset")) - 1).withColumn("_n", F.count("*").over(by)).where(F.col("_r") == F.floor(F.col("_n") / 2))
    title = F.regexp_extract("document_key", r"([^/]+?)(?:\.[^./]*)?$", 1)
    asked = F.lit(QUESTION_WITH_TITLE if with_title else QUESTION_WITHOUT_TITLE)
    question = F.replace(F.replace(asked, F.lit("{title}"), title), F.lit("{heading}"), F.col("heading"))
    rows = middle.withColumn("question", question).where(F.char_length("question") <= MAX_QUESTION_CHARS)
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("document_key").orderBy("position"))).where(F.col("_k") <= per_doc)
    location = F.format_string("%s#page=null;textUnit=utf16CodeUnit;start=%d;end=%d", "document_key", "start_offset", "end_offset")
    return first.select("document_key", "position", "heading", "question", "chunk_index", F.col("body").alias("evidence_text"), location.alias("evidence_location"))


def clause_of(body: Column) -> Column:
    """The longest balanced clause of 8 to 40 Han characters; null if it hangs on a particle or there is none."""
    count = lambda c, x: F.char_length(c) - F.char_length(F.replace(c, F.lit(x)))
    parts = F.transform(F.split(F.trim(body), f"[{CLAUSE_MARKS}]"), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: F.char_length(F.regexp_replace(p, f"[^{HAN}]", "")).between(*CLAUSE_CHARS) & (count(p, "(") == count(p, ")")) & (count(p, "（") == count(p, "）")) & (count(p, "「") == count(p, "」")) & (count(p, "`") % 2 == 0) & ~p.rlike(r"^[|#*-]"))
    longest = F.aggregate(good, F.lit(None).cast("string"), lambda acc, p: F.when(acc.isNull() | (F.char_length(p) > F.char_length(acc)), p).otherwise(acc))
    hangs = F.lit(False)
    for end in HANGING_ENDS:
        hangs = hangs | longest.endswith(end)
    return F.when(~F.contains(body, F.lit("```")) & ~hangs, longest)


GATE_BITS, SLICE_CHARS = 26, 1 << 20  # the bitmap has 8 MB
ODD, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Windows:
    """Hashes of the runs of n code points of some texts, in the order of the texts' code points, from one prefix sum over all."""

    def __init__(self, texts: pa.Array):
        self.sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
        self.text = "".join(texts.to_pylist())
        chars = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(MIX)
        chars ^= chars >> np.uint64(32)
        self.ends = np.repeat(np.cumsum(self.sizes), self.sizes)  # of the text of each code point
        power = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(len(chars), x, np.uint64)])  # noqa: E731  modulo 2^64
        self.sums, self.back = np.r_[np.uint64(0), np.cumsum(chars * power(ODD)[:-1], dtype=np.uint64)], power(pow(ODD, -1, 1 << 64))

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        h = (self.sums[at + n] - self.sums[at]) * self.back[at]
        return (h ^ (h >> np.uint64(29))) * np.uint64(MIX)


def _gate_of(clauses: DataFrame) -> np.ndarray:
    """The bitmap of the hashes of clauses and of their first characters: at most 2^GATE_BITS / 64 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _Windows(batch.column(0))
            at = np.cumsum(w.sizes) - w.sizes
            place = np.unique(np.r_[w.hashes(at, CLAUSE_CHARS[0]), w.hashes(at, w.sizes) * np.uint64(ODD)] >> np.uint64(64 - GATE_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place)], ["place"])

    word = clauses.select("clause").mapInArrow(run, "place long").groupBy(F.shiftright("place", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    gate = np.zeros(1 << (GATE_BITS - 6), np.uint64)
    gate[word["w"].to_numpy()] = word["bits"].to_numpy().view(np.uint64)
    return gate


def _held_clauses(chunks: DataFrame, gate: np.ndarray, lengths: list[int]) -> DataFrame:
    """(clause, row_id): the runs of code points of bodies that have the length of a clause and pass the bitmap, as their first characters do; all clauses that a body holds are among them."""
    shared = chunks.sparkSession.sparkContext.broadcast(gate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = shared.value
        passes = lambda h: (gate[h >> np.uint64(70 - GATE_BITS)] >> ((h >> np.uint64(64 - GATE_BITS)) & np.uint64(63)) & np.uint64(1)).astype(bool)
        for batch in batches:
            group = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy()) // SLICE_CHARS
            for g in np.unique(group):
                a, b = np.searchsorted(group, [g, g + 1])
                w = _Windows(batch.column(1).slice(a, b - a))
                ids = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), w.sizes)
                at = np.flatnonzero(np.arange(len(ids)) + CLAUSE_CHARS[0] <= w.ends)
                at = at[passes(w.hashes(at, CLAUSE_CHARS[0]))]
                for n in lengths:
                    own = at[at + n <= w.ends[at]]
                    own = own[passes(w.hashes(own, n) * np.uint64(ODD))]  # apart from those of first characters
                    yield pa.RecordBatch.from_arrays([pa.array([w.text[i : i + n] for i in own.tolist()], pa.string()), pa.array(ids[own])], ["clause", "row_id"])

    return chunks.where("body is not null and row_id is not null").select(F.col("row_id").cast("long").alias("row_id"), "body").mapInArrow(run, "clause string, row_id long")


def verbatim_questions(gold: DataFrame, chunks: DataFrame, per_doc: int = 8) -> DataFrame:
    """Clauses of gold chunks that occur in exactly one chunk; at most max(1, per_doc // 2) per document.

    Bodies are read where they lie, behind a bitmap of all clauses; only runs that pass it, nearly all of them clauses, are shuffled, the least and the greatest row of each.
    A bitmap too full lets more runs pass, which the join on the clause's text leaves out.
    """
    clauses = stored(gold.select("document_key", "chunk_index", clause_of(F.col("body")).alias("clause")).where("clause is not null"), "clauses")
    distinct = clauses.select("clause").distinct()
    lengths = sorted(r[0] for r in distinct.select(F.char_length("clause")).distinct().collect())  # of one clause, at most MAX_GOLD_CHARS where gold is usable
    held = _held_clauses(chunks, _gate_of(distinct), lengths)
    once = held.groupBy("clause").agg(F.min("row_id").alias("_a"), F.max("row_id").alias("_b")).where("_a = _b").select("clause")
    return clauses.join(once, "clause").withColumn("_k", F.row_number().over(Window.partitionBy("document_key").orderBy("chunk_index"))).where(F.col("_k") <= max(1, per_doc // 2)).select("document_key", "chunk_index", F.col("clause").alias("question"))


def verified_negatives(candidates: DataFrame, chunks: DataFrame, limit: int = 24, probes: tuple[str, ...] = NEGATIVE_PROBES) -> DataFrame:
    """candidates (position, question) whose probe term occurs in no chunk; distinct texts, the first `limit` by position."""
    probe = F.lit(None).cast("string")
    for p in reversed(probes):
        probe = F.when(F.contains("question", F.lit(p)), p).otherwise(probe)
    listed = F.array(*map(F.lit, probes))
    present = chunks.select(F.explode(F.filter(listed, lambda p: F.contains("body", p))).alias("probe")).distinct()
    kept = candidates.withColumn("probe", probe).where("probe is not null").join(F.broadcast(present), "probe", "left_anti")
    first = kept.groupBy("question").agg(F.min("position").alias("position"), F.min_by("probe", "position").alias("probe"))
    return first.orderBy("position").limit(limit)


def lexical_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add overlap (Jaccard of character pairs) and its bucket."""
    o = jaccard(char_bigrams(F.col(a)), char_bigrams(F.col(b)))
    return df.withColumn("overlap", o).withColumn("bucket", F.when(F.col("overlap") >= 0.5, "high").when(F.col("overlap") >= 0.2, "middle").otherwise("low"))


def assign_split(questions: DataFrame, ratio: float = 0.67, seed: int = 42) -> DataFrame:
    """Add split and id to questions (question, answerable): the first floor(ratio * n) answerable ones by seeded hash are dev; every third negative is holdout.

    Ranks are taken in 4096 ranges of the hash and shifted by the counts of the ranges before.
    """
    rows = questions.withColumn("_k", F.sha2(F.concat(F.lit(f"{seed}|"), "question"), 256)).withColumn("_b", F.substr("_k", F.lit(1), F.lit(3)))
    counts = rows.groupBy("answerable", "_b").agg(F.count("*").alias("_c"))
    of = Window.partitionBy("answerable")
    before = counts.select("answerable", "_b", F.coalesce(F.sum("_c").over(of.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(of).alias("_n"))
    answerable = counts.agg(F.coalesce(F.sum(F.when(F.col("answerable"), F.col("_c"))), F.lit(0)).alias("_a"))
    rows = rows.join(F.broadcast(before), ["answerable", "_b"]).crossJoin(F.broadcast(answerable))
    rows = rows.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("answerable", "_b").orderBy("_k", "question")))
    dev = F.when(F.col("answerable"), F.col("_r") <= F.floor(F.lit(ratio) * F.col("_n"))).otherwise((F.col("_r") - 1) % 3 != 0)
    number = F.when(F.col("answerable"), F.col("_r")).otherwise(F.col("_a") + F.col("_r"))
    return rows.withColumn("split", F.when(dev, "dev").otherwise("holdout")).withColumn("id", F.format_string("w5-%03d", number)).select(*questions.columns, "split", "id")


def locate_section(labels: DataFrame, sections: DataFrame) -> DataFrame:
    """labels (question_id, document_key, heading, span_start, span_end) with the one section of that heading that holds the span."""
    matched = labels.join(sections.select("document_key", "heading", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "level"), ["document_key", "heading"]).where((F.col("s_start") <= F.col("span_start")) & (F.col("span_end") <= F.col("s_end")))
    one = matched.groupBy("question_id").agg(F.count("*").alias("_n"), F.min("s_start").alias("s_start"), F.min("s_end").alias("s_end")).where("_n = 1").drop("_n")
    return labels.join(one, "question_id", "left").withColumn("resolved", F.col("s_start").isNotNull())


def section_ranks(hits: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per question and arm: best rank of a hit of the gold document that meets the section, and of one that starts inside it (0: none)."""
    joined = hits.join(bounds.where("resolved").select("question_id", F.col("document_key").alias("gold"), "s_start", "s_end"), "question_id")
    own = F.col("document_key") == F.col("gold")
    meets = own & (F.col("end_offset") > F.col("start_offset")) & (F.col("start_offset") < F.col("s_end")) & (F.col("s_start") < F.col("end_offset"))
    starts = own & (F.col("start_offset") > F.col("s_start")) & (F.col("start_offset") < F.col("s_end"))
    least = lambda c: F.coalesce(F.min(F.when(c, F.col("rank"))), F.lit(0))
    return joined.groupBy("question_id", "arm").agg(least(meets).alias("section_rank"), least(starts).alias("body_rank"))


def section_summary(ranks: DataFrame, cut: int = 5) -> DataFrame:
    """Per arm and family of ranks (doc_rank, span_rank, section_rank, body_rank, heading_line_chars, heading): hit rates with an interval and misses by cause."""
    within = lambda c: (F.col(c) > 0) & (F.col(c) <= cut)
    line_only = within("section_rank") & ~within("body_rank")
    pure = line_only & (F.col("heading_line_chars") <= utf16_length("heading") + 6)
    out = ranks.groupBy("arm", "family").agg(
        F.count("*").alias("n"), F.count_if(within("doc_rank")).alias("doc_hits"), F.count_if(within("span_rank")).alias("span_hits"), F.count_if(within("body_rank")).alias("body_hits"), F.count_if(within("section_rank")).alias("section_hits"),
        F.count_if(pure).alias("pure_heading_lines"), F.count_if(line_only & ~pure).alias("longer_heading_lines"), F.count_if(F.col("doc_rank") == 0).alias("no_document"), F.count_if(within("doc_rank") & ~within("section_rank")).alias("wrong_section"),
    )
    ci = wilson(F.col("body_hits"), F.col("n"))
    return out.withColumn("body_low", ci["low"]).withColumn("body_high", ci["high"])


def section_lengths(bounds: DataFrame) -> DataFrame:
    """One row: n, least, upper median, ninetieth (element floor(0.9 n)) and longest section."""
    of = bounds.where("resolved").select((F.col("s_end") - F.col("s_start")).alias("l"))
    at = lambda share: F.expr(f"percentile_disc({share}) within group (order by l desc)")  # noqa: E731  counted from above, so halves fall to the upper side
    return of.agg(F.count("*").cast("int").alias("n"), F.min("l").alias("length_min"), at(0.5).alias("length_p50"), at(0.1).alias("length_p90"), F.max("l").alias("length_max"))


def section_chance(bounds: DataFrame, index: DataFrame, body_ranks: DataFrame, cut: int = 5) -> DataFrame:
    """Per arm: questions, hits, mean chance that a uniform draw of the text pool starts inside the section, and P(X >= hits)."""
    text = index.where("space = 'documentText'")
    pool = text.agg(F.count("*").alias("pool"))
    starts = text.select("document_key", F.col("start_offset"), (F.col("start_offset") + 1).alias("_next"))
    inside = overlap_join(starts, bounds.where("resolved"), ["document_key"], ("start_offset", "_next"), ("s_start", "s_end")).where(F.col("start_offset") > F.col("s_start")).groupBy("question_id").agg(F.count("*").alias("relevant"))
    chances = bounds.where("resolved").select("question_id").join(inside, "question_id", "left").crossJoin(F.broadcast(pool)).withColumn("chance", chance_of_hit(F.col("pool"), F.coalesce("relevant", F.lit(0)), cut))
    rows = body_ranks.join(chances, "question_id").withColumn("hit", ((F.col("body_rank") > 0) & (F.col("body_rank") <= cut)).cast("int"))
    return null_test(rows)


def wrong_section_examples(hits: DataFrame, bounds: DataFrame, index: DataFrame, arm: str = "A1", cut: int = 5) -> DataFrame:
    """First gold-document hit, with its body, of questions whose file is in the cut but which no hit answers from the section."""
    ranks = section_ranks(hits, bounds).where((F.col("arm") == arm) & (F.col("section_rank") == 0)).select("question_id")
    own = hits.where((F.col("arm") == arm) & (F.col("rank") <= cut)).join(bounds.where("resolved").select("question_id", F.col("document_key").alias("gold")), "question_id").where(F.col("document_key") == F.col("gold"))
    first = own.join(ranks, "question_id").groupBy("question_id").agg(F.min_by(F.struct("document_key", "start_offset", "end_offset", "rank"), "rank").alias("h")).select("question_id", "h.*")
    return first.join(index.select("document_key", "start_offset", "end_offset", "body"), ["document_key", "start_offset", "end_offset"], "left").withColumn("at_zero", F.col("start_offset") == 0)
