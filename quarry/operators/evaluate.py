"""Retrieval quality: matching, metrics, failure classes, chance baselines and attributions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chance_of_hit, poisson_binomial_tail, wilson
from ..functions.text import HAN, slashes
from .blocks import each, matrix, products
from .query import ARMS

TEXT_MODALITIES = ("text", "table", "code")


def doc_matches(key: Column, file_name: Column | None, target: Column) -> Column:
    """Whether target names the hit's document: equal to its key, or ending with /key or /file name."""
    k = slashes(key)
    name = F.coalesce(file_name if file_name is not None else F.lit(None).cast("string"), F.element_at(F.split(k, "/"), -1))
    return F.coalesce((target == k) | F.endswith(target, F.concat(F.lit("/"), k)) | F.endswith(target, F.concat(F.lit("/"), name)), F.lit(False))


def names_of(key: Column, file_name: Column) -> Column:
    """The names by which a target can end if it names the document: a join on the target's last part finds all that doc_matches does."""
    return F.array_distinct(F.array_compact(F.array(F.element_at(F.split(slashes(key), "/"), -1), file_name)))


def last_part(target: Column) -> Column:
    return F.element_at(F.split(target, "/"), -1)


def targets_of(labels: DataFrame) -> Column:
    many = F.coalesce("relevant_document_ids", F.array().cast("array<string>"))
    return F.when(F.size(many) > 0, many).otherwise(F.array_compact(F.array("relevant_document_id")))


def retrieval_metrics(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Per arm and split from hits (question_id, arm, rank, document_key, file_name) and questions (question_id, arm, split, targets)."""
    asked = questions.select("question_id", "arm", "split", F.size("targets").alias("_n"), F.explode_outer("targets").alias("target"))
    joined = asked.join(hits.select("question_id", "arm", "rank", "document_key", "file_name"), ["question_id", "arm"], "left").withColumn("_m", doc_matches(F.col("document_key"), F.col("file_name"), F.col("target")))
    found = lambda cut: F.count_distinct(F.when(F.col("_m") & (F.col("rank") <= cut), F.col("target")))
    per = joined.groupBy("question_id", "arm", "split").agg(F.max("_n").alias("_n"), F.min(F.when(F.col("_m"), F.col("rank"))).alias("first"), found(5).alias("f5"), found(10).alias("f10"))
    hit = F.coalesce(F.col("first") <= 5, F.lit(False))
    out = per.groupBy("arm", "split").agg(
        F.count("*").alias("n"), F.count_if(F.col("_n") > 1).alias("multi_target"), F.count_if(hit).alias("hits_at_5"),
        F.avg(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)).alias("mrr_at_10"),
        F.avg(F.coalesce(F.try_divide("f5", "_n"), F.lit(0.0))).alias("recall_at_5"), F.avg(F.coalesce(F.try_divide("f10", "_n"), F.lit(0.0))).alias("recall_at_10"),
    )
    ci = wilson(F.col("hits_at_5"), F.col("n"))
    return out.withColumn("hit_at_5", F.col("hits_at_5") / F.col("n")).withColumn("ci_low", ci["low"]).withColumn("ci_high", ci["high"])


def latency_summary(probe: DataFrame) -> DataFrame:
    """Medians per arm of probe rows (arm, position, encode_ms, store_ms, fuse_ms); the first row's encoding counts only where it is alone. Positions of an arm differ."""
    rows = probe.join(probe.groupBy("arm").agg(F.min("position").alias("_first"), F.count("*").alias("_n")), "arm")
    median = lambda c: F.percentile(c, F.lit(0.5))
    warm = F.when((F.col("position") > F.col("_first")) | (F.col("_n") == 1), F.col("encode_ms"))
    return rows.groupBy("arm").agg(F.count("*").alias("n"), median(warm).alias("encode_p50"), median(F.col("store_ms")).alias("store_p50"), median(F.col("fuse_ms")).alias("fuse_p50"))


def run_integrity(probe: DataFrame, params: DataFrame, frozen: DataFrame) -> DataFrame:
    """Per arm: rows, repeated question ids, splits; and how many frozen parameters differ."""
    arms = probe.groupBy("arm").agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("question_id")).alias("duplicates"), F.count_distinct("split").alias("splits"))
    changed = frozen.select("name", F.col("value").alias("_f")).join(params.select("name", "value"), "name", "left").agg(F.count_if(F.coalesce(F.abs(F.col("value") - F.col("_f")) > 1e-9, F.lit(True))).alias("changed_params"))
    return arms.crossJoin(F.broadcast(changed)).withColumn("sound", (F.col("duplicates") == 0) & (F.col("splits") == 1) & (F.col("changed_params") == 0))


def parse_locations(labels: DataFrame, column: str = "evidence_locations") -> DataFrame:
    """One row per location: position, doc, kind (file, span, metadata), page, span_start, span_end, fragment."""
    rows = labels.select("*", F.posexplode(column).alias("position", "_l"))
    doc, fragment = F.substring_index("_l", "#", 1), F.when(F.instr("_l", "#") > 0, F.expr("substr(_l, instr(_l, '#') + 1)"))
    out = rows.withColumn("doc", doc).withColumn("fragment", fragment).withColumn("_m", F.str_to_map(F.coalesce("fragment", F.lit("")), F.lit(";"), F.lit("=")))
    get = lambda k: F.try_element_at("_m", F.lit(k))
    number = lambda k: F.expr(f"try_cast(_m['{k}'] as int)")
    spans = number("start").isNotNull() & number("end").isNotNull()
    page = F.when(~F.coalesce(get("page"), F.lit("")).isin("", "null", "None"), number("page"))
    return out.withColumn("kind", F.when(F.col("fragment").isNull(), "file").when(spans, "span").otherwise("metadata")).withColumn("page", page).withColumn("span_start", F.when(spans, number("start"))).withColumn("span_end", F.when(spans, number("end"))).drop("_l", "_m")


def span_overlaps(start: Column, end: Column, page: Column, gold_start: Column, gold_end: Column, gold_page: Column, tolerance: int = 0) -> Column:
    """Whether a hit's span meets a gold span on the gold page, if there is one; an empty hit span never does."""
    meets = (end > start) & (start < gold_end + tolerance) & (gold_start - tolerance < end)
    return F.coalesce(meets & (gold_page.isNull() | gold_page.eqNullSafe(page)), F.lit(False))


def gold_chunk(locations: DataFrame, index: DataFrame) -> DataFrame:
    """The text chunk that is a label's first span: (question_id, gold_chunk_index, gold_page)."""
    first = locations.where("position = 0 and kind = 'span'").select("question_id", "doc", "span_start", "span_end")
    chunks = index.where("space = 'documentText'").select("row_id", "document_key", "file_name", "chunk_index", "page_number", F.col("start_offset").alias("span_start"), F.col("end_offset").alias("span_end"))
    named = chunks.withColumn("_name", F.explode(names_of(F.col("document_key"), F.col("file_name"))))
    matched = first.withColumn("_name", last_part(F.col("doc"))).join(named, ["_name", "span_start", "span_end"]).where(doc_matches(F.col("document_key"), F.col("file_name"), F.col("doc")))
    return matched.groupBy("question_id").agg(F.min_by(F.struct(F.col("chunk_index").alias("gold_chunk_index"), F.col("page_number").alias("gold_page")), "row_id").alias("g")).select("question_id", "g.*")


def first_ranks(hits: DataFrame, locations: DataFrame, gold: DataFrame, tolerance: int = 0, chunk_tolerance: int = 1) -> DataFrame:
    """doc_rank, span_rank, neighbor_rank per question and arm, 0 for none."""
    joined = hits.join(locations.select("question_id", "doc", "kind", "page", "span_start", "span_end"), "question_id").join(gold, "question_id", "left")
    doc = doc_matches(F.col("document_key"), F.col("file_name"), F.col("doc"))
    span = doc & (F.col("kind") == "span") & span_overlaps(F.col("start_offset"), F.col("end_offset"), F.col("page_number"), F.col("span_start"), F.col("span_end"), F.col("page"), tolerance)
    near = doc & F.coalesce((F.col("page").isNull() | (F.col("page") == F.col("page_number"))) & (F.abs(F.col("chunk_index") - F.col("gold_chunk_index")) <= chunk_tolerance), F.lit(False))
    least = lambda c: F.coalesce(F.min(F.when(c, F.col("rank"))), F.lit(0))
    return joined.groupBy("question_id", "arm").agg(least(doc).alias("doc_rank"), least(span).alias("span_rank"), least(span | near).alias("neighbor_rank"))


def classify_failures(rows: DataFrame, cut: int = 5) -> DataFrame:
    """Add class and the hit flags at the cut to rows (arm, modality, answerable, printed_text, n_locations, n_spans, doc_rank, span_rank, neighbor_rank)."""
    within = lambda c: (F.col(c) > 0) & (F.col(c) <= cut)
    text = F.col("modality").isin(*TEXT_MODALITIES)
    channels = F.create_map(*[x for a, c, _ in ARMS for x in (F.lit(a), F.array(*map(F.lit, c)))])
    reach = F.when(text, F.array(F.lit("text"), F.lit("keyword"))).otherwise(F.array(F.lit("image"), F.lit("keyword")))
    name = (
        F.when(~F.coalesce("answerable", F.lit(True)), "unanswerable").when(F.col("n_locations") == 0, "label_defect")
        .when(~F.arrays_overlap(F.try_element_at(channels, F.col("arm")), reach), "modality_gap").when(F.col("doc_rank") == 0, "no_recall")
        .when(F.col("n_spans") == 0, F.when(within("doc_rank"), "hit").otherwise("ranked_low"))
        .when(within("span_rank"), "hit").when(within("neighbor_rank"), "hit_via_neighbor").when(F.col("span_rank") > 0, "span_ranked_low")
        .when(within("doc_rank"), F.when(F.coalesce("printed_text", F.lit(False)), "hit").otherwise("wrong_span_same_doc")).otherwise("ranked_low")
    )
    out = rows.withColumn("class", name)
    scored = ~F.col("class").isin("unanswerable", "label_defect", "modality_gap", "no_recall")
    by_doc = (F.col("n_spans") == 0) | ((F.col("class") == "hit") & ~within("span_rank") & ~within("neighbor_rank"))
    flag = lambda c: (scored & F.when(by_doc, within("doc_rank")).otherwise(within(c))).cast("int")
    return out.withColumn("doc_hit_at_cut", (scored & within("doc_rank")).cast("int")).withColumn("span_hit_at_cut", flag("span_rank")).withColumn("neighbor_hit_at_cut", flag("neighbor_rank")).withColumn("hit_at_cut", F.col("neighbor_hit_at_cut"))


def channel_blocked(weight: Column | float, text_weight: float = 0.5, k: int = 60, cut: int = 5) -> Column:
    """Whether rank 1 of a channel still loses to rank `cut` of the text channel."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return (w <= 0) | (w / (k + 1) < text_weight / (k + cut))


def failure_flags(labels: DataFrame, posting_rows: int, cut: int = 5, image_weight: float = 0.49) -> DataFrame:
    """Add flags to labels (question, modality, pool, relevant, evidence_text, n_spans, printed_text, glossed)."""
    text = F.col("modality").isin(*TEXT_MODALITIES)
    han = F.col("question").rlike(f"[{HAN}]")
    flags = F.array(
        F.when((F.col("pool") > 0) & (F.col("relevant") >= F.col("pool")), "free_label"), F.when(F.lit(posting_rows == 0) & han, "keyword_bigram_dead"), F.when(han & ~F.coalesce("glossed", F.lit(False)), "clip_vocab_gap"),
        F.when(F.trim(F.coalesce("evidence_text", F.lit(""))) == "", "empty_evidence_text"), F.when(F.col("n_spans") == 0, "no_span_label"), F.when(F.col("printed_text"), "printed_text_only"), F.when(~text & channel_blocked(image_weight, cut=cut), "channel_blocked"),
    )
    return labels.withColumn("flags", F.array_compact(flags))


def chance_analytic(labels: DataFrame, index: DataFrame, cut: int = 5) -> DataFrame:
    """(question_id, pool, relevant, chance) for labels (question_id, space, targets): a uniform draw of `cut` chunks of the space."""
    documents = index.groupBy("space", "document_key", "file_name").agg(F.count("*").alias("n"))
    pools = documents.groupBy("space").agg(F.sum("n").alias("pool"))
    asked = labels.select("question_id", "space", F.explode("targets").alias("target")).withColumn("_name", last_part(F.col("target")))
    keyed = documents.withColumn("_name", F.explode(names_of(F.col("document_key"), F.col("file_name"))))
    relevant = asked.join(keyed, ["space", "_name"]).where(doc_matches(F.col("document_key"), F.col("file_name"), F.col("target"))).select("question_id", "document_key", "n").distinct().groupBy("question_id").agg(F.sum("n").alias("relevant"))
    out = labels.select("question_id", "space").join(F.broadcast(pools), "space", "left").join(relevant, "question_id", "left").select("question_id", F.coalesce("pool", F.lit(0)).alias("pool"), F.coalesce("relevant", F.lit(0)).alias("relevant"))
    return out.withColumn("chance", chance_of_hit(F.col("pool"), F.col("relevant"), cut))


def chance_shuffle(hits: DataFrame, cut: int = 5, draws: int | None = None) -> DataFrame:
    """(question_id, arm, observed, chance, p_value) of shuffled hit lists (matched flag); closed form, or `draws` seeded shuffles."""
    if draws is None:
        per = hits.groupBy("question_id", "arm").agg(F.count("*").alias("n"), F.count_if("matched").alias("r"))
        chance = chance_of_hit(F.col("n"), F.col("r"), cut)
        observed = (F.col("r") > 0).cast("int")
        return per.select("question_id", "arm", observed.alias("observed"), chance.alias("chance"), F.when(observed == 1, chance).otherwise(1.0).alias("p_value"))

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(zlib.crc32(f"{key[0]}|{key[1]}".encode()))
        marks = group.sort_values("rank")["matched"].tolist()
        observed, wins = int(any(marks)), draws if any(marks) and (all(marks) or len(marks) <= cut) else 0
        for _ in range(draws if observed and not wins else 0):  # else every draw says the same
            rng.shuffle(marks)
            wins += any(marks[:cut])
        return pd.DataFrame([(key[0], key[1], observed, wins / draws, wins / draws if observed else 1.0)], columns=["question_id", "arm", "observed", "chance", "p_value"])

    return hits.select("question_id", "arm", "rank", "matched").groupBy("question_id", "arm").applyInPandas(run, f"question_id {hits.schema['question_id'].dataType.simpleString()}, arm string, observed int, chance double, p_value double")


def null_test(chances: DataFrame) -> DataFrame:
    """Per arm of (arm, chance, hit): trials, hits, mean chance and P(X >= hits)."""
    per = chances.groupBy("arm").agg(F.count("*").alias("n"), F.sum("hit").cast("int").alias("hits"), F.avg("chance").alias("mean_chance"))
    return poisson_binomial_tail(chances, per)


def arm_summary(records: DataFrame) -> DataFrame:
    """Per arm without unanswerable rows: rates with intervals, mean chance, P of as many hits by chance (by document, span and neighbour), counts by class and by flag."""
    rows = records.where("class <> 'unanswerable'")
    rate = lambda c: F.avg(c)
    main = rows.groupBy("arm").agg(F.count("*").alias("n"), F.sum("hit_at_cut").alias("hits"), rate("doc_hit_at_cut").alias("doc_rate"), rate("span_hit_at_cut").alias("span_rate"), rate("neighbor_hit_at_cut").alias("bridge_rate"), F.avg("chance").alias("mean_chance"))
    counted = lambda df, name: df.groupBy("arm", "k").agg(F.count("*").alias("c")).groupBy("arm").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "k", F.col("c").cast("string")))), ";").alias(name))
    classes, flags = counted(rows.select("arm", F.col("class").alias("k")), "classes"), counted(rows.select("arm", F.explode("flags").alias("k")), "flags")
    ci = wilson(F.col("hits"), F.col("n"))
    sums = rows.groupBy("arm").agg(*[F.sum(f"{x}_hit_at_cut").cast("int").alias(f"_{x}") for x in ("doc", "span", "neighbor")])
    nulls = poisson_binomial_tail(rows, sums, {"_doc": "p_doc", "_span": "p_span", "_neighbor": "p_bridge"}).select("arm", "p_doc", "p_span", "p_bridge")
    return main.join(classes, "arm").join(flags, "arm", "left").join(nulls, "arm").withColumn("ci_low", ci["low"]).withColumn("ci_high", ci["high"])


def unanswerable_axis(records: DataFrame) -> DataFrame:
    """Per arm over unanswerable rows (top_score, returned): count, abstained, and top score max, lower-order median, min."""
    return records.where("class = 'unanswerable'").groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("returned") == 0).alias("abstained"), F.max("top_score").alias("top_max"), F.expr("percentile_disc(0.5) within group (order by top_score)").alias("top_median"), F.min("top_score").alias("top_min"))


def corpus_stats(index: DataFrame, postings: DataFrame) -> DataFrame:
    per = index.groupBy("space").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.count_if(F.coalesce("body", F.lit("")) != "").alias("with_body"))
    return per.crossJoin(F.broadcast(postings.agg(F.count("*").alias("posting_rows"))))


def fusion_attribution(records: DataFrame, base: str, fused: str, cut: int = 5) -> DataFrame:
    """(question_id, outcome): both, base_only, fused_only or neither, from doc_rank of two arms."""
    hit = lambda a: F.max(((F.col("arm") == a) & (F.col("doc_rank") > 0) & (F.col("doc_rank") <= cut)).cast("int"))
    per = records.where(F.col("arm").isin(base, fused)).groupBy("question_id").agg(hit(base).alias("b"), hit(fused).alias("f"))
    return per.select("question_id", F.when((F.col("b") == 1) & (F.col("f") == 1), "both").when(F.col("b") == 1, "base_only").when(F.col("f") == 1, "fused_only").otherwise("neither").alias("outcome"))


def channel_mix(hits: DataFrame, outcomes: DataFrame, fused: str, cut: int = 5) -> DataFrame:
    """Per outcome: rows of the fused top by channels (none, keyword_only, text_and_keyword, text_only, other) and their share of all slots."""
    c = F.coalesce("channels", F.array().cast("array<string>"))
    has = lambda x: F.array_contains(c, x)
    mix = F.when(F.size(c) == 0, "none").when((F.size(c) == 1) & has("keyword"), "keyword_only").when((F.size(c) == 2) & has("text") & has("keyword"), "text_and_keyword").when((F.size(c) == 1) & has("text"), "text_only").otherwise("other")
    questions = outcomes.agg(F.count("*").alias("_q"))
    top = hits.where((F.col("arm") == fused) & (F.col("rank") <= cut)).join(outcomes, "question_id").groupBy("outcome", mix.alias("mix")).agg(F.count("*").alias("rows"))
    return top.crossJoin(F.broadcast(questions)).withColumn("share", F.col("rows") / (F.col("_q") * cut)).drop("_q")


def keyword_difference(hits: DataFrame, a: str = "A0", b: str = "A1", cut: int = 5) -> DataFrame:
    """One row: top slots of arm a whose document arm b never returns, and the questions that have one."""
    slots = hits.where((F.col("arm") == a) & (F.col("rank") <= cut)).select("question_id", "rank", "document_key")
    seen = hits.where(F.col("arm") == b).select("question_id", "document_key").distinct()
    return slots.join(seen, ["question_id", "document_key"], "left_anti").agg(F.count("*").alias("slots"), F.count_distinct("question_id").alias("questions"))


def neighborhood_coverage(labels: DataFrame, index: DataFrame) -> DataFrame:
    """labels (question_id, document_key, chunk_indexes, evidence_text): all claimed chunks exist; the evidence's first 24 characters occur; some / every claimed chunk's window of one position holds all claimed."""
    place = Window.partitionBy("document_key").orderBy("chunk_index")
    chunks = index.select("document_key", "chunk_index", "body").withColumn("position", F.dense_rank().over(place))
    claimed = labels.select("question_id", "document_key", F.size(F.array_distinct("chunk_indexes")).alias("_n"), F.trim("evidence_text").alias("_e"), F.explode(F.array_distinct("chunk_indexes")).alias("chunk_index"))
    per = claimed.join(chunks, ["document_key", "chunk_index"], "left").groupBy("question_id").agg(
        F.max("_n").alias("claimed"), F.count_distinct(F.when(F.col("position").isNotNull(), F.col("chunk_index"))).alias("found"), F.min("position").alias("lo"), F.max("position").alias("hi"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.coalesce("body", F.lit("")).alias("b")))), lambda x: x["b"]), "").alias("_text"), F.max("_e").alias("_e"),
    )
    reach = F.col("hi") - F.col("lo")
    return per.select("question_id", "claimed", "found", (F.col("claimed") == F.col("found")).alias("exists_all"), F.contains("_text", F.substring("_e", 1, 24)).alias("evidence_found"), F.coalesce(reach <= 2, F.lit(False)).alias("some_window"), F.coalesce(reach <= 1, F.lit(False)).alias("every_window"))


def _gold_ranks(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query, rank): 1 + pool members above the query's gold (or equal with a lower position), its `skip` left out; block by block."""
    rows = pool.select(F.lit("").alias("space"), F.col("position").cast("long").alias("position"), "vec")
    asked = queries.select(F.lit("").alias("space"), F.col("query").cast("long").alias("query"), "vec", F.col("gold").cast("long").alias("gold"), "gold_vec", F.coalesce("skip", F.lit(-1)).cast("long").alias("skip"))

    def score(rows: dict, asked: dict) -> pa.RecordBatch:
        q = matrix(asked["vec"])
        target, s = (q * matrix(asked["gold_vec"])).sum(axis=1), matrix(rows["vec"]) @ q.T
        at, gold, skip = rows["position"].to_numpy()[:, None], asked["gold"].to_numpy(), asked["skip"].to_numpy()
        near = np.abs(s - target) <= 1e-12
        wins = ((s > target) & ~near | near & (at < gold)) & (at != gold) & (at != skip)
        return pa.RecordBatch.from_arrays([asked["query"], pa.array(wins.sum(axis=0))], ["query", "above"])

    return products(rows, asked, each(score), "query long, above long").groupBy("query").agg((F.sum("above") + 1).alias("rank"))


def rank_summary(ranks: DataFrame, chance_pool: int) -> DataFrame:
    """One row: recall@1/@5, mean reciprocal rank, rank least / median / mean / most, chance."""
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranks.agg(F.count("*").alias("n"), hit(1).alias("recall_at_1"), hit(5).alias("recall_at_5"), F.avg(1 / F.col("rank")).alias("mrr"), F.min("rank").alias("rank_min"), F.percentile("rank", F.lit(0.5)).alias("rank_median"), F.avg("rank").alias("rank_mean"), F.max("rank").alias("rank_max")).withColumn("chance_at_1", F.lit(1 / chance_pool)).withColumn("chance_at_5", F.lit(5 / chance_pool))


def paired_ranks(pairs: DataFrame) -> DataFrame:
    """pairs (i, question_vec, gold_vec): question i ranks gold i among all golds (positions first) and all other questions."""
    n = pairs.count()
    pool = pairs.select(F.col("i").alias("position"), F.col("gold_vec").alias("vec")).unionByName(pairs.select((F.col("i") + n).alias("position"), F.col("question_vec").alias("vec")))
    asked = pairs.select(F.col("i").alias("query"), F.col("question_vec").alias("vec"), F.col("i").alias("gold"), "gold_vec", (F.col("i") + n).alias("skip"))
    return _gold_ranks(asked, pool)


def cross_modal_ranks(pairs: DataFrame) -> DataFrame:
    """pairs (i, image_vec, caption_vec): image i ranks caption i among all captions."""
    pool = pairs.select(F.col("i").alias("position"), F.col("caption_vec").alias("vec"))
    return _gold_ranks(pairs.select(F.col("i").alias("query"), F.col("image_vec").alias("vec"), F.col("i").alias("gold"), F.col("caption_vec").alias("gold_vec"), F.lit(None).cast("long").alias("skip")), pool)


def percentile_summary(samples: DataFrame, expected: int, by: list[str]) -> DataFrame:
    """Nearest-rank p50 and p95 of `ms` per group, and whether each group has the expected number of samples."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by ms)")
    return samples.groupBy(*by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95")).withColumn("complete", F.col("n") == expected)
