"""Keyword channels, fusion, neighbourhood, the hybrid search, and comparison of rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_ascii, han_bigrams, ngrams
from ..sources.staged import stored
from .blocks import Best, best, products
from .query import channel_availability, glossary_terms, keyword_plan
from .vectors import cosine_topk, tie_order

WEIGHTS = {"text": 0.5, "keyword": 0.3, "image": 0.49}
SHOWN = ["row_id", "document_id", "chunk_id", "relative_path", "page_number", "start_offset"]
BROADCAST_QUERIES, FEW_QUERIES = 20_000, 200


def small(df: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """A broadcast hint where the rows are few enough."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class _Shared(Best):
    """Best rows by the share of a query's terms that they hold."""

    def __init__(self, asked: dict[str, pa.Array], k: int):
        super().__init__(asked["query_id"], k)
        self.n, flat = asked["terms"].value_lengths().to_numpy(), asked["terms"].flatten()
        self.known = flat.unique()
        term = pc.index_in(flat, self.known).to_numpy()
        self.queries = np.repeat(np.arange(len(self.n)), self.n)[np.argsort(term, kind="stable")]  # those of the first term, of the second, ..
        self.many = np.bincount(term, minlength=len(self.known))
        self.first = np.cumsum(self.many) - self.many

    def see(self, rows: dict[str, pa.Array]) -> None:
        terms = rows.pop("terms")
        term = pc.index_in(terms.flatten(), self.known)
        row = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy())[term.is_valid().to_numpy(zero_copy_only=False)]
        term = term.drop_null().to_numpy()
        many = self.many[term]
        query = self.queries[np.arange(many.sum()) + np.repeat(self.first[term] - np.cumsum(many) + many, many)]
        counts = np.bincount(np.repeat(row * len(self.n), many) + query, minlength=len(terms) * len(self.n)).reshape(len(terms), -1)
        scores = np.where(counts > 0, counts / self.n, -np.inf)
        at, of = self.above(scores)
        self.take(rows, at, of, scores[at, of])


def bigram_search(postings: DataFrame | None, index: DataFrame, queries: DataFrame, k: int = 50, where: Column | None = None) -> DataFrame:
    """Score = found distinct terms / distinct terms of the query (query_id, terms; both sides hold a term once).

    Without postings the terms are those of the index's bodies, and no row is shuffled; postings are gathered by row, those of terms that no query asks for left out.
    Blocks of rows then meet blocks of queries, and a task hands on its k best rows a query: pairs of rows and queries are never shuffled.
    """
    asked = queries.where(F.size("terms") > 0).select(F.lit("").alias("space"), F.col("query_id").cast("long").alias("query_id"), "terms")
    rows = index.where(where) if where is not None else index
    if postings is None:
        held = rows.select(*SHOWN, han_bigrams(F.coalesce("body", F.lit(""))).alias("terms"))
    else:
        wanted = postings.join(small(asked.select(F.explode("terms").alias("term")).distinct()), "term", "left_semi")
        held = rows.select(*SHOWN).join(wanted.groupBy(F.col("chunk_rowid").alias("row_id")).agg(F.collect_set("term").alias("terms")), "row_id")
    rows = held.where(F.size("terms") > 0).select(F.lit("").alias("space"), *SHOWN, "terms")
    kinds = dict(rows.dtypes)
    found = products(rows, asked, best(lambda asked: _Shared(asked, k)), f"query_id long, {', '.join(f'{c} {kinds[c]}' for c in SHOWN)}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*tie_order()))).where(F.col("rank") <= k)


def _first_rows(matched: DataFrame, k: int) -> DataFrame:
    """The first k matches by row id, then in tie order."""
    cut = matched.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("row_id"))).where(F.col("_r") <= k).drop("_r")
    return cut.withColumn("score", F.lit(1.0)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*tie_order())))


def _held_texts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(row_id, _q) for few questions: each body is looked through for each of their distinct texts, which come as one row."""
    texts = F.broadcast(asked.agg(F.collect_set("_q").alias("_all")))
    return rows.crossJoin(texts).select("row_id", F.explode(F.filter("_all", lambda q: F.contains(F.col("_b"), q))).alias("_q"))


def trigram_search(index: DataFrame, queries: DataFrame, k: int = 50, where: Column | None = None) -> DataFrame:
    """Bodies that hold the query's text (query_id, query; three characters or more), any case; score 1.

    The join runs on one trigram of the query, the one found in the fewest bodies, and the whole query is then looked for in those.
    """
    rows = (index.where(where) if where is not None else index).select(*SHOWN, F.lower("body").alias("_b"))
    grams = lambda c: F.array_distinct(ngrams(c, 3))
    asked = queries.where(F.char_length("query") >= 3).select("query_id", F.lower("query").alias("_q"))
    if asked.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES:
        return _first_rows(_held_texts(rows, asked).join(F.broadcast(asked), "_q").drop("_q").join(rows.drop("_b"), "row_id"), k)
    wanted = asked.select("query_id", F.explode(grams(F.col("_q"))).alias("gram"))
    # Counts of the asked trigrams; those that no question asks for are dropped before anything is shuffled.
    posted = rows.where(F.char_length("_b") >= 3).select("row_id", F.explode(grams(F.col("_b"))).alias("gram")).join(small(wanted.select("gram").distinct()), "gram", "left_semi")
    counts = posted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    candidates = posted.join(small(rarest), "gram").select("query_id", "row_id")
    matched = candidates.join(asked, "query_id").join(rows, "row_id").where(F.contains("_b", "_q")).drop("_b", "_q")
    return _first_rows(matched, k)


def like_search(index: DataFrame, queries: DataFrame, k: int = 50, where: Column | None = None) -> DataFrame:
    """Bodies that hold a query of one or two characters, A-Z in any case; the first min(k, 50) by row id."""
    rows = (index.where(where) if where is not None else index).select(*SHOWN, fold_ascii("body").alias("_b"))
    asked = queries.where(F.char_length("query").between(1, 2)).select("query_id", fold_ascii("query").alias("_q"))
    if asked.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES:
        held = _held_texts(rows, asked)
    else:  # many questions: by the characters and character pairs of the bodies
        grams = F.array_union(F.array_distinct(ngrams("_b", 1)), F.array_distinct(ngrams("_b", 2)))
        held = rows.select("row_id", F.explode(grams).alias("_q")).join(small(asked.select("_q").distinct()), "_q", "left_semi")
    matched = held.join(small(asked), "_q").drop("_q").join(rows.drop("_b"), "row_id")
    return _first_rows(matched, min(k, 50))


def merge_max(*lists: DataFrame) -> DataFrame:
    """Union of hit lists; the higher score per chunk, the first list on a tie."""
    out = None
    for i, part in enumerate(lists):
        part = part.drop("rank").withColumn("_list", F.lit(i))
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query_id", "document_id", "chunk_id", "start_offset").orderBy(F.desc("score"), "_list")
    return out.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_list")


def keyword_topk(index: DataFrame, postings: DataFrame | None, queries: DataFrame, k: int = 50, where: Column | None = None) -> DataFrame:
    """Each query (query_id, query; probes may be given) by its path: terms and probes, substring, or short text."""
    planned = stored(keyword_plan(queries.where(F.coalesce("query", F.lit("")) != "")), "keyword-plan")
    by = lambda p: planned.where(F.col("path") == p)
    paths = {r["path"] for r in planned.select("path").distinct().collect()}  # of three; a path that no query takes is not planned
    lists = [bigram_search(postings, index, by("bigram"), k, where)]
    lists += [trigram_search(index, by("trigram"), k, where)] if "trigram" in paths else []
    lists += [like_search(index, by("like"), k, where)] if "like" in paths else []
    if "probes" in queries.columns:
        probes = by("bigram").select("query_id", F.explode("probes").alias("query")).distinct()
        numbered = probes.withColumn("_id", F.xxhash64("query_id", "query"))
        hits = trigram_search(index, numbered.select(F.col("_id").alias("query_id"), "query"), k, where)
        lists.append(hits.withColumnRenamed("query_id", "_id").join(numbered.select("_id", "query_id"), "_id").drop("_id"))
    merged = merge_max(*lists)
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*tie_order()))).where(F.col("rank") <= k)


def rrf_fuse(hits: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse hits (query_id, channel, rank, SHOWN): score = sum over channels of weight / (k + first rank), in fixed channel order."""
    weights = WEIGHTS if weights is None else weights
    used = hits.where(F.col("channel").isin(*[c for c, w in weights.items() if w > 0]))
    order = F.element_at(F.create_map(*[x for i, c in enumerate(("text", "keyword", "image")) for x in (F.lit(c), F.lit(i))]), F.col("channel"))
    first = {c: F.min(F.when(F.col("channel") == c, F.col("rank"))) for c in ("text", "keyword", "image")}
    shown = F.min_by(F.struct(*[c for c in SHOWN if c not in ("document_id", "chunk_id")]), F.struct(order.alias("o"), F.col("rank").alias("r")))
    grouped = used.groupBy("query_id", "document_id", "chunk_id").agg(*[m.alias(f"_{c}") for c, m in first.items()], shown.alias("_s"), F.array_sort(F.collect_set("channel")).alias("channels"))
    score = F.lit(0.0)
    for c in ("text", "keyword", "image"):
        score = score + F.coalesce(F.lit(weights.get(c, 0.0)) / (k + F.col(f"_{c}")), F.lit(0.0))
    out = grouped.select("query_id", "document_id", "chunk_id", "_s.*", score.alias("score"), "channels")
    place = Window.partitionBy("query_id").orderBy(*tie_order(row_id=None), "document_id", "chunk_id")
    return out.withColumn("rank", F.row_number().over(place))


def expand_neighborhood(results: DataFrame, index: DataFrame) -> DataFrame:
    """Add snippet: the bodies before, at and after a text hit on its page, joined by line ends; order and scores stay.

    The results are few: their wanted neighbours meet the index in one equi-join.
    """
    chunks = index.select("document_id", "chunk_id", F.col("page_number").alias("_page"), "chunk_index", "body", "modality", "start_offset")
    own = results.select("query_id", "document_id", "chunk_id", "start_offset").join(chunks, ["document_id", "chunk_id", "start_offset"], "left")
    wanted = own.where(F.coalesce("modality", F.lit("")) != "image").select("query_id", "document_id", "chunk_id", "start_offset", F.col("_page").alias("_p"), F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("_want"), F.col("chunk_index").alias("_at"))
    near = chunks.select("document_id", "_page", F.col("chunk_index").alias("_want"), F.col("body").alias("_body"))
    joined = small(wanted).join(near, ["document_id", "_want"]).where(F.col("_p").eqNullSafe(F.col("_page")) & (F.coalesce("_body", F.lit("")) != ""))
    sides = joined.groupBy("query_id", "document_id", "chunk_id", "start_offset").agg(F.max(F.when(F.col("_want") < F.col("_at"), F.col("_body"))).alias("_before"), F.max(F.when(F.col("_want") > F.col("_at"), F.col("_body"))).alias("_after"))
    keys = ["query_id", "document_id", "chunk_id", "start_offset"]
    return results.join(own.select(*keys, "body").dropDuplicates(keys), keys, "left").join(sides, keys, "left").withColumn("snippet", F.concat_ws("\n", "_before", F.nullif("body", F.lit("")), "_after")).drop("_before", "_after", "body")


def routed(queries: DataFrame) -> DataFrame:
    """Queries (query, requested, text_tokens, image_tokens) that can run, with the channels they may use, the glossary's keyword probes and the query for the image tower."""
    return glossary_terms(channel_availability(queries).where("reason is null"))


def hybrid_search(index: DataFrame, postings: DataFrame, queries: DataFrame, top_k: int = 10, recall_k: int = 50, where: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Per query (query_id, query, text_vec, image_vec; channels and probes may be given): recall by channel, fusion, cut, neighbourhood."""
    recall = max(top_k, recall_k)
    may = lambda channel: queries.where(F.array_contains("channels", channel)) if "channels" in queries.columns else queries
    lists = []
    for channel, space, column in (("text", "documentText", "text_vec"), ("image", "clipShared", "image_vec")):
        if column in queries.columns:
            asked = may(channel).where(F.col(column).isNotNull()).select("query_id", F.lit(space).alias("space"), F.col(column).alias("vec"))
            hits = cosine_topk(index, asked, recall, where).select("query_id", "row_id", "score", "rank")
            lists.append(hits.join(index.select(*SHOWN), "row_id").select("query_id", *SHOWN, "rank", F.lit(channel).alias("channel")))
    lists.append(keyword_topk(index, postings, may("keyword"), recall, where).select("query_id", *SHOWN, "rank", F.lit("keyword").alias("channel")))
    hits = lists[0]
    for more in lists[1:]:
        hits = hits.unionByName(more)
    fused = rrf_fuse(hits, weights=weights).where(F.col("rank") <= top_k)
    return expand_neighborhood(fused, index)


def compare_rankings(left: DataFrame, right: DataFrame, slots: int = 5, gate: float = 0.96) -> DataFrame:
    """One row: positions, agreed, agreement, largest score differences by slot and by chunk, passed; a missing slot is a mismatch."""
    first = lambda df: df.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy(*tie_order()))).where(F.col("slot") <= slots)
    a, b = first(left).select("query_id", "slot", F.col("chunk_id").alias("ca"), F.col("score").alias("sa")), first(right).select("query_id", "slot", F.col("chunk_id").alias("cb"), F.col("score").alias("sb"))
    wanted = left.select("query_id").union(right.select("query_id")).distinct().select("query_id", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot"))
    placed = wanted.join(a, ["query_id", "slot"], "left").join(b, ["query_id", "slot"], "left")
    by_slot = placed.agg(F.count("*").alias("positions"), F.count_if(F.col("ca") == F.col("cb")).alias("agreed"), F.max(F.abs(F.col("sa") - F.col("sb"))).alias("max_slot_delta"))
    by_chunk = a.join(b, (a["query_id"] == b["query_id"]) & (a["ca"] == b["cb"])).agg(F.max(F.abs(F.col("sa") - F.col("sb"))).alias("max_chunk_delta"))
    return by_slot.crossJoin(by_chunk).withColumn("agreement", F.col("agreed") / F.col("positions")).withColumn("passed", F.col("agreement") >= gate)
