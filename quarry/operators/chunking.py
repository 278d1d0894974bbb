"""Pages to chunks: a cascade of ever finer cuts, with offsets in UTF-16 units of the page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, is_blank

VERSION = "w3-cascade-1"
CHUNK_CHARS, MAX_TOKENS = 120, 128
SPACE_SET = set(SPACES)
CHUNKS = "document_id string, ordinal int, page_number int, start_offset int, end_offset int, text string, tokens int, failure string"


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(1 for c in text if ord(c) > 0xFFFF)


def count_chars(text: str) -> int:
    """The default counter: UTF-16 length and two special tokens."""
    return units(text) + 2


class OverBudget(ValueError):
    """Not even one character fits the token budget."""


def _trimmed(text: str, a: int, b: int) -> tuple[int, int] | None:
    while a < b and text[a] in SPACE_SET:
        a += 1
    while b > a and text[b - 1] in SPACE_SET:
        b -= 1
    return (a, b) if a < b else None


def _cut(text: str, a: int, b: int, separator: str) -> Iterator[tuple[int, int]]:
    at = a
    for m in re.finditer(separator, text[a:b]):
        if (span := _trimmed(text, at, a + m.start())) is not None:
            yield span
        at = a + m.end()
    if (span := _trimmed(text, at, b)) is not None:
        yield span


def _sentences(text: str, a: int, b: int) -> list[tuple[int, int]]:
    ends = [a + m.end() for m in re.finditer("[。！？；.!?;]", text[a:b])]
    spans = [_trimmed(text, x, y) for x, y in zip([a, *ends], [*ends, b], strict=True)]
    found = [s for s in spans if s is not None]
    return found if len(found) > 1 else [(a, b)]


def _windows(text: str, a: int, b: int, chars: int, tokens: int, count: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    while a < b:
        if text[a] in SPACE_SET:
            a += 1
            continue
        end, used = a, 0
        while end < b and used < chars:  # a pair of surrogates is never parted: one unit more is taken
            used += 2 if ord(text[end]) > 0xFFFF else 1
            end += 1
        if count(text[a:end]) > tokens:  # the largest prefix within the budget, by bisection
            low, high = a, end
            while low < high - 1:
                mid = (low + high) // 2
                low, high = (mid, high) if count(text[a:mid]) <= tokens else (low, mid)
            end = low
        if end == a:
            raise OverBudget
        if (span := _trimmed(text, a, end)) is not None:
            yield span
        a = end


def cascade(text: str, chars: int = CHUNK_CHARS, tokens: int = MAX_TOKENS, count: Callable[[str], int] = count_chars) -> list[tuple[int, int]]:
    """Spans of a page, as character positions: paragraphs, lines, sentences, windows."""
    if _trimmed(text, 0, len(text)) is None:
        return []
    if "\n\n" in text:
        spans = [s for p in _cut(text, 0, len(text), "\n\n") for s in (_cut(text, *p, "\n") if "\n" in text[p[0] : p[1]] and count(text[p[0] : p[1]]) > tokens else [p])]
    else:
        spans = list(_cut(text, 0, len(text), "\n")) if "\n" in text else [_trimmed(text, 0, len(text))]
    large = lambda a, b: units(text[a:b]) > chars or count(text[a:b]) > tokens
    out = []
    for a, b in spans:
        for x, y in _sentences(text, a, b) if large(a, b) else [(a, b)]:
            out += list(_windows(text, x, y, chars, tokens, count)) if large(x, y) else [(x, y)]
    return out


def chunk_pages(pages: DataFrame, chunk_chars: int = CHUNK_CHARS, max_tokens: int = MAX_TOKENS, counter: Callable[[str], int] = count_chars) -> DataFrame:
    """Chunks of pages (document_id, ordinal, page_number, text); a page over the budget gives one row with failure overBudget, one on which the counter fails one with unknown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, ordinal, page, text in zip(batch["document_id"], batch["ordinal"], batch["page_number"], batch["text"], strict=True):
                page = None if pd.isna(page) else int(page)
                text = text or ""
                try:
                    spans = cascade(text, chunk_chars, max_tokens, counter)
                except Exception as error:  # the counter may be anyone's; one page must not stop the others
                    rows.append((doc, ordinal, page, None, None, None, None, "overBudget" if isinstance(error, OverBudget) else "unknown"))
                    continue
                wide = [i for i, c in enumerate(text) if ord(c) > 0xFFFF]
                before = lambda i: i + sum(1 for w in wide if w < i)  # noqa: B023, E731
                rows += [(doc, ordinal, page, before(a), before(b), text[a:b], counter(text[a:b]), None) for a, b in spans]
            yield pd.DataFrame(rows, columns=["document_id", "ordinal", "page_number", "start_offset", "end_offset", "text", "tokens", "failure"]).astype({c: "Int32" for c in ("ordinal", "page_number", "start_offset", "end_offset", "tokens")})

    return pages.select("document_id", "ordinal", "page_number", "text").mapInPandas(run, CHUNKS)


def resolve_page_numbers(documents: DataFrame) -> DataFrame:
    """Pages of documents (document_id, text, pages, attributes): numbers are physical with pageCount, extractor or several pages."""
    physical = F.map_contains_key("attributes", F.lit("pageCount")) | F.map_contains_key("attributes", F.lit("extractor")) | (F.size("pages") > 1)
    whole = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text").alias("text")))
    listed = F.when(F.size("pages") > 0, F.col("pages")).when(~is_blank("text"), whole)
    rows = documents.select("document_id", physical.alias("_physical"), F.posexplode(listed).alias("ordinal", "_p"))
    return rows.select("document_id", "ordinal", F.when(F.col("_physical"), F.col("_p.page_number")).alias("page_number"), F.col("_p.text").alias("text"))


def chunker_version(chunk_chars: int = CHUNK_CHARS, max_tokens: int = MAX_TOKENS) -> str:
    return VERSION if (chunk_chars, max_tokens) == (CHUNK_CHARS, MAX_TOKENS) else f"{VERSION}-c{chunk_chars}-t{max_tokens}"


def with_chunk_ids(chunks: DataFrame, chunk_chars: int = CHUNK_CHARS, max_tokens: int = MAX_TOKENS, counter_name: str = "chars") -> DataFrame:
    """Add chunk_id; chunks have an ordinal of the page and an index within it (`position`)."""
    doc = F.coalesce("document_id", F.sha2("text", 256))
    parts = [doc, F.lit(chunker_version(chunk_chars, max_tokens)), F.lit(counter_name), F.lit(f"c{chunk_chars}"), F.lit(f"t{max_tokens}"), F.concat(F.lit("o"), F.col("ordinal").cast("string")), F.concat(F.lit("p"), F.coalesce(F.col("page_number").cast("string"), F.lit("na"))), F.concat(F.lit("i"), F.col("position").cast("string"))]
    return chunks.withColumn("chunk_id", F.concat_ws("-", *parts))


def with_chunk_index(chunks: DataFrame) -> DataFrame:
    """Add the 0-based chunk_index per document and page (null counts as one) over chunks that are not blank."""
    by = Window.partitionBy("document_id", "page_number").orderBy("ordinal", "start_offset")
    return chunks.where(~is_blank("text")).withColumn("chunk_index", F.row_number().over(by) - 1)


def budget_failures(chunks: DataFrame) -> DataFrame:
    return chunks.where("failure is not null").select("document_id", F.col("failure").alias("kind")).distinct()


def chunk_size_profile(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Per document: chunks, tokens least, upper median, mean, most, how many over budget, characters per content token."""
    median = F.element_at(F.sort_array(F.collect_list("tokens")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return chunks.where("failure is null").groupBy("document_id").agg(F.count("*").alias("chunks"), F.min("tokens").alias("tokens_min"), median.alias("tokens_p50"), F.avg("tokens").alias("tokens_mean"), F.max("tokens").alias("tokens_max"), F.count_if(F.col("tokens") > max_tokens).alias("over_budget"), (F.sum(F.col("end_offset") - F.col("start_offset")) / F.sum(F.greatest(F.col("tokens") - 2, F.lit(1)))).alias("chars_per_token"))
