"""The library in Spark SQL: a table function that cuts texts, and the scoring formulas as functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.stats import Z95
from . import chunking
from .search import WEIGHTS

RANK_CONSTANT = 60


class ChunkText:
    """Rows (position, start_offset, end_offset, chunk, tokens, failure) of a text, in order, offsets in UTF-16 units; a text over the budget gives one row with its failure."""

    def eval(self, text: str, chars: int, tokens: int) -> Iterator[tuple]:
        text = text or ""
        try:
            spans = chunking.cascade(text, chars, tokens)
        except chunking.OverBudget:
            yield None, None, None, None, None, "overBudget"
            return
        at, seen = 0, 0
        for position, (a, b) in enumerate(spans):
            seen, at = seen + chunking.units(text[at:a]), a
            yield position, seen, seen + chunking.units(text[a:b]), text[a:b], chunking.count_chars(text[a:b]), None


def _wilson(sign: str, bound: str, worst: str) -> str:
    p, z = "(successes / total)", f"{Z95}D"
    spread = f"{z} * sqrt({p} * (1 - {p}) / total + {z} * {z} / (4D * total * total))"
    return f"CASE WHEN total > 0 THEN {bound}({worst}, ({p} + {z} * {z} / (2D * total) {sign} {spread}) / (1 + {z} * {z} / total)) ELSE 0D END"


def register(spark: SparkSession) -> None:
    """Register chunk_text(text, chars, tokens), a table function for LATERAL joins, and wilson_low, wilson_high(successes, total) and rrf(channel, rank)."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="position int, start_offset int, end_offset int, chunk string, tokens int, failure string"))
    for name, sign, bound, worst in (("low", "-", "greatest", "0D"), ("high", "+", "least", "1D")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION wilson_{name}(successes BIGINT, total BIGINT) RETURNS DOUBLE RETURN {_wilson(sign, bound, worst)}")
    weights = " ".join(f"WHEN '{channel}' THEN {weight}D" for channel, weight in WEIGHTS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rrf(channel STRING, place BIGINT) RETURNS DOUBLE RETURN CASE channel {weights} ELSE 0D END / ({RANK_CONSTANT} + place)")
