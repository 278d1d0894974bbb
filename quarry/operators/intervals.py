"""Joins of spans by position: spans are cut into bins, so those far apart never meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 4096


def _bins(start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """The first and the last bin of [start, end); an empty span lies in the bin of its start."""
    return F.floor(start / width), F.floor(F.greatest(end - 1, start) / width)


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN) -> DataFrame:
    """The pairs of rows that agree on the columns `on` and whose half-open spans meet: left.start < right.end and right.start < left.end. All columns of both, those of `on` once.

    Each row goes to every bin its span touches, and a pair counts in the first bin both touch: work follows the spans that lie in one bin, not all pairs of a
    document. Spans of a null end meet nothing; an empty span meets what holds it strictly inside.
    """
    (a, b), (c, d) = left_span, right_span
    cut = lambda df, s, e, name: df.where(F.col(s) <= F.col(e)).withColumn(f"_{name}", _bins(F.col(s), F.col(e), width)[0]).withColumn("_bin", F.explode(F.sequence(*_bins(F.col(s), F.col(e), width))))
    met = cut(left, a, b, "l").join(cut(right, c, d, "r"), [*on, "_bin"]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("_bin") == F.greatest("_l", "_r")))
    return met.drop("_bin", "_l", "_r")
