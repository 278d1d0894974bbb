"""Vectors: storage form, checks, pooling, drift and exact search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import all_finite, doubles, dot, norm
from .blocks import Best, best, each, matrix, products


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _from_blob(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.StringType())
def _to_base64(vec: pd.Series) -> pd.Series:
    import base64

    return vec.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


def decode_vectors(df: DataFrame, b64_col: str, dim_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `vec`, rejected rows): base64 of little-endian float32; its length must be four times dim."""
    blob = F.try_to_binary(F.col(b64_col), F.lit("base64"))
    fits = F.coalesce(F.octet_length(blob) == F.col(dim_col) * 4, F.lit(False))
    return df.where(fits).withColumn("vec", _from_blob(blob)), df.where(~fits).withColumn("kind", F.lit("corruptVector"))


def encode_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    return df.withColumn("vectorB64", _to_base64(F.col(vec_col)))


def mean_pool(df: DataFrame, hidden_col: str, mask_col: str, dim: int) -> DataFrame:
    """Add `pooled` (masked mean over token vectors) and `failure` (badOutput for a wrong length, a non-finite value or an empty mask)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pool(hidden: pd.Series, mask: pd.Series) -> pd.Series:
        def one(h, m):
            if h is None or m is None or len(h) != len(m) * dim:
                return None
            h, m = np.asarray(h, np.float64).reshape(len(m), dim), np.asarray(m, np.float64)
            return (h * m[:, None]).sum(axis=0) / m.sum() if m.sum() > 0 and np.isfinite(h).all() else None

        return pd.Series([one(h, m) for h, m in zip(hidden, mask, strict=True)])

    out = df.withColumn("pooled", pool(F.col(hidden_col), F.col(mask_col)))
    return out.withColumn("failure", F.when(F.col("pooled").isNull(), "badOutput"))


def l2_normalize(df: DataFrame, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with unit vectors, rejected rows): empty, non-finite and zero vectors are rejected."""
    good = F.coalesce((F.size(vec_col) > 0) & all_finite(F.col(vec_col)) & (norm(F.col(vec_col)) > 0), F.lit(False))
    n = norm(F.col(vec_col))
    return df.where(good).withColumn("_n", n).withColumn(vec_col, F.transform(doubles(F.col(vec_col)), lambda x: x / F.col("_n"))).drop("_n"), df.where(~good).withColumn("kind", F.lit("badOutput"))


def validate_vectors(df: DataFrame) -> DataFrame:
    """Add `kind`, null where a row (space, dim, vec, normalized) is sound; a space of several dims rejects its rows."""
    dims = df.groupBy("space").agg(F.min("dim").alias("_lo"), F.max("dim").alias("_hi"))
    kind = (
        F.when(F.col("vec").isNull() | (F.size("vec") != F.col("dim")), "dimMismatch")
        .when(~all_finite(F.col("vec")), "nonFinite").when(~F.coalesce("normalized", F.lit(False)), "notNormalized").when(F.col("_lo") != F.col("_hi"), "spaceMismatch")
    )
    return df.join(F.broadcast(dims), "space").withColumn("kind", kind).drop("_lo", "_hi")


def pair_chunks_with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Full outer pairing on (document_id, chunk_id); kind is null for a sound pair, else conflict or spaceMismatch."""
    c = chunks.select("document_id", "chunk_id", "modality").withColumn("_c", F.lit(True))
    v = vectors.select("document_id", "chunk_id", "space", "vec").withColumn("_v", F.lit(True))
    wants = F.when(F.col("modality") == "image", "clipShared").otherwise("documentText")
    kind = F.when(F.col("_c").isNull() | F.col("_v").isNull(), "conflict").when(F.col("space") != wants, "spaceMismatch")
    return c.join(v, ["document_id", "chunk_id"], "full").withColumn("kind", kind).drop("_c", "_v")


def embedding_drift(left: DataFrame, right: DataFrame, key: str, label: str, gate: float = 0.999) -> DataFrame:
    """Per label the least cosine between two versions of a vector; NaN if any is not finite; passed = at least gate."""
    a, b = left.select(key, label, F.col("vec").alias("_a")), right.select(key, F.col("vec").alias("_b"))
    cosine = dot(F.col("_a"), F.col("_b")) / (norm(F.col("_a")) * norm(F.col("_b")))
    worst = F.when(F.bool_or(F.coalesce(F.isnan("_cos"), F.lit(True))), float("nan")).otherwise(F.min("_cos"))
    return a.join(b, key).withColumn("_cos", F.coalesce(cosine, F.lit(float("nan")))).groupBy(label).agg(F.count("*").alias("n"), worst.alias("min_cosine")).withColumn("passed", ~F.isnan("min_cosine") & (F.col("min_cosine") >= gate))


def embedding_report(records: DataFrame) -> DataFrame:
    """Counts by failure_kind; ok for none."""
    return records.groupBy(F.coalesce("failure_kind", F.lit("ok")).alias("kind")).agg(F.count("*").alias("n"))


def tie_order(score: str | None = "score", row_id: str | None = "row_id") -> list[Column]:
    """Score descending, path, page (none last), offset, row id."""
    order = [F.desc(score)] if score else []
    return [*order, F.asc("relative_path"), F.asc_nulls_last("page_number"), F.asc("start_offset"), *([F.asc(row_id)] if row_id else [])]


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.trunc(x * 10**digits + np.copysign(0.5, x)) / 10**digits


class _Nearest(Best):
    """Best rows by the product of vectors."""

    def __init__(self, asked: dict[str, pa.Array], k: int, digits: int | None):
        super().__init__(asked["query_id"], k)
        self.vecs, self.digits = matrix(asked["vec"]), digits
        self.slack = 4 * np.finfo(float).eps * self.vecs.shape[1] * np.linalg.norm(self.vecs, axis=1)  # of a product in a block, times the row's norm

    def see(self, rows: dict[str, pa.Array]) -> None:
        r = matrix(rows.pop("vec"))
        slack = np.linalg.norm(r, axis=1).max() * self.slack + (0 if self.digits is None else 1.001 * 10.0**-self.digits)
        at, of = self.above(r @ self.vecs.T, slack)
        # Pair by pair, so that equal vectors have equal scores wherever they lie in a block.
        s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", r[at[a : a + 65536]], self.vecs[of[a : a + 65536]]) for a in range(0, len(at), 65536))])
        self.take(rows, at, of, s if self.digits is None else _rounded(s, self.digits))


def cosine_topk(index: DataFrame, queries: DataFrame, k: int = 50, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """Exact top k per query inside its space: (query_id, row_id, order columns, score, rank); with digits, scores are rounded before they are ranked.

    Blocks of queries meet blocks of rows as matrix products. A task hands on its k best per query by the full order, so
    ties at the cut are settled exactly; the ranks are then taken over all tasks.
    """
    rows = (index.where(where) if where is not None else index).select("space", "row_id", "relative_path", "page_number", "start_offset", "vec")
    asked = queries.select("space", F.col("query_id").cast("long").alias("query_id"), "vec")
    out = products(rows, asked, best(lambda asked: _Nearest(asked, k, digits)), "query_id long, row_id long, relative_path string, page_number int, start_offset long, score double")
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*tie_order())))
    return ranked.where(F.col("rank") <= k)


def nearest_other(vectors: DataFrame) -> DataFrame:
    """(vec_id, self_cosine, other_cosine): each vector against all others, block by block."""
    rows = vectors.select(F.lit("").alias("space"), F.col("vec_id").cast("long").alias("vec_id"), "vec")

    def score(rows: dict, asked: dict) -> pa.RecordBatch:
        s = matrix(rows["vec"]) @ matrix(asked["vec"]).T
        same = rows["vec_id"].to_numpy()[:, None] == asked["vec_id"].to_numpy()[None, :]
        best = [np.where(mask, s, -np.inf).max(axis=0) for mask in (same, ~same)]
        return pa.RecordBatch.from_arrays([asked["vec_id"], *map(pa.array, best)], ["vec_id", "self_cosine", "other_cosine"])

    out = products(rows, rows, each(score), "vec_id long, self_cosine double, other_cosine double")
    return out.groupBy("vec_id").agg(F.max("self_cosine").alias("self_cosine"), F.max("other_cosine").alias("other_cosine"))
