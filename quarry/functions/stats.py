"""Column formulas of interval estimates and chance baselines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95) -> Column:
    """struct<low, high>: the Wilson score interval, within [0, 1]; zeros where total is not positive."""
    n, p = total.cast("double"), successes / total
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low = F.when(total > 0, F.greatest(F.lit(0.0), (centre - spread) / scale)).otherwise(0.0)
    high = F.when(total > 0, F.least(F.lit(1.0), (centre + spread) / scale)).otherwise(0.0)
    return F.struct(low.alias("low"), high.alias("high"))


def chance_of_hit(pool: Column, relevant: Column, cut: int) -> Column:
    """P(at least one relevant row) in a uniform draw of `cut` rows without replacement."""
    draws = F.least(F.lit(cut).cast("long"), pool.cast("long"))
    miss = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(draws - 1, F.lit(0).cast("long"))), F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(0.0), (pool - relevant - i) / F.greatest(pool - i, F.lit(1))))
    return F.when((relevant <= 0) | (draws <= 0), 0.0).when(relevant >= pool, 1.0).otherwise(1 - miss)


def poisson_binomial_tail(trials: DataFrame, observed: DataFrame, tails: dict[str, str] | None = None) -> DataFrame:
    """observed (arm, hits, ..) with p_value = P(X >= hits) for the independent trials (arm, chance) of the arm; no trials: 1. tails names other
    columns of counts and those that get their P.

    The distribution is the inverse Fourier transform of the product over trials of 1 - p + p w, w a root of unity. Equal chances are counted first; the
    logarithm of the product is a sum over them for each frequency, partially aggregated like any sum. The roots are those of the order of the window
    outside which less than 1e-16 of the distribution lies, and only frequencies count whose product can exceed 1e-18: a hundred or so of them at any number of
    trials. The tail at a count is then a sum over these, each a geometric series. No task sees an arm's trials; errors are of the order 1e-14, absolute.
    """
    c = F.col
    p = F.least(F.greatest("chance", F.lit(0.0)), F.lit(1.0))
    counted = trials.groupBy("arm", p.alias("p")).agg(F.count("*").alias("n"))
    spread = F.sum(c("n") * c("p") * (1 - c("p")))
    arms = counted.groupBy("arm").agg(F.sum("n").alias("_n"), F.sum(c("n") * c("p")).alias("_mean"), spread.alias("_var"))
    half = F.ceil(12.4 + F.sqrt(152 + 74 * c("_var")))  # Bernstein: 1e-16 on each side
    size = F.least(c("_n") + 1, 2 * half + 2).cast("long")
    first = F.greatest(F.lit(0), F.least(F.floor(c("_mean")) - half, c("_n") + 1 - size)).cast("long")
    arms = arms.withColumn("_size", size).withColumn("_first", first)
    few = F.least(F.floor(c("_size") / 2), F.ceil(2.27 * c("_size") / F.sqrt(F.greatest("_var", F.lit(1e-9))))).cast("long")
    angle = 2 * math.pi * c("k") / c("_size")
    each = counted.join(arms.select("arm", "_size", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(few, F.lit(1).cast("long")))).alias("k")).where(c("_size") > 1), "arm").withColumn("a", angle)
    size_log = 0.5 * F.log1p(F.greatest(-4 * c("p") * (1 - c("p")) * F.sin(c("a") / 2) * F.sin(c("a") / 2), F.lit(-1 + 1e-15)))
    turn = F.atan2(c("p") * F.sin("a"), 1 - c("p") + c("p") * F.cos("a")) - c("p") * c("a")  # about the mean, so it stays small
    waves = each.groupBy("arm", "k", "a").agg(F.sum(c("n") * size_log).alias("log"), F.sum(c("n") * turn).alias("turn"))
    listed = waves.groupBy("arm").agg(F.collect_list(F.struct("k", "a", "log", "turn")).alias("_waves"))
    whole = arms.join(listed, "arm", "left")

    def value(hits: str) -> Column:
        last, h = c("_first") + c("_size") - 1, c(hits)
        length = last - h + 1
        term = lambda w: F.when(2 * w["k"] == c("_size"), 1.0).otherwise(2.0) * F.exp(w["log"]) * F.cos(w["turn"] - w["a"] * ((h + last) / 2 - c("_mean"))) * F.sin(w["a"] * length / 2) / F.sin(w["a"] / 2)
        tail = (length + F.aggregate(F.coalesce("_waves", F.array().cast("array<struct<k:bigint,a:double,log:double,turn:double>>")), F.lit(0.0), lambda s, w: s + term(w))) / c("_size")
        return F.when(c("_size").isNull() | (h <= c("_first")), 1.0).when(h > last, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))

    tails = tails or {"hits": "p_value"}
    return observed.join(whole, "arm", "left").withColumns({name: value(hits) for hits, name in tails.items()}).drop("_n", "_mean", "_var", "_size", "_first", "_waves")
