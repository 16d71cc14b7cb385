"""Temporal dependence: lagged correlation of window features, and the gap that it asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.operators import ordering


def lag_pairs(features: DataFrame, lags: list[int], at: str, step: int = 1, column: str = "features") -> DataFrame:
    """lag, a, b: features of rows whose `at` differ by exactly lag * step; a join by key, whatever the gaps."""
    if not lags or any(k <= 0 for k in lags):
        raise ValueError("lags must be positive integers")
    if step < 1:
        raise ValueError("the step between rows is at least 1")
    left = features.select(F.col(at).alias("_t"), F.col(column).alias("a"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    left = left.select("lag", "a", (F.col("_t") + F.col("lag") * step).alias("_t"))
    return left.join(features.select(F.col(at).alias("_t"), F.col(column).alias("b")), "_t").select("lag", "a", "b")


def lag_autocorrelation(features: DataFrame, lags: list[int], at: str, step: int = 1, column: str = "features") -> DataFrame:
    """lag, value, n_pairs: mean absolute correlation over columns that vary on both sides; null under three pairs.

    Sums are taken about the pairs' means, in two passes, so a large level doesn't swallow the spread.
    """
    pairs = lag_pairs(features, lags, at, step, column).select("lag", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p"))
    pairs = pairs.select("lag", "i", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    means = pairs.groupBy("lag", "i").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.count("*").alias("n"))
    c = pairs.join(F.broadcast(means), ["lag", "i"]).select("lag", "i", "n", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"))
    s = c.groupBy("lag", "i", "n").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    r = F.when((F.col("aa") > 1e-24) & (F.col("bb") > 1e-24) & (F.col("n") >= 3), F.abs(F.col("ab")) / F.sqrt(F.col("aa") * F.col("bb")))
    got = s.groupBy("lag").agg(F.avg(r).alias("value"), F.max("n").alias("n_pairs"))
    frame = features.sparkSession.createDataFrame([(k,) for k in lags], "lag int")
    return frame.join(got, "lag", "left").select("lag", "value", F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs"))


def time_gaps(windows: DataFrame, win: int, at: str = "start") -> DataFrame:
    """One row: pairs of neighbours along time, and those that aren't adjacent."""
    return ordering.steps(windows, at, win)


def choose_gap(report: DataFrame, threshold: float = 0.30) -> DataFrame:
    """One row (gap, reason): the lag before the first one that is below the threshold.

    The first lag below: gap 0. A null met first: undefined. None below: the largest lag.
    """
    hit = report.where(F.col("value").isNull() | (F.col("value") < threshold))
    first = hit.agg(F.min_by(F.struct("lag", "value"), "lag").alias("h"))
    ends = report.agg(F.min("lag").alias("lo"), F.max("lag").alias("hi"))
    h = first.join(F.broadcast(ends)).select("lo", "hi", F.col("h.lag").alias("lag"), F.col("h.value").alias("value"))
    gap = F.when(F.col("lag").isNull(), F.col("hi")).when(F.col("value").isNull(), F.lit(None)).when(F.col("lag") == F.col("lo"), 0).otherwise(F.col("lag") - 1)
    reason = F.when(F.col("lag").isNull(), F.lit("never_below")).when(F.col("value").isNull(), F.concat(F.lit("undefined_at_lag_"), "lag")).when(F.col("lag") == F.col("lo"), F.lit("already_below")).otherwise(F.concat(F.lit("crossed_at_lag_"), "lag"))
    return h.select(gap.cast("int").alias("gap"), reason.alias("reason"))
