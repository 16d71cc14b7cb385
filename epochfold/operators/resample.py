"""Resampling of group scores: bootstrap intervals, paired deltas, label permutation within groups.

The unit is the group: a group gives one value, so a table of values is as small as the groups are few. Two index
sources: a portable hash, which any engine can repeat, and NumPy's generator, for parity with array code.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochfold.operators.splits import draw


def bootstrap_ci(values: DataFrame, keys: list[str], order: str, value: str = "value", n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """point, lo, hi, n of the mean by keys: percentile interval over resamples of the groups, by hashed indices.

    Nulls are dropped; under two values there is no interval. A key's values travel as one array, a value a group.
    """
    have = values.where(F.col(value).isNotNull())
    listed = have.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("_v"))
    listed = listed.withColumn("_n", F.size("_v"))
    boots = listed.where("_n > 1").select(*keys, "_v", "_n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("_b"))

    def pick(j: Column) -> Column:
        return F.get("_v", (draw(seed, F.col("_b"), j) % F.col("_n")).cast("int"))

    mean = F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), F.lit(0.0).cast("double"), lambda a, j: a + pick(j)) / F.col("_n")
    spread = boots.select(*keys, mean.alias("_m")).groupBy(*keys).agg(F.percentile("_m", F.lit(alpha / 2)).alias("lo"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("hi"))
    point = F.aggregate("_v", F.lit(0.0).cast("double"), lambda a, v: a + v) / F.col("_n")
    return listed.select(*keys, point.alias("point"), F.col("_n").cast("long").alias("n")).join(spread, keys, "left")


def bootstrap_ci_numpy(values: DataFrame, keys: list[str], order: str, value: str = "value", n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The same with the indices of NumPy's default generator."""
    kinds = dict(values.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", point double, lo double, hi double, n long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().to_numpy(float)
        out = {k: [pdf[k].iloc[0]] for k in keys}
        if len(v) < 2:
            return pd.DataFrame({**out, "point": [v.mean() if len(v) else None], "lo": [None], "hi": [None], "n": [len(v)]})
        means = v[np.random.default_rng(seed).integers(0, len(v), (n_boot, len(v)))].mean(axis=1)
        lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({**out, "point": [v.mean()], "lo": [lo], "hi": [hi], "n": [len(v)]})

    return values.groupBy(*keys).applyInPandas(run, schema)


def paired_delta(a: DataFrame, b: DataFrame, group: str, value: str = "value", **boot) -> DataFrame:
    """One row: mean of b - a over shared groups, its interval, n and n_improved; nulls drop out of all."""
    both = a.select(group, F.col(value).alias("_a")).join(b.select(group, F.col(value).alias("_b")), group)
    d = both.select(group, (F.col("_b") - F.col("_a")).alias("value")).withColumn("_k", F.lit(0))
    ci = bootstrap_ci(d, ["_k"], group, **boot)
    more = d.groupBy("_k").agg(F.count_if(F.col("value") > 0).alias("n_improved"))
    return ci.join(more, "_k").drop("_k")


def permute_within(rows: DataFrame, group: str, row_id: str, y: str, n_perm: int, seed: int = 42, first: int = 1) -> DataFrame:
    """rows n_perm times, with perm (from first on) and y shuffled inside each group: the label ranked by a hash goes to the row ranked by id."""
    w_id = Window.partitionBy(group).orderBy(row_id)
    base = rows.withColumn("_r", F.row_number().over(w_id))
    perms = F.explode(F.sequence(F.lit(first), F.lit(first + n_perm - 1))).alias("perm")
    drawn = rows.select(group, row_id, F.col(y).alias("_y"), perms)
    w_hash = Window.partitionBy("perm", group).orderBy(draw(seed, F.col("perm"), F.col(row_id)), row_id)
    drawn = drawn.select("perm", group, "_y", F.row_number().over(w_hash).alias("_r"))
    return drawn.join(base, [group, "_r"]).select("perm", *[F.col("_y").alias(y) if c == y else F.col(c) for c in rows.columns])


def permutation_p(observed: DataFrame, null: DataFrame, value: str = "value") -> DataFrame:
    """One row: observed, p_value = (r + 1) / (n + 1) one-sided, and the null's mean, deviation and 95th percentile."""
    o = observed.select(F.col(value).alias("observed"))
    stats = null.join(F.broadcast(o)).groupBy("observed").agg(
        F.count("*").alias("n_perm"), F.count_if(F.col(value) >= F.col("observed")).alias("_r"),
        F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_std"), F.percentile(value, F.lit(0.95)).alias("null_p95"),
    )
    return stats.select("observed", ((F.col("_r") + 1) / (F.col("n_perm") + 1)).alias("p_value"), "n_perm", "null_mean", "null_std", "null_p95")
