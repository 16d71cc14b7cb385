"""Spatial patterns: band-pass, class covariances, CSP and linear discriminants, fitted inside folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.functions import kernels
from epochfold.operators import fold_sums


def bandpass(epochs: DataFrame, lo: float, hi: float, sfreq: float, order: int = 4, x: str = "x") -> DataFrame:
    """Zero-phase Butterworth band-pass of an array column; rows of a batch side by side, a loop over time alone."""
    b, a = kernels.butter_bandpass(lo, hi, sfreq, order)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(list(kernels.filtfilt(b, a, np.stack(column.to_numpy()).astype(float)))) if len(column) else pd.Series([], dtype=object)

    return epochs.withColumn(x, run(F.col(x)))


def bandpass_channels(epochs: DataFrame, lo: float, hi: float, sfreq: float, order: int = 4, channels: str = "channels") -> DataFrame:
    """The same for every channel of channels: array<struct<name, x>>; epochs of a batch go side by side by their shape."""
    b, a = kernels.butter_bandpass(lo, hi, sfreq, order)

    @F.pandas_udf("array<array<double>>")
    def run(column: pd.Series) -> pd.Series:
        shapes: dict = {}
        for i, epoch in enumerate(column):
            shapes.setdefault((len(epoch), len(epoch[0]) if len(epoch) else 0), []).append(i)
        out: list = [[]] * len(column)
        for (n, _), own in shapes.items():
            if n:
                filtered = kernels.filtfilt(b, a, np.stack([np.stack(column.iloc[i]) for i in own]).astype(float))
                for i, x in zip(own, filtered, strict=True):
                    out[i] = list(x)
        return pd.Series(out, dtype=object)

    filtered = run(F.transform(channels, lambda c: c["x"]))
    named = F.zip_with(channels, filtered, lambda c, x: F.struct(c["name"].alias("name"), x.alias("x")))
    return epochs.withColumn(channels, named)


def class_covariance(epochs: DataFrame, keys: list[str], channels: str = "channels") -> DataFrame:
    """Sums of products of channels i <= j over epochs and samples, by keys: n, sum_xy.

    Products are made inside a row from its arrays, so what is shuffled is a row for each pair and task.
    """
    pairs = F.flatten(F.transform(channels, lambda a, i: F.transform(F.filter(F.transform(channels, lambda b, j: F.struct(j.alias("j"), b.alias("b"))), lambda p: p["j"] >= i), lambda p: F.struct(i.alias("i"), p["j"].alias("j"), F.aggregate(F.zip_with(a["x"], p["b"]["x"], lambda u, v: u * v), F.lit(0.0).cast("double"), lambda s, v: s + v).alias("s"), F.size(a["x"]).alias("n")))))
    rows = epochs.select(*keys, F.explode(pairs).alias("_p"))
    return rows.groupBy(*keys, F.col("_p.i").alias("ch_i"), F.col("_p.j").alias("ch_j")).agg(F.sum("_p.n").cast("long").alias("n"), F.sum("_p.s").alias("sum_xy"))


def lda_moments(features: DataFrame, y: str = "y", column: str = "features") -> DataFrame:
    """Class means and within-class sums of products of features i <= j: y, i, j, n, mean_i, mean_j, within.

    Products are taken about the class means, so no large sums are subtracted.
    """
    size = F.posexplode(column).alias("i", "v")
    means = features.select(y, size).groupBy(y, "i").agg(F.avg("v").alias("m"))
    listed = means.groupBy(y).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_m"))
    c = features.join(F.broadcast(listed), y).select(y, "_m", F.zip_with(column, "_m", lambda a, b: a - b).alias("_d"))
    pairs = F.flatten(F.transform("_d", lambda a, i: F.transform(F.filter(F.transform("_d", lambda b, j: F.struct(j.alias("j"), b.alias("b"))), lambda p: p["j"] >= i), lambda p: F.struct(i.alias("i"), p["j"].alias("j"), (a * p["b"]).alias("s")))))
    rows = c.select(y, "_m", F.explode(pairs).alias("_p"))
    out = rows.groupBy(y, F.col("_p.i").alias("i"), F.col("_p.j").alias("j")).agg(F.count("*").alias("n"), F.first("_m").alias("_m"), F.sum("_p.s").alias("within"))
    return out.select(y, "i", "j", "n", F.get("_m", F.col("i")).alias("mean_i"), F.get("_m", F.col("j")).alias("mean_j"), "within")


def csp_lda_folds(split: DataFrame, keys: list[str], row_id: str, components: int = 6, channels: str = "channels", y: str = "y") -> DataFrame:
    """Test rows of each fold with pred and proba of CSP and a discriminant fitted on the fold's training epochs.

    A split of fold_sums.epoch_moments, made before rows meet folds, spares their making in each fold.
    """
    if "moments" not in split.columns:
        split = fold_sums.epoch_moments(split, channels)
    return fold_sums.csp_lda(split, keys, row_id, components, y=y)
