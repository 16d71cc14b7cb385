"""Metrics of predictions: one aggregate over confusion counts and tie-averaged ranks, by group or pooled.

Undefined values are null, and averages skip them: no AUC for one class, no recall for an absent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOLED = "descriptive only: pools dependent rows as if they were independent"
METRICS = ("balanced_accuracy", "macro_f1", "roc_auc")


def _d(c: Column) -> Column:
    return c.cast("double")


def confusion(preds: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    t, p = F.col(y) == 1, F.col(pred) == 1
    return preds.groupBy(*keys).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def with_rates(conf: DataFrame) -> DataFrame:
    """Counts with n_test, n_positive, sensitivity, specificity, balanced accuracy and macro F1.

    Balanced accuracy averages the recalls of the classes that are present; macro F1 the classes present or predicted.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    sens, spec = _d(tp) / F.nullif(_d(tp + fn), F.lit(0.0)), _d(tn) / F.nullif(_d(tn + fp), F.lit(0.0))
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    ba = (F.coalesce(sens, F.lit(0.0)) + F.coalesce(spec, F.lit(0.0))) / F.nullif(_d(present), F.lit(0.0))
    f1 = lambda hit, a, b: _d(hit * 2) / F.nullif(_d(hit * 2 + a + b), F.lit(0.0))
    f1_pos, f1_neg = f1(tp, fp, fn), f1(tn, fn, fp)
    seen = (tp + fp + fn > 0).cast("int") + (tn + fp + fn > 0).cast("int")
    macro = (F.coalesce(f1_pos, F.lit(0.0)) + F.coalesce(f1_neg, F.lit(0.0))) / F.nullif(_d(seen), F.lit(0.0))
    return conf.select("*", (tn + fp + fn + tp).alias("n_test"), (tp + fn).alias("n_positive"), sens.alias("sensitivity"), spec.alias("specificity"), ba.alias("balanced_accuracy"), macro.alias("macro_f1"))


def roc_auc(preds: DataFrame, keys: list[str], y: str = "y", proba: str = "proba") -> DataFrame:
    """The share of (positive, negative) pairs in order, ties half; null for one class.

    Rows are first counted by score, so ranks run over distinct scores, and a group's ties are one row.
    """
    by = preds.groupBy(*keys, proba).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    below = Window.partitionBy(*keys).orderBy(proba).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    out = by.groupBy(*keys).agg(F.sum(_d(F.col("_p")) * (_d(F.col("_below")) + _d(F.col("_n")) / 2.0)).alias("_w"), F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    return out.select(*keys, (F.col("_w") / F.nullif(_d(F.col("_ps")) * _d(F.col("_ns")), F.lit(0.0))).alias("roc_auc"))


#: Scores are ranked in so many ranges of [0, 1] and then over these, so that no task ranks all scores of a pool.
RANGES = 1024


def fold_metrics(preds: DataFrame, keys: list[str], y: str = "y", pred: str = "pred", proba: str = "proba") -> DataFrame:
    """Counts, rates and AUC by keys, from one aggregate of the predictions, so that a fit behind them runs once.

    A null score ranks lowest.
    """
    by = preds.groupBy(*keys, F.col(proba).alias("_s"), (F.col(pred) == 1).alias("_said")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_s")
    ties = Window.partitionBy(*keys, "_s")
    by = by.select("*", F.sum("_n").over(below.rangeBetween(Window.unboundedPreceding, 0)).alias("_to"), F.sum("_n").over(ties).alias("_tied"))
    return _scored(by, keys, _d(F.col("_to") - F.col("_tied")) + _d(F.col("_tied")) / 2.0)


def pooled_metrics(preds: DataFrame, y: str = "y", pred: str = "pred", proba: str = "proba") -> DataFrame:
    """One row for all predictions together, with a warning: it takes dependent rows as independent.

    Scores are ranked in RANGES parts of [0, 1] and then over these, so no task ranks them all.
    """
    by = preds.groupBy(F.floor(F.col(proba) * RANGES).alias("_r"), F.col(proba).alias("_s"), (F.col(pred) == 1).alias("_said")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    piles = by.groupBy("_r").agg(F.sum("_n").alias("_rn"))
    piles = piles.select(F.col("_r").alias("_r2"), (F.sum("_rn").over(Window.orderBy("_r")) - F.col("_rn")).alias("_r0"))
    inside, ties = Window.partitionBy("_r").orderBy("_s"), Window.partitionBy("_r", "_s")
    by = by.select("*", F.sum("_n").over(inside.rangeBetween(Window.unboundedPreceding, 0)).alias("_to"), F.sum("_n").over(ties).alias("_tied"))
    by = by.join(F.broadcast(piles), F.col("_r").eqNullSafe(F.col("_r2")))
    out = _scored(by, [], _d(F.col("_r0") + F.col("_to") - F.col("_tied")) + _d(F.col("_tied")) / 2.0)
    return out.withColumn("warning", F.lit(POOLED))


def _scored(by: DataFrame, keys: list[str], below: Column) -> DataFrame:
    hits = lambda said, c: F.sum(F.when(F.col("_said") == said, F.col(c)).otherwise(0))
    auc = F.sum(_d(F.col("_p")) * below) / F.nullif(_d(F.sum("_p")) * _d(F.sum("_n")), F.lit(0.0))
    out = by.groupBy(*keys).agg(hits(False, "_n").alias("tn"), hits(True, "_n").alias("fp"), hits(False, "_p").alias("fn"), hits(True, "_p").alias("tp"), auc.alias("roc_auc"))
    return with_rates(out)


def pooled_and_fold_metrics(preds: DataFrame, key: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Each fold's rates and, with a null fold, those of all rows pooled, from one pass by grouping sets.

    The pooled row takes dependent rows as independent: it describes, it isn't a result to infer from.
    """
    t, p = F.col(y) == 1, F.col(pred) == 1
    counts = [F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp")]
    rows = preds.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping(key).cast("int").alias("pooled"), *counts)
    return with_rates(rows)


def unpivot(metrics: DataFrame, keys: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    return metrics.unpivot(keys, list(names), "metric", "value")


def summary(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, std (null under two values), median, n_valid and n_above_half of the values that aren't null."""
    v = F.col(value)
    return values.groupBy(*keys).agg(F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_samp(v)).alias("std"), F.percentile(v, F.lit(0.5)).alias("median"), F.count(v).alias("n_valid"), F.count_if(v > 0.5).alias("n_above_half"))


def summary_by_unit(values: DataFrame, keys: list[str], unit: str, value: str = "value") -> DataFrame:
    """summary() with columns named after the unit whose values are summarised, say subject or fold."""
    names = {"std": f"std_across_{unit}s", "n_valid": f"n_{unit}s", "n_above_half": "n_above_half_descriptive_count"}
    return summary(values, keys, value).withColumnsRenamed(names)


def run_out_summary(run_metrics: DataFrame, subject: str = "subject") -> tuple[DataFrame, DataFrame]:
    """(subject, metric, value) as means over a subject's runs, and their summary over subjects."""
    long = unpivot(run_metrics, [subject, "fold"])
    per = long.groupBy(subject, "metric").agg(F.avg("value").alias("value"), F.count("*").alias("n_runs"))
    return per, summary(per, ["metric"])


def class_counts(rows: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Rows and positives by the keys and each shorter run of them, and in all."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("n_positive"))
