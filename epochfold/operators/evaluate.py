"""Evaluators: a split, a model, fold metrics, their summary and an interval over groups, as one job graph.

The grouping unit is a parameter. Predictions are fitted once and kept, so folds, pooled figures and coefficients all
read the same fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.operators import metrics as M
from epochfold.operators import fold_sums, models, resample, splits
from epochfold.operators.models import ModelSpec


@dataclass(frozen=True)
class Report:
    """folds: metrics a fold; summary and ci: by metric; pooled: all rows, descriptive only; predictions: test rows."""

    folds: DataFrame
    summary: DataFrame
    ci: DataFrame
    pooled: DataFrame
    predictions: DataFrame
    config: dict

    def to_dict(self) -> dict:
        """For a JSON file: a row a fold and metric, never a row a sample."""
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        return {"folds": rows(self.folds), "summary": rows(self.summary), "ci": rows(self.ci), "pooled": rows(self.pooled), "config": self.config}


def report(predictions: DataFrame, keys: list[str], unit: str, n_boot: int = 10_000, seed: int = 42, parity: bool = True, **config) -> Report:
    """predictions(keys, y, pred, proba) to a Report; unit is the key that the interval resamples."""
    p = predictions.persist()
    folds = M.fold_metrics(p, keys)
    per = M.unpivot(folds, keys).groupBy(unit, "metric").agg(F.avg("value").alias("value"))
    boot = resample.bootstrap_ci_numpy if parity else resample.bootstrap_ci
    pooled = M.pooled_metrics(p)
    return Report(folds, M.summary(per, ["metric"]), boot(per, ["metric"], unit, n_boot=n_boot, seed=seed), pooled, p, {"unit": unit, "n_boot": n_boot, "seed": seed, **config})


def provenance(split: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Training and test index hashes and sizes of each fold."""
    h = splits.index_hash(split, keys, row_id)
    return h.groupBy(*keys).pivot("role", ["train", "test"]).agg(F.first("index_hash").alias("hash"), F.first("n").alias("n"))


def evaluate_loso(rows: DataFrame, group: str, row_id: str, spec: ModelSpec | None = None, dummy: str | None = None, grid: list[dict] | None = None, inner_splits: int = 5, n_boot: int = 10_000, seed: int = 42) -> Report:
    """Leave one group out. dummy names a baseline in place of the model; a grid is searched inside training rows."""
    if dummy is None and not isinstance(spec, ModelSpec):
        raise ValueError("pass an unfitted ModelSpec or a dummy's name")
    split = splits.leave_one_group_out(rows, group)
    if dummy:
        preds = models.dummy(split, ["fold"], dummy, row_id, seed=seed)
    else:
        preds = models.fit_folds(split, ["fold"], row_id, spec, grid=grid, inner_group=group if grid else None, inner_splits=inner_splits)
    return report(preds, ["fold"], "fold", n_boot, seed, group=group, tuned=bool(grid), dummy=dummy)


def evaluate_leave_one_run_out(rows: DataFrame, row_id: str, spec: ModelSpec, subject: str = "subject", run: str = "run", n_boot: int = 10_000, seed: int = 42) -> Report:
    """Leave one run out inside each subject; a subject's score is the mean of its runs, and the interval is over subjects."""
    split = splits.valid_folds(splits.leave_one_run_out(rows, subject, run), [subject, "fold"])
    return report(models.fit_folds(split, [subject, "fold"], row_id, spec, strict=False), [subject, "fold"], subject, n_boot, seed)


def evaluate_within_subject(rows: DataFrame, row_id: str, spec: ModelSpec, subject: str = "subject", k: int = 5, n_boot: int = 10_000, seed: int = 42) -> Report:
    """Stratified shuffled folds inside each subject, scored over the subject's rows together."""
    split = splits.roles_of(splits.stratified_kfold(rows, "y", row_id, k, seed, [subject]), k)
    return report(models.fit_folds(split, [subject, "fold"], row_id, spec, strict=False), [subject], subject, n_boot, seed)


def evaluate_naive(rows: DataFrame, row_id: str, spec: ModelSpec, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified shuffled folds over all rows, groups ignored: one pooled row, to show what leaks."""
    split = splits.roles_of(splits.stratified_kfold(rows, "y", row_id, k, seed), k)
    preds = models.fit_folds(split, ["fold"], row_id, spec, strict=False)
    return M.pooled_metrics(preds).drop("warning")


def evaluate_expanding(rows: DataFrame, group: str, order: str, spec: ModelSpec, n_init: int, step: int = 1, gap: int = 0, n_boot: int = 10_000, seed: int = 42) -> Report:
    """Walk forward over groups in time."""
    if spec.kind == "logistic":
        preds = fold_sums.expanding_logistic(rows, group, order, n_init, step, gap, spec.params.get("c", 1.0), spec.params.get("balanced", True))
    else:
        preds = models.fit_folds(splits.expanding_by_group(rows, group, order, n_init, step, gap), ["fold"], order, spec)
    return report(preds, ["fold"], "fold", n_boot, seed, n_init=n_init, step=step, gap=gap)


def evaluate_chronological(rows: DataFrame, order: str, spec: ModelSpec, fraction: float = 0.7, gap: int = 0, seed: int = 42) -> Report:
    """One fold: the past trains, what comes after the gap tests."""
    placed = splits.row_numbers(rows, order)
    split = splits.chronological(placed, placed.count(), fraction, gap)
    return report(models.fit_folds(split, ["fold"], order, spec, strict=False), ["fold"], "fold", 2, seed, fraction=fraction, gap=gap)
