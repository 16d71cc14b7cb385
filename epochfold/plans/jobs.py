"""Whole evaluations as one call each: a labelled recording, trials of several subjects, and spatial patterns.

Features whose fit reads samples (clipping) are made again in every fold from its training rows; others are made once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochfold.operators import clip as K
from epochfold.operators import evaluate as E
from epochfold.operators import metrics as M
from epochfold.operators import fold_sums, models, spatial, spectral, splits
from epochfold.operators import temporal as T
from epochfold.operators import windows as W
from epochfold.operators.models import ModelSpec
from epochfold.sources import edf


def clipped_power(split: DataFrame, keys: list[str], row_id: str, sfreq: float, bands: dict, n_times: int, rows: DataFrame, group: str, channels: str = "channels") -> DataFrame:
    """A split's rows with features: each fold's channels clipped at limits of its training rows, then band power.

    Features are channel-major, then by band. split has channels: array<struct<name, x>>. rows are the split's, each
    once, and group the column of both by which a fold takes rows for training: all of a group or none of it.
    """
    rest = [c for c in split.columns if c != channels]
    one = split.select(*rest, F.posexplode(channels).alias("channel_ord", "_c")).select(*rest, "channel_ord", F.col("_c.x").alias("x"))
    values = rows.select(F.col(group).alias("_group"), F.posexplode(channels).alias("channel_ord", "_c")).select("_group", "channel_ord", F.explode("_c.x").alias("v"))
    trained = split.where("role = 'train'").select(*keys, F.col(group).alias("_group"))
    fitted = K.fold_limits(values, trained, keys, "_group", ["channel_ord"])
    power = spectral.band_power(K.clip_arrays(one, fitted, [*keys, "channel_ord"]), sfreq, bands, n_times, out="_f")
    listed = F.array_sort(F.collect_list(F.struct("channel_ord", "_f")))
    return power.groupBy(*rest).agg(F.flatten(F.transform(listed, lambda s: s["_f"])).alias("features"))


def temporal_diagnostic(windows: DataFrame, n: int, fraction: float, sfreq: float, bands: dict, win: int, lags: list[int], threshold: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Lag report and gap of the first part of the windows, with everything fitted on that part alone.

    windows(start, channels, pos); a gap that isn't defined raises in the caller, as a run can't go on without one.
    """
    prefix = windows.where(F.col("pos") < int(fraction * n)).withColumn("fold", F.lit(0)).withColumn("role", F.lit("train"))
    report = T.lag_autocorrelation(clipped_power(prefix, ["fold"], "start", sfreq, bands, win, prefix, "role"), lags, "start", win)
    return report, T.choose_gap(report, threshold)


def recording_job(samples: DataFrame, channels: list[str], sfreq: float, bands: dict | None = None, win_sec: float = 1.0, per_super: int = 4, n_init: int = 6, lags: tuple[int, ...] = (1, 2, 3, 4, 5), n_boot: int = 10_000, seed: int = 42, trees: int = 300) -> dict:
    """One long labelled recording under five protocols: shuffled, chronological, expanding, merged and native blocks.

    The merged blocks are scored by a kernel machine and a forest as well.

    samples(sample_idx, y, a double column a channel). The result is small: rows by fold and metric.
    """
    bands = bands or spectral.STANDARD_BANDS
    win = W.window_samples(win_sec, sfreq)
    blocked = W.label_blocks(samples).persist()
    w = W.tumbling(blocked, win, channels, carry=("block",)).withColumnRenamed("label", "y")
    w = w.select("start", "y", "block", F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in channels]).alias("channels"))
    w = splits.row_numbers(w.join(W.super_blocks(w, per_super), "block"), "start").persist()
    n = w.count()
    if not n:
        raise ValueError("the recording yields no windows of a single label")
    _, gap = temporal_diagnostic(w, n, 0.7, sfreq, bands, win, list(lags))
    chosen = gap.first()
    if chosen["gap"] is None:
        raise RuntimeError(f"the temporal gap is {chosen['reason']}")
    spec = ModelSpec()

    def score(split: DataFrame, strict: bool, rows: DataFrame, group: str) -> E.Report:
        f = clipped_power(split, ["fold"], "start", sfreq, bands, win, rows, group)
        return E.report(models.fit_folds(f, ["fold"], "start", spec, strict=strict), ["fold"], "fold", n_boot, seed)

    def secondary() -> dict:
        f = clipped_power(splits.leave_one_group_out(w, "super_block"), ["fold"], "start", sfreq, bands, win, w, "super_block").persist()
        kernel = models.fit_folds(f, ["fold"], "start", ModelSpec("svm_rbf", {"c": 1.0, "balanced": False}))
        forest = models.random_forest(f, "fold", "start", trees, seed)
        got = {name: E.report(p, ["fold"], "fold", n_boot, seed).to_dict() for name, p in (("svm_rbf", kernel), ("random_forest", forest))}
        f.unpersist()
        return got

    dealt = splits.stratified_kfold(w, "y", "start", 5, seed).withColumn("part", F.col("fold"))
    split = splits.chronological(w, n, 0.7, chosen["gap"])
    out = {
        "naive": score(splits.roles_of(dealt, 5), False, dealt, "part").to_dict()["pooled"],
        "chronological": score(split, False, split, "role").to_dict(),
        "expanding": score(splits.expanding_by_group(w, "block", "start", n_init), True, w, "block").to_dict(),
        "merged_blocks": score(splits.leave_one_group_out(w, "super_block"), True, w, "super_block").to_dict(),
        "native_blocks": score(splits.leave_one_group_out(w, "block"), True, w, "block").to_dict(),
        "secondary": secondary(),
        "merged_blocks_prior": E.evaluate_loso(w, "super_block", "start", dummy="prior", n_boot=n_boot, seed=seed).to_dict(),
        "class_summary": [r.asDict() for r in W.class_summary(w, "super_block", "y").collect()],
        "gap": chosen.asDict(),
    }
    w.unpersist()
    blocked.unpersist()
    return out


def trials_job(features: DataFrame, names: list[str], row_id: str = "epoch_id", n_boot: int = 10_000, seed: int = 42, trees: int = 300) -> dict:
    """Trials(row_id, subject, run, y, features) within subjects, by runs, by subjects, and shuffled over all.

    Trials without a run column, as from an older cache, have no protocol by runs: its place is null.
    """
    f = features.persist()
    spec = ModelSpec()
    within = E.evaluate_within_subject(f, row_id, spec, n_boot=n_boot, seed=seed)
    loso = E.evaluate_loso(f, "subject", row_id, spec, n_boot=n_boot, seed=seed)
    out = {
        "within_subject": within.to_dict(),
        "leave_one_run_out": E.evaluate_leave_one_run_out(f, row_id, spec, n_boot=n_boot, seed=seed).to_dict() if "run" in f.columns else None,
        "leave_one_subject_out": loso.to_dict(),
        "unweighted_c_half": E.evaluate_loso(f, "subject", row_id, ModelSpec("logistic", {"c": 0.5, "balanced": False}), n_boot=n_boot, seed=seed).to_dict(),
        "random_forest": E.report(models.random_forest(splits.leave_one_group_out(f, "subject"), "fold", row_id, trees, seed), ["fold"], "fold", n_boot, seed).to_dict(),
        "naive": E.evaluate_naive(f, row_id, spec, seed=seed).first().asDict(recursive=True),
        "coefficients": [r.asDict() for r in models.top_coefficients(models.coefficient_means(within.predictions, [], names, ("subject", "fold"))).collect()],
    }
    f.unpersist()
    return out


def spatial_job(epochs: DataFrame, components: int = 6, row_id: str = "epoch_id", n_boot: int = 10_000, seed: int = 42, band: tuple[float, float] = (8.0, 30.0), sfreq: float = edf.SFREQ) -> dict:
    """Epochs(row_id, subject, run, y, channels) by spatial patterns: across subjects, across runs, shuffled within.

    Epochs are band-passed first, each by itself, so nothing of it is fitted.
    """
    e = fold_sums.epoch_moments(spatial.bandpass_channels(epochs, *band, sfreq)).persist()
    cross = splits.valid_folds(splits.leave_one_group_out(e, "subject"), ["fold"])
    runs = splits.valid_folds(splits.leave_one_run_out(e), ["subject", "fold"])
    shuffled = splits.roles_of(splits.stratified_kfold(e, "y", row_id, 5, seed, ["subject"]), 5)
    score = lambda split, keys, by, unit: E.report(spatial.csp_lda_folds(split, keys, row_id, components), by, unit, n_boot, seed).to_dict()
    out = {
        "leave_one_subject_out": score(cross, ["fold"], ["fold"], "fold"),
        "leave_one_run_out": score(runs, ["subject", "fold"], ["subject", "fold"], "subject"),
        "within_subject": score(shuffled, ["subject", "fold"], ["subject"], "subject"),
    }
    e.unpersist()
    return out


def calibration_curve(rows: DataFrame, subject: str, row_id: str, spec: ModelSpec, counts: tuple[int, ...] = (0, 1, 2, 3, 5), draws: int = 50, seed: int = 42) -> DataFrame:
    """Balanced accuracy on a held-out subject when k of its labelled rows a class join the training rows.

    subject, k, draw, value; rows drawn for training leave the test rows. One fit for each subject, k and draw.
    """
    split = splits.leave_one_group_out(rows, subject)
    many = split.select("*", F.explode(F.array(*[F.lit(k) for k in counts])).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    many = many.where("k > 0 OR draw = 1")
    w = Window.partitionBy("fold", "k", "draw", "role", "y").orderBy(splits.draw(seed, F.col("draw"), F.col(row_id)), row_id)
    many = many.withColumn("_r", F.row_number().over(w)).withColumn("role", F.when((F.col("role") == "test") & (F.col("_r") <= F.col("k")), "train").otherwise(F.col("role"))).drop("_r")
    preds = models.fit_folds(many, ["fold", "k", "draw"], row_id, spec)
    return M.with_rates(M.confusion(preds, ["fold", "k", "draw"])).select(F.col("fold").alias(subject), "k", "draw", F.col("balanced_accuracy").alias("value"))


def drift_control(windows: DataFrame, n: int, head: int, spec: ModelSpec, row_id: str = "start", pos: str = "pos") -> DataFrame:
    """Can the first windows be told from the last? Labels are the place in time; a score far from a half is drift."""
    ends = windows.where((F.col(pos) < head) | (F.col(pos) >= n - head)).withColumn("y", (F.col(pos) >= n - head).cast("int"))
    return E.evaluate_naive(ends, row_id, spec)
