"""Queries over splits, metrics, baselines, resampling and dependence; each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochfold.operators import metrics as M
from epochfold.operators import fold_sums, models, refit, resample, spatial, spectral, splits
from epochfold.operators import temporal as T
from epochfold.operators import windows as W
from epochfold.plans import signal_queries as S
from epochfold.plans.fit_sql import fit_sql, solve_sql
from epochfold.plans.signal_queries import BANDS, EIGHT, power_sql, r8
from epochfold.session import stash
from epochfold.sources import edf, results
from epochfold.sources import fixtures as X
from epochfold.sources.fixtures import WINDOW, views

SEED, BOOTS, PERMS, REFITS = 42, 10_000, 200, 50
LAGS = [1, 2, 3, 4, 5]
LEAST_TRAIN = 5  # blocks before the first test block


# ---- splits

def _trials(s, d):
    return X.trials(s, d).select("epoch_id", "subject", "run", "y")


def splits_loso(s, d):
    return splits.leave_one_group_out(_trials(s, d), "subject").select("fold", "epoch_id", "role")


def splits_loro(s, d):
    return splits.valid_folds(splits.leave_one_run_out(_trials(s, d)), ["subject", "fold"]).select("subject", "fold", "epoch_id", "role")


def _windows(s, d):
    return S.windows(s, d).select("start", "label", "block")


def splits_expanding_group(s, d):
    w = stash(_windows(s, d), "windows")
    return splits.expanding_by_group(w, "block", "start", LEAST_TRAIN, 2, 1).select("fold", "start", "role")


def splits_expanding_row(s, d):
    w = splits.row_numbers(_windows(s, d), "start")
    return splits.expanding_by_row(w, w.count(), 20, 50, 5).select("fold", "start", "role")


def splits_chronological(s, d):
    w = splits.row_numbers(_windows(s, d), "start")
    return splits.chronological(w, w.count(), 0.7, 3).select("start", "pos", "role")


def splits_stratified_kfold(s, d):
    return splits.stratified_kfold(_trials(s, d), "y", "epoch_id", 5, SEED).select("epoch_id", "fold")


def splits_within_subject_kfold(s, d):
    return splits.stratified_kfold(_trials(s, d), "y", "epoch_id", 5, SEED, ["subject"]).select("subject", "epoch_id", "fold")


def splits_group_kfold(s, d):
    return splits.group_kfold(_trials(s, d), "subject", 3)


def split_index_hash(s, d):
    return splits.index_hash(splits.leave_one_group_out(_trials(s, d), "subject"), ["fold"], "epoch_id")


def fold_validity_semijoin(s, d):
    return splits.valid_folds(splits.leave_one_run_out(_trials(s, d)), ["subject", "fold"]).where("role = 'test'").select("subject", "fold", "epoch_id")


_LOSO = "folds AS (SELECT f.fold, t.*, CASE WHEN t.subject = f.fold THEN 'test' ELSE 'train' END AS role FROM trials t, (SELECT DISTINCT subject AS fold FROM trials) f)"
_LORO = lambda src: f"""many AS (SELECT subject FROM {src} GROUP BY subject HAVING count(DISTINCT run) >= 2),
    runs AS (SELECT DISTINCT subject, run AS fold FROM {src} WHERE subject IN (SELECT subject FROM many)),
    each AS (SELECT t.*, fold, CASE WHEN run = fold THEN 'test' ELSE 'train' END AS role FROM {src} t JOIN runs USING (subject)),
    ok AS (SELECT subject, fold FROM each GROUP BY subject, fold HAVING count(DISTINCT CASE WHEN role = 'train' THEN y END) = 2 AND count(*) FILTER (WHERE role = 'test') > 0)"""  # noqa: E731
_DRAW = lambda *p: f"('0x' || substr(md5('{SEED}:' || {' || chr(58) || '.join(p)}), 1, 8))::BIGINT"
_PLACED = "placed AS (SELECT start, row_number() OVER (ORDER BY start) - 1 AS pos, count(*) OVER () AS n FROM windows)"

SPLIT_SQL = {
    "splits_loso": views("trials") + f", {_LOSO} SELECT fold, epoch_id, role FROM folds",
    "splits_loro": views("trials") + f", {_LORO('trials')} SELECT subject, fold, epoch_id, role FROM each JOIN ok USING (subject, fold)",
    "splits_expanding_group": views("recording", "windows") + f""", o AS (SELECT *, dense_rank() OVER (ORDER BY block) - 1 AS ord FROM windows),
        f AS (SELECT DISTINCT ord AS fold FROM o WHERE ord >= {LEAST_TRAIN} AND (ord - {LEAST_TRAIN}) % 2 = 0)
        SELECT fold::INT AS fold, start, CASE WHEN ord = fold THEN 'test' ELSE 'train' END AS role FROM o, f WHERE ord = fold OR ord < fold - 1""",
    "splits_expanding_row": views("recording", "windows") + f""", {_PLACED}, f AS (SELECT unnest(range(20, (SELECT max(n) FROM placed), 50)) AS fold)
        SELECT fold, start, CASE WHEN pos >= fold THEN 'test' ELSE 'train' END AS role FROM placed, f WHERE (pos >= fold AND pos < fold + 50) OR pos < fold - 5""",
    "splits_chronological": views("recording", "windows") + f""", {_PLACED} SELECT start, pos, CASE WHEN pos < floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS role
        FROM placed WHERE pos < floor(0.7::DOUBLE * n) OR pos >= floor(0.7::DOUBLE * n) + 3""",
    "splits_stratified_kfold": views("trials") + f" SELECT epoch_id, ((row_number() OVER (PARTITION BY y ORDER BY {_DRAW('epoch_id')}, epoch_id) - 1) % 5)::INT AS fold FROM trials",
    "splits_within_subject_kfold": views("trials") + f" SELECT subject, epoch_id, ((row_number() OVER (PARTITION BY subject, y ORDER BY {_DRAW('epoch_id')}, epoch_id) - 1) % 5)::INT AS fold FROM trials",
    "splits_group_kfold": "WITH RECURSIVE " + views("trials")[5:] + """, g AS (SELECT subject, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, subject) AS i FROM trials GROUP BY subject),
        step(i, subject, fold, w) AS (SELECT 0::BIGINT, NULL::INT, NULL::INT, [0, 0, 0]::BIGINT[]
          UNION ALL SELECT g.i, g.subject, (list_position(w, list_min(w)) - 1)::INT, list_transform(w, lambda v, k: CASE WHEN k = list_position(w, list_min(w)) THEN v + g.n ELSE v END) FROM step JOIN g ON g.i = step.i + 1)
        SELECT subject, fold FROM step WHERE i > 0""",
    "split_index_hash": views("trials") + f", {_LOSO} SELECT fold, role, substr(sha1(string_agg(epoch_id::VARCHAR, ',' ORDER BY epoch_id)), 1, 12) AS index_hash, count(*) AS n FROM folds GROUP BY fold, role",
    "fold_validity_semijoin": views("trials") + f", {_LORO('trials')} SELECT subject, fold, epoch_id FROM each JOIN ok USING (subject, fold) WHERE role = 'test'",
}


# ---- fold statistics, dummies, centroids

def _loso(s, d):
    return splits.leave_one_group_out(_trials(s, d), "subject")


def fold_scaler_stats(s, d):
    f = models.loso_moments(S.power_long(s, d), "subject")
    return f.select("fold", "band", r8("mean").alias("mean"), r8("sd").alias("sd"))


def _dummy(s, d, strategy):
    p = models.dummy(_loso(s, d), ["fold"], strategy, "epoch_id", seed=SEED)
    return p.select("fold", "epoch_id", "y", "pred", r8("proba").alias("proba"))


def dummy_most_frequent(s, d):
    return _dummy(s, d, "most_frequent")


def dummy_prior(s, d):
    return _dummy(s, d, "prior")


def dummy_stratified_hash(s, d):
    return _dummy(s, d, "stratified")


def dummy_uniform_hash(s, d):
    return _dummy(s, d, "uniform")


def _rounded(df, keys, names):
    return df.select(*keys, *[r8(n).alias(n) for n in names])


def per_split_baselines(s, d):
    split = _loso(s, d)
    preds = None
    for name in ("most_frequent", "stratified", "uniform"):
        p = models.dummy(split, ["fold"], name, "epoch_id", seed=SEED).withColumn("strategy", F.lit(name))
        preds = p if preds is None else preds.unionByName(p)
    out = M.fold_metrics(preds, ["fold", "strategy"])
    rates = models.training_classes(split, ["fold"]).select("fold", "majority", F.col("rate").alias("positive_rate_train"))
    out = out.join(rates, "fold").withColumn("positive_rate_test", F.col("n_positive") / F.col("n_test"))
    return _rounded(out, ["fold", "strategy", "n_test", "majority"], ["positive_rate_train", "positive_rate_test", *M.METRICS])


def cv_dummy_baselines(s, d):
    rows = splits.roles_of(splits.stratified_kfold(_trials(s, d), "y", "epoch_id", 5, SEED), 5)
    out = None
    for name in ("most_frequent", "stratified", "uniform"):
        p = models.dummy(rows, ["fold"], name, "epoch_id", seed=SEED).withColumn("strategy", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return _rounded(M.fold_metrics(out, ["strategy"]), ["strategy", "n_test"], [*M.METRICS])


def _centroid(s, d):
    return models.loso_centroid(S.power_long(s, d), "subject", "epoch_id")


def loso_centroid_end_to_end(s, d):
    """Fit on training subjects, score the held-out one, average over subjects, with an interval over subjects."""
    per = M.unpivot(M.fold_metrics(_centroid(s, d), ["fold"]), ["fold"]).persist()
    out = M.summary(per, ["metric"]).join(resample.bootstrap_ci(per, ["metric"], "fold", n_boot=BOOTS, seed=SEED), "metric")
    return _rounded(out, ["metric", "n_valid", "n_above_half"], ["mean", "std", "median", "lo", "hi"])


def coef_topk(s, d):
    """Differences of the class centroids on scaled features, as weights, averaged over folds: the largest three."""
    t = models.loso_moments(S.power_long(s, d), "subject")
    means = t.groupBy(F.col("band").alias("name")).agg(F.avg((F.col("c1") - F.col("c0")) / F.col("sd")).alias("mean_coefficient"))
    return _rounded(models.top_coefficients(means, 3), ["name"], ["mean_coefficient"])


_CLASSES = "classes AS (SELECT fold, count(*) AS n, count(*) FILTER (WHERE y = 1) AS p FROM folds WHERE role = 'train' GROUP BY fold)"
_U = f"({_DRAW('fold', 'epoch_id')})::DOUBLE / 4294967296.0::DOUBLE"
_PICKS = {
    "most_frequent": ("(2 * p > n)::INT", "(2 * p > n)::INT::DOUBLE"), "prior": ("(2 * p > n)::INT", "p::DOUBLE / n"),
    "stratified": (f"({_U} < p::DOUBLE / n)::INT", f"({_U} < p::DOUBLE / n)::INT::DOUBLE"), "uniform": (f"({_U} < 0.5::DOUBLE)::INT", "0.5::DOUBLE"),
}
_PREDS = lambda name: f"SELECT fold, epoch_id, y, {_PICKS[name][0]} AS pred, {_PICKS[name][1]} AS proba FROM folds JOIN classes USING (fold) WHERE role = 'test'"
_DUMMY = lambda name: views("trials") + f", {_LOSO}, {_CLASSES}, preds AS ({_PREDS(name)}) SELECT fold, epoch_id, y, pred, round(proba, 8) AS proba FROM preds"


def metric_sql(keys: str, source: str = "preds") -> str:
    """conf, auc and m(keys, counts, rates, roc_auc) from rows of source."""
    k = keys or "1"
    return f"""conf AS (SELECT {keys}, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
        count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM {source} GROUP BY {k}),
    ranked AS (SELECT {keys}, y, rank() OVER (PARTITION BY {k} ORDER BY proba) + (count(*) OVER (PARTITION BY {k}, proba) - 1) / 2.0::DOUBLE AS r FROM {source}),
    auc AS (SELECT {keys}, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE)
        / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0) AS roc_auc FROM ranked GROUP BY {k}),
    rates AS (SELECT *, tn + fp + fn + tp AS n_test, tp + fn AS n_positive, tp::DOUBLE / nullif(tp + fn, 0) AS sensitivity, tn::DOUBLE / nullif(tn + fp, 0) AS specificity,
        2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1p, 2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0) AS f1n FROM conf),
    m AS (SELECT *, (coalesce(sensitivity, 0) + coalesce(specificity, 0)) / ((sensitivity IS NOT NULL)::INT + (specificity IS NOT NULL)::INT) AS balanced_accuracy,
        (coalesce(f1p, 0) + coalesce(f1n, 0)) / ((f1p IS NOT NULL)::INT + (f1n IS NOT NULL)::INT) AS macro_f1 FROM rates JOIN auc USING ({keys}))"""


_R = lambda *names: ", ".join(f"round({n}, 8) AS {n}" for n in names)
_LONG = "per AS (SELECT fold, unnest(['balanced_accuracy', 'macro_f1', 'roc_auc']) AS metric, unnest([balanced_accuracy, macro_f1, roc_auc]) AS value FROM m)"


def boot_sql(source: str, key: str, order: str, boots: int) -> str:
    """boot(key, point, n, lo, hi) of source(key, order, value)."""
    return f"""listed AS (SELECT {key}, list(value ORDER BY {order}) AS v FROM {source} WHERE value IS NOT NULL GROUP BY {key}),
    draws AS (SELECT {key}, b, avg(v[1 + {_DRAW('b', 'j')} % len(v)]) AS mean FROM listed, unnest(range({boots})) AS x(b), unnest(range(len(v))) AS z(j) WHERE len(v) > 1 GROUP BY {key}, b),
    spread AS (SELECT {key}, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM draws GROUP BY {key}),
    boot AS (SELECT {key}, list_avg(v) AS point, len(v) AS n, lo, hi FROM listed LEFT JOIN spread USING ({key}))"""


_CENTROID = power_sql() + f""", longfolds AS (SELECT f.fold, t.*, CASE WHEN t.subject = f.fold THEN 'test' ELSE 'train' END AS role FROM power_rows t, (SELECT DISTINCT subject AS fold FROM trials) f),
    fit AS (SELECT fold, band, CASE WHEN stddev_pop(power) > 0 THEN stddev_pop(power) ELSE 1 END AS s, avg(power) FILTER (WHERE y = 0) AS c0, avg(power) FILTER (WHERE y = 1) AS c1 FROM longfolds WHERE role = 'train' GROUP BY fold, band),
    dist AS (SELECT fold, epoch_id, y, sqrt(sum(((power - c0) / s) ** 2)) AS d0, sqrt(sum(((power - c1) / s) ** 2)) AS d1 FROM longfolds JOIN fit USING (fold, band) WHERE role = 'test' GROUP BY fold, epoch_id, y),
    preds AS (SELECT fold, epoch_id, y, (d1 < d0)::INT AS pred, coalesce(d0 / nullif(d0 + d1, 0), 0.5) AS proba FROM dist)"""
_THREE = ["most_frequent", "stratified", "uniform"]
_CV = f"""own AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY {_DRAW('epoch_id')}, epoch_id) - 1) % 5)::INT AS f FROM trials),
    folds AS (SELECT fold::INT AS fold, own.*, CASE WHEN f = fold THEN 'test' ELSE 'train' END AS role FROM own, unnest(range(5)) AS u(fold))"""

FOLD_SQL = {
    "fold_scaler_stats": _CENTROID + " SELECT fold, band, round(avg(power), 8) AS mean, round(CASE WHEN stddev_pop(power) > 0 THEN stddev_pop(power) ELSE 1 END, 8) AS sd FROM longfolds WHERE role = 'train' GROUP BY fold, band",
    "dummy_most_frequent": _DUMMY("most_frequent"), "dummy_prior": _DUMMY("prior"), "dummy_stratified_hash": _DUMMY("stratified"), "dummy_uniform_hash": _DUMMY("uniform"),
    "per_split_baselines": views("trials") + f", {_LOSO}, {_CLASSES}, preds AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS strategy FROM ({_PREDS(n)})" for n in _THREE) + f"), {metric_sql('fold, strategy')}" + f"""
        SELECT fold, strategy, n_test, (2 * p > n)::INT AS majority, round(p::DOUBLE / n, 8) AS positive_rate_train, round(n_positive::DOUBLE / n_test, 8) AS positive_rate_test, {_R(*M.METRICS)} FROM m JOIN classes USING (fold)""",
    "cv_dummy_baselines": views("trials") + f", {_CV}, {_CLASSES}, preds AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS strategy FROM ({_PREDS(n)})" for n in _THREE) + f"), {metric_sql('strategy')} SELECT strategy, n_test, {_R(*M.METRICS)} FROM m",
    "loso_centroid_end_to_end": _CENTROID + f", {metric_sql('fold')}, {_LONG}, {boot_sql('per', 'metric', 'fold', BOOTS)}" + f"""
        SELECT metric, count(value) AS n_valid, count(*) FILTER (WHERE value > 0.5) AS n_above_half, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std, round(median(value), 8) AS median,
        round(any_value(lo), 8) AS lo, round(any_value(hi), 8) AS hi FROM per JOIN boot USING (metric) GROUP BY metric""",
    "coef_topk": _CENTROID + """, w AS (SELECT fold, band, (avg(power) FILTER (WHERE y = 1) - avg(power) FILTER (WHERE y = 0)) / stddev_pop(power) AS v FROM longfolds WHERE role = 'train' GROUP BY fold, band)
        SELECT band AS name, round(avg(v), 8) AS mean_coefficient FROM w GROUP BY band ORDER BY abs(avg(v)) DESC, band LIMIT 3""",
}


# ---- metrics of scored rows

def confusion_by_fold(s, d):
    return M.confusion(X.scored(s, d), ["subject"])


def fold_metrics(s, d):
    return _rounded(M.fold_metrics(X.scored(s, d), ["subject"]), ["subject", "tn", "fp", "fn", "tp", "n_test", "n_positive"], ["sensitivity", "specificity", *M.METRICS])


def pooled_vs_fold_metrics(s, d):
    m = M.pooled_and_fold_metrics(X.scored(s, d), "subject")
    return _rounded(m, ["subject", "pooled", "n_test", "n_positive"], ["balanced_accuracy", "macro_f1"])


def roc_auc_by_group(s, d):
    return _rounded(M.roc_auc(X.scored(s, d).withColumn("g", F.substring(F.md5("row_key"), 1, 1)), ["subject", "g"]), ["subject", "g"], ["roc_auc"])


def _scored_long(s, d):
    return M.unpivot(M.fold_metrics(X.scored(s, d), ["subject"]), ["subject"])


def across_fold_summary(s, d):
    out = M.summary(M.unpivot(M.fold_metrics(_centroid(s, d), ["fold"]), ["fold"]), ["metric"])
    return _rounded(out, ["metric", "n_valid", "n_above_half"], ["mean", "std", "median"])


def loro_subject_summary(s, d):
    long = splits.valid_folds(splits.leave_one_run_out(_trials(s, d)), ["subject", "fold"])
    runs = M.fold_metrics(models.dummy(long, ["subject", "fold"], "stratified", "epoch_id", seed=SEED), ["subject", "fold"])
    _, out = M.run_out_summary(runs)
    return _rounded(out, ["metric", "n_valid", "n_above_half"], ["mean", "std", "median"])


def class_balance_rollup(s, d):
    return M.class_counts(_trials(s, d), ["subject", "run"])


_M = views("scored") + ", preds AS (SELECT * FROM scored), " + metric_sql("subject")
_UP = "per AS (SELECT subject, unnest(['balanced_accuracy', 'macro_f1', 'roc_auc']) AS metric, unnest([balanced_accuracy, macro_f1, roc_auc]) AS value FROM m)"
_SUMMARY = "count(value) AS n_valid, count(*) FILTER (WHERE value > 0.5) AS n_above_half, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std, round(median(value), 8) AS median"
_RUN_U = f"({_DRAW('subject', 'fold', 'epoch_id')})::DOUBLE / 4294967296.0::DOUBLE"
METRIC_SQL = {
    "confusion_by_fold": _M + " SELECT subject, tn, fp, fn, tp FROM conf",
    "fold_metrics": _M + f" SELECT subject, tn, fp, fn, tp, n_test, n_positive, {_R('sensitivity', 'specificity', *M.METRICS)} FROM m",
    "pooled_vs_fold_metrics": views("scored") + ", preds AS (SELECT subject::VARCHAR AS k, y, pred, proba FROM scored UNION ALL SELECT 'all', y, pred, proba FROM scored), " + metric_sql("k") + """
        SELECT CASE WHEN k = 'all' THEN NULL ELSE k::INT END AS subject, (k = 'all')::INT AS pooled, n_test, n_positive, round(balanced_accuracy, 8) AS balanced_accuracy, round(macro_f1, 8) AS macro_f1 FROM m""",
    "roc_auc_by_group": views("scored") + ", preds AS (SELECT *, substr(md5(row_key), 1, 1) AS g FROM scored), " + metric_sql("subject, g") + " SELECT subject, g, round(roc_auc, 8) AS roc_auc FROM m",
    "across_fold_summary": _CENTROID + f", {metric_sql('fold')}, {_LONG} SELECT metric, {_SUMMARY} FROM per GROUP BY metric",
    "loro_subject_summary": views("trials") + f""", {_LORO('trials')}, folds AS (SELECT each.* FROM each JOIN ok USING (subject, fold)),
        classes AS (SELECT subject, fold, count(*) AS n, count(*) FILTER (WHERE y = 1) AS p FROM folds WHERE role = 'train' GROUP BY subject, fold),
        preds AS (SELECT subject, fold, epoch_id, y, ({_RUN_U} < p::DOUBLE / n)::INT AS pred, ({_RUN_U} < p::DOUBLE / n)::INT::DOUBLE AS proba FROM folds JOIN classes USING (subject, fold) WHERE role = 'test'),
        {metric_sql('subject, fold')}, up AS (SELECT subject, unnest(['balanced_accuracy', 'macro_f1', 'roc_auc']) AS metric, unnest([balanced_accuracy, macro_f1, roc_auc]) AS v FROM m),
        per AS (SELECT subject, metric, avg(v) AS value FROM up GROUP BY ALL) SELECT metric, {_SUMMARY} FROM per GROUP BY metric""",
    "class_balance_rollup": views("trials") + " SELECT subject, run, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_positive FROM trials GROUP BY ROLLUP (subject, run)",
}


# ---- resampling and dependence

def bootstrap_ci_hash(s, d):
    out = resample.bootstrap_ci(_scored_long(s, d), ["metric"], "subject", n_boot=BOOTS, seed=SEED)
    return _rounded(out, ["metric", "n"], ["point", "lo", "hi"])


def bootstrap_ci_numpy(s, d):
    return _rounded(resample.bootstrap_ci_numpy(_scored_long(s, d), ["metric"], "subject", seed=SEED), ["metric", "n"], ["point", "lo", "hi"])


def paired_delta(s, d):
    a = M.fold_metrics(X.scored(s, d), ["subject"]).select("subject", F.col("balanced_accuracy").alias("value"))
    b = M.fold_metrics(X.scored(s, d).withColumn("pred", (F.col("proba") >= 0.3).cast("int")), ["subject"]).select("subject", F.col("balanced_accuracy").alias("value"))
    return _rounded(resample.paired_delta(a, b, "subject", n_boot=BOOTS, seed=SEED), ["n", "n_improved"], ["point", "lo", "hi"])


def within_group_permutation(s, d):
    """Is the threshold 32 Hz-power above its median related to the label? Labels are shuffled within subjects."""
    rows = X.trials(s, d).select("epoch_id", "subject", "y", (F.get("x", F.lit(0)) > 0).cast("int").alias("pred"))
    score = lambda df, keys: M.with_rates(M.confusion(df, [*keys, "subject"])).groupBy(*keys).agg(F.avg("balanced_accuracy").alias("value"))
    null = score(resample.permute_within(rows, "subject", "epoch_id", "y", PERMS, SEED), ["perm"])
    seen = score(rows.withColumn("perm", F.lit(0)), ["perm"])
    return _rounded(resample.permutation_p(seen, null), ["n_perm"], ["observed", "p_value", "null_mean", "null_std", "null_p95"])


def _window_features(s, d):
    x = F.col("x")
    mean = F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v) / WINDOW
    return S.windows(s, d).select("start", F.array(mean, F.array_max(x), F.get(x, F.lit(0))).alias("features"))


def lag_autocorr_rows(s, d):
    f = splits.row_numbers(_window_features(s, d), "start")
    return _rounded(T.lag_autocorrelation(f, LAGS, "pos"), ["lag", "n_pairs"], ["value"])


def lag_autocorr_time_aligned(s, d):
    return _rounded(T.lag_autocorrelation(_window_features(s, d), LAGS, "start", WINDOW), ["lag", "n_pairs"], ["value"])


def temporal_gap_choice(s, d):
    return T.choose_gap(T.lag_autocorrelation(_window_features(s, d), LAGS, "start", WINDOW), 0.05)


def window_time_gaps(s, d):
    return T.time_gaps(S.windows(s, d), WINDOW)


def missing_files_antijoin(s, d):
    """Expected subject x run files, of twelve subjects, that have no trial with a positive label."""
    want = s.range(12).select(F.col("id").cast("int").alias("subject"), F.explode(F.array(F.lit(4), F.lit(8), F.lit(12))).alias("run"))
    there = _trials(s, d).where("y = 1").select("subject", "run").distinct()
    return want.join(there, ["subject", "run"], "left_anti").select("subject", "run", F.format_string("S%03d/S%03dR%02d.edf", F.col("subject") + 1, F.col("subject") + 1, "run").alias("path"))


def trial_ids(s, d):
    n = F.row_number().over(Window.partitionBy("subject", "run").orderBy("epoch_id")) - 1
    return _trials(s, d).select("epoch_id", F.format_string("S%03d_R%02d_T%03d", F.col("subject") + 1, "run", n).alias("trial_id"))


_BA = "SELECT subject, balanced_accuracy AS value FROM m"
_FEATURES = """feature AS (SELECT start, i, CASE i WHEN 0 THEN list_avg(x) WHEN 1 THEN list_max(x) ELSE x[1] END AS v FROM windows, unnest(range(3)) AS u(i)),
    numbered AS (SELECT *, dense_rank() OVER (ORDER BY start) - 1 AS pos FROM feature)"""
_LAG = lambda at, step: f"""pairs AS (SELECT lag, a.i, a.v AS a, b.v AS b FROM numbered a, unnest({LAGS}) AS l(lag) JOIN numbered b ON b.i = a.i AND b.{at} = a.{at} + lag * {step}),
    cent AS (SELECT lag, i, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM pairs WINDOW w AS (PARTITION BY lag, i)),
    corr AS (SELECT lag, i, count(*) AS n, CASE WHEN count(*) >= 3 AND sum(a * a) > 1e-24 AND sum(b * b) > 1e-24 THEN abs(sum(a * b)) / sqrt(sum(a * a) * sum(b * b)) END AS r FROM cent GROUP BY lag, i),
    report AS (SELECT l.lag::INT AS lag, avg(r) AS value, coalesce(max(n), 0) AS n_pairs FROM unnest({LAGS}) AS l(lag) LEFT JOIN corr USING (lag) GROUP BY l.lag)"""  # noqa: E731
_W = views("recording", "windows")
_BA_PERM = "(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT)"
RESAMPLE_SQL = {
    "bootstrap_ci_hash": _M + f", {_UP}, {boot_sql('per', 'metric', 'subject', BOOTS)} SELECT metric, n, {_R('point', 'lo', 'hi')} FROM boot",
    "paired_delta": _M + f", first AS ({_BA}), second AS (WITH preds AS (SELECT * REPLACE ((proba >= 0.3)::INT AS pred) FROM scored), {metric_sql('subject')} {_BA})," + f"""
        delta AS (SELECT 0 AS k, subject, second.value - first.value AS value FROM first JOIN second USING (subject)), {boot_sql('delta', 'k', 'subject', BOOTS)}
        SELECT n, (SELECT count(*) FROM delta WHERE value > 0) AS n_improved, {_R('point', 'lo', 'hi')} FROM boot""",
    "within_group_permutation": views("trials") + f""", base AS (SELECT epoch_id, subject, y, (x[1] > 0)::INT AS pred, row_number() OVER (PARTITION BY subject ORDER BY epoch_id) AS r FROM trials),
        drawn AS (SELECT perm, subject, y, row_number() OVER (PARTITION BY perm, subject ORDER BY {_DRAW('perm', 'epoch_id')}, epoch_id) AS r FROM base, unnest(range(1, {PERMS + 1})) AS u(perm)),
        mixed AS (SELECT perm, subject, d.y, pred FROM drawn d JOIN base USING (subject, r) UNION ALL SELECT 0, subject, y, pred FROM base),
        conf AS (SELECT perm, subject, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM mixed GROUP BY ALL),
        s AS (SELECT perm, avg({_BA_PERM}) AS value FROM conf GROUP BY perm), o AS (SELECT value AS observed FROM s WHERE perm = 0)
        SELECT count(*) AS n_perm, round(any_value(observed), 8) AS observed, round((count(*) FILTER (WHERE value >= observed) + 1)::DOUBLE / (count(*) + 1), 8) AS p_value,
        round(avg(value), 8) AS null_mean, round(stddev_samp(value), 8) AS null_std, round(quantile_cont(value, 0.95), 8) AS null_p95 FROM s, o WHERE perm > 0""",
    "lag_autocorr_rows": _W + f", {_FEATURES}, {_LAG('pos', 1)} SELECT lag, n_pairs, round(value, 8) AS value FROM report",
    "lag_autocorr_time_aligned": _W + f", {_FEATURES}, {_LAG('start', WINDOW)} SELECT lag, n_pairs, round(value, 8) AS value FROM report",
    "temporal_gap_choice": _W + f", {_FEATURES}, {_LAG('start', WINDOW)}, h AS (SELECT lag, value FROM report WHERE value IS NULL OR value < 0.05 ORDER BY lag LIMIT 1)" + """
        SELECT (CASE WHEN lag IS NULL THEN 5 WHEN value IS NULL THEN NULL WHEN lag = 1 THEN 0 ELSE lag - 1 END)::INT AS gap,
        CASE WHEN lag IS NULL THEN 'never_below' WHEN value IS NULL THEN 'undefined_at_lag_' || lag WHEN lag = 1 THEN 'already_below' ELSE 'crossed_at_lag_' || lag END AS reason FROM (SELECT 1) LEFT JOIN h ON true""",
    "window_time_gaps": _W + f", g AS (SELECT lead(start) OVER (ORDER BY start) - start AS d FROM windows) SELECT count(d) AS n_adjacent, count(*) FILTER (WHERE d <> {WINDOW}) AS n_gapped FROM g",
    "missing_files_antijoin": views("trials") + """ SELECT s::INT AS subject, r::INT AS run, printf('S%03d/S%03dR%02d.edf', (s + 1)::INT, (s + 1)::INT, r::INT) AS path FROM unnest(range(12)) AS a(s), unnest([4, 8, 12]) AS b(r)
        WHERE NOT EXISTS (SELECT 1 FROM trials WHERE y = 1 AND subject = s AND run = r)""",
    "trial_ids": views("trials") + " SELECT epoch_id, printf('S%03d_R%02d_T%03d', subject + 1, run, (row_number() OVER (PARTITION BY subject, run ORDER BY epoch_id) - 1)::INT) AS trial_id FROM trials",
}


# ---- names, files and texts of results

def channel_names(s, d):
    """Channel labels as files pad them, and as they are compared."""
    t = X.trials(s, d).select("epoch_id", F.concat(F.initcap(F.substring(F.md5(F.col("epoch_id").cast("string")), 1, 3)), F.lit("..")).alias("label"))
    return t.select("epoch_id", "label", edf.clean_name(F.col("label")).alias("name"))


def run_ids(s, d):
    """The run that a file's path names."""
    subject = F.format_string("S%03d", F.col("subject") + 1)
    t = _trials(s, d).select("epoch_id", F.concat(F.lit("data/"), edf.expected_path(subject, F.col("run"))).alias("path"))
    return t.select("epoch_id", "path", edf.run_of_path(F.col("path")).alias("run"))


def file_digests(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return edf.digests(docs.withColumn("length", F.length("content").cast("long"))).withColumnRenamed("length", "nbytes")


def interval_texts(s, d):
    ci = resample.bootstrap_ci(_scored_long(s, d), ["metric"], "subject", n_boot=BOOTS, seed=SEED)
    return ci.select("metric", results.ci_text(F.col("point"), F.col("lo"), F.col("hi"), 2).alias("interval"))


def pooled_metrics(s, d):
    return _rounded(M.pooled_metrics(X.scored(s, d)), ["n_test", "n_positive"], ["balanced_accuracy", "macro_f1", "roc_auc"])


def cross_subject_folds(s, d):
    """Folds over subjects whose training rows have both classes, and their sizes."""
    f = splits.valid_folds(splits.leave_one_group_out(_trials(s, d), "subject"), ["fold"])
    return f.groupBy("fold", "role").agg(F.count("*").alias("n"))


def prefix_gap(s, d):
    """The gap that the first seventy per cent of the windows ask for."""
    f = splits.row_numbers(_window_features(s, d), "start")
    head = f.where(F.col("pos") < int(0.7 * f.count()))
    return _rounded(T.lag_autocorrelation(head, LAGS, "start", WINDOW), ["lag", "n_pairs"], ["value"])


def flat_channels(s, d):
    """Epochs of eight channels flattened to one array and cut again: first and last sample of each channel."""
    e = W.unflatten(W.flatten_channels(X.multichannel(s, d, EIGHT)).drop("channels"), list(EIGHT))
    one = e.select("epoch_id", F.explode("channels").alias("c"))
    return one.select("epoch_id", F.col("c.name").alias("channel"), r8(F.get("c.x", F.lit(0))).alias("first_x"), r8(F.element_at("c.x", -1)).alias("last_x"))


def feature_columns(s, d):
    """Names and values of the flat features, channel by channel and band by band."""
    power = S._channel_power(s, d)
    names = F.array(*[F.lit(n) for n in spectral.feature_names(list(X.FOUR_CHANNELS), S.LOW_BANDS)])
    at = F.array_position(names, F.concat_ws("_", "channel", "band"))
    return power.select("epoch_id", F.element_at(names, at.cast("int")).alias("feature"), r8("power").alias("power"))


NAME_SQL = {
    "channel_names": views("trials") + ", l AS (SELECT epoch_id, upper(substr(md5(epoch_id::VARCHAR), 1, 1)) || substr(md5(epoch_id::VARCHAR), 2, 2) || '..' AS label FROM trials) SELECT epoch_id, label, upper(replace(label, '.', '')) AS name FROM l",
    "run_ids": views("trials") + " SELECT epoch_id, printf('data/S%03d/S%03dR%02d.edf', subject + 1, subject + 1, run) AS path, run FROM trials",
    "file_digests": "SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS nbytes FROM documents",
    "interval_texts": _M + f", {_UP}, {boot_sql('per', 'metric', 'subject', BOOTS)} SELECT metric, CASE WHEN point IS NULL OR lo IS NULL OR hi IS NULL THEN 'n/a' ELSE printf('%.2f [%.2f, %.2f]', point, lo, hi) END AS interval FROM boot",
    "pooled_metrics": views("scored") + ", preds AS (SELECT 1 AS k, y, pred, proba FROM scored), " + metric_sql("k") + f" SELECT n_test, n_positive, {_R('balanced_accuracy', 'macro_f1', 'roc_auc')} FROM m",
    "cross_subject_folds": views("trials") + f", {_LOSO}, ok AS (SELECT fold FROM folds GROUP BY fold HAVING count(DISTINCT CASE WHEN role = 'train' THEN y END) = 2 AND count(*) FILTER (WHERE role = 'test') > 0) SELECT fold, role, count(*) AS n FROM folds JOIN ok USING (fold) GROUP BY fold, role",
    "prefix_gap": _W.replace("windows AS (", "whole AS (") + f", windows AS (SELECT * FROM whole QUALIFY row_number() OVER (ORDER BY start) <= floor(0.7::DOUBLE * count(*) OVER ())), {_FEATURES}, {_LAG('start', WINDOW)} SELECT lag, n_pairs, round(value, 8) AS value FROM report",
    "flat_channels": views("trials") + " SELECT epoch_id, 'CH' || i AS channel, round(x[i * 8 + 1], 8) AS first_x, round(x[i * 8 + 8], 8) AS last_x FROM trials, unnest(range(8)) AS u(i)",
    "feature_columns": S._CHANNEL_POWER + " SELECT epoch_id, channel || '_' || band AS feature, round(power, 8) AS power FROM power_rows",
}


# ---- fitted models; tests hold those without a SQL twin against NumPy

def _summary(preds, keys=("fold",), decimals=6):
    m = M.unpivot(M.fold_metrics(preds, list(keys)), list(keys))
    s = M.summary(m, ["metric"])
    return s.select("metric", "n_valid", "n_above_half", *[F.round(c, decimals).alias(c) for c in ("mean", "std", "median")])


def _feature_trials(s, d):
    return S.power(s, d).select("epoch_id", "subject", "run", "y", "features")


def loso_logreg(s, d):
    return _summary(models.fit_folds(splits.leave_one_group_out(_feature_trials(s, d), "subject"), ["fold"], "epoch_id", models.ModelSpec()))


def loro_logreg(s, d):
    split = splits.valid_folds(splits.leave_one_run_out(_feature_trials(s, d)), ["subject", "fold"])
    runs = M.fold_metrics(models.fit_folds(split, ["subject", "fold"], "epoch_id", models.ModelSpec(), strict=False), ["subject", "fold"])
    _, out = M.run_out_summary(runs)
    return out.select("metric", "n_valid", "n_above_half", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])


def within_subject_logreg(s, d):
    split = splits.roles_of(splits.stratified_kfold(_feature_trials(s, d), "y", "epoch_id", 5, SEED, ["subject"]), 5)
    return _summary(models.fit_folds(split, ["subject", "fold"], "epoch_id", models.ModelSpec(), strict=False), ("subject",))


def naive_logreg(s, d):
    """All rows shuffled, groups ignored: the leaky split that others are held against."""
    split = splits.roles_of(splits.stratified_kfold(_feature_trials(s, d), "y", "epoch_id", 5, SEED), 5)
    p = fold_sums.logistic(split, ["fold"], "epoch_id", strict=False)
    return _rounded(M.pooled_metrics(p).withColumn("all", F.lit("pooled")), ["all", "n_test"], M.METRICS)


def expanding_logreg(s, d):
    w = S.windows(s, d).withColumnRenamed("label", "y").join(_window_features(s, d), "start").select("start", "y", "block", "features")
    return _summary(fold_sums.expanding_logistic(w, "block", "start", LEAST_TRAIN))


def chronological_logreg(s, d):
    w = splits.row_numbers(S.windows(s, d).withColumnRenamed("label", "y").join(_window_features(s, d), "start").select("start", "y", "features"), "start")
    return _summary(fold_sums.logistic(splits.chronological(w, w.count()), ["fold"], "start", strict=False))


def loso_csp_lda(s, d):
    epochs = fold_sums.epoch_moments(X.multichannel(s, d, EIGHT))
    return _summary(spatial.csp_lda_folds(splits.leave_one_group_out(epochs, "subject"), ["fold"], "epoch_id"))


def loso_random_forest(s, d):
    return _summary(models.random_forest(splits.leave_one_group_out(_feature_trials(s, d), "subject"), "fold", "epoch_id"), decimals=4)


def loso_svm_rbf(s, d):
    spec = models.ModelSpec("svm_rbf", {"c": 1.0, "balanced": False})
    return _summary(models.fit_folds(splits.leave_one_group_out(_feature_trials(s, d), "subject"), ["fold"], "epoch_id", spec))


def nested_grid_logreg(s, d):
    split = splits.leave_one_group_out(_feature_trials(s, d), "subject")
    p = models.fit_folds(split, ["fold"], "epoch_id", models.ModelSpec(), grid=[{"c": 0.1}, {"c": 1.0}, {"c": 10.0}], inner_group="subject", inner_splits=3)
    return p.groupBy("fold").agg(F.first(F.element_at("chosen_params", "c")).alias("chosen_c"), F.count("*").alias("n_test"))


def coefficient_means(s, d):
    p = models.fit_folds(splits.leave_one_group_out(_feature_trials(s, d), "subject"), ["fold"], "epoch_id", models.ModelSpec())
    return _rounded(models.coefficient_means(p, [], list(BANDS)), ["name"], ["mean_coefficient"])


def coefficient_means_by_subject(s, d):
    split = splits.valid_folds(splits.leave_one_run_out(_feature_trials(s, d)), ["subject", "fold"])
    p = models.fit_folds(split, ["subject", "fold"], "epoch_id", models.ModelSpec(), strict=False)
    means = models.coefficient_means(p, ["subject"], list(BANDS), ("subject", "fold"))
    return means.select("subject", "name", F.round("mean_coefficient", 6).alias("mean_coefficient"))


def permutation_refit(s, d):
    """Does a model tell the labels of a subject that it hasn't seen better than models of shuffled labels do?"""
    out = refit.permutation_refit(_feature_trials(s, d), "subject", "epoch_id", REFITS, SEED)
    return _rounded(out, ["n_perm"], ["observed", "p_value", "null_mean", "null_std", "null_p95"])


_POWER = "WITH RECURSIVE " + power_sql()[5:] + ", trials_f AS (SELECT epoch_id, subject, run, y, " + ", ".join(f"max(power) FILTER (WHERE band = '{b}') AS f{j}" for j, b in enumerate(BANDS)) + " FROM power_rows GROUP BY ALL)"
_P = len(BANDS)
_LOSO_F = _POWER + ", " + _LOSO.replace("FROM trials t", "FROM trials_f t")
_FOLDS5 = lambda by: f"parts AS (SELECT *, ((row_number() OVER (PARTITION BY {by} ORDER BY {_DRAW('epoch_id')}, epoch_id) - 1) % 5)::INT AS part FROM trials_f), folds AS (SELECT parts.*, fold, CASE WHEN part = fold THEN 'test' ELSE 'train' END AS role FROM parts, (SELECT DISTINCT part AS fold FROM parts))"
_SIX = "count(value) AS n_valid, count(*) FILTER (WHERE value > 0.5) AS n_above_half, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median"
_WINDOW_F = "WITH RECURSIVE " + _W[5:] + f", {_FEATURES}, windows_f AS (SELECT start, any_value(label) AS y, any_value(block) AS block, " + ", ".join(f"max(v) FILTER (WHERE i = {j}) AS f{j}" for j in range(3)) + " FROM feature JOIN windows USING (start) GROUP BY start)"
_SUMMED = f"{metric_sql('fold')}, {_LONG} SELECT metric, {_SIX} FROM per GROUP BY metric"
_GRID = f"""settings(c) AS (VALUES (0.1::DOUBLE), (1.0), (10.0)),
    g AS (SELECT fold, subject, count(*) AS n, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, subject) AS i FROM folds WHERE role = 'train' GROUP BY fold, subject),
    step AS (SELECT DISTINCT fold, 0::BIGINT AS i, NULL::INT AS subject, NULL::INT AS part, [0, 0, 0]::BIGINT[] AS w FROM g
      UNION ALL SELECT g.fold, g.i, g.subject, (list_position(w, list_min(w)) - 1)::INT, list_transform(w, lambda v, k: CASE WHEN k = list_position(w, list_min(w)) THEN v + g.n ELSE v END) FROM step JOIN g ON g.fold = step.fold AND g.i = step.i + 1),
    inside AS (SELECT f.* EXCLUDE (role), t.part AS own, p.part AS inner_fold, c, CASE WHEN t.part = p.part THEN 'test' ELSE 'train' END AS role
      FROM folds f JOIN step t USING (fold, subject), (SELECT unnest(range(3)) AS part) p, settings WHERE f.role = 'train'),
    {fit_sql('fold, inner_fold, c', 'epoch_id', _P, 'inside', c='c')},
    recalls AS (SELECT fold, c, inner_fold, y, avg((pred = y)::INT) AS r FROM preds GROUP BY ALL),
    marks AS (SELECT fold, c, avg(m) AS mark FROM (SELECT fold, c, inner_fold, avg(r) AS m FROM recalls GROUP BY ALL) GROUP BY ALL),
    best AS (SELECT fold, min(c) AS c FROM (SELECT *, max(mark) OVER (PARTITION BY fold) AS top FROM marks) WHERE mark >= top - 1e-12 GROUP BY fold)
    SELECT fold, c::VARCHAR AS chosen_c, n_test FROM best JOIN (SELECT fold, count(*) AS n_test FROM folds WHERE role = 'test' GROUP BY fold) USING (fold)"""
_REFIT = f"""base AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY epoch_id) AS r FROM trials_f),
    drawn AS (SELECT perm, subject, y, row_number() OVER (PARTITION BY perm, subject ORDER BY {_DRAW('perm', 'epoch_id')}, epoch_id) AS r FROM base, unnest(range(1, {REFITS + 1})) AS u(perm)),
    mixed AS (SELECT perm, epoch_id, d.y FROM drawn d JOIN base USING (subject, r) UNION ALL SELECT 0, epoch_id, y FROM base),
    stat AS (SELECT fold, {", ".join(f"avg(f{j}) AS m{j}, CASE WHEN stddev_pop(f{j}) > 0 THEN stddev_pop(f{j}) ELSE 1 END AS s{j}" for j in range(_P))} FROM folds WHERE role = 'train' GROUP BY fold),
    scaled AS (SELECT fold, role, subject, epoch_id, {", ".join(f"(f{j} - m{j}) / s{j} AS x{j}" for j in range(_P))} FROM folds JOIN stat USING (fold)),
    gram AS (SELECT fold, {", ".join(f"sum(x{i} * x{j})" + (" + 1" if i == j else "") + f" AS h{i}_{j}" for i in range(_P) for j in range(i + 1))} FROM scaled WHERE role = 'train' GROUP BY fold),
    sides AS (SELECT fold, perm, {", ".join(f"sum(x{j} * (2 * y - 1)) AS g{j}" for j in range(_P))}, avg(2 * y - 1) AS a FROM scaled JOIN mixed USING (epoch_id) WHERE role = 'train' GROUP BY fold, perm),
    model AS (SELECT fold, perm, a, {", ".join(f"d{j}" for j in range(_P))} FROM (SELECT *, {", ".join(solve_sql(_P))} FROM sides JOIN gram USING (fold))),
    said AS (SELECT fold, perm, m.y, (a + {" + ".join(f"d{j} * x{j}" for j in range(_P))} > 0)::INT AS pred FROM scaled JOIN mixed m USING (epoch_id) JOIN model USING (fold, perm) WHERE role = 'test'),
    conf AS (SELECT perm, fold, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp FROM said GROUP BY ALL),
    s AS (SELECT perm, avg({_BA_PERM}) AS value FROM conf GROUP BY perm), o AS (SELECT value AS observed FROM s WHERE perm = 0)
    SELECT count(*) AS n_perm, round(any_value(observed), 8) AS observed, round((count(*) FILTER (WHERE value >= observed) + 1)::DOUBLE / (count(*) + 1), 8) AS p_value,
    round(avg(value), 8) AS null_mean, round(stddev_samp(value), 8) AS null_std, round(quantile_cont(value, 0.95), 8) AS null_p95 FROM s, o WHERE perm > 0"""
FIT_SQL = {
    "loso_logreg": _LOSO_F + f", {fit_sql('fold', 'epoch_id', _P, 'folds')}, {_SUMMED}",
    "loro_logreg": _POWER + f", {_LORO('trials_f')}, folds AS (SELECT each.* FROM each JOIN ok USING (subject, fold)), {fit_sql('subject, fold', 'epoch_id', _P, 'folds', strict=False)}, {metric_sql('subject, fold')}, "
    + _LONG.replace("SELECT fold", "SELECT subject, fold") + f", mean AS (SELECT subject, metric, avg(value) AS value FROM per GROUP BY ALL) SELECT metric, {_SIX} FROM mean GROUP BY metric",
    "within_subject_logreg": _POWER + f", {_FOLDS5('subject, y')}, {fit_sql('subject, fold', 'epoch_id', _P, 'folds', strict=False)}, {metric_sql('subject')}, {_UP} SELECT metric, {_SIX} FROM per GROUP BY metric",
    "naive_logreg": _POWER + f", {_FOLDS5('y')}, {fit_sql('fold', 'epoch_id', _P, 'folds', strict=False)}, pool AS (SELECT 'pooled' AS \"all\", y, pred, proba FROM preds), {metric_sql(chr(34) + 'all' + chr(34), 'pool')} SELECT \"all\", n_test, {_R(*M.METRICS)} FROM m",
    "expanding_logreg": _WINDOW_F + f""", o AS (SELECT *, dense_rank() OVER (ORDER BY block) - 1 AS ord FROM windows_f), f AS (SELECT DISTINCT ord AS fold FROM o WHERE ord >= {LEAST_TRAIN}),
        folds AS (SELECT fold, o.*, CASE WHEN ord = fold THEN 'test' ELSE 'train' END AS role FROM o, f WHERE ord <= fold), {fit_sql('fold', 'start', 3, 'folds')}, {_SUMMED}""",
    "chronological_logreg": _WINDOW_F + f""", {_PLACED}, folds AS (SELECT 0 AS fold, windows_f.*, CASE WHEN pos < floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS role FROM windows_f JOIN placed USING (start)),
        {fit_sql('fold', 'start', 3, 'folds', strict=False)}, {_SUMMED}""",
    "coefficient_means_by_subject": _POWER + f", {_LORO('trials_f')}, folds AS (SELECT each.* FROM each JOIN ok USING (subject, fold)), {fit_sql('subject, fold', 'epoch_id', _P, 'folds', strict=False)} SELECT subject, unnest({list(BANDS)}) AS name, unnest(["
    + ", ".join(f"round(avg(b{j}), 6)" for j in range(_P)) + "]) AS mean_coefficient FROM fit GROUP BY subject",
    "permutation_refit": _LOSO_F + ", " + _REFIT,
    "nested_grid_logreg": _LOSO_F + ", " + _GRID,
    "coefficient_means": _LOSO_F + f", {fit_sql('fold', 'epoch_id', _P, 'folds')} SELECT unnest({list(BANDS)}) AS name, unnest([" + ", ".join(f"round(avg(b{j}), 8)" for j in range(_P)) + "]) AS mean_coefficient FROM fit",
}

QUERIES = {f.__name__: f for f in (
    splits_loso, splits_loro, splits_expanding_group, splits_expanding_row, splits_chronological, splits_stratified_kfold, splits_within_subject_kfold, splits_group_kfold, split_index_hash, fold_validity_semijoin,
    fold_scaler_stats, dummy_most_frequent, dummy_prior, dummy_stratified_hash, dummy_uniform_hash, per_split_baselines, cv_dummy_baselines, loso_centroid_end_to_end, coef_topk,
    confusion_by_fold, fold_metrics, pooled_vs_fold_metrics, roc_auc_by_group, across_fold_summary, loro_subject_summary, class_balance_rollup,
    bootstrap_ci_hash, bootstrap_ci_numpy, paired_delta, within_group_permutation, lag_autocorr_rows, lag_autocorr_time_aligned, temporal_gap_choice, window_time_gaps, missing_files_antijoin, trial_ids,
    loso_logreg, loro_logreg, within_subject_logreg, naive_logreg, expanding_logreg, chronological_logreg, loso_csp_lda, loso_random_forest, loso_svm_rbf, nested_grid_logreg, coefficient_means, coefficient_means_by_subject, permutation_refit,
    channel_names, run_ids, file_digests, interval_texts, pooled_metrics, cross_subject_folds, prefix_gap, flat_channels, feature_columns,
)}
ORACLE = SPLIT_SQL | FOLD_SQL | METRIC_SQL | RESAMPLE_SQL | NAME_SQL | FIT_SQL
