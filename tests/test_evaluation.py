import numpy as np
import pytest
from pyspark.sql import functions as F

from epochfold.functions import kernels as K
from epochfold.operators import evaluate as E
from epochfold.operators import metrics as M
from epochfold.operators import models, ordering, resample, splits
from epochfold.operators import temporal as T

SPEC = models.ModelSpec()
ROWS = "row long, g int, y int, features array<double>"


def frame(spark, x, y, g, **more):
    rows = [(i, int(g[i]), int(y[i]), [float(v) for v in x[i]], *[int(c[i]) for c in more.values()]) for i in range(len(y))]
    return spark.createDataFrame(rows, ROWS + "".join(f", {k} int" for k in more))


def with_offsets():
    rng = np.random.default_rng(0)
    g = np.repeat(range(6), 40)
    y = rng.integers(0, 2, 240)
    x = rng.normal(size=(240, 4)) + rng.normal(0, 10, size=(6, 1))[g]
    x[:, 0] += 2 * y
    return x, y, g


def fingerprint():
    """Each subject's label shows in a feature of its own."""
    rng = np.random.default_rng(0)
    g = np.repeat(range(8), 60)
    y = rng.integers(0, 2, 480)
    x = rng.normal(size=(480, 8))
    x[np.arange(480), g] += 4 * y
    return x, y, g


def test_metrics_by_hand(spark):
    rows = [(0, 1, 1, 0.9), (0, 1, 0, 0.4), (0, 0, 0, 0.4), (0, 0, 1, 0.8), (0, 0, 0, 0.1), (1, 1, 1, 0.7), (1, 1, 0, 0.2)]
    m = {r.k: r for r in M.fold_metrics(spark.createDataFrame(rows, "k int, y int, pred int, proba double"), ["k"]).collect()}
    assert (m[0].tn, m[0].fp, m[0].fn, m[0].tp) == (2, 1, 1, 1)
    assert m[0].balanced_accuracy == pytest.approx((1 / 2 + 2 / 3) / 2) and m[0].macro_f1 == pytest.approx((2 / 4 + 4 / 6) / 2)
    assert m[0].roc_auc == pytest.approx((3 + 1.5) / 6)
    assert m[1].roc_auc is None and m[1].specificity is None and m[1].balanced_accuracy == 0.5
    s = {r.metric: r for r in M.summary(M.unpivot(M.fold_metrics(spark.createDataFrame(rows, "k int, y int, pred int, proba double"), ["k"]), ["k"]), ["metric"]).collect()}
    assert s["roc_auc"].n_valid == 1 and s["roc_auc"].std is None and s["balanced_accuracy"].n_valid == 2


def test_loso_folds_and_pooling(spark):
    x, y, g = with_offsets()
    r = E.evaluate_loso(frame(spark, x, y, g), "g", "row", SPEC, n_boot=200)
    folds = {f.fold: f for f in r.folds.collect()}
    assert sorted(folds) == list(range(6)) and sum(f.n_test for f in folds.values()) == 240
    assert r.pooled.first().n_test == 240 and "descriptive" in r.pooled.first().warning
    ci = {c.metric: c for c in r.ci.collect()}
    assert all(c.n == 6 and c.lo <= c.point <= c.hi for c in ci.values())
    again = E.evaluate_loso(frame(spark, x, y, g), "g", "row", SPEC, n_boot=200)
    assert sorted(map(str, again.folds.collect())) == sorted(map(str, folds.values()))
    assert set(r.to_dict()) == {"folds", "summary", "ci", "pooled", "config"}


def test_single_class_subject(spark):
    rng = np.random.default_rng(0)
    g, y = np.repeat(range(3), 20), np.concatenate([rng.integers(0, 2, 40), np.ones(20, int)])
    r = E.evaluate_loso(frame(spark, rng.normal(size=(60, 3)), y, g), "g", "row", SPEC, n_boot=50)
    assert {f.fold: f.roc_auc is None for f in r.folds.collect()} == {0: False, 1: False, 2: True}
    assert {s.metric: s.n_valid for s in r.summary.collect()} == {"roc_auc": 2, "balanced_accuracy": 3, "macro_f1": 3}


def test_naive_split_is_better_than_held_out_subjects(spark):
    x, y, g = fingerprint()
    df = frame(spark, x, y, g)
    naive = E.evaluate_naive(df, "row", SPEC).first().balanced_accuracy
    loso = {s.metric: s.mean for s in E.evaluate_loso(df, "g", "row", SPEC, n_boot=50).summary.collect()}["balanced_accuracy"]
    assert naive > loso + 0.15 and loso < 0.6


def test_held_out_rows_dont_touch_training_statistics(spark):
    x, y, g = with_offsets()
    wild = x.copy()
    wild[g == 3] *= 1e12
    stats = []
    for data in (x, wild):
        long = splits.leave_one_group_out(frame(spark, data, y, g).select("*", F.posexplode("features").alias("band", "power")), "g")
        s = models.fold_scaler(long.where("role = 'train'").repartition(1).sortWithinPartitions("row"), ["fold", "band"]).where("fold = 3")
        stats.append(sorted((r.band, r.mean, r.sd) for r in s.collect()))
    assert stats[0] == stats[1]
    coefs = []
    for data in (x, wild):
        p = models.fit_folds(splits.leave_one_group_out(frame(spark, data, y, g), "g").where("fold = 3"), ["fold"], "row", SPEC)
        coefs.append(p.first().coefficients)
    assert coefs[0] == coefs[1]


def test_splits(spark):
    ids = np.repeat(range(6), [3, 4, 2, 5, 3, 4])
    df = spark.createDataFrame([(i, int(v), i % 2) for i, v in enumerate(ids)], "pos long, g int, y int")
    e = splits.expanding_by_group(df, "g", "pos", 2).collect()
    assert {r.fold for r in e} == {2, 3, 4, 5}
    for f in (2, 3, 4, 5):
        assert {r.g for r in e if r.fold == f and r.role == "train"} == set(range(f)) and {r.g for r in e if r.fold == f and r.role == "test"} == {f}
    assert {r.g for r in splits.expanding_by_group(df, "g", "pos", 2, gap=1).where("fold = 3 AND role = 'train'").collect()} == {0, 1}
    bad = spark.createDataFrame([(0, 1), (1, 0)], "pos long, g int")
    with pytest.raises(Exception, match="must not decrease"):
        splits.expanding_by_group(bad, "g", "pos", 1).collect()
    r = splits.expanding_by_row(df, 21, 10, 5, 2).collect()
    assert {x.fold for x in r} == {10, 15, 20} and {x.pos for x in r if x.fold == 20 and x.role == "test"} == {20}
    assert max(x.pos for x in r if x.fold == 15 and x.role == "train") == 12
    c = splits.chronological(df, 21, 0.7, 2).collect()
    assert {x.pos for x in c if x.role == "train"} == set(range(14)) and {x.pos for x in c if x.role == "test"} == set(range(16, 21))
    for bad_call in (lambda: splits.chronological(df, 21, 0.7, 7), lambda: splits.expanding_by_row(df, 21, 0, 5), lambda: splits.expanding_by_group(df, "g", "pos", 2, step=0)):
        with pytest.raises(ValueError):
            bad_call()
    k = splits.roles_of(splits.stratified_kfold(df, "y", "pos", 5, 1), 5)
    assert k.where("role = 'test'").count() == 21 and k.count() == 105
    assert {r.g: r.fold for r in splits.group_kfold(df, "g", 3).collect()}.keys() == set(range(6))
    assert [r.pos for r in splits.row_numbers(df.select(F.col("pos").alias("t")).repartition(3), "t").orderBy("t").collect()] == list(range(21))


def test_run_out_needs_two_runs_and_two_classes(spark):
    rows = [(i, s, run, y) for i, (s, run, y) in enumerate([(0, 4, 0), (0, 4, 1), (0, 8, 0), (0, 8, 1), (1, 4, 0), (1, 4, 1), (2, 4, 1), (2, 8, 1), (2, 8, 0)])]
    df = spark.createDataFrame(rows, "row long, subject int, run int, y int")
    got = splits.valid_folds(splits.leave_one_run_out(df), ["subject", "fold"])
    assert {(r.subject, r.fold) for r in got.collect()} == {(0, 4), (0, 8), (2, 4)}


def test_run_out_interval_is_over_subjects(spark):
    rows = [(s, run, 0.4 + 0.1 * s) for s in range(3) for run in (4, 8, 12)]
    df = spark.createDataFrame(rows, "subject int, fold int, balanced_accuracy double").withColumn("macro_f1", F.col("balanced_accuracy")).withColumn("roc_auc", F.lit(None).cast("double"))
    per, out = M.run_out_summary(df)
    s = {r.metric: r for r in out.collect()}
    assert s["balanced_accuracy"].mean == pytest.approx(0.5) and s["balanced_accuracy"].n_valid == 3 and s["roc_auc"].n_valid == 0
    ci = {r.metric: r for r in resample.bootstrap_ci_numpy(per, ["metric"], "subject", n_boot=300).collect()}
    assert ci["balanced_accuracy"].n == 3 and ci["roc_auc"].lo is None


def test_dummies_learn_from_training_labels(spark):
    rows = [(i, 0, y) for i, y in enumerate([0, 0, 0, 0, 1])] + [(10 + i, 1, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "row long, g int, y int").withColumn("fold", F.lit(0)).withColumn("role", F.when(F.col("g") == 1, "test").otherwise("train"))
    m = M.fold_metrics(models.dummy(df, ["fold"], "most_frequent", "row"), ["fold"]).first()
    assert m.balanced_accuracy == 0.0 and m.roc_auc is None
    assert models.dummy(df, ["fold"], "prior", "row").first().proba == pytest.approx(0.2)
    with pytest.raises(ValueError):
        models.dummy(df, ["fold"], "nearest", "row")


def test_tuning_and_guards(spark):
    x, y, g = with_offsets()
    df = frame(spark, x, y, g)
    r = E.evaluate_loso(df, "g", "row", SPEC, grid=[{"c": 0.01}, {"c": 1.0}], inner_splits=3, n_boot=20)
    assert {p.chosen_params["c"] for p in r.predictions.collect()} <= {"0.01", "1.0"}
    with pytest.raises(ValueError):
        E.evaluate_loso(df, "g", "row", None)
    with pytest.raises(ValueError):
        models.fit_folds(splits.leave_one_group_out(df, "g"), ["fold"], "row", SPEC, grid=[])
    prov = E.provenance(splits.leave_one_group_out(df, "g"), ["fold"], "row").collect()
    assert len({p.test_hash for p in prov}) == 6 and all(p.train_n == 200 for p in prov)


def test_other_evaluators(spark):
    x, y, g = with_offsets()
    run = np.tile([4, 8], 120)
    df = frame(spark, x, y, g, subject=g, run=run)
    assert E.evaluate_leave_one_run_out(df, "row", SPEC, n_boot=20).folds.count() == 12
    assert E.evaluate_within_subject(df, "row", SPEC, n_boot=20).folds.count() == 6
    assert E.evaluate_expanding(df, "g", "row", SPEC, 3, n_boot=20).folds.count() == 3
    assert E.evaluate_chronological(df, "row", SPEC).folds.first().n_test == 72


def test_svm_parts_rings():
    rng = np.random.default_rng(0)
    r, a = np.repeat([1.0, 3.0], 60), rng.random(120) * 2 * np.pi
    x, y = np.stack([r * np.cos(a), r * np.sin(a)], 1) + rng.normal(0, 0.1, (120, 2)), np.repeat([0, 1], 60)
    m = K.rbf_svm(x, y)
    assert ((K.sigmoid(K.svm_score(m, x) * m["w"] + m["b"]) > 0.5) == y).mean() > 0.98


def test_svm_in_sets_of_rows_is_the_same_machine(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    y = ((x**2).sum(axis=1) + rng.normal(0, 2, 900) > 4).astype(int)
    whole = K.svm_score(K.rbf_svm(x[:600], y[:600], balanced=False), x[600:])
    monkeypatch.setattr(K, "SET", 128)
    parts = K.svm_score(K.rbf_svm(x[:600], y[:600], balanced=False), x[600:])
    assert np.abs(whole - parts).max() < 5e-3


def test_svm_holds_no_table_of_all_pairs():
    import tracemalloc

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(6000, 4)), np.repeat([0, 1], 3000)
    x[y == 1] += 6  # far apart, so that it ends at once
    tracemalloc.start()
    m = K.rbf_svm(x, y)
    said = K.svm_score(m, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6 < x.shape[0] ** 2 * 8 and ((said > 0) == y).mean() > 0.999


def test_bootstrap_parity_and_paired(spark):
    v = [0.5, 0.6, 0.55, 0.7]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(v)], "metric string, s int, value double")
    got = resample.bootstrap_ci_numpy(df, ["metric"], "s", n_boot=1000).first()
    means = np.random.default_rng(42).choice(np.array(v), (1000, 4)).mean(axis=1)
    assert np.allclose([got.lo, got.hi], np.quantile(means, [0.025, 0.975]))
    a = spark.createDataFrame([(i, x) for i, x in enumerate([0.5, 0.55, 0.6, 0.45])], "s int, value double")
    b = spark.createDataFrame([(i, x) for i, x in enumerate([0.6, 0.58, 0.72, 0.44])], "s int, value double")
    p = resample.paired_delta(a, b, "s", n_boot=100).first()
    assert p.n_improved == 3 and p.n == 4 and p.point == pytest.approx(0.06)
    one = resample.bootstrap_ci(df.where("s = 0"), ["metric"], "s", n_boot=10).first()
    assert one.lo is None and one.point == 0.5


def test_permutation_keeps_groups(spark):
    x, y, g = with_offsets()
    df = frame(spark, x, y, g)
    p = resample.permute_within(df, "g", "row", "y", 3).groupBy("perm", "g").agg(F.sum("y").alias("n")).collect()
    want = {k: int(y[g == k].sum()) for k in range(6)}
    assert len(p) == 18 and all(r.n == want[r.g] for r in p)
    null = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "value double")
    r = resample.permutation_p(spark.createDataFrame([(0.5,)], "value double"), null).first()
    assert r.p_value == pytest.approx(3 / 4) and r.null_std == pytest.approx(0.4)


def series(spark, x, at=None):
    return spark.createDataFrame([(int(at[i]) if at is not None else i, [float(v) for v in r]) for i, r in enumerate(x)], "t long, features array<double>")


def test_lagged_correlation(spark):
    rng = np.random.default_rng(0)
    iid = {r.lag: r.value for r in T.lag_autocorrelation(series(spark, rng.normal(size=(2000, 6))), [1, 2], "t").collect()}
    assert max(iid.values()) < 0.05
    x = np.zeros((3000, 4))
    e = np.random.default_rng(1).normal(size=x.shape)
    for i in range(1, 3000):
        x[i] = 0.9 * x[i - 1] + e[i]
    ar = {r.lag: r.value for r in T.lag_autocorrelation(series(spark, x), [1, 5, 30], "t").collect()}
    assert ar[1] > 0.85 and 0.4 < ar[5] < 0.7 and ar[30] < 0.2
    flat = rng.normal(size=(50, 2))
    flat[:, 1] = 3.0
    one = T.lag_autocorrelation(series(spark, flat), [1], "t").first()
    assert one.value is not None and one.n_pairs == 49


def test_a_time_gap_is_no_neighbour(spark):
    s = series(spark, np.random.default_rng(2).normal(size=(4, 5)), [0, 128, 256, 512])
    got = T.lag_autocorrelation(s, [1], "t", 128).first()
    assert got.n_pairs == 2 and got.value is None
    assert T.time_gaps(s, 128, "t").first().n_gapped == 1
    with pytest.raises(ValueError):
        T.lag_autocorrelation(s, [0], "t")


@pytest.mark.parametrize(
    ("values", "gap", "reason"),
    [([0.1, 0.1], 0, "already_below"), ([0.8, 0.5, 0.2], 2, "crossed_at_lag_3"), ([0.8, 0.7], 2, "never_below"), ([0.8, None, 0.1], None, "undefined_at_lag_2")],
)
def test_gap_rule(spark, values, gap, reason):
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "lag int, value double")
    assert tuple(T.choose_gap(df).first()) == (gap, reason)


def test_coefficient_means_weigh_subjects_alike(spark):
    rows = [(s, f, [100.0 * s]) for s in range(10) for f in range(2 + s % 3) for _ in range(3)]
    df = spark.createDataFrame(rows, "subject int, fold int, coefficients array<double>").repartition(7)
    assert models.coefficient_means(df, [], ["w"], ("subject", "fold")).first().mean_coefficient == pytest.approx(450.0)
    per = {r.subject: r.mean_coefficient for r in models.coefficient_means(df, ["subject"], ["w"], ("subject", "fold")).collect()}
    assert per == {s: 100.0 * s for s in range(10)}


def test_a_fit_runs_once_behind_its_metrics(spark):
    x, y, g = with_offsets()
    p = models.fit_folds(splits.leave_one_group_out(frame(spark, x, y, g), "g"), ["fold"], "row", SPEC)
    plan = M.fold_metrics(p, ["fold"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_pooled_metrics_rank_all_scores(spark):
    rng = np.random.default_rng(4)
    s = np.round(rng.random(500), 2)
    y = (rng.random(500) < s).astype(int)
    df = spark.createDataFrame([(int(a), int(b > 0.5), float(b)) for a, b in zip(y, s)], "y int, pred int, proba double").repartition(5)
    m = M.pooled_metrics(df).first()
    pairs = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert m.roc_auc == pytest.approx(pairs) and m.n_test == 500 and "descriptive" in m.warning
    assert M.pooled_metrics(df.limit(0)).first().roc_auc is None


def test_merged_moments_are_those_of_the_training_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 5, int(rng.random() < 0.4), b, float(rng.normal(b * 1e6, 1))) for i in range(200) for b in range(2)]
    long = spark.createDataFrame(rows, "row int, g int, y int, band int, power double")
    got = {(r.fold, r.band): r for r in models.loso_moments(long, "g").collect()}
    for f in range(5):
        for b in range(2):
            v = np.array([(r[4], r[2]) for r in rows if r[1] != f and r[3] == b])
            r = got[f, b]
            assert np.allclose([r.mean, r.sd, r.c0, r.c1], [v[:, 0].mean(), v[:, 0].std(), v[v[:, 1] == 0, 0].mean(), v[v[:, 1] == 1, 0].mean()], rtol=1e-9)
    split = splits.leave_one_group_out(long, "g")
    key = lambda r: (r.fold, r.row, r.y, r.pred, round(r.proba, 6))
    assert sorted(map(key, models.loso_centroid(long, "g", "row").collect())) == sorted(map(key, models.centroid(split, ["fold"], "row").collect()))


def test_places_and_steps_over_many_ranges(spark):
    at = [3 * i + (i > 500) for i in range(1000)]
    df = spark.createDataFrame([(t, t % 7) for t in at], "t long, v long").repartition(6)
    got = ordering.placed(df, "t", "pos", before={"was": "v"}, total="n").orderBy("t").collect()
    assert [(r.t, r.pos, r.n) for r in got] == [(t, i, 1000) for i, t in enumerate(at)]
    assert [r.was for r in got] == [None, *[t % 7 for t in at[:-1]]]
    assert tuple(ordering.steps(df, "t", 3).first()) == (999, 1)
    assert tuple(ordering.steps(df.where("false"), "t", 3).first()) == (0, 0)
    assert ordering.placed(df.where("false"), "t").count() == 0


@pytest.mark.parametrize(("n_init", "step", "gap"), [(1, 1, 0), (2, 3, 1), (1, 2, 4), (3, 1, 7), (5, 4, 2), (1, 1, 30)])
def test_walks_equal_loops(spark, n_init, step, gap):
    n = 23
    df = spark.range(n).withColumnRenamed("id", "pos").withColumn("g", F.col("pos"))
    want_rows, want_groups = set(), set()
    for f in range(n_init, n, step):
        if f - gap < 1:
            continue
        want_rows |= {(f, p, "test") for p in range(f, min(n, f + step))} | {(f, p, "train") for p in range(f - gap)}
        want_groups |= {(f, f, "test")} | {(f, p, "train") for p in range(f - gap)}
    got = splits.expanding_by_row(df, n, n_init, step, gap).select("fold", "pos", "role").collect()
    assert len(got) == len(want_rows) and {tuple(r) for r in got} == want_rows
    got = splits.expanding_by_group(df, "g", "pos", n_init, step, gap).select("fold", "pos", "role").collect()
    assert len(got) == len(want_groups) and {tuple(r) for r in got} == want_groups


def test_walk_is_spelled_out_by_many_tasks(spark):
    n = 40_000
    df = spark.range(n).withColumnRenamed("id", "pos").coalesce(1)
    per = [r["count"] for r in splits.expanding_by_row(df, n, 20, 50, 5).groupBy(F.spark_partition_id()).count().collect()]
    folds = range(20, n, 50)
    assert sum(per) == sum(f - 5 for f in folds) + n - 20 and len(per) > 2 and max(per) < 2 * sum(per) / len(per)
    few = splits.expanding_by_group(df.where("pos < 2000").withColumn("g", F.expr("pos div 4")), "g", "pos", 5, 1)
    assert few.count() == 4 * sum(f + 1 for f in range(5, 500))


def test_walk_forward_is_small_once_written(spark, tmp_path):
    """Rows times folds are written in an order that repeats: over a byte a row before."""
    n = 20_000
    df = spark.range(n).withColumnRenamed("id", "pos")
    out = splits.expanding_by_row(df, n, 20, 10, 5).select("fold", "pos", "role")
    out.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert rows == out.count() == sum(min(f - 5, n) + min(10, n - f) for f in range(20, n, 10))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * rows
