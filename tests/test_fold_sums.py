import numpy as np
import pytest
from pyspark.sql import functions as F

from epochfold.functions import kernels as K
from epochfold.operators import fold_sums, models, spatial, spectral, splits
from epochfold.operators import windows as W
from epochfold.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def labelled(spark, n=240, groups=5):
    rng = np.random.default_rng(4)
    g, y = rng.integers(0, groups, n), rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + y[:, None] * [0.8, 10, 0]
    x = np.hstack([x, np.full((n, 1), 2.5)])  # a constant feature
    return spark.createDataFrame([(i, int(g[i]), int(y[i]), x[i].tolist()) for i in range(n)], "row long, g int, y int, features array<double>")


@pytest.mark.parametrize(("c", "balanced", "strict"), [(1.0, True, True), (0.05, False, False)])
def test_logistic_equals_a_fit_of_each_fold(spark, c, balanced, strict):
    split = splits.leave_one_group_out(labelled(spark), "g")
    want = models.fit_folds(split, ["fold"], "row", models.ModelSpec("logistic", {"c": c, "balanced": balanced}), strict=strict)
    got = fold_sums.logistic(split.repartition(7), ["fold"], "row", c, balanced, strict=strict)
    assert got.schema == want.schema and "FlatMapGroups" not in plan(got)
    a, b = ({(r.fold, r.row): r for r in df.collect()} for df in (want, got))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].pred == b[k].pred and a[k].y == b[k].y and abs(a[k].proba - b[k].proba) < 1e-8
        assert np.allclose(a[k].coefficients, b[k].coefficients, atol=1e-7)


def test_logistic_of_odd_folds(spark):
    """One training class, no training rows, no test rows, keys of several kinds, and an empty split."""
    rows = [("a", 1, 0, 1, [1.0], "train"), ("a", 1, 1, 1, [2.0], "train"), ("a", 1, 2, 0, [3.0], "test"), ("b", 1, 3, 0, [1.0], "test"), ("c", 2, 4, 1, [1.0], "train"), ("c", 2, 5, 0, [0.0], "train")]
    split = spark.createDataFrame(rows, "s string, fold long, row long, y int, features array<double>, role string")
    out = fold_sums.logistic(split, ["s", "fold"], "row").collect()
    assert [(r.s, r.fold, r.row, r.pred, r.proba, r.coefficients) for r in out] == [("a", 1, 2, 1, 1.0, None)]
    assert fold_sums.logistic(split.limit(0), ["s", "fold"], "row").count() == 0


@pytest.mark.parametrize(("step", "gap", "balanced"), [(1, 0, True), (3, 2, False)])
def test_expanding_logistic_equals_a_fit_of_each_fold(spark, monkeypatch, step, gap, balanced):
    """No fold is written out or gathered, so there is no limit on its rows; the first folds have one class alone."""
    df = labelled(spark, 600).withColumn("g", F.expr("row div 7")).withColumn("y", F.when(F.col("g") < 4, 0).otherwise(F.col("y")))
    split = splits.expanding_by_group(df, "g", "row", 2, step, gap)
    want = {(r.fold, r.row): r for r in models.fit_folds(split, ["fold"], "row", models.ModelSpec("logistic", {"c": 1.0, "balanced": balanced})).collect()}
    monkeypatch.setattr(models, "MOST_ROWS", 0)
    out = fold_sums.expanding_logistic(df.repartition(5), "g", "row", 2, step, gap, balanced=balanced)
    assert "FlatMapGroups" not in plan(out)
    got = {(r.fold, r.row): r for r in out.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k].pred == w.pred and got[k].y == w.y and abs(got[k].proba - w.proba) < 1e-8
        assert got[k].coefficients == w.coefficients or np.allclose(got[k].coefficients, w.coefficients, atol=1e-7)
    assert fold_sums.expanding_logistic(df.where("g < 2"), "g", "row", 2).count() == 0


def test_patterns_from_merged_moments_equal_those_from_samples(spark):
    rng = np.random.default_rng(2)
    n, y = 90, np.arange(90) % 2
    mix = rng.normal(size=(5, 5))
    x = np.stack([mix @ (rng.normal(size=(5, 40)) * np.where(y[i], [3, 1, 1, 1, 1], [1, 1, 1, 1, 3])[:, None]) + 0.5 for i in range(n)])
    rows = [(i, i // 30, int(y[i]), [(f"C{k}", x[i, k].tolist()) for k in range(5)]) for i in range(n)]
    epochs = spark.createDataFrame(rows, "epoch_id long, g int, y int, channels array<struct<name:string,x:array<double>>>")
    got = spatial.csp_lda_folds(splits.leave_one_group_out(epochs, "g"), ["fold"], "epoch_id", 4)
    assert "FlatMapGroups" not in plan(got)
    out = {(r.fold, r.epoch_id): r.proba for r in got.collect()}
    for f in range(3):
        train, test = np.arange(n) // 30 != f, np.flatnonzero(np.arange(n) // 30 == f)
        w = K.csp(x[train], y[train], 4)
        d, c = K.lda(K.log_variance(w, x[train]), y[train])
        want = K.sigmoid(K.log_variance(w, x[test]) @ d + c)
        assert np.allclose([out[f, i] for i in test], want, atol=1e-7)
    assert len(out) == n


@pytest.mark.parametrize("name", ["band_power", "feature_columns", "regional_summary"])
def test_band_power_is_made_once(spark, name):
    assert plan(registry.queries()[name](spark, SF)).count("ArrowEvalPython") == 1


def test_null_features_give_no_long_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [])], "k int, features array<double>")
    assert sorted(spectral.long_features(rows, ["k"], ["a", "b"]).collect()) == [(1, "a", 1.0), (1, "b", 2.0)]


def test_runs_of_events_by_buckets(spark):
    """Many runs of very different lengths, gaps between them, and events at their edges."""
    rng = np.random.default_rng(0)
    runs, at = [], 0
    for i in range(15_000):
        at += int(rng.integers(0, 4))
        length = 50_000 if i % 5000 == 7 else int(rng.integers(1, 9))
        runs.append((i, at, at + length))
        at += length
    events = sorted({int(v) for v in rng.integers(-5, at + 5, 3000)} | {r[1] for r in runs[:50]} | {r[2] for r in runs[:50]})
    first = np.array([r[1] for r in runs])
    want = {}
    for e in events:
        k = int(np.searchsorted(first, e, side="right")) - 1
        want[e] = k if k >= 0 and e < runs[k][2] else -1
    table = spark.createDataFrame(runs, "run int, first long, end long")
    got = W.run_of_event(spark.createDataFrame([(e,) for e in events], "at long"), table)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.at: r.run for r in got.collect()} == want
    assert W.run_of_event(spark.createDataFrame([(3,)], "at long"), table.limit(0)).first().run == -1


def test_windows_carry_the_first_samples_values(spark):
    s = spark.range(10).select(F.col("id").alias("sample_idx"), F.lit(0).alias("y"), F.col("id").cast("double").alias("x"), (F.col("id") * 7).alias("block"))
    assert [(r.start, r.block) for r in W.tumbling(s, 4, ["x"], carry=("block",)).orderBy("start").collect()] == [(0, 0), (4, 28)]
