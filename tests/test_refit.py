"""Permutation with refits against a loop that fits every draw and fold with NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochfold.operators import refit, resample, splits
from tests.test_fold_sums import labelled, plan


def by_loops(drawn, ridge):
    """{(perm, group): (tn, fp, fn, tp)} of rows (perm, g, y, features)."""
    out = {}
    for perm in {r.perm for r in drawn}:
        own = [r for r in drawn if r.perm == perm]
        g, y, x = np.array([r.g for r in own]), np.array([r.y for r in own]), np.array([r.features for r in own])
        for fold in set(g.tolist()):
            a, t = x[g != fold], 2 * y[g != fold] - 1
            sd = np.where(np.ptp(a, axis=0) > 0, a.std(axis=0), 1.0)
            z = (a - a.mean(axis=0)) / sd
            beta = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ (t - t.mean()))
            said = ((x[g == fold] - a.mean(axis=0)) / sd) @ beta + t.mean() > 0
            true = y[g == fold] == 1
            out[perm, fold] = tuple(int(v.sum()) for v in (~true & ~said, ~true & said, true & ~said, true & said))
    return out


@pytest.mark.parametrize(("ridge", "most"), [(1.0, refit.MOST_VALUES), (30.0, 80)])  # 80: draws in blocks of three
def test_counts_equal_fits_of_every_draw(spark, ridge, most):
    rows = labelled(spark)
    want = resample.permute_within(rows, "g", "row", "y", 7, 3).unionByName(rows.withColumn("perm", F.lit(0))).collect()
    got = refit.permuted_counts(rows.repartition(6), "g", "row", 7, 3, ridge=ridge, most_values=most)
    assert {(r.perm, r.g): (r.tn, r.fp, r.fn, r.tp) for r in got.collect()} == by_loops(want, ridge)


def test_held_out_rows_change_no_other_fold_of_theirs(spark):
    """A fold's model doesn't move with its held-out features: the same model says the same of a group put far away."""
    rng = np.random.default_rng(1)
    states = [(5.0, rng.normal(size=2), np.eye(2) * i, rng.integers(1, 4, 3).astype(float), rng.normal(size=(3, 2))) for i in range(1, 5)]
    moved = [*states[:2], (5.0, np.array([1e9, -1e9]), np.eye(2) * 1e18, np.ones(3), np.ones((3, 2)) * 1e9), states[3]]
    a, b = list(refit._others(states))[2], list(refit._others(moved))[2]
    assert all(np.array_equal(u, v) for u, v in zip(a, b, strict=True))


def test_signal_is_told_from_none(spark):
    rows = labelled(spark, 200, 4)
    r = refit.permutation_refit(rows, "g", "row", 19, 5).first()
    assert r.p_value == 0.05 and r.n_perm == 19 and r.observed > 0.6 and abs(r.null_mean - 0.5) < 0.1
    none = rows.withColumn("features", F.array(F.lit(1.0)))
    assert refit.permutation_refit(none, "g", "row", 19, 5).first().p_value == 1.0


def test_odd_tables(spark):
    """Nulls, one class, one group, no rows, clashing extra columns, and a label of another width."""
    kind = "row long, g string, y long, features array<double>, perm int, _drawn int, _labels int"
    rows = [(1, "a", 1, [1.0]), (2, "a", 1, [2.0]), (3, "b", 1, [1.0]), (4, None, 0, [1.0]), (5, "b", None, [1.0]), (6, "b", 0, None), (7, "b", 1, [5.0])]
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], kind)
    got = refit.permuted_counts(df, "g", "row", 2)
    assert sorted(tuple(r) for r in got.select("perm", "g", "tn", "fp", "fn", "tp").collect()) == [(p, g, 0, 0, 0, 2) for p in range(3) for g in "ab"]
    assert refit.permutation_refit(df.where("g = 'a'"), "g", "row", 2).count() == 0
    assert refit.permutation_refit(df.limit(0), "g", "row", 2).count() == 0


def test_no_fold_is_gathered(spark, monkeypatch):
    assert "FlatMapGroups" not in plan(refit.permuted_counts(labelled(spark), "g", "row", 3))
    monkeypatch.setattr(refit, "MOST_FOLDS", 3)
    with pytest.raises(ValueError, match="coarser"):
        refit.permuted_counts(labelled(spark), "g", "row", 3)
    assert splits.MOST_FOLDS > 3
