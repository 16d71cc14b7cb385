"""Label permutation with refits: every draw's model is fitted anew in every leave-one-group-out fold.

The model is a ridge regression of -1 and 1 on features scaled by the training rows. Its scaler and its matrix don't depend
on labels, so all draws of a fold share them and only their right-hand sides differ: sums over the rows of label 1. Folds
come from merged sums of the other groups, never from totals less the held-out one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.operators import metrics, resample
from epochfold.operators.fold_sums import fold_sums, sum_table
from epochfold.operators.splits import MOST_FOLDS
from epochfold.session import stash

#: Right-hand sides, and coefficients, held at a time; draws beyond this are taken in further passes.
MOST_VALUES = 4_000_000


def _merge(a: tuple | None, b: tuple | None) -> tuple | None:
    """Rows, mean, sum of products about it, rows of label 1 and their sum about the mean by draw, of two parts together."""
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    mean = a[1] + (b[1] - a[1]) * (b[0] / n)
    second, ones, sums = a[2] + b[2], a[3] + b[3], a[4] + b[4]
    for part in (a, b):
        off = part[1] - mean
        second = second + part[0] * np.outer(off, off)
        sums = sums + np.outer(part[3], off)
    return n, mean, second, ones, sums


def _others(states: list[tuple]) -> Iterator[tuple | None]:
    """For each state what all the others merge to, from those before and those after it."""
    after = [None] * (len(states) + 1)
    for i in reversed(range(len(states))):
        after[i] = _merge(states[i], after[i + 1])
    before = None
    for i, s in enumerate(states):
        yield _merge(before, after[i + 1])
        before = _merge(before, s)


def permuted_counts(rows: DataFrame, group: str, row_id: str, n_perm: int, seed: int = 42, ridge: float = 1.0, features: str = "features", y: str = "y", most_values: int = MOST_VALUES) -> DataFrame:
    """perm (0: the labels as they are), group, tn, fp, fn, tp of each group when the others of that draw train.

    Labels are shuffled inside groups as permute_within does; row_id is unique. Rows with a null group, label or features
    are left out; a group without others has no row; a fold of one training class says that class.
    """
    have = rows.where(F.col(group).isNotNull() & F.col(y).isNotNull() & F.col(features).isNotNull()).select(group, row_id, F.col(y).cast("int").alias(y), features)
    have = stash(have, "refit-rows")
    if have.select(group).distinct().limit(MOST_FOLDS + 1).count() > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} groups; use a coarser one")
    first = fold_sums(have, [group], features, y, lambda key, x, t: np.r_[len(x), x.sum(axis=0)])
    mean = {k: v[1:] / v[0] for k, v in first.items()}
    second = fold_sums(have, [group], features, y, lambda key, x, t: ((x - mean[key]).T @ (x - mean[key])).ravel())
    groups = sorted(first)
    p = len(mean[groups[0]]) if groups else 0
    at_once = max(1, most_values // max(1, len(groups) * (p + 1)) - 1)

    def block(start: int, n: int) -> DataFrame:
        drawn = resample.permute_within(have.select(group, row_id, y), group, row_id, y, n, seed, start)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("perm", y))), lambda s: s[y])
        each = have.join(drawn.groupBy(row_id).agg(listed.alias("_drawn")), row_id)
        each = stash(each.select(group, features, F.concat(F.array(y), "_drawn").alias("_labels")), "refit-labels")

        def right_sides(key, x, t):
            return np.hstack([t.sum(axis=0)[:, None], t.T @ (x - mean[key])]).ravel()

        sides = {k: v.reshape(-1, p + 1) for k, v in fold_sums(each, [group], features, "_labels", right_sides).items()}
        states = [(first[k][0], mean[k], second[k].reshape(p, p), sides[k][:, 0], sides[k][:, 1:]) for k in groups]
        fitted = {}
        for k, other in zip(groups, _others(states), strict=True):
            if other is not None:
                m, m2, ones, sums = other[1:]
                sd = np.sqrt(np.diag(m2) / other[0])
                sd = np.where(sd > 0, sd, 1.0)
                beta = np.linalg.solve(m2 / np.outer(sd, sd) + ridge * np.eye(p), 2 * (sums / sd).T)
                fitted[k] = m, beta / sd[:, None], 2 * ones / other[0] - 1

        def confusion(key, x, t):
            if key not in fitted:
                return None
            m, beta, offset = fitted[key]
            said, true = (x - m) @ beta + offset > 0, t == 1
            return np.stack([(~true & ~said).sum(axis=0), (~true & said).sum(axis=0), (true & ~said).sum(axis=0), (true & said).sum(axis=0)], axis=1).ravel()

        cells = sum_table(each, [group], features, "_labels", confusion).withColumn("_at", F.floor(F.col("pos") / 4))
        perm = F.when(F.col("_at") == 0, 0).otherwise(F.col("_at") + (start - 1)).cast("int").alias("perm")
        one = lambda k, name: F.sum(F.when(F.col("pos") % 4 == k, F.col("value"))).cast("long").alias(name)
        counts = cells.groupBy(group, perm).agg(*[one(k, name) for k, name in enumerate(("tn", "fp", "fn", "tp"))])
        return stash(counts if start == 1 else counts.where("perm > 0"), "refit-counts")

    out = block(1, min(at_once, n_perm))
    for start in range(1 + at_once, n_perm + 1, at_once):
        out = out.unionByName(block(start, min(at_once, n_perm + 1 - start)))
    return out


def permutation_refit(rows: DataFrame, group: str, row_id: str, n_perm: int = 200, seed: int = 42, **options) -> DataFrame:
    """One row as permutation_p gives it, of the mean balanced accuracy over groups, models refitted under every draw.

    No row if fewer than two groups have rows. options go to permuted_counts.
    """
    counts = permuted_counts(rows, group, row_id, n_perm, seed, **options)
    score = metrics.with_rates(counts).groupBy("perm").agg(F.avg("balanced_accuracy").alias("value"))
    return resample.permutation_p(score.where("perm = 0"), score.where("perm > 0"))
