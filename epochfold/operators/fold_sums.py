"""Fits of many folds at once without gathering a fold: sums over rows in the tasks, small systems on the driver.

A pass over the training rows makes each fold's sums (of gradients, second moments and so on) inside the tasks, Spark adds
up the tasks' sums, and what comes back is a vector a fold: bounded by the folds' number and the features', not by rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.functions import kernels
from epochfold.operators import splits
from epochfold.session import stash


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _by_key(batch: pa.RecordBatch, n_keys: int):
    """(key, places of its rows) for each key of a batch."""
    keys = pd.DataFrame({k: batch.column(k).to_pylist() for k in range(n_keys)})
    for key, own in keys.groupby(list(range(n_keys)), sort=False, dropna=False).indices.items():
        yield key if isinstance(key, tuple) else (key,), own


def sum_table(rows: DataFrame, keys: list[str], x: str, y: str, fn: Callable) -> DataFrame:
    """keys, pos, value: for each fold the sum over its rows of the vectors fn(key, x, y) gives, a row a place.

    x is a matrix of the array column, and so is y where it is an array. fn says None for folds that it doesn't ask about.
    """
    kinds, n_keys = dict(rows.dtypes), len(keys)

    def run(batches):
        sums: dict = {}
        for b in batches:
            values, said = _matrix(b.column(n_keys)), b.column(n_keys + 1)
            labels = (_matrix(said) if pa.types.is_list(said.type) else said.to_numpy(zero_copy_only=False)).astype(int)
            for key, own in _by_key(b, n_keys):
                v = fn(key, values[own], labels[own])
                if v is not None:
                    sums[key] = sums[key] + v if key in sums else v
        for key, v in sums.items():
            cols = [pa.array([k] * len(v), t) for k, t in zip(key, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v, pa.float64())], names=[*keys, "pos", "value"])

    src = rows.select(*keys, x, y)
    types = [pa.from_numpy_dtype("int64") if kinds[k] == "bigint" else pa.int32() if kinds[k] == "int" else pa.string() for k in keys]
    parts = src.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pos int, value double")
    return parts.groupBy(*keys, "pos").agg(F.sum("value").alias("value"))


def fold_sums(rows: DataFrame, keys: list[str], x: str, y: str, fn: Callable) -> dict[tuple, np.ndarray]:
    """sum_table as a vector a fold, on the driver."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
    total = sum_table(rows, keys, x, y, fn).groupBy(*keys).agg(listed.alias("v"))
    return {tuple(r[k] for k in keys): np.array(r["v"]) for r in total.collect()}


def _predict(rows: DataFrame, keys: list[str], row_id: str, x: str, y: str, score: Callable, strict: bool, coefficients: dict | None = None) -> DataFrame:
    """Test rows with pred, proba (score(key, x); None leaves the rows out), coefficients and chosen_params."""
    kinds, n_keys = dict(rows.dtypes), len(keys)

    def run(batches):
        for b in batches:
            values = _matrix(b.column(n_keys + 2))
            proba, there = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            coef: list = [None] * b.num_rows
            for key, own in _by_key(b, n_keys):
                p = score(key, values[own])
                if p is not None:
                    proba[own], there[own] = p, True
                    for i in own:
                        coef[i] = (coefficients or {}).get(key)
            pred = (proba > 0.5 if strict else proba >= 0.5).astype(np.int32)
            cols = [*b.columns[: n_keys + 1], b.column(n_keys + 1).cast(pa.int32()), pa.array(pred), pa.array(proba), pa.array(coef, pa.list_(pa.float64())), pa.nulls(b.num_rows, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(there))

    names = [*keys, row_id, y, "pred", "proba", "coefficients", "chosen_params"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, row_id]) + f", {y} int, pred int, proba double, coefficients array<double>, chosen_params map<string,string>"
    return rows.where("role = 'test'").select(*keys, row_id, y, x).mapInArrow(run, schema)


def logistic(split: DataFrame, keys: list[str], row_id: str, c: float = 1.0, balanced: bool = True, features: str = "features", y: str = "y", strict: bool = True, rounds: int = 100) -> DataFrame:
    """Test rows of every fold scored by its L2-penalised logistic regression, on features scaled by its training rows.

    All folds take their Newton steps together, a pass over the training rows a step; a step that raises a fold's loss is
    halved. pred, proba, coefficients and chosen_params (null) are as fit_folds gives them: a fold of one training class
    says that class, one without training rows has no rows.
    """
    rows = stash(split.select(*keys, row_id, y, features, "role"), "fold-rows")
    train = rows.where("role = 'train'")
    first = fold_sums(train, keys, features, y, lambda key, x, t: np.r_[len(x), t.sum(), x.sum(axis=0)])
    mean = {k: v[2:] / v[0] for k, v in first.items()}
    spread = fold_sums(train, keys, features, y, lambda key, x, t: ((x - mean[key]) ** 2).sum(axis=0))
    sd = {k: np.sqrt(v / first[k][0]) for k, v in spread.items()}
    sd = {k: np.where(v > 0, v, 1.0) for k, v in sd.items()}
    weight = {k: (v[0] / (2 * max(1, v[0] - v[1])), v[0] / (2 * max(1, v[1]))) if balanced else (1.0, 1.0) for k, v in first.items()}
    fixed = {k: float(v[1] > 0) for k, v in first.items() if v[1] in (0, v[0])}

    beta = {k: np.zeros(len(m) + 1) for k, m in mean.items() if k not in fixed}
    move, size, loss = {k: np.zeros_like(b) for k, b in beta.items()}, dict.fromkeys(beta, 1.0), dict.fromkeys(beta, np.inf)
    left = set(beta)
    for _ in range(rounds):
        trial = {k: beta[k] - size[k] * move[k] for k in left}

        def step(key, x, t, trial=trial):
            if key not in trial:
                return None
            a = np.hstack([(x - mean[key]) / sd[key], np.ones((len(x), 1))])
            s, w = a @ trial[key], np.where(t == 1, weight[key][1], weight[key][0])
            q = kernels.sigmoid(s)
            return np.r_[(w * (np.logaddexp(0, s) - t * s)).sum(), a.T @ (w * (q - t)), ((a * (w * q * (1 - q))[:, None]).T @ a).ravel()]

        for k, v in fold_sums(train, keys, features, y, step).items():
            b = trial[k]
            pen = np.append(np.full(len(b) - 1, 1 / c), 0.0)
            now, n = v[0] + (pen * b**2).sum() / 2, len(b)
            if now > loss[k] * (1 + 1e-14) and size[k] > 1e-8:
                size[k] /= 2
                continue
            done = np.abs(b - beta[k]).max() < 1e-10 or abs(loss[k] - now) < 1e-14
            first_look = not np.isfinite(loss[k])
            beta[k], loss[k] = b, now
            if done and not first_look:
                left.discard(k)
                continue
            hess = v[1 + n :].reshape(n, n) + np.diag(pen) + 1e-12 * np.eye(n)
            move[k], size[k] = np.linalg.solve(hess, v[1 : 1 + n] + pen * b), 1.0
        if not left:
            break

    def score(key, x):
        if key in fixed:
            return np.full(len(x), fixed[key])
        return kernels.sigmoid(((x - mean[key]) / sd[key]) @ beta[key][:-1] + beta[key][-1]) if key in beta else None

    return _predict(rows, keys, row_id, features, y, score, strict, {k: list(map(float, b[:-1])) for k, b in beta.items()})


#: Rows and folds whose scores a task of a walk forward holds at once, and scores that are made for each file of its rows.
WALK_ROWS, WALK_FOLDS, WALK_SCORES = 2048, 64, 50_000_000


def _walk_sums(rows: DataFrame, folds: np.ndarray, gap: int, n: int, add: Callable) -> np.ndarray:
    """(folds, n): for each fold the sums of add over the rows (_ord, _y, _x) whose place is below fold - gap.

    add(x, cls, some) gives the sums of rows of one class for a slice of the folds; where rows differ in whether a fold has
    them, add(x, cls, some, has) is given that as a table of rows and folds. A row is never copied for its folds.
    """
    below = folds - gap

    def run(batches):
        out = np.zeros((len(folds), n))
        for b in batches:
            ords, said, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2))
            for cls in (0, 1):
                own = np.flatnonzero((said == 1) == bool(cls))
                own = own[np.argsort(ords[own], kind="stable")]
                for i in range(0, len(own), WALK_ROWS):
                    o, rows_x = ords[own[i : i + WALK_ROWS]], x[own[i : i + WALK_ROWS]]
                    first = int(np.searchsorted(below, o[0], "right"))
                    for at in range(first, len(folds), WALK_FOLDS):
                        some = slice(at, min(at + WALK_FOLDS, len(folds)))
                        edge, end = np.searchsorted(o, [below[at], below[some.stop - 1]])
                        if edge:
                            out[some] += add(rows_x[:edge], cls, some)
                        if end > edge:
                            out[some] += add(rows_x[edge:end], cls, some, o[edge:end, None] < below[None, some])
        at = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(out[at, j]) for j in range(n)]], names=["at", *[f"v{j}" for j in range(n)]])

    parts = rows.select("_ord", "_y", "_x").mapInArrow(run, ", ".join(["at long", *[f"v{j} double" for j in range(n)]]))
    got = parts.groupBy("at").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(n)]).toPandas()
    total = np.zeros((len(folds), n))
    total[got["at"].to_numpy(np.int64)] = got.drop(columns="at").to_numpy(float)
    return total


def expanding_logistic(rows: DataFrame, group: str, order: str, n_init: int, step: int = 1, gap: int = 0, c: float = 1.0, balanced: bool = True, features: str = "features", y: str = "y", strict: bool = True, rounds: int = 100) -> DataFrame:
    """logistic() on the folds of splits.expanding_by_group: each is fitted on all groups before it, none is written out.

    A group's moments are merged along the order, so a fold's scaler is one of a row a group. A Newton step is one pass over
    the rows, which scores each for the folds that train on it: rows times folds in time, as the job asks for, but the
    rows alone in memory and on disk.
    """
    if n_init < 1 or step < 1 or gap < 0:
        raise ValueError("n_init and step are at least 1, gap at least 0")
    ords = stash(splits.group_order(rows, group, order), "group-order")
    last, n_rows = ords.agg(F.max("ord"), F.sum("n_rows")).first()
    first = n_init + -(-max(0, gap + 1 - n_init) // step) * step
    folds = np.arange(first, (last or 0) + 1, step)
    names = dict.fromkeys((order, y, features))
    placed = rows.join(ords.select(group, F.col("ord").alias("_ord")), group).select("_ord", *names, F.col(y).cast("int").alias("_y"))
    files = int(len(folds) * (n_rows or 0) // (2 * WALK_SCORES)) + 1
    placed = stash(placed.repartition(files, order), "walk-rows")
    source = placed.withColumn("fold", F.col("_ord")).withColumn("role", F.lit("test"))
    if not len(folds):
        return _predict(source, ["fold"], order, features, y, lambda key, x: None, strict)

    p = len(placed.select(features).first()[0])
    x = [F.get(features, F.lit(j)).cast("double") for j in range(p)]
    per = placed.groupBy("_ord").agg(F.count("*").alias("n"), F.sum("_y").alias("n1"), *[F.avg(v).alias(f"m{j}") for j, v in enumerate(x)], *[(F.var_pop(v) * F.count("*")).alias(f"q{j}") for j, v in enumerate(x)])
    per = per.toPandas().set_index("_ord").sort_index()
    stats, n, ones, mean, q = [], 0.0, 0.0, np.zeros(p), np.zeros(p)
    for r in per.to_numpy(float):
        k, away = n + r[0], r[2 : 2 + p] - mean
        mean, q, ones = mean + away * r[0] / k, q + r[2 + p :] + away**2 * n * r[0] / k, ones + r[1]
        n = k
        stats.append(np.r_[n, ones, mean, q])
    stats = np.array(stats)[folds - gap - 1]
    n, ones, mean, sd = stats[:, 0], stats[:, 1], stats[:, 2 : 2 + p], np.sqrt(stats[:, 2 + p :] / stats[:, :1])
    sd = np.where(sd > 0, sd, 1.0)
    weight = np.stack([n / (2 * np.maximum(1, n - ones)), n / (2 * np.maximum(1, ones))], axis=1) if balanced else np.ones((len(n), 2))
    one_class = (ones == 0) | (ones == n)
    # rows are scaled once, by the last fold; a fold's own scaling is a linear map from there
    shift, unit = mean[-1], sd[-1]
    scaled = placed.select("_ord", "_y", F.array(*[(v - float(shift[j])) / float(unit[j]) for j, v in enumerate(x)]).alias("_x"))
    to_own = np.zeros((len(folds), p + 1, p + 1))  # (x, 1) @ to_own: the row in the fold's own scale
    to_own[:, range(p), range(p)], to_own[:, p, p] = unit / sd, 1.0
    to_own[:, p, :p] = (shift - mean) / sd
    pairs = [(i, j) for i in range(p + 1) for j in range(i + 1)]
    upper, lower = np.array(pairs).T

    beta, move, size, loss = np.zeros((len(folds), p + 1)), np.zeros((len(folds), p + 1)), np.ones(len(folds)), np.full(len(folds), np.inf)
    left, pen = np.flatnonzero(~one_class), np.append(np.full(p, 1 / c), 0.0)
    for _ in range(rounds if len(left) else 0):
        trial = beta[left] - size[left, None] * move[left]
        w = np.einsum("fij,fj->fi", to_own[left], trial).T
        heavy = weight[left]

        def add(x, cls, some, has=None, w=w, heavy=heavy):
            a = np.column_stack([x, np.ones(len(x))])
            z = np.exp(np.clip((a @ w[:, some]) * (1.0 - 2 * cls), -500, 500))
            missed = z / (1 + z)
            lost, curve = np.log1p(z), missed / (1 + z)
            if has is not None:
                missed, lost, curve = missed * has, lost * has, curve * has
            grad = (missed.T @ a) * (1.0 - 2 * cls)
            return np.column_stack([lost.sum(axis=0), grad, curve.T @ (a[:, upper] * a[:, lower])]) * heavy[some, cls : cls + 1]

        v = _walk_sums(scaled, folds[left], gap, 1 + (p + 1) + len(pairs), add)
        half = np.zeros((len(left), p + 1, p + 1))
        half[:, upper, lower] = half[:, lower, upper] = v[:, p + 2 :]
        own = to_own[left]
        grad = np.einsum("fij,fi->fj", own, v[:, 1 : p + 2]) + pen * trial
        hess = np.swapaxes(own, 1, 2) @ half @ own + np.diag(pen) + 1e-12 * np.eye(p + 1)
        now = v[:, 0] + (pen * trial**2).sum(axis=1) / 2
        up = (now > loss[left] * (1 + 1e-12)) & (size[left] > 1e-8)
        seen = np.isfinite(loss[left])
        done = seen & ~up & ((np.abs(trial - beta[left]).max(axis=1) < 1e-10) | (np.abs(loss[left] - now) < 1e-14))
        size[left[up]] /= 2
        ok = left[~up]
        beta[ok], loss[ok], size[ok] = trial[~up], now[~up], 1.0
        move[ok] = np.linalg.solve(hess[~up], grad[~up, :, None])[:, :, 0]
        done |= ~up & (np.abs(move[left]).max(axis=1) < 1e-10)  # a step so small needs no look at where it leads
        beta[left[done]] -= move[left[done]]
        left = left[~done]
        if not len(left):
            break

    place = {int(f): i for i, f in enumerate(folds)}

    def score(key, x):
        i = place.get(key[0])
        if i is None:
            return None
        return np.full(len(x), float(ones[i] > 0)) if one_class[i] else kernels.sigmoid(((x - mean[i]) / sd[i]) @ beta[i, :-1] + beta[i, -1])

    coefficients = {(int(f),): list(map(float, beta[i, :-1])) for i, f in enumerate(folds) if not one_class[i]}
    return _predict(source, ["fold"], order, features, y, score, strict, coefficients)


def epoch_moments(epochs: DataFrame, channels: str = "channels", out: str = "moments") -> DataFrame:
    """epochs with out: samples, sums and sums of products of the channels, in one array, in place of the samples."""

    @F.pandas_udf("array<double>")
    def moments(column: pd.Series) -> pd.Series:
        x = [np.stack(e).astype(float) for e in column]
        return pd.Series([np.r_[e.shape[1], e.sum(axis=1), (e @ e.T).ravel()] for e in x], dtype=object)

    return epochs.withColumn(out, moments(F.transform(channels, lambda c: c["x"]))).drop(channels)


def _second(moments: np.ndarray, p: int) -> np.ndarray:
    return moments[..., 1 + p :].reshape(*moments.shape[:-1], p, p)


def csp_lda(split: DataFrame, keys: list[str], row_id: str, components: int = 6, moments: str = "moments", y: str = "y") -> DataFrame:
    """Test rows of each fold scored by spatial patterns and a discriminant of its training epochs, from epoch_moments.

    A fold's class covariances are sums of its epochs' moments, and a component's log variance in an epoch is a quadratic
    form of that epoch's, so no samples are read again: a pass for the covariances, two for the discriminant.
    """
    rows = stash(split.select(*keys, row_id, y, moments, "role"), "fold-moments")
    train = rows.where("role = 'train'")

    def classes(key, x, t):
        return np.concatenate([np.r_[(t == k).sum(), x[t == k].sum(axis=0)] for k in (0, 1)])

    both = {k: v.reshape(2, -1) for k, v in fold_sums(train, keys, moments, y, classes).items()}
    fixed = {k: float(v[1, 0] > 0) for k, v in both.items() if 0 in v[:, 0]}
    filters, p = {}, 0
    for k, v in both.items():
        if k not in fixed:
            p = round((np.sqrt(1 + 4 * (v.shape[1] - 2)) - 1) / 2)
            m = v[:, 1:] / v[:, 1:2]
            cov = _second(m, p) - m[:, 1 : 1 + p, None] * m[:, None, 1 : 1 + p]
            filters[k] = kernels.spatial_filters(cov[0], cov[1], components)

    def features(key, x):
        w = filters[key]
        return np.log(np.einsum("cp,npq,cq->nc", w, _second(x, p), w) / x[:, :1])

    def sums(key, x, t):
        f = features(key, x) if key in filters else None
        return None if f is None else np.concatenate([f[t == k].sum(axis=0) for k in (0, 1)])

    means = {k: v.reshape(2, -1) / both[k][:, :1] for k, v in fold_sums(train, keys, moments, y, sums).items()}

    def within(key, x, t):
        if key not in filters:
            return None
        d = features(key, x) - means[key][t]
        return (d.T @ d).ravel()

    rule = {}
    for k, v in fold_sums(train, keys, moments, y, within).items():
        n, m = both[k][:, 0], means[k]
        w = np.linalg.lstsq(v.reshape(m.shape[1], -1) / max(1, n.sum() - 2), m[1] - m[0], rcond=None)[0]
        rule[k] = w, float(-w @ m.mean(axis=0) + np.log(n[1] / n[0]))

    def score(key, x):
        if key in fixed:
            return np.full(len(x), fixed[key])
        return kernels.sigmoid(features(key, x) @ rule[key][0] + rule[key][1]) if key in rule else None

    return _predict(rows, keys, row_id, moments, y, score, True).drop("coefficients", "chosen_params")
