"""Models fitted inside folds: fold statistics and dummies in SQL, iterative solvers in one grouped map a fold.

A grouped map gets a fold's rows once and returns predictions and coefficients together, so nothing is fitted twice. Its
input is sorted by row id, so a fold's fit doesn't depend on how rows were partitioned. Logistic folds of any size are
fitted by fold_sums.logistic, which gathers none of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.functions import kernels
from epochfold.operators.splits import draw, leave_one_group_out
from epochfold.session import stash

#: Training rows that one grouped map takes; larger folds raise and name the distributed path.
MOST_ROWS = 1_000_000
#: Partitions that folds of a kernel machine are dealt to: its folds are small in bytes and long in time, so they aren't
#: put together by their bytes.
KERNEL_PARTS = 64


@dataclass(frozen=True)
class ModelSpec:
    """An unfitted model: a kind and its settings. It has no fitted state that could leak."""

    kind: str = "logistic"
    params: dict = field(default_factory=lambda: {"c": 1.0, "balanced": True})


def fold_scaler(train: DataFrame, keys: list[str], value: str = "power") -> DataFrame:
    """mean and population deviation by fold and feature, of training rows alone; a constant feature is divided by 1."""
    sd = F.stddev_pop(value)
    return train.groupBy(*keys).agg(F.avg(value).alias("mean"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("sd"))


def training_classes(split: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """Training positives, rows, majority class (the smaller one on a tie) and positive rate of each fold."""
    t = split.where("role = 'train'").groupBy(*keys).agg(F.count("*").alias("n_train"), F.count_if(F.col(y) == 1).alias("n_train_pos"))
    rate = F.col("n_train_pos").cast("double") / F.col("n_train")
    return t.select("*", (F.col("n_train_pos") * 2 > F.col("n_train")).cast("int").alias("majority"), rate.alias("rate"))


def dummy(split: DataFrame, keys: list[str], strategy: str, row_id: str, y: str = "y", seed: int = 42) -> DataFrame:
    """Test rows of each fold with pred and proba of a dummy fitted on the fold's training labels.

    most_frequent and prior say the majority; stratified and uniform draw by a portable hash of seed, fold and row.
    """
    test = split.where("role = 'test'").join(training_classes(split, keys, y), keys)
    u = draw(seed, *[F.col(k) for k in keys], F.col(row_id)).cast("double") / float(1 << 32)
    pick = {
        "most_frequent": (F.col("majority"), F.col("majority").cast("double")),
        "prior": (F.col("majority"), F.col("rate")),
        "stratified": ((u < F.col("rate")).cast("int"), (u < F.col("rate")).cast("double")),
        "uniform": ((u < 0.5).cast("int"), F.lit(0.5).cast("double")),
    }
    if strategy not in pick:
        raise ValueError(f"no dummy strategy {strategy!r}")
    pred, proba = pick[strategy]
    return test.select(*keys, row_id, y, pred.alias("pred"), proba.alias("proba"))


def loso_moments(long: DataFrame, group: str, name: str = "band", value: str = "power", y: str = "y") -> DataFrame:
    """fold, name, mean, sd, c0, c1: training statistics of each left-out group, merged from a row a group and feature.

    Groups' moments are added up, never taken away from totals, so a held-out group's values can't come in by rounding.
    The product is of groups and groups; rows meet their own group's fold alone.
    """
    v, one = F.col(value), lambda k: F.when(F.col(y) == k, F.col(value))
    per = long.groupBy(group, name).agg(F.count(v).alias("_n"), F.avg(v).alias("_m"), (F.var_pop(v) * F.count(v)).alias("_q"), *[f(one(k)).alias(f"_{n}{k}") for k in (0, 1) for n, f in (("k", F.count), ("c", F.avg))])
    per = stash(per, "moments")  # a row a group and feature, read for the folds, the means and the spread
    others = leave_one_group_out(per, group).where("role = 'train'")
    mean = lambda n, m: F.sum(F.col(n) * F.col(m)) / F.nullif(F.sum(n), F.lit(0))
    fit = others.groupBy("fold", name).agg(mean("_n", "_m").alias("mean"), F.sum("_n").alias("_all"), mean("_k0", "_c0").alias("c0"), mean("_k1", "_c1").alias("c1"))
    spread = others.join(F.broadcast(fit.select("fold", name, "mean")), ["fold", name])
    spread = spread.groupBy("fold", name).agg(F.sum(F.col("_q") + F.col("_n") * F.pow(F.col("_m") - F.col("mean"), F.lit(2.0))).alias("_q"))
    sd = F.sqrt(F.col("_q") / F.col("_all"))
    return fit.join(spread, ["fold", name]).select("fold", name, "mean", F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("sd"), "c0", "c1")


def loso_centroid(long: DataFrame, group: str, row_id: str, y: str = "y", name: str = "band", value: str = "power") -> DataFrame:
    """centroid() with each group left out in turn: fold, row_id, y, pred, proba, from one pass over the rows."""
    fit = loso_moments(long, group, name, value, y).select(F.col("fold").alias(group), name, F.col("sd").alias("_s"), F.col("c0").alias("_c0"), F.col("c1").alias("_c1"))
    return _nearest(long.join(F.broadcast(fit), [group, name]).withColumn("fold", F.col(group)), ["fold"], row_id, y, value)


def _nearest(t: DataFrame, keys: list[str], row_id: str, y: str, value: str) -> DataFrame:
    """Rows of (keys, row, feature) with _s, _c0 and _c1 to the row's prediction."""
    d = lambda c: F.sqrt(F.sum(F.pow((F.col(value) - F.col(c)) / F.col("_s"), F.lit(2.0))))
    s = t.groupBy(*keys, row_id, y).agg(d("_c0").alias("_d0"), d("_c1").alias("_d1"))
    proba = F.col("_d0") / F.nullif(F.col("_d0") + F.col("_d1"), F.lit(0.0))
    return s.select(*keys, row_id, y, (F.col("_d1") < F.col("_d0")).cast("int").alias("pred"), F.coalesce(proba, F.lit(0.5)).alias("proba"))


def centroid(split_long: DataFrame, keys: list[str], row_id: str, y: str = "y", name: str = "band", value: str = "power") -> DataFrame:
    """Nearest centroid on fold-scaled features, all in SQL: fits on training rows, scores test rows.

    split_long is long: a row for each fold, row and feature, with role. proba is the share of the distance to class 0.
    """
    train = split_long.where("role = 'train'")
    fit = train.groupBy(*keys, name).agg(
        F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"),
        F.avg(F.when(F.col(y) == 0, F.col(value))).alias("_c0"), F.avg(F.when(F.col(y) == 1, F.col(value))).alias("_c1"),
    )
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    fit = fit.select(*keys, name, sd.alias("_s"), "_c0", "_c1")
    return _nearest(split_long.where("role = 'test'").join(fit, [*keys, name]), keys, row_id, y, value)


def _fit_predict(spec: ModelSpec, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, list[float] | None]:
    """Probabilities of class 1 for the test rows, and signed coefficients where the model has them."""
    if len(np.unique(y)) < 2:
        return np.full(len(test), float(y[0]) if len(y) else 0.0), None
    p = spec.params
    m, s = kernels.scale(x)
    a, b = (x - m) / s, (test - m) / s
    if spec.kind == "logistic":
        w, c = kernels.logistic(a, y, p.get("c", 1.0), p.get("balanced", True))
        return kernels.sigmoid(b @ w + c), list(map(float, w))
    if spec.kind == "svm_rbf":
        fit = kernels.rbf_svm(a, y, p.get("c", 1.0), p.get("balanced", True))
        return kernels.sigmoid(kernels.svm_score(fit, b) * fit["w"] + fit["b"]), None
    if spec.kind == "lda":
        w, c = kernels.lda(x, y)
        return kernels.sigmoid(test @ w + c), list(map(float, w))
    raise ValueError(f"no model {spec.kind!r}")


def _balanced(y: np.ndarray, pred: np.ndarray) -> float:
    return float(np.mean([(pred[y == c] == c).mean() for c in np.unique(y)]))


def _inner(spec: ModelSpec, grid: list[dict], x: np.ndarray, y: np.ndarray, groups: np.ndarray, k: int) -> ModelSpec:
    """The grid's best setting by mean balanced accuracy over inner group folds; the first of equal ones."""
    ids, sizes = np.unique(groups, return_counts=True)
    load, fold = np.zeros(min(k, len(ids))), {}
    for i in np.argsort(-sizes, kind="stable"):
        fold[ids[i]] = int(load.argmin())
        load[fold[ids[i]]] += sizes[i]
    own = np.array([fold[g] for g in groups])
    best = (-1.0, grid[0])
    for setting in grid:
        trial = ModelSpec(spec.kind, {**spec.params, **setting})
        marks = [_balanced(y[own == f], (_fit_predict(trial, x[own != f], y[own != f], x[own == f])[0] > 0.5).astype(int)) for f in range(len(load))]
        if np.mean(marks) > best[0] + 1e-12:
            best = (float(np.mean(marks)), setting)
    return ModelSpec(spec.kind, {**spec.params, **best[1]})


def fit_folds(split: DataFrame, keys: list[str], row_id: str, spec: ModelSpec, features: str = "features", y: str = "y", strict: bool = True, grid: list[dict] | None = None, inner_group: str | None = None, inner_splits: int = 5) -> DataFrame:
    """Test rows of every fold with pred, proba, coefficients and chosen_params, each fold fitted in one task.

    strict says `proba > 0.5`, else `>= 0.5`, for a positive prediction. With a grid, settings are chosen inside the
    training rows by group folds. A fold of one training class gives that class as a constant.
    """
    if not isinstance(spec, ModelSpec):
        raise ValueError("pass an unfitted ModelSpec")
    if grid is not None and (not grid or inner_group is None):
        raise ValueError("tuning needs a grid and a group column")
    cols = [*keys, row_id, y, features, "role", *([inner_group] if inner_group and inner_group not in keys else [])]
    kinds = dict(split.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, row_id]) + f", {y} int, pred int, proba double, coefficients array<double>, chosen_params map<string,string>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id, kind="stable")
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        if len(train) > MOST_ROWS:
            raise ValueError("too many training rows for one task; use fold_sums.logistic")
        if not len(test) or not len(train):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        x, labels, own = np.stack(train[features].to_numpy()), train[y].to_numpy().astype(int), spec
        if grid:
            own = _inner(spec, grid, x, labels, train[inner_group].to_numpy(), inner_splits)
        proba, coef = _fit_predict(own, x, labels, np.stack(test[features].to_numpy()))
        out = test[[*keys, row_id, y]].copy()
        out["pred"] = (proba > 0.5 if strict else proba >= 0.5).astype(int)
        out["proba"] = proba
        out["coefficients"] = [coef] * len(out)
        out["chosen_params"] = [{k: str(v) for k, v in own.params.items()} if grid else None] * len(out)
        return out

    rows = split.select(*cols)
    if spec.kind == "svm_rbf":
        rows = rows.repartition(KERNEL_PARTS, *keys)
    return rows.groupBy(*keys).applyInPandas(run, schema)


def random_forest(split: DataFrame, fold: str, row_id: str, trees: int = 300, seed: int = 42, features: str = "features", y: str = "y") -> DataFrame:
    """Test rows of each fold scored by a Spark ML forest fitted on its training rows; the folds' ids are few by design.

    Every fold reads the split again, so its vectors stay persisted as long as the result may be read.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = split.select(fold, row_id, y, "role", array_to_vector(features).alias("_v")).persist()
    out = None
    for (f,) in sorted(data.select(fold).distinct().collect()):
        own = data.where(F.col(fold) == f)
        m = RandomForestClassifier(featuresCol="_v", labelCol=y, numTrees=trees, seed=seed).fit(own.where("role = 'train'"))
        proba = F.get(vector_to_array("probability"), F.lit(1))
        got = m.transform(own.where("role = 'test'")).select(fold, row_id, y, (proba > 0.5).cast("int").alias("pred"), proba.alias("proba"))
        out = got if out is None else out.unionByName(got)
    return out


def coefficient_means(preds: DataFrame, keys: list[str], names: list[str], split: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Mean coefficient by name; keys are those that a mean is kept apart by, split those that tell fits apart.

    Folds of a subject (the split's keys beside fold) are averaged first, then subjects, so each subject weighs the same.
    """
    every = list(dict.fromkeys([*keys, *split]))
    units = [c for c in every if c != "fold"]
    folds = preds.where("coefficients IS NOT NULL").select(*every, "coefficients").dropDuplicates(every)
    labels = F.array(*[F.lit(n) for n in names])
    long = folds.select(*units, F.posexplode("coefficients").alias("_i", "v")).withColumn("name", F.element_at(labels, F.col("_i") + 1))
    per = long.groupBy(*units, "name").agg(F.avg("v").alias("v"))
    return per.groupBy(*keys, "name").agg(F.avg("v").alias("mean_coefficient"))


def top_coefficients(means: DataFrame, k: int = 10) -> DataFrame:
    return means.orderBy(F.abs("mean_coefficient").desc(), "name").limit(k)
