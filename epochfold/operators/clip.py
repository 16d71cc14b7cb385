"""Artifact clipping: limits are quantiles of the training rows of a fold, and of nothing else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochfold.session import stash

LOW, HIGH = 0.001, 0.999


def limits(train_samples: DataFrame, keys: list[str], value: str = "v", low: float = LOW, high: float = HIGH) -> DataFrame:
    """keys, lo, hi: exact quantiles with linear interpolation over the given rows alone.

    The counts of distinct values of a key meet in one task; see fold_limits for values that are too many for that.
    """
    return train_samples.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))


def fold_limits(rows: DataFrame, pairs: DataFrame, folds: list[str], group: str, keys: list[str] | None = None, value: str = "v", low: float = LOW, high: float = HIGH, held_out: bool = False, buckets: int = 4096) -> DataFrame:
    """folds, keys, lo, hi: the exact quantiles of every fold's training rows, without a row for each row and fold.

    rows hold their group; pairs(folds, group) says which groups a fold trains on or, with held_out, which ones it does
    not. Values are counted by group in the buckets of an interval, and the counts of groups, not their rows, are added
    up by fold. The bucket that holds a wanted rank is the next interval, until it holds one value. Each round reads the
    rows once and shuffles counts alone: about three rounds for a billion rows. Counts are whole numbers, so a fold's
    limits depend on its training rows only. Null values and groups are left out; a value that isn't finite raises.
    """
    at = ["_k", *(keys or [])]
    r = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, *(keys or []), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_k"))
    per = stash(r.groupBy(group, *at).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count_if(F.isnan("_v") | (F.abs("_v") == float("inf"))).alias("_bad")), "clip-groups")
    if per.agg(F.sum("_bad")).first()[0]:
        raise ValueError("quantiles need finite values")
    pairs = pairs.select(*folds, group).distinct()
    span = per.groupBy(*at).agg(F.sum("_n").alias("_all"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    own = per.join(pairs, group).groupBy(*folds, *at).agg(F.sum("_n").alias("_own"))
    whole = pairs.select(*folds, F.lit(0).alias("_k")).distinct().join(span, "_k").join(own, [*folds, *at], "left")
    own_n = F.coalesce("_own", F.lit(0))
    n = F.col("_all") - own_n if held_out else own_n
    wanted = [(name, q, f) for name, q in (("lo", low), ("hi", high)) for f in (F.floor, F.ceil)]
    ranks = F.array(*[F.struct(F.lit(f"{name}{i % 2}").alias("_side"), f(F.lit(q) * (n - 1)).alias("_rank"), (F.lit(q) * (n - 1)).alias("_pos")) for i, (name, q, f) in enumerate(wanted)])
    spread = whole.where(n > 0).select(*folds, *at, "_a", "_b", F.lit(False).alias("_few"), F.explode(ranks).alias("_t"))
    targets = stash(spread.select(*folds, *at, "_a", "_b", "_few", "_t.*"), "clip-ranks")
    done, open_ = targets.where("_a = _b"), targets.where("_a < _b")
    turn = 0
    while not open_.isEmpty():
        counts = _bucket_counts(r, open_, group, at, buckets, turn % 2 == 1)
        turn += 1
        spot = [*at, "_a", "_b"]
        every = counts.groupBy(*spot, "_j").agg(F.sum("_c").alias("_all"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        mine = counts.join(pairs, group).groupBy(*folds, *spot, "_j").agg(F.sum("_c").alias("_own"))
        grid = open_.join(every, spot).join(mine, [*folds, *spot, "_j"], "left")
        c = F.col("_all") - own_n if held_out else own_n
        upto = Window.partitionBy(*folds, *at, "_side").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumn("_c", c).withColumn("_upto", F.sum("_c").over(upto))
        hit = grid.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        left = F.col("_rank") - (F.col("_upto") - F.col("_c"))
        found = stash(hit.select(*folds, *at, F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), (F.col("_all") <= buckets).alias("_few"), "_side", left.alias("_rank"), "_pos"), "clip-ranks")
        done, open_ = done.unionByName(found.where("_a = _b")), found.where("_a < _b")
    side = lambda name: F.max(F.when(F.col("_side") == name, F.col("_a")))
    place = lambda name: F.max(F.when(F.col("_side") == name, F.col("_pos")))
    got = done.groupBy(*folds, *at).agg(*[side(f"{x}{i}").alias(f"_{x}{i}") for x in ("lo", "hi") for i in (0, 1)], *[place(f"{x}0").alias(f"_{x}p") for x in ("lo", "hi")])

    def between(x: str) -> Column:
        a, b, p = F.col(f"_{x}0"), F.col(f"_{x}1"), F.col(f"_{x}p")
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b).alias(x)

    return got.select(*folds, *(keys or []), between("lo"), between("hi"))


def _bucket_counts(r: DataFrame, open_: DataFrame, group: str, at: list[str], buckets: int, odd: bool) -> DataFrame:
    """Counts and ends of the buckets of each open interval, by group; an interval of few rows is cut at every value.

    Buckets are equally wide in the value or, where an interval spans magnitudes, in its logarithm with its sign: an
    interval around 0 takes turns. So values spread over all exponents need no more than some ten rounds.
    Intervals of a key share no value, so a row is in one at most. Rows outside all of a key's are left out first.
    """
    side = F.substring("_side", 1, 2)
    ends = [f(F.when(side == x, F.col(c))).alias(f"_{x}{c}") for x in ("lo", "hi") for f, c in ((F.min, "_a"), (F.max, "_b"))]
    near = r.join(open_.groupBy(*at).agg(*ends), at).where("_v BETWEEN _lo_a AND _lo_b OR _v BETWEEN _hi_a AND _hi_b").select(group, *at, "_v")
    spots = open_.select(*at, "_a", "_b", "_few").distinct()
    inside = near.join(spots, at).where("_v BETWEEN _a AND _b")
    sizes = F.abs("_a"), F.abs("_b")
    wide = F.when(F.signum("_a") * F.signum("_b") > 0, F.greatest(*sizes) / F.greatest(F.least(*sizes), F.lit(5e-324)) > 16).otherwise(F.lit(odd))
    # ln of the smallest double is -744.4; halves, so that a difference can't overflow
    code = lambda c: F.when(wide, F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.ln(F.abs(c)) + 746))).otherwise(F.col(c) / 2)
    width = code("_b") - code("_a")
    cut = F.least(F.floor((code("_v") - code("_a")) / F.nullif(width, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("double")
    inside = inside.withColumn("_j", F.when(F.col("_few") | (width <= 0), F.col("_v")).otherwise(cut))
    return stash(inside.groupBy(group, *at, "_a", "_b", "_j").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "clip-buckets")


def clip(samples: DataFrame, fitted: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """samples with value held between their key's limits; a key without limits raises."""
    joined = samples.join(fitted, keys, "left")
    lo = F.coalesce("lo", F.raise_error(F.lit("the clipper has not been fitted for this key")).cast("double"))
    return joined.withColumn(value, F.greatest(lo, F.least(F.col("hi"), F.col(value)))).drop("lo", "hi")


@dataclass(frozen=True)
class Clipper:
    """An unfitted clipper; fit gives a FittedClipper, so nothing can be clipped before a fit."""

    low: float = LOW
    high: float = HIGH
    fixed: tuple[float, float] | None = None

    def fit(self, train_samples: DataFrame, keys: list[str], value: str = "v") -> FittedClipper:
        if self.fixed:
            own = train_samples.select(*keys).distinct().select("*", F.lit(float(self.fixed[0])).alias("lo"), F.lit(float(self.fixed[1])).alias("hi"))
        else:
            own = limits(train_samples, keys, value, self.low, self.high)
        return FittedClipper(own, tuple(keys), value)


@dataclass(frozen=True)
class FittedClipper:
    limits: DataFrame
    keys: tuple[str, ...]
    value: str

    def transform(self, samples: DataFrame) -> DataFrame:
        return clip(samples, self.limits, list(self.keys), self.value)


def clip_arrays(epochs: DataFrame, fitted: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Epochs with an array of samples, each value held between the key's limits; no row is taken apart."""
    joined = epochs.join(fitted, keys)
    return joined.withColumn(x, F.transform(x, lambda v: F.greatest(F.col("lo"), F.least(F.col("hi"), v)))).drop("lo", "hi")
