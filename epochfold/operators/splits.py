"""Splits as relations: rows of (fold, role) joined to the data, never index lists on the driver.

Folds are made from distinct groups, a small table; rows meet folds by an explode of what they belong to, or by a key
where there is one, so the planner never sees a product of two data-sized tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochfold.operators import ordering
from epochfold.session import stash

#: Groups of a fan-out split are held in one array a row; more than this many would multiply the data too far.
MOST_FOLDS = 10_000
#: Rows of a walk forward that a task spells out on average.
SPELLED = 5_000_000
#: Folds of a walk forward that are spelled out at once for each row of a task.
SPAN = 256


def _fan_out(rows: DataFrame, folds: DataFrame, most: int = MOST_FOLDS) -> DataFrame:
    """Each row with each fold. The folds' number is checked, as the result is rows times folds by definition."""
    n = folds.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} folds; use a coarser group")
    return rows.join(F.broadcast(folds))


def leave_one_group_out(rows: DataFrame, group: str) -> DataFrame:
    """rows with fold (the held-out group) and role, once for each group."""
    folds = rows.select(F.col(group).alias("fold")).distinct()
    return _fan_out(rows, folds).withColumn("role", F.when(F.col(group) == F.col("fold"), "test").otherwise("train"))


def leave_one_run_out(rows: DataFrame, subject: str = "subject", run: str = "run") -> DataFrame:
    """As above within each subject: fold is the held-out run; subjects of one run are left out."""
    runs = rows.select(subject, F.col(run).alias("fold")).distinct()
    many = runs.groupBy(subject).count().where("count >= 2").select(subject)
    folds = runs.join(many, subject, "left_semi")
    return rows.join(folds, subject).withColumn("role", F.when(F.col(run) == F.col("fold"), "test").otherwise("train"))


def valid_folds(split: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """The split's folds whose training rows have both classes and whose test rows aren't empty, by a semi-join."""
    train = F.col("role") == "train"
    ok = split.groupBy(*keys).agg(F.count_distinct(F.when(train, F.col(y))).alias("classes"), F.count_if(~train).alias("n_test"))
    return split.join(ok.where("classes = 2 AND n_test > 0").select(*keys), keys, "left_semi")


def group_order(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, ord, n_rows: the groups' place, from 0, by their first row; a group id that falls along the order raises."""
    g = rows.groupBy(group).agg(F.min(order).alias("_at"), F.count("*").alias("n_rows"))
    g = ordering.placed(g, "_at", "ord", before={"_before": group})
    falls = F.col("_before").isNotNull() & (F.col("_before") > F.col(group))
    return g.select(group, F.when(falls, F.raise_error(F.lit("group ids must not decrease along the order")).cast("long")).otherwise(F.col("ord")).alias("ord"), "n_rows")


def _walk(rows: DataFrame, place: str, n: int, n_init: int, step: int, gap: int, width: int, n_rows: int, spread: str) -> DataFrame:
    """rows with fold and role: folds start at n_init, every step places, before n, and train on places below fold - gap.

    A row's folds follow from its place, so they are spelled out in it: no fold is joined to the rows. They are whole
    numbers alone, as the role follows from fold and place. Early rows have the most folds, and a few MB of rows may have
    billions, so the n_rows rows are dealt out by the hash of spread, a task for each SPELLED of the result. A task spells
    out SPAN folds for each of its rows, then the next SPAN: the same few folds over and over are small once written.
    """
    first = n_init + -(-max(0, gap + 1 - n_init) // step) * step
    last = n_init + (n - 1 - n_init) // step * step
    if first > last:
        return rows.withColumns({"fold": F.lit(0).cast("long"), "role": F.lit("train")}).where("false")
    # a fold trains on the places before it: (first + last) / 2 of n on average
    total = ((last - first) // step + 1) * (first + last) * n_rows // (2 * n)
    if total > SPELLED:
        rows = rows.repartition(-(-total // SPELLED), spread)
    p = F.col(place)
    own = first + F.floor((p - first) / step) * step
    test = (p >= first) & (p - own < width) & (own <= last)
    start = first + F.ceil(F.greatest(F.lit(0).cast("long"), p + gap + 1 - first) / step) * step
    none = F.array().cast("array<bigint>")
    span = lambda f: F.floor((f - first) / (step * SPAN))
    spans = F.when(start <= last, F.sequence(span(F.when(test, own).otherwise(start)), span(F.lit(last)))).when(test, F.array(span(own)))
    parts = rows.withColumn("_span", F.explode(spans)).sortWithinPartitions("_span")
    low = F.col("_span") * (step * SPAN) + first
    high = F.least(low + step * (SPAN - 1), F.lit(last).cast("long"))
    train = F.when(F.greatest(start, low) <= high, F.sequence(F.greatest(start, low), high, F.lit(step).cast("long")))
    held = F.when(test & (own >= low) & (own <= high), F.array(own)).otherwise(none)
    spelled = parts.withColumn("fold", F.explode(F.concat(held, F.coalesce(train, none)))).drop("_span")
    return spelled.withColumn("role", F.when(F.col("fold") <= p, "test").otherwise("train"))


def expanding_by_group(rows: DataFrame, group: str, order: str, n_init: int, step: int = 1, gap: int = 0) -> DataFrame:
    """Walk forward over groups in order: test is group i, from n_init on, training the groups before i - gap."""
    if n_init < 1 or step < 1 or gap < 0:
        raise ValueError("n_init and step are at least 1, gap at least 0")
    ords = stash(group_order(rows, group, order), "group-order")
    last, n_rows = ords.agg(F.max("ord"), F.sum("n_rows")).first()
    return _walk(rows.join(ords.drop("n_rows"), group), "ord", (last or 0) + 1, n_init, step, gap, 1, n_rows or 0, order).drop("ord")


def row_numbers(rows: DataFrame, order: str, out: str = "pos") -> DataFrame:
    """rows with their place from 0 along an order."""
    return ordering.placed(rows, order, out)


def expanding_by_row(rows: DataFrame, n: int, n_init: int, step: int, gap: int = 0, pos: str = "pos") -> DataFrame:
    """Walk forward over rows: test is rows [start, start + step), training rows [0, start - gap); fold is start."""
    if n_init < 1 or step < 1 or gap < 0 or n_init >= n:
        raise ValueError("n_init lies in [1, n), step is at least 1 and gap at least 0")
    return _walk(rows, pos, n, n_init, step, gap, step, n, pos)


def chronological(rows: DataFrame, n: int, fraction: float = 0.7, gap: int = 0, pos: str = "pos") -> DataFrame:
    """One fold: training the first part of the rows by place, test those after it and the gap."""
    split = int(fraction * n)
    if gap < 0:
        raise ValueError("gap is at least 0")
    if split + gap >= n:
        raise ValueError("the gap leaves no test rows")
    role = F.when(F.col(pos) < split, "train").when(F.col(pos) >= split + gap, "test")
    return rows.withColumn("fold", F.lit(0)).withColumn("role", role).where("role IS NOT NULL")


def draw(seed: int, *parts: Column) -> Column:
    """A portable 32-bit draw: the first 8 hex digits of the MD5 of seed and parts, as a number."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def stratified_kfold(rows: DataFrame, y: str, row_id: str, k: int, seed: int, within: list[str] | None = None) -> DataFrame:
    """rows with fold (0 to k - 1): classes are dealt out in a shuffled order, within the given groups if any.

    The row keeps its own fold; a fold's training rows are those of the others.
    """
    w = Window.partitionBy(*(within or []), y).orderBy(draw(seed, F.col(row_id)), row_id)
    return rows.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def roles_of(folded: DataFrame, k: int) -> DataFrame:
    """A split of k folds from rows with their own fold."""
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_f")
    out = folded.withColumnRenamed("fold", "_own").select("*", every)
    return out.withColumn("fold", F.col("_f")).withColumn("role", F.when(F.col("_f") == F.col("_own"), "test").otherwise("train")).drop("_own", "_f")


def group_kfold(rows: DataFrame, group: str, k: int) -> DataFrame:
    """group, fold: the largest group goes to the lightest fold, in turn; min(k, groups) folds.

    A running choice over a row a group: an aggregate over the sorted list of groups.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(group).alias("g")))).alias("gs"))
    folds = F.least(F.lit(k), F.size("gs"))
    start = F.struct(F.transform(F.sequence(F.lit(0), folds - 1), lambda i: F.lit(0).cast("long")).alias("w"), F.array().cast(f"array<struct<g:{dict(rows.dtypes)[group]},f:int>>").alias("out"))

    def place(acc: Column, x: Column) -> Column:
        light = (F.array_position(acc["w"], F.array_min(acc["w"])) - 1).cast("int")
        loads = F.transform(acc["w"], lambda v, i: F.when(i == light, v - x["m"]).otherwise(v))
        return F.struct(loads.alias("w"), F.concat(acc["out"], F.array(F.struct(x["g"].alias("g"), light.alias("f")))).alias("out"))

    done = listed.select(F.explode(F.aggregate("gs", start, place, lambda a: a["out"])).alias("r"))
    return done.select(F.col("r.g").alias(group), F.col("r.f").alias("fold"))


def index_hash(split: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """12 hex digits of the SHA-1 of a fold's row ids, sorted, by role."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(row_id)), lambda i: i.cast("string")), ",")
    return split.groupBy(*keys, "role").agg(F.substring(F.sha1(ids), 1, 12).alias("index_hash"), F.count("*").alias("n"))
