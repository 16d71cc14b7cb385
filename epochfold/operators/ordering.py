"""Places and neighbours along an order, over range partitions: no task holds more than one range.

Rows are sent to ranges of the order and ranked inside each; what crosses a border (counts, edge values) is one row a
range, so the only window over a whole table is over as many rows as there are partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochfold.session import stash

_PART, _IN = "_range", "_range_place"


def _ranged(rows: DataFrame, order: str) -> DataFrame:
    return rows.repartitionByRange(F.col(order)).withColumn(_PART, F.spark_partition_id())


def placed(rows: DataFrame, order: str, out: str = "pos", before: dict[str, str] | None = None, total: str | None = None) -> DataFrame:
    """rows with their place from 0 along an order.

    before maps a new column to the one whose value on the row before is wanted (null on the first row); total names a
    column for the number of rows. Nulls of the order come first; ties keep to one range, in no stated order among them.
    """
    before = before or {}
    w = Window.partitionBy(_PART).orderBy(order)
    local = _ranged(rows, order).withColumns({_IN: F.row_number().over(w) - 1, **{new: F.lag(old).over(w) for new, old in before.items()}})
    local = stash(local, "places")  # ranges are told apart by their number, so they are written once
    edges = {f"_range_last_{new}": F.max_by(old, _IN) for new, old in before.items()}
    per = local.groupBy(_PART).agg(F.count("*").alias("_range_n"), *[e.alias(c) for c, e in edges.items()])
    v = Window.orderBy(_PART)
    per = per.select(_PART, (F.sum("_range_n").over(v) - F.col("_range_n")).alias("_range_before"), F.sum("_range_n").over(Window.partitionBy()).alias("_range_all"), *[F.lag(c).over(v).alias(c) for c in edges])
    got = local.join(F.broadcast(per), _PART)  # a row a partition
    previous = [F.when(F.col(_IN) == 0, F.col(f"_range_last_{new}")).otherwise(F.col(new)).alias(new) for new in before]
    extra = [F.col("_range_all").alias(total)] if total else []
    return got.select(*rows.columns, (F.col(_IN) + F.col("_range_before")).cast("long").alias(out), *previous, *extra)


def steps(rows: DataFrame, at: str, expected: int) -> DataFrame:
    """One row: n_adjacent pairs of neighbours along `at`, and n_gapped, those that don't differ by what is expected.

    A null `at` has no place and is left out. Everything but a row a range is summed up in the tasks.
    """
    w = Window.partitionBy(_PART).orderBy(at)
    local = _ranged(rows.where(F.col(at).isNotNull()).select(at), at).withColumn("_d", F.col(at) - F.lag(at).over(w))
    per = local.groupBy(_PART).agg(F.count("_d").alias("_n"), F.count_if(F.col("_d") != expected).alias("_off"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    edge = F.col("_first") - F.lag("_last").over(Window.orderBy(_PART))
    joined = per.withColumn("_edge", edge)
    return joined.agg(F.coalesce(F.sum("_n") + F.count("_edge"), F.lit(0).cast("long")).alias("n_adjacent"), F.coalesce(F.sum("_off") + F.count_if(F.col("_edge") != expected), F.lit(0).cast("long")).alias("n_gapped"))
