"""Cutting recordings: tumbling and sliding windows, event-locked epochs, label blocks, super-blocks.

Windows are grouped by their number, so one shuffle makes them, whatever the recording's length. Label blocks are runs
over an order; they are numbered in two levels (inside chunks of samples, then over one row a chunk), so no task holds
a whole recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochfold.operators import ordering

#: Samples in a chunk of the two-level block numbering.
CHUNK = 1 << 16


def window_samples(win_sec: float, sfreq: float) -> int:
    n = round(win_sec * sfreq)
    if n < 1:
        raise ValueError(f"a window of {win_sec} s holds no sample at {sfreq} Hz")
    return n


def _ordered(value_cols: list[str], order: str) -> list[Column]:
    out = []
    for c in value_cols:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))
        out.append(F.transform(pairs, lambda s: s["v"]).alias(c))
    return out


def tumbling(samples: DataFrame, win: int, value_cols: list[str], label: str = "y", idx: str = "sample_idx", rec: list[str] | None = None, drop_mixed: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Windows of win samples from sample 0 on: start, label (the first sample's) and an ordered array for each value.

    A partial window is dropped, and with drop_mixed one whose labels differ. carry names columns of which the first
    sample's value is kept, such as block.
    """
    if win < 1:
        raise ValueError("a window holds at least one sample")
    keys = [*(rec or []), "start"]
    s = samples.withColumn("start", F.expr(f"{idx} div {win}") * win)
    out = s.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.min_by(label, idx).alias("label"), *[F.min_by(c, idx).alias(c) for c in carry], *_ordered(value_cols, idx))
    out = out.where(F.col("_n") == win)
    if drop_mixed:
        out = out.where(F.col("_lo").eqNullSafe(F.col("_hi")))
    return out.drop("_n", "_lo", "_hi")


def sliding(samples: DataFrame, win: int, overlap: float, value_cols: list[str], label: int, idx: str = "sample_idx", rec: list[str] | None = None) -> DataFrame:
    """Windows of win samples with a share of overlap: start, label (a constant) and an ordered array for each value."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap lies in [0, 1)")
    step = max(1, round(win * (1 - overlap)))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(idx) - (win - 1)) / step).cast("long"))
    s = samples.withColumn("_w", F.explode(F.sequence(first, F.expr(f"{idx} div {step}")))).withColumn("start", F.col("_w") * step)
    s = s.where(F.col(idx) < F.col("start") + win)
    out = s.groupBy(*(rec or []), "start").agg(F.count("*").alias("_n"), *_ordered(value_cols, idx))
    return out.where(F.col("_n") == win).select(*(rec or []), "start", F.lit(label).alias("label"), *value_cols)


def event_epochs(samples: DataFrame, events: DataFrame, first: int, last: int, value_cols: list[str], idx: str = "sample_idx", at: str = "at", rec: list[str] | None = None) -> DataFrame:
    """Samples from `first` to `last` after each event, both in: events' columns with an ordered array for each value.

    The range is spelled out as its sample numbers, so the join is by key; an event whose samples aren't all there is dropped.
    """
    if last < first:
        raise ValueError("an epoch ends after it begins")
    wanted = events.withColumn("_off", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(idx, F.col(at) + F.col("_off"))
    got = wanted.join(samples.select(*(rec or []), idx, *value_cols), [*(rec or []), idx])
    out = got.groupBy(*events.columns).agg(F.count("*").alias("_n"), *_ordered(value_cols, idx))
    return out.where(F.col("_n") == last - first + 1).drop("_n")


def run_of_event(events: DataFrame, runs: DataFrame, at: str = "at") -> DataFrame:
    """events with the run whose range [first, end) holds their sample; -1 for none.

    An interval join by buckets as wide as the mean run: a run stands in each bucket that it touches, about two on the
    whole, an event in one, so they meet by key however many they are. An event in several runs gets a row for each.
    """
    span = runs.where("end > first").agg(F.avg(F.col("end") - F.col("first"))).first()[0]
    width = max(1, int(span or 1))
    spread = runs.where("end > first").select("first", "end", "run", F.explode(F.expr(f"sequence(floor(first / {width}), floor((end - 1) / {width}))")).alias("_bucket"))
    hit = (F.col("_at") == F.col("_bucket")) & (F.col(at) >= F.col("first")) & (F.col(at) < F.col("end"))
    found = events.withColumn("_at", F.floor(F.col(at) / width)).join(spread, hit, "left")
    return found.select(*events.columns, F.coalesce("run", F.lit(-1)).alias("run"))


def label_blocks(samples: DataFrame, label: str = "y", idx: str = "sample_idx", rec: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """samples with block: the number, from 0, of the run of equal labels that a sample is in."""
    rec = rec or []
    s = samples.withColumn("_chunk", F.expr(f"{idx} div {chunk}"))
    w = Window.partitionBy(*rec, "_chunk").orderBy(idx)
    s = s.withColumn("_new", F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0)))
    s = s.withColumn("_in", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = s.groupBy(*rec, "_chunk").agg(F.max("_in").alias("_n"), F.min_by(label, idx).alias("_first"), F.max_by(label, idx).alias("_last"))
    v = Window.partitionBy(*rec).orderBy("_chunk")
    edge = F.coalesce((F.col("_first") != F.lag("_last").over(v)).cast("int"), F.lit(0))
    per = per.withColumn("_edge", edge)
    before = F.sum(F.col("_n") + F.col("_edge")).over(v.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    per = per.select(*rec, "_chunk", before.cast("long").alias("_before"))
    return s.join(per, [*rec, "_chunk"]).select(*samples.columns, (F.col("_in") + F.col("_before")).cast("long").alias("block"))


def super_blocks(windows: DataFrame, per_super: int, block: str = "block", order: str = "start") -> DataFrame:
    """block, super_block: blocks in first-seen order, per_super to each; a remainder joins the last complete one.

    A row a block is placed, by ranges of the order, not the windows.
    """
    if per_super < 1:
        raise ValueError("a super-block holds at least one block")
    b = ordering.placed(windows.groupBy(block).agg(F.min(order).alias("_seen")), "_seen", "_i", total="_n")
    whole, own = F.expr(f"_n div {per_super}"), F.expr(f"_i div {per_super}")
    return b.select(block, F.when((whole >= 1) & (own >= whole), whole - 1).otherwise(own).cast("long").alias("super_block"))


def class_summary(windows: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Windows of each class in each group."""
    out = windows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    return out.withColumn("both", (F.col("n0") > 0) & (F.col("n1") > 0))


def select_channels(epochs: DataFrame, names: list[str], channels: str = "channels") -> DataFrame:
    """Channels in the order asked for; an absent one raises."""
    wanted = F.array(*[F.lit(n) for n in names])
    pick = lambda n: F.coalesce(F.get(F.filter(channels, lambda c: c["name"] == n), F.lit(0)), F.raise_error(F.concat(F.lit("channel not in the montage: "), n)).cast(epochs.schema[channels].dataType.elementType))
    return epochs.withColumn(channels, F.transform(wanted, pick))


def flatten_channels(epochs: DataFrame, channels: str = "channels", out: str = "x") -> DataFrame:
    return epochs.withColumn(out, F.flatten(F.transform(channels, lambda c: c["x"])))


def unflatten(epochs: DataFrame, names: list[str], x: str = "x", out: str = "channels") -> DataFrame:
    step = F.expr(f"size({x}) div {len(names)}").cast("int")
    return epochs.withColumn(out, F.array(*[F.struct(F.lit(n).alias("name"), F.slice(x, step * i + 1, step).alias("x")) for i, n in enumerate(names)]))
