"""Windows of an event stream: the batch windows' counterpart on event time, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, step: str | None = None, late: str = "10 minutes", ts: str = "ts", keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """start, end, keys, n and sum by tumbling (or, with step, sliding) windows; rows later than `late` are dropped.

    Works on a stream and on a batch alike; on a stream a window is final once the watermark has passed it.
    """
    w = F.window(ts, length, step) if step else F.window(ts, length)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), *(keys or [])).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), "n", "total")


def label_changes(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", label: str = "y") -> DataFrame:
    """Sessions of each label: runs of its events with no pause longer than gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), label).agg(F.count("*").alias("n"))
    return out.select(label, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
