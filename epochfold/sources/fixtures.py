"""Driver tables seen as recordings, trials and scored rows; plain projections, so pruning and pushdown reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochfold.session import table

#: Fixed values of the trial view: samples a second, samples in a trial, channel names of its cut into four.
TRIAL_FS, TRIAL_SAMPLES = 64.0, 64
FOUR_CHANNELS = ("F3", "C3", "P3", "O1")
#: Window of the recording view, in samples.
WINDOW = 16


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch_id, subject (0-9), run (4, 8, 12), y, x: one channel of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("epoch_id"),
        (F.col("vec_id") % 10).cast("int").alias("subject"),
        (F.expr("vec_id div 10") % 3 * 4 + 4).cast("int").alias("run"),
        (F.col("label") >= 5).cast("int").alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, x, y (parity of the day): one long recording of one channel."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sample_idx"), F.col("value").cast("double").alias("x"), (F.dayofmonth("ts") % 2).cast("int").alias("y"))


def multichannel(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = FOUR_CHANNELS) -> DataFrame:
    """trials with channels: array<struct<name, x>>, the samples cut into one run a channel."""
    step = TRIAL_SAMPLES // len(names)
    parts = [F.struct(F.lit(n).alias("name"), F.slice("x", i * step + 1, step).alias("x")) for i, n in enumerate(names)]
    return trials(spark, sf_dir).select("epoch_id", "subject", "run", "y", F.array(*parts).alias("channels"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_key, subject, y, proba, pred: predictions ready for metrics."""
    e = table(spark, sf_dir, "lineitem")
    proba = F.col("l_quantity").cast("double") / F.lit(50.0).cast("double")
    return e.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        (F.col("l_suppkey") % 10).cast("int").alias("subject"),
        (F.col("l_linestatus") == "O").cast("int").alias("y"),
        proba.alias("proba"),
        (proba >= 0.5).cast("int").alias("pred"),
    )


#: The same views in DuckDB's SQL, for the oracles.
SQL = {
    "trials": """trials AS (SELECT vec_id AS epoch_id, (vec_id % 10)::INT AS subject, (4 + 4 * ((vec_id // 10) % 3))::INT AS run,
        (label >= 5)::INT AS y, embedding::DOUBLE[] AS x FROM embeddings)""",
    "recording": "recording AS (SELECT event_id AS sample_idx, value::DOUBLE AS x, (day(ts) % 2)::INT AS y FROM events)",
    "scored": """scored AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_key, (l_suppkey % 10)::INT AS subject,
        (l_linestatus = 'O')::INT AS y, l_quantity::DOUBLE / 50.0::DOUBLE AS proba, (l_quantity::DOUBLE / 50.0::DOUBLE >= 0.5)::INT AS pred FROM lineitem)""",
    "windows": f"""blocked AS (SELECT *, sum(chg) OVER (ORDER BY sample_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM
          (SELECT *, (y <> coalesce(lag(y) OVER (ORDER BY sample_idx), y))::INT AS chg FROM recording)),
        windows AS (SELECT sample_idx // {WINDOW} * {WINDOW} AS start, min(y)::INT AS label, min(block) AS block, list(x ORDER BY sample_idx) AS x
          FROM blocked GROUP BY 1 HAVING count(*) = {WINDOW} AND min(y) = max(y))""",
}


def views(*names: str) -> str:
    """A WITH clause of the named views, to be continued by a comma or a SELECT."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
