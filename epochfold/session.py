"""Session factory and table access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "epochfold", cores: int | str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead.

    ANSI mode stays on and the time zone is UTC, so results match other engines.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores).replace("*", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns are pruned by what the query selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where the session names none and is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="epochfold-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch space
        return


def stash(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back, for what is read more than once; it goes when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.parquet(path)
