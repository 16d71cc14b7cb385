"""What the corpus operators share: table access, text expressions and stored intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but a space and the ASCII control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of ASCII letters and digits (after lower-casing) and of any character beyond ASCII.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is.

    Text of ASCII alone takes the fast built-in; any other text is mapped letter by letter, as the built-in would
    also change letters beyond ASCII.
    """
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The words of a lower-cased text; an empty array for an empty or null one."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="epochfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch space
        return


def scratch(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder; what is there goes when this Python process ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stash(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Texts that go to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS: ten thousand texts at once would fill executor and worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Up to so many keys (8 or 16 bytes each), a list of rows to leave out is broadcast; a longer one is joined by shuffle.
FEW_KEYS = 1_000_000


def without_rows(df: DataFrame, gone: DataFrame, on) -> DataFrame:
    """df less the rows that gone lists; rows with their texts stay in place unless the list is too long to send."""
    return df.join(F.broadcast(gone) if gone.count() <= FEW_KEYS else gone, on, "left_anti")


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Are the ids whole numbers, without nulls or repeats?"""
    whole = dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    return whole and df.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty()
