"""ARFF tables: header by pattern, rows by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, label: str = "eyeDetection") -> DataFrame:
    """sample_idx, a double column for each attribute but the label, and y, the label as an int.

    A file is a recording and is read whole, as rows have no number but their order in it; the names come from the
    header alone.
    """
    text = spark.read.text(path, wholetext=True)
    names = [r["n"] for r in text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?im)^\s*@attribute\s+'?([^'\s]+)'?"), F.lit(1))).alias("i", "n")).orderBy("i").collect()]
    if label not in names:
        raise ValueError(f"no attribute {label!r}")
    body = F.regexp_replace("value", r"(?is)^.*?@data[^\n]*\n", "")
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("%")))
    rows = text.select(F.posexplode(lines).alias("sample_idx", "line")).select(F.col("sample_idx").cast("long").alias("sample_idx"), F.split("line", ",").alias("v"))
    value = lambda i: F.trim(F.regexp_replace(F.get("v", F.lit(i)), "'", ""))
    return rows.select("sample_idx", *[value(i).cast("double").alias(n) for i, n in enumerate(names) if n != label], value(names.index(label)).cast("double").cast("int").alias("y"))
