"""A cache of prepared trials: Parquet with features, labels and groups, so that evaluations start from features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NEEDED = ("trial_id", "subject", "y", "features")


def write_features(features: DataFrame, path: str) -> None:
    """Writes trials; run is kept where there is one. Missing columns raise before anything is written."""
    missing = [c for c in NEEDED if c not in features.columns]
    if missing:
        raise ValueError(f"a feature cache needs the columns {', '.join(missing)}")
    features.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The trials, and whether their runs are known: a cache without runs allows no protocol by runs."""
    got = spark.read.parquet(path)
    missing = [c for c in NEEDED if c not in got.columns]
    if missing:
        raise ValueError(f"the feature cache lacks {', '.join(missing)}")
    return got, "run" in got.columns
