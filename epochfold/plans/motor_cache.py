"""From EDF recordings to a cache of motor features with its manifest, as one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochfold.operators import spectral
from epochfold.sources import cache, edf

KEYS = ["trial_id", "subject", "run", "y"]


def build(spark: SparkSession, root: str, cache_path: str, subjects=edf.SUBJECTS, runs=edf.RUNS, channels=edf.MOTOR, bands: dict | None = None) -> tuple[DataFrame, dict]:
    """The cached trials and the manifest, once every expected file is whole and every subject has both classes.

    The cache is written once and all counts are taken from what was written.
    """
    bands = bands or spectral.MOTOR_BANDS
    found = edf.files(spark, root)
    edf.validate_layout(found, subjects, runs)
    epochs = edf.load_all(found, subjects, runs, channels=channels)
    n_times = round(edf.TMAX * edf.SFREQ) - round(edf.TMIN * edf.SFREQ) + 1
    cache.write_features(spectral.channel_features(epochs, KEYS, edf.SFREQ, bands, n_times), cache_path)
    rows, _ = cache.read_features(spark, cache_path)
    return rows, manifest(rows, edf.subject_metadata(rows, found, runs), cache_path, subjects, runs, channels, bands)


def manifest(rows: DataFrame, per_subject: DataFrame, cache_path: str, subjects, runs, channels, bands: dict) -> dict:
    """What a JSON file says of a cache. The same cache gives the same manifest; a row a subject comes to the driver."""
    names = spectral.feature_names(list(channels), bands)
    place = {s: i for i, s in enumerate(subjects)}
    told = [r.asDict(recursive=True) for r in per_subject.orderBy("subject").collect()]
    # The keys are those that readers of such manifests look for.
    return {
        "cache_path": cache_path,
        "n_trials": sum(t["n_trials"] for t in told),
        "n_features": len(names),
        "n_subjects": len(told),
        "sampling_rate_hz": edf.SFREQ,
        "epoch_window_seconds": {"tmin": edf.TMIN, "tmax": edf.TMAX},
        "bands_hz": {b: list(edges) for b, edges in bands.items()},
        "channel_order": list(channels),
        "feature_names": names,
        "imagery_runs": list(runs),
        "preprocessing": {
            "welch_fs": edf.SFREQ,
            "welch_nperseg": round(edf.SFREQ),
            "integration_rule": "trapezoids over the density",
            "channel_reference": "as recorded",
            "boundary_handling": "runs are recordings of their own",
        },
        "per_subject": [{"subject_id": t.pop("subject"), **t} | {"subject_index": place[s]} for t in told for s in [t["subject"]]],
        "npz_keys": rows.columns,
    }
