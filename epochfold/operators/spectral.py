"""Band power by Welch's method, relative power, feature names, regional means, ablation and centring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochfold.functions import kernels

# Band edges in Hz, and the electrodes of each scalp region.
STANDARD_BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}
MOTOR_BANDS = {"mu": (8.0, 13.0), "beta": (13.0, 30.0)}
REGIONS = {
    "frontal": ["FP1", "FP2", "AF3", "AF4", "F3", "F4", "F7", "F8", "FZ"],
    "central": ["C3", "C4", "CZ", "FC5", "FC6"],
    "temporal": ["T7", "T8", "T9", "T10", "FT7", "FT8", "TP7", "TP8"],
    "parietal": ["P3", "P4", "PZ", "P7", "P8", "CP3", "CP4"],
    "occipital": ["O1", "O2", "OZ"],
}


def check_bands(bands: dict, sfreq: float, nperseg: int) -> None:
    freqs = np.fft.rfftfreq(nperseg, 1 / sfreq)
    for name, (lo, hi) in bands.items():
        if hi > sfreq / 2:
            raise ValueError(f"band {name} reaches beyond half the sampling rate {sfreq}")
        if not ((freqs >= lo) & (freqs < hi)).any():
            raise ValueError(f"band {name} holds no frequency bin at {sfreq} Hz and {nperseg} samples")


def band_power(epochs: DataFrame, sfreq: float, bands: dict, n_times: int, nperseg_sec: float = 1.0, relative: bool = False, x: str = "x", out: str = "features") -> DataFrame:
    """epochs with an array of band powers in the bands' order; x: array<double> of n_times samples.

    The kernel takes whole Arrow batches; with relative, powers are shares of their sum, and null where that isn't above 0.
    """
    nperseg = min(n_times, round(nperseg_sec * sfreq))
    check_bands(bands, sfreq, nperseg)
    edges = list(bands.values())

    @F.pandas_udf("array<double>")
    def power(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        freqs, psd = kernels.welch(np.stack(column.to_numpy()).astype(float), sfreq, nperseg)
        return pd.Series(list(np.stack([kernels.band_integral(freqs, psd, lo, hi) for lo, hi in edges], axis=-1)))

    res = epochs.withColumn(out, power(F.col(x)))
    if relative:
        total = F.aggregate(out, F.lit(0.0).cast("double"), lambda a, v: a + v)
        res = res.withColumn(out, F.transform(out, lambda v: F.when(total > 0, v / total)))
    return res


def long_features(features: DataFrame, keys: list[str], names: list[str], column: str = "features", value: str = "power", name: str = "band") -> DataFrame:
    """A row for each feature of each row, named by position."""
    labels = F.array(*[F.lit(n) for n in names])
    # the outer form: from an inner one the optimiser infers filters on the features, which makes a UDF run twice
    rows = features.select(*keys, F.posexplode_outer(column).alias("_i", value)).where("_i IS NOT NULL")
    return rows.select(*keys, F.element_at(labels, F.col("_i") + 1).alias(name), value)


def channel_band_power(epochs: DataFrame, keys: list[str], sfreq: float, bands: dict, n_times: int, channels: str = "channels", **kw) -> DataFrame:
    """Long band power of each channel: keys, channel, band, power; a channel's column name is channel_band."""
    one = epochs.select(*keys, F.posexplode(channels).alias("channel_ord", "_c")).select(*keys, "channel_ord", F.col("_c.name").alias("channel"), F.col("_c.x").alias("x"))
    power = band_power(one, sfreq, bands, n_times, **kw)
    return long_features(power, [*keys, "channel_ord", "channel"], list(bands))


def channel_features(epochs: DataFrame, keys: list[str], sfreq: float, bands: dict, n_times: int, channels: str = "channels", out: str = "features") -> DataFrame:
    """keys with one array of band powers an epoch, channel by channel and band by band, as feature_names tells them."""
    one = epochs.select(*keys, F.posexplode(channels).alias("_ord", "_c")).select(*keys, "_ord", F.col("_c.x").alias("_x"))
    power = band_power(one, sfreq, bands, n_times, x="_x", out="_f")
    listed = F.array_sort(F.collect_list(F.struct("_ord", "_f")))
    return power.groupBy(*keys).agg(F.flatten(F.transform(listed, lambda c: c["_f"])).alias(out))


def feature_names(channels: list[str], bands: dict) -> list[str]:
    return [f"{c}_{b}" for c in channels for b in bands]


def regional_summary(power: DataFrame, keys: list[str], bands: dict, regions: dict = REGIONS) -> DataFrame:
    """Mean power over the electrodes of each region that are present, with their number; null and 0 where none is."""
    cells = []
    for region, own in regions.items():
        for band in bands:
            here = F.col("channel").isin(own) & (F.col("band") == band)
            mean, n = F.avg(F.when(here, F.col("power"))), F.count_if(here)
            cells.append(F.struct(F.lit(region).alias("region"), F.lit(band).alias("band"), mean.alias("mean_power"), n.alias("coverage")))
    # regions x bands aggregates a row, from one pass over the features
    return power.groupBy(*keys).agg(F.array(*cells).alias("_cells")).select(*keys, F.explode("_cells").alias("_c")).select(*keys, "_c.*")


def without(features: DataFrame, *dropped: str, name: str = "band") -> DataFrame:
    """Ablation: long features without those named."""
    return features.where(~F.col(name).isin(list(dropped)))


def centred(features: DataFrame, group: str, name: str = "band", value: str = "power") -> DataFrame:
    """Long features less their group's mean; no label is read."""
    return features.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(group, name)))
