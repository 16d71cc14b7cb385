"""Queries over recordings and trials: windows, clipping, spectra, covariances; each with its DuckDB twin."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from epochfold.operators import clip as K
from epochfold.operators import spatial, spectral
from epochfold.operators import windows as W
from epochfold.sources import fixtures as X
from epochfold.sources.fixtures import TRIAL_FS, TRIAL_SAMPLES, WINDOW, views

BANDS = spectral.STANDARD_BANDS
LOW_BANDS = {k: BANDS[k] for k in ("delta", "theta")}
EIGHT = tuple(f"CH{i}" for i in range(8))


def r8(c) -> object:
    return F.round(c, 8)


def blocked(s, d):
    return W.label_blocks(X.recording(s, d))


def windows(s, d):
    """Pure windows of the recording with their block."""
    b = blocked(s, d)
    return W.tumbling(b, WINDOW, ["x"], carry=("block",))


def power(s, d, nperseg_sec: float = 1.0, relative: bool = False):
    return spectral.band_power(X.trials(s, d), TRIAL_FS, BANDS, TRIAL_SAMPLES, nperseg_sec, relative)


def power_long(s, d, **kw):
    return spectral.long_features(power(s, d, **kw), ["epoch_id", "subject", "run", "y"], list(BANDS))


def label_blocks(s, d):
    return blocked(s, d).select("sample_idx", "y", "block")


def tumbling_windows(s, d):
    w = windows(s, d)
    return w.select("start", "label", "block", r8(F.aggregate("x", F.lit(0.0).cast("double"), lambda a, v: a + v)).alias("sum_x"), r8(F.get("x", F.lit(0))).alias("first_x"))


def sliding_windows(s, d):
    w = W.sliding(X.recording(s, d), WINDOW, 0.5, ["x"], label=1)
    return w.select("start", "label", r8(F.aggregate("x", F.lit(0.0).cast("double"), lambda a, v: a + v)).alias("sum_x"), r8(F.get("x", F.lit(WINDOW - 1))).alias("last_x"))


def event_epochs_range_join(s, d):
    events = s.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'").select(F.col("event_id").alias("at"))
    rec = X.recording(s, d)
    n = 1000
    runs = rec.groupBy(F.expr(f"cast(sample_idx div {n} as int)").alias("run")).agg(F.min("sample_idx").alias("first"), (F.max("sample_idx") + 1).alias("end"))
    e = W.event_epochs(rec, W.run_of_event(events, runs), 2, 9, ["x"])
    return e.select("at", "run", r8(F.aggregate("x", F.lit(0.0).cast("double"), lambda a, v: a + v)).alias("sum_x"))


def super_blocks(s, d):
    return W.super_blocks(windows(s, d), 4)


def super_block_class_summary(s, d):
    w = windows(s, d)
    return W.class_summary(w.join(W.super_blocks(w, 4), "block"), "super_block")


def _subject_limits(s, d):
    """Limits of the training samples of each fold that leaves a subject out."""
    t = X.trials(s, d)
    held = t.select("subject", F.col("subject").alias("fold")).distinct()
    return K.fold_limits(t.select("subject", F.explode("x").alias("v")), held, ["fold"], "subject", held_out=True)


def clip_thresholds_by_fold(s, d):
    return _subject_limits(s, d).select("fold", r8("lo").alias("lo"), r8("hi").alias("hi"))


def clipped_samples(s, d):
    """Each trial clipped in the one fold that tests it."""
    own = X.trials(s, d).withColumn("fold", F.col("subject")).withColumn("raw", F.col("x"))
    c = K.clip_arrays(own, _subject_limits(s, d), ["fold"])
    changed = F.size(F.filter(F.zip_with("x", "raw", lambda a, b: a != b), lambda t: t)).cast("long")
    return c.select("fold", "epoch_id", changed.alias("n_clipped"), r8(F.aggregate("x", F.lit(0.0).cast("double"), lambda a, v: a + v)).alias("sum_x"))


def band_power(s, d):
    return power_long(s, d).select("epoch_id", "band", r8("power").alias("power"))


def band_power_relative(s, d):
    return power_long(s, d, relative=True).select("epoch_id", "band", r8("power").alias("power"))


def band_power_welch_multi_segment(s, d):
    return power_long(s, d, nperseg_sec=0.5).select("epoch_id", "band", r8("power").alias("power"))


def _channel_power(s, d, names=None):
    e = X.multichannel(s, d)
    if names:
        e = W.select_channels(e, names)
    return spectral.channel_band_power(e, ["epoch_id"], 16.0, LOW_BANDS, 16)


def band_power_selected_channels(s, d):
    return _channel_power(s, d, ["O1", "F3"]).select("epoch_id", "channel_ord", "channel", "band", r8("power").alias("power"))


def regional_summary(s, d):
    r = spectral.regional_summary(_channel_power(s, d), ["epoch_id"], LOW_BANDS)
    return r.select("epoch_id", "region", "band", r8("mean_power").alias("mean_power"), "coverage")


def feature_ablation_minus_delta(s, d):
    return spectral.without(power_long(s, d), "delta").select("epoch_id", "band", r8("power").alias("power"))


def subject_centred_features(s, d):
    return spectral.centred(power_long(s, d), "subject").select("epoch_id", "band", r8("power").alias("power"))


def class_covariance(s, d):
    c = spatial.class_covariance(X.multichannel(s, d, EIGHT), ["y"])
    return c.select("y", "ch_i", "ch_j", "n", F.round("sum_xy", 6).alias("sum_xy"))


def lda_moments(s, d):
    m = spatial.lda_moments(power(s, d))
    return m.select("y", "i", "j", "n", r8("mean_i").alias("mean_i"), r8("mean_j").alias("mean_j"), F.round("within", 6).alias("within"))


def _welch_sql(source: str, keys: str, n_times: int, fs: float, nperseg: int, bands: dict) -> str:
    """power_rows(keys, band, power): the DFT by its sums. source has keys and x."""
    step = nperseg - nperseg // 2
    starts = list(range(0, n_times - nperseg + 1, step))
    scale = fs * sum((0.5 - 0.5 * math.cos(2 * math.pi * i / nperseg)) ** 2 for i in range(nperseg))
    rows = ", ".join(f"('{b}', {lo}::DOUBLE, {hi}::DOUBLE)" for b, (lo, hi) in bands.items())
    return f"""
seg AS (SELECT {keys}, s, x[s + 1 : s + {nperseg}] AS g FROM {source}, unnest({starts}) AS u(s)),
win AS (SELECT {keys}, s, i, (g[i + 1] - list_avg(g)) * (0.5 - 0.5 * cos(2 * pi() * i / {nperseg})) AS v FROM seg, unnest(range({nperseg})) AS u(i)),
dft AS (SELECT {keys}, s, k, power(sum(v * cos(2 * pi() * ((k * i) % {nperseg}) / {nperseg})), 2) + power(sum(v * sin(2 * pi() * ((k * i) % {nperseg}) / {nperseg})), 2) AS p
        FROM win, unnest(range({nperseg // 2 + 1})) AS u(k) GROUP BY {keys}, s, k),
psd AS (SELECT {keys}, k, k * {fs}::DOUBLE / {nperseg} AS f, avg(p) / {scale!r} * (CASE WHEN k = 0 OR k = {nperseg // 2} THEN 1 ELSE 2 END) AS p FROM dft GROUP BY {keys}, k),
bands(band, lo, hi) AS (VALUES {rows}),
binned AS (SELECT {keys}, band, f, p, lag(p) OVER w AS before, lag(f) OVER w AS fb FROM psd JOIN bands ON f >= lo AND f < hi WINDOW w AS (PARTITION BY {keys}, band ORDER BY k)),
power_rows AS (SELECT {keys}, band, coalesce(sum((p + before) / 2 * (f - fb)), 0) AS power FROM binned GROUP BY {keys}, band)"""


def power_sql(nperseg: int = 64, keys: str = "epoch_id, subject, run, y") -> str:
    return views("trials") + "," + _welch_sql("trials", keys, TRIAL_SAMPLES, TRIAL_FS, nperseg, BANDS)


_CHANNELS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(X.FOUR_CHANNELS))
_FOUR = f"""four AS (SELECT epoch_id, name AS channel, x[o * 16 + 1 : o * 16 + 16] AS x FROM trials, (VALUES {_CHANNELS}) AS c(o, name))"""
_CHANNEL_POWER = views("trials") + f", {_FOUR}," + _welch_sql("four", "epoch_id, channel", 16, 16.0, 16, LOW_BANDS)
_REGION_ROWS = ", ".join(f"('{r}', '{e}')" for r, own in spectral.REGIONS.items() for e in own)
_FOLD = "fold_rows AS (SELECT f.fold, t.*, CASE WHEN t.subject = f.fold THEN 'test' ELSE 'train' END AS role FROM trials t, (SELECT DISTINCT subject AS fold FROM trials) f)"

QUERIES = {f.__name__: f for f in (
    label_blocks, tumbling_windows, sliding_windows, event_epochs_range_join, super_blocks, super_block_class_summary, clip_thresholds_by_fold, clipped_samples,
    band_power, band_power_relative, band_power_welch_multi_segment, band_power_selected_channels, regional_summary, feature_ablation_minus_delta, subject_centred_features, class_covariance, lda_moments,
)}

_SUPER = """ordered AS (SELECT block, row_number() OVER (ORDER BY min(start)) - 1 AS i, count(*) OVER () AS n FROM windows GROUP BY block),
supers AS (SELECT block, (CASE WHEN n // 4 >= 1 AND i // 4 >= n // 4 THEN n // 4 - 1 ELSE i // 4 END)::BIGINT AS super_block FROM ordered)"""

ORACLE = {
    "label_blocks": views("recording", "windows") + " SELECT sample_idx, y, block FROM blocked",
    "tumbling_windows": views("recording", "windows") + " SELECT start, label, block, round(list_sum(x), 8) AS sum_x, round(x[1], 8) AS first_x FROM windows",
    "sliding_windows": views("recording") + f""" SELECT start, 1::INT AS label, round(sum(x), 8) AS sum_x, round(max_by(x, sample_idx), 8) AS last_x
        FROM recording JOIN (SELECT unnest(range(0, (SELECT max(sample_idx) FROM recording) + 1, {WINDOW // 2})) AS start) ON sample_idx >= start AND sample_idx < start + {WINDOW}
        GROUP BY start HAVING count(*) = {WINDOW}""",
    "event_epochs_range_join": views("recording") + """, runs AS (SELECT (sample_idx // 1000)::INT AS run, min(sample_idx) AS a, max(sample_idx) + 1 AS b FROM recording GROUP BY 1)
        SELECT e.event_id AS at, coalesce(any_value(r.run), -1) AS run, round(sum(x), 8) AS sum_x FROM events e JOIN recording s ON s.sample_idx BETWEEN e.event_id + 2 AND e.event_id + 9
        LEFT JOIN runs r ON e.event_id >= r.a AND e.event_id < r.b WHERE event_type = 'purchase' GROUP BY e.event_id HAVING count(*) = 8""",
    "super_blocks": views("recording", "windows") + f", {_SUPER} SELECT block, super_block FROM supers",
    "super_block_class_summary": views("recording", "windows") + f""", {_SUPER} SELECT super_block, count(*) AS n, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1,
        min(label) = 0 AND max(label) = 1 AS both FROM windows JOIN supers USING (block) GROUP BY super_block""",
    "clip_thresholds_by_fold": views("trials") + f""", {_FOLD}, v AS (SELECT fold, unnest(x) AS v FROM fold_rows WHERE role = 'train')
        SELECT fold, round(quantile_cont(v, 0.001), 8) AS lo, round(quantile_cont(v, 0.999), 8) AS hi FROM v GROUP BY fold""",
    "clipped_samples": views("trials") + f""", {_FOLD}, v AS (SELECT fold, unnest(x) AS v FROM fold_rows WHERE role = 'train'),
        lim AS (SELECT fold, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM v GROUP BY fold),
        t AS (SELECT fold, epoch_id, unnest(x) AS v FROM fold_rows WHERE role = 'test')
        SELECT fold, epoch_id, count(*) FILTER (WHERE v < lo OR v > hi) AS n_clipped, round(sum(greatest(lo, least(hi, v))), 8) AS sum_x FROM t JOIN lim USING (fold) GROUP BY fold, epoch_id""",
    "band_power": power_sql() + " SELECT epoch_id, band, round(power, 8) AS power FROM power_rows",
    "band_power_relative": power_sql() + " SELECT epoch_id, band, round(power / sum(power) OVER (PARTITION BY epoch_id), 8) AS power FROM power_rows",
    "band_power_welch_multi_segment": power_sql(32) + " SELECT epoch_id, band, round(power, 8) AS power FROM power_rows",
    "band_power_selected_channels": _CHANNEL_POWER + " SELECT epoch_id, (channel = 'F3')::INT AS channel_ord, channel, band, round(power, 8) AS power FROM power_rows WHERE channel IN ('O1', 'F3')",
    "regional_summary": _CHANNEL_POWER + f""", region(region, channel) AS (VALUES {_REGION_ROWS}),
        frame AS (SELECT epoch_id, region, band FROM (SELECT DISTINCT epoch_id FROM trials), (SELECT DISTINCT region FROM region), (SELECT band FROM bands))
        SELECT epoch_id, region, band, round(avg(power), 8) AS mean_power, count(power) AS coverage FROM frame JOIN region USING (region) LEFT JOIN power_rows USING (epoch_id, band, channel) GROUP BY ALL""",
    "feature_ablation_minus_delta": power_sql() + " SELECT epoch_id, band, round(power, 8) AS power FROM power_rows WHERE band <> 'delta'",
    "subject_centred_features": power_sql() + " SELECT epoch_id, band, round(power - avg(power) OVER (PARTITION BY subject, band), 8) AS power FROM power_rows",
    "class_covariance": views("trials") + """ SELECT y, i::INT AS ch_i, j::INT AS ch_j, count(*) AS n, round(sum(x[i * 8 + t + 1] * x[j * 8 + t + 1]), 6) AS sum_xy
        FROM trials, unnest(range(8)) AS a(i), unnest(range(8)) AS b(j), unnest(range(8)) AS c(t) WHERE i <= j GROUP BY ALL""",
    "lda_moments": power_sql() + f""", f AS (SELECT epoch_id, y, list_position({list(BANDS)!r}, band) - 1 AS i, power AS v FROM power_rows),
        m AS (SELECT y, i, avg(v) AS m FROM f GROUP BY y, i), c AS (SELECT epoch_id, y, i, m, v - m AS d FROM f JOIN m USING (y, i))
        SELECT a.y, a.i::INT AS i, b.i::INT AS j, count(*) AS n, round(any_value(a.m), 8) AS mean_i, round(any_value(b.m), 8) AS mean_j, round(sum(a.d * b.d), 6) AS within
        FROM c a JOIN c b ON a.epoch_id = b.epoch_id AND a.i <= b.i GROUP BY a.y, a.i, b.i""",
}
