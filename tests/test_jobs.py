import numpy as np
import pytest

from epochfold.functions import kernels
from epochfold.operators import metrics, models, spatial, spectral, splits
from epochfold.plans import jobs, run_spatial
from epochfold.sources import cache, edf, results

BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0)}


def test_recording(spark, tmp_path):
    rng = np.random.default_rng(0)
    fs, sec = 32, 48
    y = np.repeat(np.arange(12) % 2, fs * sec // 12)
    t = np.arange(fs * sec) / fs
    x = rng.normal(size=(2, len(t))) + np.where(y == 1, 3 * np.sin(2 * np.pi * 10 * t), 0)
    df = spark.createDataFrame([(i, int(y[i]), float(x[0, i]), float(x[1, i])) for i in range(len(t))], "sample_idx long, y int, O1 double, O2 double")
    got = jobs.recording_job(df, ["O1", "O2"], fs, BANDS, lags=(1, 2), n_boot=20, n_init=4, trees=5)
    assert len(got["merged_blocks"]["folds"]) == 3 and len(got["native_blocks"]["folds"]) == 12
    assert got["naive"][0]["balanced_accuracy"] > 0.9 and {m["metric"]: m["mean"] for m in got["merged_blocks"]["summary"]}["balanced_accuracy"] > 0.9
    assert sum(c["n"] for c in got["class_summary"]) == 48 and got["gap"]["gap"] is not None
    assert {m["metric"]: m["mean"] for m in got["secondary"]["random_forest"]["summary"]}["balanced_accuracy"] > 0.8
    assert len(got["secondary"]["svm_rbf"]["folds"]) == 3
    table = results.recording_table(results.jsonable(got)).splitlines()
    assert len(table) == 10 and table[2].startswith("| shuffled (leaks) | 0.9") or table[2].startswith("| shuffled (leaks) | 1.0")
    results.save_results("phase", got, str(tmp_path))
    assert results.load_results("phase", str(tmp_path))["gap"] == got["gap"]


def test_clipping_is_fitted_in_each_fold(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, i % 2, [("A", [float(v) for v in rng.normal(size=32)])]) for i in range(30)]
    kind = "row long, g int, y int, channels array<struct<name:string,x:array<double>>>"
    wild = [(r, g, y, [("A", [v * 1e6 for v in c[0][1]])]) if g == 2 else (r, g, y, c) for r, g, y, c in rows]
    out = []
    for data in (rows, wild):
        rows = spark.createDataFrame(data, kind)
        f = jobs.clipped_power(splits.leave_one_group_out(rows, "g"), ["fold"], "row", 32.0, BANDS, 32, rows, "g")
        out.append({r.row: r.features for r in f.where("fold = 2 AND role = 'train'").collect()})
        assert f.count() == 90
    assert out[0] == out[1]


def trials(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(96):
        s, run, y = i % 4, (4, 8)[i // 4 % 2], i // 8 % 2
        x = rng.normal(size=(3, 40))
        x[y] *= 3
        rows.append((i, s, run, y, [(n, [float(v) for v in c]) for n, c in zip("ABC", x, strict=True)], [float(np.log(c.var())) for c in x]))
    return spark.createDataFrame(rows, "epoch_id long, subject int, run int, y int, channels array<struct<name:string,x:array<double>>>, features array<double>")


def test_trials_and_patterns(spark):
    df = trials(spark)
    got = jobs.trials_job(df.drop("channels"), ["A", "B", "C"], n_boot=20, trees=5)
    assert len(got["leave_one_subject_out"]["folds"]) == 4 and len(got["leave_one_run_out"]["folds"]) == 8
    assert {c["name"] for c in got["coefficients"]} == {"A", "B", "C"} and got["naive"]["balanced_accuracy"] > 0.9
    csp = jobs.spatial_job(df.drop("features"), components=2, n_boot=20)
    assert all({m["metric"]: m["mean"] for m in csp[k]["summary"]}["balanced_accuracy"] > 0.85 for k in csp)
    table = results.trials_table(results.jsonable(got), results.jsonable(csp))
    assert len(table.splitlines()) == 2 + 5 + 3
    assert "4 of 4 above 0.5" in results.console("by subject", results.jsonable(got["leave_one_subject_out"]))
    curve = jobs.calibration_curve(df.drop("channels"), "subject", "epoch_id", models.ModelSpec(), (0, 2), 2).collect()
    assert len(curve) == 4 * 3 and {r.k for r in curve} == {0, 2}


def test_drift(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, i, [float(v) for v in rng.normal(size=3) + (i > 50)]) for i in range(100)], "start long, pos long, features array<double>")
    assert jobs.drift_control(df, 100, 20, models.ModelSpec()).first().balanced_accuracy > 0.6


def test_names():
    assert spectral.feature_names(["C3", "C4"], spectral.MOTOR_BANDS) == ["C3_mu", "C3_beta", "C4_mu", "C4_beta"]


def test_filtered_channels_match_single_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [(n, [float(v) for v in rng.normal(size=60 + i % 2)]) for n in "AB"]) for i in range(6)] + [(9, [])]
    df = spark.createDataFrame(rows, "epoch_id long, channels array<struct<name:string,x:array<double>>>")
    got = {r.epoch_id: r.channels for r in spatial.bandpass_channels(df, 8.0, 30.0, 160.0).collect()}
    b, a = kernels.butter_bandpass(8.0, 30.0, 160.0)
    assert got[9] == []
    for i, channels in rows[:-1]:
        assert [c.name for c in got[i]] == ["A", "B"]
        for c, (_, x) in zip(got[i], channels, strict=True):
            assert np.allclose(c.x, kernels.filtfilt(b, a, np.array(x)))


def test_filter_passes_the_band_alone(spark):
    t = np.arange(480) / 160
    rows = [(f, [("A", [float(v) for v in np.sin(2 * np.pi * f * t)])]) for f in (2, 15, 60)]
    df = spark.createDataFrame(rows, "f int, channels array<struct<name:string,x:array<double>>>")
    power = {r.f: np.square(r.channels[0].x[100:-100]).mean() for r in spatial.bandpass_channels(df, 8.0, 30.0, edf.SFREQ).collect()}
    assert abs(power[15] - 0.5) < 0.01 and power[2] < 1e-3 and power[60] < 1e-3


def test_cache_with_and_without_runs(spark, tmp_path):
    df = trials(spark).drop("channels").withColumnRenamed("epoch_id", "trial_id")
    for columns, known in ((df.columns, True), ([c for c in df.columns if c != "run"], False)):
        cache.write_features(df.select(*columns), str(tmp_path / "c"))
        got, runs = cache.read_features(spark, str(tmp_path / "c"))
        assert runs == known and got.count() == 96
    assert jobs.trials_job(got, ["A", "B", "C"], row_id="trial_id", n_boot=20, trees=2)["leave_one_run_out"] is None
    with pytest.raises(ValueError, match="features"):
        cache.write_features(df.drop("features"), str(tmp_path / "d"))


def test_spatial_run_without_recordings(tmp_path, capsys):
    assert run_spatial.main([str(tmp_path / "none"), str(tmp_path)]) == 0
    assert "skipped" in capsys.readouterr().out


def test_summary_named_by_unit(spark):
    df = spark.createDataFrame([("m", 0.25), ("m", 0.75), ("m", None)], "metric string, value double")
    r = metrics.summary_by_unit(df, ["metric"], "subject").first()
    assert (r.mean, r.n_subjects, r.n_above_half_descriptive_count) == (0.5, 2, 1) and abs(r.std_across_subjects - 0.125**0.5) < 1e-12


def test_console_of_baselines():
    text = results.console_baselines("chronological", {"uniform": {"balanced_accuracy": 0.5, "macro_f1": 0.48, "roc_auc": None}})
    assert "roc_auc n/a" in text and "balanced_accuracy 0.500" in text
