import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochfold.plans import motor_cache
from epochfold.sources import arff, edf, results


def minimal(n=1, records=1, per=1, extra=0, version=b"0"):
    f = lambda v, w: str(v).encode().ljust(w)
    head = version.ljust(8) + b" " * 176 + f(256 * (1 + n), 8) + b" " * 44 + f(records, 8) + f(1, 8) + f(n, 4)
    signal = b"X" * (216 * n) + f(per, 8) * n + b" " * (32 * n)
    data = head + signal + b"\0\0" * (records * per * n)
    return data + b"\0" * extra if extra >= 0 else data[:extra]


def recording(channels, per, records, notes, rate_s=1):
    """An EDF+ file of channels (name -> ints, per a record) with annotations in records of 64 samples."""
    names = [*channels, "EDF Annotations"]
    pers = [per] * len(channels) + [64]
    f = lambda v, w: str(v).encode().ljust(w)
    n = len(names)
    head = f(0, 8) + b" " * 176 + f(256 * (1 + n), 8) + b" " * 44 + f(records, 8) + f(rate_s, 8) + f(n, 4)
    cols = [[f(x, 16) for x in names], [b" " * 80] * n, [f("uV", 8)] * n, [f(-3276.8, 8)] * n, [f(3276.7, 8)] * n, [f(-32768, 8)] * n, [f(32767, 8)] * n, [b" " * 80] * n, [f(p, 8) for p in pers], [b" " * 32] * n]
    body = b""
    for r in range(records):
        for x in channels.values():
            body += np.asarray(x[r * per : (r + 1) * per], "<i2").tobytes()
        tal = f"+{r}\x14\x14\x00" + "".join(f"+{o}\x151\x14{t}\x14\x00" for o, t in notes if r <= o < r + 1)
        body += tal.encode().ljust(128, b"\0")
    return head + b"".join(b"".join(c) for c in cols) + body


def put(root, name, data):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)


def test_headers(spark, tmp_path):
    cases = {"ok": minimal(), "short": minimal(extra=-1), "long": minimal(extra=500_000), "tiny": b"0", "version": minimal(version=b"1"), "zero": minimal(records=0), "text": minimal()[:184] + b"abcdefgh" + minimal()[192:]}
    for k, v in cases.items():
        put(tmp_path, f"{k}.edf", v)
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in edf.headers(edf.files(spark, str(tmp_path))).collect()}
    assert got["ok"].error is None and got["ok"].nbytes == got["ok"].declared_nbytes == 514
    for k, part in (("short", "truncated to 513"), ("long", "longer than"), ("tiny", "too few"), ("version", "version"), ("zero", "0 records"), ("text", "whole number")):
        assert part in got[k].error, k


def test_layout_lists_all_that_is_wrong(spark, tmp_path):
    put(tmp_path, "S001/S001R04.edf", minimal())
    put(tmp_path, "S001/S001R08.edf", minimal(extra=-1))
    with pytest.raises(RuntimeError) as e:
        edf.validate_layout(edf.files(spark, str(tmp_path)))
    assert "29 files" in str(e.value) and str(e.value).count("missing\n") + str(e.value).endswith("missing") == 28 and "truncated" in str(e.value)


def test_names(spark):
    df = spark.createDataFrame([("Fc3.", "x/S001R04.edf"), ("Cz..", "S010R12.edf")], "c string, p string")
    got = df.select(edf.clean_name(F.col("c")).alias("c"), edf.run_of_path(F.col("p")).alias("r")).collect()
    assert [(r.c, r.r) for r in got] == [("FC3", 4), ("CZ", 12)]
    assert df.select(edf.expected_path(F.lit("S001"), F.lit(4)).alias("p")).first().p == "S001/S001R04.edf"


def test_trials(spark, tmp_path):
    fs, sec = 160, 12
    a, b = np.arange(fs * sec) % 1000, -np.arange(fs * sec) % 500
    for run in (4, 8):
        put(tmp_path, f"S001R{run:02d}.edf", recording({"C3..": a, "Cz..": b, "Other": a}, fs, sec, [(1.0, "T1"), (5.0, "T2"), (10.0, "T1"), (3.0, "T0")]))
    put(tmp_path, "S001R03.edf", recording({"C3..": a}, fs, sec, [(1.0, "T1")]))
    t = edf.trials(edf.files(spark, str(tmp_path)), channels=("CZ", "C3")).orderBy("trial_id").collect()
    assert [(r.subject, r.run, r.trial_id, r.y) for r in t] == [("S001", run, f"S001_R{run:02d}_T{k:03d}", k) for run in (4, 8) for k in (0, 1)]
    first = t[0].channels
    assert [c.name for c in first] == ["CZ", "C3"] and len(first[0].x) == 481
    assert np.allclose(first[1].x, a[fs + 80 : fs + 80 + 481] * 0.1, atol=1e-6)
    m = edf.manifest(edf.trials(edf.files(spark, str(tmp_path)), channels=("CZ", "C3")), edf.files(spark, str(tmp_path)), {"sfreq": 160.0})
    assert m["n_trials"] == 4 and len(m["sources"]) == 3 and len(m["sources"][0]["sha256"]) == 64
    with pytest.raises(Exception, match="sampled at 100"):
        edf.trials(edf.files(spark, str(tmp_path)), sfreq=100.0, channels=("C3",)).collect()


def test_subjects_that_cannot_be_loaded_are_named(spark, tmp_path):
    x = np.arange(160 * 6)
    put(tmp_path, "S001/S001R04.edf", recording({"C3": x}, 160, 6, [(1.0, "T1")]))
    put(tmp_path, "S002/S002R03.edf", recording({"C3": x}, 160, 6, [(1.0, "T1"), (2.0, "T2")]))
    put(tmp_path, "S003/S003R04.edf", recording({"C3": x}, 160, 6, [(1.0, "T1"), (2.0, "T2")]))
    found = edf.files(spark, str(tmp_path))
    with pytest.raises(RuntimeError) as e:
        edf.load_all(found, ("S001", "S002", "S003", "S004"), channels=("C3",))
    assert str(e.value).splitlines() == ["3 subjects can't be loaded:", "S001: fewer than two classes are marked", "S002: no recording of the wanted runs", "S004: no recording of the wanted runs"]
    assert edf.load_all(found, ("S003",), channels=("C3",)).count() == 2


def test_motor_cache(spark, tmp_path):
    fs, sec = 160, 12
    wave = np.round(1000 * np.sin(2 * np.pi * 10 * np.arange(fs * sec) / fs)).astype(int)
    for subject in ("S001", "S002"):
        for run in (4, 8):
            put(tmp_path, f"in/{subject}/{subject}R{run:02d}.edf", recording({"C3..": wave, "Cz..": wave // 2}, fs, sec, [(1.0, "T1"), (5.0, "T2")]))
    ask = lambda at: motor_cache.build(spark, str(tmp_path / "in"), str(tmp_path / at), ("S001", "S002"), (4, 8), ("CZ", "C3"))
    rows, told = ask("cache")
    got = rows.orderBy("trial_id").collect()
    assert [r.trial_id for r in got] == [f"S00{s}_R{run:02d}_T00{k}" for s in (1, 2) for run in (4, 8) for k in (0, 1)]
    assert told["feature_names"] == ["CZ_mu", "CZ_beta", "C3_mu", "C3_beta"] and (told["n_trials"], told["n_features"], told["n_subjects"]) == (8, 4, 2)
    mu, c3 = got[0].features[0], got[0].features[2]
    assert mu > 100 * got[0].features[1] and c3 / mu == pytest.approx(4, rel=0.01)
    one = told["per_subject"][1]
    assert (one["subject_id"], one["subject_index"], one["n_trials"], one["n_left"], one["n_right"], one["run_trial_counts"]) == ("S002", 1, 4, 2, 2, {4: 2, 8: 2})
    assert [f["path"].rsplit("/", 1)[1] for f in one["source_files"]] == ["S002R04.edf", "S002R08.edf"] and len(one["source_files"][0]["sha256"]) == 64
    assert {**ask("cache")[1]} == told and json.loads(json.dumps(told))["imagery_runs"] == [4, 8]


def test_arff(spark, tmp_path):
    (tmp_path / "x.arff").write_text("@RELATION eeg\n\n@ATTRIBUTE AF3 NUMERIC\n@attribute 'F7' NUMERIC\n@ATTRIBUTE eyeDetection {0,1}\n@DATA\n1.5,2,0\n% note\n3,4.25,1\n\n")
    got = arff.read(spark, str(tmp_path / "x.arff")).orderBy("sample_idx").collect()
    assert [(r.sample_idx, r.AF3, r.F7, r.y) for r in got] == [(0, 1.5, 2.0, 0), (1, 3.0, 4.25, 1)]
    with pytest.raises(ValueError):
        arff.read(spark, str(tmp_path / "x.arff"), label="none")


def test_results(spark, tmp_path):
    payload = {"b": np.float64("nan"), "a": [np.int64(3), {"x": np.array([1.5, np.inf])}]}
    p = results.save_results("r", payload, str(tmp_path / "deep"), provenance=False)
    first = open(p).read()
    results.save_results("r", payload, str(tmp_path / "deep"), provenance=False)
    assert open(p).read() == first and json.loads(first) == {"a": [3, {"x": [1.5, None]}], "b": None}
    results.save_results("q", payload, str(tmp_path))
    assert "written_utc" in results.load_results("q", str(tmp_path))["provenance"]
    df = spark.createDataFrame([("m", 0.5, 0.4, 0.61234), ("n", 0.5, None, None)], "metric string, point double, lo double, hi double")
    got = [r.t for r in df.orderBy("metric").select(results.ci_text(F.col("point"), F.col("lo"), F.col("hi")).alias("t")).collect()]
    assert got == ["0.500 [0.400, 0.612]", "n/a"]
    assert results.markdown(df, ["metric", "lo"], "metric").splitlines()[2:] == ["| m | 0.400 |", "| n | n/a |"]
    assert results.interval_bars(df).first().below == pytest.approx(0.1)
