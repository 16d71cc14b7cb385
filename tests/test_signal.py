import numpy as np
import pytest

from epochfold.functions import kernels as K
from epochfold.operators import clip, spectral
from epochfold.operators import windows as W

BANDS = spectral.STANDARD_BANDS


def sine(f, sfreq, n=8, sec=4):
    rng = np.random.default_rng(0)
    t = np.arange(int(sec * sfreq)) / sfreq
    return np.sin(2 * np.pi * f * t) + 0.01 * rng.normal(size=(n, len(t)))


def powers(spark, x, sfreq, **kw):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    return np.array([r.features for r in spectral.band_power(df, sfreq, BANDS, x.shape[1], **kw).orderBy("id").collect()])


@pytest.mark.parametrize("sfreq", [128, 160, 500])
def test_peak_lands_in_its_band_at_any_rate(spark, sfreq):
    assert (powers(spark, sine(10, sfreq), sfreq).argmax(axis=1) == 2).all()
    assert (powers(spark, sine(6, sfreq), sfreq).argmax(axis=1) == 1).all()


def test_wrong_rate_misplaces_the_peak(spark):
    assert (powers(spark, sine(10, 160), 80.0).argmax(axis=1) != 2).all()


def test_relative_sums_to_one_and_guards(spark):
    assert np.allclose(powers(spark, sine(10, 128), 128, relative=True).sum(axis=1), 1)
    zero = spark.createDataFrame([(0, [0.0] * 128)], "id int, x array<double>")
    assert spectral.band_power(zero, 128, BANDS, 128, relative=True).first().features == [None] * 4
    with pytest.raises(ValueError, match="half the sampling rate"):
        spectral.check_bands(BANDS, 50, 50)
    with pytest.raises(ValueError, match="no frequency bin"):
        spectral.check_bands({"thin": (0.2, 0.4)}, 128, 128)


def test_welch_by_hand():
    x = np.random.default_rng(1).normal(size=64)
    f, p = K.welch(x, 64.0, 32)
    want = []
    for s in (0, 16, 32):
        g = (x[s : s + 32] - x[s : s + 32].mean()) * K.hann(32)
        want.append([abs(sum(g[n] * np.exp(-2j * np.pi * k * n / 32) for n in range(32))) ** 2 / (64 * (K.hann(32) ** 2).sum()) * (1 if k in (0, 16) else 2) for k in range(17)])
    assert np.allclose(p, np.mean(want, axis=0)) and f[1] == 2.0


def test_windows_mixed_dropped_and_counts(spark):
    y = [0] * 158 + [1] * 354
    df = spark.createDataFrame([(i, 0.0, v) for i, v in enumerate(y)], "sample_idx long, x double, y int")
    got = W.tumbling(df, W.window_samples(1.0, 128), ["x"]).orderBy("start").collect()
    assert [(r.start, r.label, len(r.x)) for r in got] == [(0, 0, 128), (256, 1, 128), (384, 1, 128)]
    assert W.tumbling(df, 128, ["x"], drop_mixed=False).count() == 4
    long = spark.range(30000).selectExpr("id AS sample_idx", "0D AS x")
    assert [len(r.x) for r in W.sliding(long, 2000, 0.0, ["x"], 1).collect()] == [2000] * 15
    with pytest.raises(ValueError):
        W.sliding(long, 10, 1.0, ["x"], 1)
    with pytest.raises(ValueError):
        W.window_samples(0.001, 128)


def test_blocks_across_chunks(spark):
    y = [0, 0, 1, 1, 0, 1, 1, 1, 0, 0, 0, 1] * 9
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "sample_idx long, y int").repartition(3)
    want = np.cumsum(np.concatenate([[0], np.diff(y) != 0])).tolist()
    for chunk in (1, 4, 7, 1 << 16):
        assert [r.block for r in W.label_blocks(df, chunk=chunk).orderBy("sample_idx").collect()] == want


def supers(spark, blocks, k):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "start long, block long")
    m = {r.block: r.super_block for r in W.super_blocks(df, k).collect()}
    return [m[b] for b in blocks]


def test_super_blocks(spark):
    assert supers(spark, [0, 0, 1, 1, 1, 2, 2, 3, 3, 4, 4, 4], 2) == [0] * 5 + [1] * 7
    assert set(supers(spark, np.repeat(range(19), 2).tolist(), 4)) == {0, 1, 2, 3}
    assert supers(spark, [5, 5, 3, 3, 3, 8, 8, 1, 1], 2) == [0] * 5 + [1] * 4
    assert supers(spark, [3, 4], 5) == [0, 0]
    with pytest.raises(ValueError):
        supers(spark, [1], 0)


def test_channels(spark):
    df = spark.createDataFrame([(1, [("A", [1.0]), ("B", [2.0])])], "id int, channels array<struct<name:string,x:array<double>>>")
    got = W.select_channels(df, ["B", "A"]).first().channels
    assert [c.name for c in got] == ["B", "A"]
    assert W.flatten_channels(df).first().x == [1.0, 2.0]
    assert W.unflatten(W.flatten_channels(df), ["A", "B"]).first().channels == df.first().channels
    with pytest.raises(Exception, match="not in the montage"):
        W.select_channels(df, ["C"]).collect()


def test_events_join_and_runs(spark):
    s = spark.range(100).selectExpr("id AS sample_idx", "cast(id AS double) AS x")
    e = spark.createDataFrame([(5,), (50,), (97,)], "at long")
    got = W.event_epochs(s, e, -2, 2, ["x"]).orderBy("at").collect()
    assert [r.x for r in got] == [[3, 4, 5, 6, 7], [48, 49, 50, 51, 52], [95, 96, 97, 98, 99]]
    assert W.event_epochs(s, e, 0, 3, ["x"]).count() == 2
    runs = spark.createDataFrame([(4, 0, 10), (8, 10, 60)], "run int, first long, end long")
    assert {r.at: r.run for r in W.run_of_event(e, runs).collect()} == {5: 4, 50: 8, 97: -1}


def test_clipping_reads_training_rows_alone(spark):
    rng = np.random.default_rng(7)
    train, test = rng.normal(size=3000), 50 * rng.normal(size=1000)
    rows = [(0, float(v)) for v in train]
    own = clip.Clipper().fit(spark.createDataFrame(rows, "fold int, v double"), ["fold"])
    lim = own.limits.first()
    assert np.allclose([lim.lo, lim.hi], np.quantile(train, [0.001, 0.999]))
    joint = clip.limits(spark.createDataFrame([*rows, *[(0, float(v)) for v in test]], "fold int, v double"), ["fold"]).first()
    assert joint.hi > lim.hi
    out = own.transform(spark.createDataFrame([(0, 500.0), (0, -500.0)], "fold int, v double")).collect()
    assert sorted(r.v for r in out) == [lim.lo, lim.hi]
    with pytest.raises(Exception, match="not been fitted"):
        own.transform(spark.createDataFrame([(1, 0.0)], "fold int, v double")).collect()
    fixed = clip.Clipper(fixed=(-1.0, 1.0)).fit(own.limits.selectExpr("fold", "lo AS v"), ["fold"])
    assert fixed.transform(spark.createDataFrame([(0, 9.0)], "fold int, v double")).first().v == 1.0


LIMIT_DATA = {0: lambda r: r.normal(size=20_000), 1: lambda r: r.integers(0, 5, 3_000).astype(float), 2: lambda r: np.array([1.0, 2.0, 4.0]), 3: lambda r: np.array([-1e308, 1e308, 5e-324, 0.0]), 4: lambda r: 10.0 ** r.uniform(-300, 300, 500)}


@pytest.mark.parametrize("held_out", [True, False])
def test_limits_of_all_folds_in_one_pass(spark, held_out):
    rng = np.random.default_rng(3)
    data = {k: make(rng) for k, make in LIMIT_DATA.items()}
    df = spark.createDataFrame([(k, c, float(v)) for k, x in data.items() for c in ("a", "b") for v in (x if c == "a" else -x)] + [(1, "a", None), (None, "a", 9.0)], "g int, c string, v double").repartition(5)
    pairs = [(f, f) for f in data] if held_out else [(f, g) for f in data for g in data if g <= f]
    got = {(r.fold, r.c): (r.lo, r.hi) for r in clip.fold_limits(df, spark.createDataFrame(pairs, "fold int, g int"), ["fold"], "g", ["c"], low=0.01, high=0.95, held_out=held_out, buckets=64).collect()}
    assert len(got) == 10
    for (f, c), lim in got.items():
        train = np.concatenate([x for g, x in data.items() if (g != f if held_out else g <= f)])
        assert np.allclose(lim, np.quantile(train if c == "a" else -train, [0.01, 0.95]), rtol=1e-12, atol=0)


def test_limits_of_a_fold_ignore_what_it_does_not_train_on(spark):
    rng = np.random.default_rng(5)
    make = lambda scale: spark.createDataFrame([(g, float(v)) for g in range(3) for v in rng_of[g] * (scale if g == 2 else 1)], "g int, v double")
    rng_of = {g: rng.normal(size=400) for g in range(3)}
    held = spark.createDataFrame([(2, 2)], "fold int, g int")
    one, other = (clip.fold_limits(make(k), held, ["fold"], "g", held_out=True).first() for k in (1.0, 1e6))
    assert one == other
    with pytest.raises(ValueError, match="finite"):
        clip.fold_limits(spark.createDataFrame([(0, float("nan"))], "g int, v double"), held, ["fold"], "g")
    assert clip.fold_limits(spark.createDataFrame([], "g int, v double"), held, ["fold"], "g").count() == 0


def test_regions(spark):
    rows = [(1, "F3", 1.0), (1, "F4", 3.0), (1, "C3", 5.0)]
    df = spark.createDataFrame([(i, c, "alpha", p) for i, c, p in rows], "id int, channel string, band string, power double")
    got = {r.region: (r.mean_power, r.coverage) for r in spectral.regional_summary(df, ["id"], {"alpha": (8, 13)}).collect()}
    assert got["frontal"] == (2.0, 2) and got["central"] == (5.0, 1) and got["occipital"] == (None, 0)


def test_filter_keeps_its_band():
    b, a = K.butter_bandpass(8, 30, 160)
    t = np.arange(480) / 160
    inside, outside = np.sin(2 * np.pi * 15 * t), np.sin(2 * np.pi * 2 * t)
    y = K.filtfilt(b, a, np.stack([inside, outside, inside + outside]))
    mid = slice(100, 380)
    assert np.abs(y[0][mid] - inside[mid]).max() < 0.02 and np.abs(y[1][mid]).max() < 0.02
    assert np.abs(y[2] - y[0] - y[1]).max() < 1e-9
    w = np.exp(-2j * np.pi * np.array([8, 30, 15.5]) / 160)
    gain = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert np.allclose(gain[:2], 2**-0.5, atol=1e-6) and gain[2] > 0.99
    with pytest.raises(ValueError):
        K.filtfilt(b, a, np.zeros(20))


def test_csp_and_lda_part_variances():
    rng = np.random.default_rng(2)
    y = np.arange(80) % 2
    x = rng.normal(size=(80, 4, 100))
    x[y == 0, 1] *= 3
    w = K.csp(x[:60], y[:60], 2)
    d, c = K.lda(K.log_variance(w, x[:60]), y[:60])
    assert ((K.log_variance(w, x[60:]) @ d + c > 0) == y[60:]).mean() > 0.9
