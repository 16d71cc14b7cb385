import random
import zlib

import numpy as np

from epochfold.llm import queries
from epochfold.llm import toxicity as T


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def made(n, seed=0):
    """Texts of invented words, a fifth of them with some of four bad ones; no two alike."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "or", "in", "ul")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 200))]
        bad = i % 5 == 0
        for _ in range(max(3, len(w) // 15) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["wixquayz", "jhavokk", "quezzwal", "vyxomorph"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op13_toxicity(spark, sf).collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(out) == ids
    for i, r in out.items():
        assert r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    told = [(out[r.doc_id].score, out[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r.doc_id].held_out]
    s, p, y = map(np.array, zip(*told, strict=True))
    above = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert above > 0.88 and p[y == 1].mean() > 0.6 and 1 - p[y == 0].mean() > 0.95


def test_finds_planted_words_in_rows_never_learnt(spark):
    rows = made(1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    m = T.train(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in T.classify(docs, m).collect()}
    some = [(out[i], t, text) for i, text, t in rows if held(i)]
    assert np.mean([r.predicted for r, t, _ in some if t]) > 0.95 and np.mean([r.predicted for r, t, _ in some if not t]) < 0.02
    where = [any(b in " ".join(text.split()[r.worst_word : r.worst_word + 8]) for b in ("wixquayz", "jhavokk", "quezzwal", "vyxomorph")) for r, t, text in some if t]
    assert np.mean(where) > 0.95


def test_labels_of_held_out_rows_and_partitions_change_nothing(spark):
    rows = made(400, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    told = [(i, t) for i, _, t in rows]
    flip = [(i, 1 - t if held(i) else t) for i, t in told]
    a = T.train(docs, spark.createDataFrame(told, "doc_id long, toxic int"))
    b = T.train(docs.repartition(7), spark.createDataFrame(flip, "doc_id long, toxic int").repartition(3))
    assert (a.ordinary, a.toxic, a.base) == (b.ordinary, b.toxic, b.base) and np.array_equal(a.coef, b.coef)


def test_windows_cover_the_text():
    own = [b"%d" % i for i in range(103)]
    for width, step in T.WIDTHS:
        found = T.windows(own, width, step)
        assert set(b" ".join(found).split()) == set(own) and max(len(x.split()) for x in found) <= width
    assert T.windows([], 8, 4) == [b" "]


def test_calibrated_cut_scores_the_threshold():
    x = np.arange(100, dtype=float).reshape(-1, 1)
    mean, spread, coef, base = T.calibrate(x, (x[:, 0] >= 80).astype(float))
    s = 1 / (1 + np.exp(-(base + ((x - mean) / spread) @ coef)))
    assert (s[80:] >= T.THRESHOLD).all() and (s[:80] < T.THRESHOLD).all()


def test_odd_rows(spark):
    rows = [(None, None, 0.1), (1, "", 0.1), (1, "", 0.1), (2, "\x00퟿ é", 0.1), (3, "w " * 100_000, None), (4, "badword " * 9, 0.2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for labels in ([], [(1, 1)], [(None, 1), (1, None), (2, 1), (2, 0), (3, 0), (4, 1), (99, 1)]):
        m = T.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = T.classify(df, m).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert T.classify(df.limit(0), m).count() == 0
    empty = T.train(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert len({r.score for r in T.classify(df, empty).collect()}) == 1


def test_cuts_are_the_windows():
    texts = [None, "", " \n", "One", "a b c d e f g h i", "\x00퟿ é x", *(" ".join(f"W{j}" for j in range(n)) for n in (4, 8, 11, 57))]
    body, cuts = T._cuts(texts)
    for text, own in zip(texts, cuts, strict=True):
        for (width, step), (starts, ends) in zip(T.WIDTHS, own, strict=True):
            assert [body[a:b] for a, b in zip(starts, ends, strict=True)] == T.windows(T.words(text), width, step)
    m = T.Model(b"some ordinary words of many texts " * 4, b" wixquayz jhavokk quezzwal", *(np.zeros(0),) * 3, 0.0)
    both, alone = m.savings([*texts, "so wixquayz is quezzwal"]), [m.savings([t])[0] for t in texts]
    assert all(np.array_equal(a, b) for x, y in zip(both, alone, strict=False) for a, b in zip(x, y, strict=True)) and both[-1][0].max() > 3
    assert m.savings([]) == []
