import bisect
import math
import zlib

import numpy as np

from epochfold.llm import quality as Q
from epochfold.llm import queries


def test_fit_learns_additive_and_pair_effects():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(Q.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4000) < 0.05)).astype(float)
    m = Q.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == (y[3000:] == 1)).mean() > 0.8
    assert (0, 1) in {(i, j) for i, j, *_ in m.pairs}
    again = Q.fit(x[:3000], y[:3000])
    assert np.array_equal(m.score(x), again.score(x))


def test_one_class_or_no_rows():
    x = np.zeros((5, len(Q.FEATURES)))
    assert (Q.fit(x, np.ones(5)).score(x) > 0.5).all()
    assert np.allclose(Q.fit(x[:0], np.ones(0)).score(x), 0.5)


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert set(got) == {r.doc_id for r in docs}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, "good text here. " * (i % 7 + 1) if i % 2 else "BAD!! %%% " * (i % 5 + 1)) for i in range(200)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(200)]
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in rows]
    a, b = (Q.train(docs, spark.createDataFrame(r, "doc_id long, quality int")) for r in (rows, flip))
    x = Q.matrix(["some text", "BAD!!"])
    assert np.array_equal(a.score(x), b.score(x))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 0.1), (1, "", 0.1), (1, "", 0.1), (2, "\x00퟿ é", 0.1), (3, "w " * 200_000, 0.1)], "doc_id long, text string, score double")
    m = Q.train(df, spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, quality int"))
    out = Q.classify(df, m).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert Q.classify(df.limit(0), m).count() == 0


def plain_features(text):
    """The features of a text by loops over its characters, words and lines."""
    text = text or ""
    if not text:
        return [0.0] * len(Q.FEATURES)
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    share = lambda test: sum(1 for v in raw if test(chr(v))) / len(raw)
    part = lambda some, test: sum(1 for w in some if test(w)) / max(1, len(words))
    seen, again = set(), 0
    for line in lines:
        again += len(line) if line in seen else 0
        seen.add(line)
    bits = [raw.count(bytes([v])) / len(raw) for v in set(raw)]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(len(w) for w in words) / max(1, len(words)),
        share(lambda c: "A" <= c <= "Z"), share(lambda c: "a" <= c <= "z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c > "\x7f"),
        share(lambda c: c == " "), share(lambda c: c == "\n"), share(lambda c: c == "."), share(lambda c: c == "!"),
        share(lambda c: c in "#$%&*+<=>@^_`{}~\\"), share(lambda c: c == "|"), share(lambda c: c == "-"), share(lambda c: c in "\"'(),/:;[]"),
        len(set(words)) / max(1, len(words)), max((words.count(w) for w in set(words)), default=0) / max(1, len(words)),
        len(seen) / len(lines), again / len(text), math.log1p(len(raw) / len(lines)), sum(1 for x in lines if len(x) < 30) / len(lines),
        -sum(b * math.log2(b) for b in bits), part(words, lambda w: w[-1] in "!#$%&*|@^~"), part(words, lambda w: w[0].isupper()),
    ]


def test_the_query_scores_like_loops_over_texts_and_bins(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = Q.train(docs, labels)
    got = {r.doc_id: r.score for r in queries.op8_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and len(m.pairs) == Q.PAIRS
    for r in rows:
        x = plain_features(r.text)
        s = m.base
        for k in range(len(x)):
            s += m.tables[k][bisect.bisect_right(list(m.edges[k]), x[k] + 1e-12)]  # a border counts to its right, whatever the rounding
        for i, j, a, b, t in m.pairs:
            s += t[bisect.bisect_right(list(a), x[i] + 1e-12)][bisect.bisect_right(list(b), x[j] + 1e-12)]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-s))) < 1e-9


def test_pair_trees_have_at_most_four_leaves_and_a_repeated_id_counts_once(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        g, h, c = rng.normal(size=(6, 5)), rng.random((6, 5)), rng.integers(1, 40, (6, 5))
        t = Q._pair_tree(g, h, c)
        assert 2 <= len(np.unique(t)) <= 4 and (t * g).sum() > 0
    docs = spark.createDataFrame([(1, "one text")] * 50 + [(2, "two"), (3, "three three")], "doc_id long, text string")
    rows = Q.training_rows(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")).collect()
    assert len({r["id"] for r in rows}) == len(rows)
