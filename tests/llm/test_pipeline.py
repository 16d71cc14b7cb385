import re
from collections import Counter

import numpy as np
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import targets
from tests.llm.test_near_copies import classes
from tests.llm.test_token_files import want

import corpus_pipeline as P
from epochfold.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    good = P.good_quality(spark, docs, SF)
    assert good.columns == columns
    kept = {r.doc_id: r for r in good.collect()}
    assert all(kept[i] == rows[i] for i in kept)
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95

    once = P.one_of_each(spark, good, SF)
    assert once.columns == columns
    left = {r.doc_id for r in once.collect()}
    group = classes({i: r.text for i, r in kept.items()})
    copies = [i for i, c in group.items() if c != i]
    assert set(group.values()) <= left and sum(i not in left for i in copies) >= 0.95 * len(copies) > 0
    by_text = Counter(rows[i].text for i in left)
    assert max(by_text.values()) == 1

    clean = P.without_leaks(spark, once, SF)
    assert clean.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, _ in leaks([(i, rows[i].text) for i in left], items)}
    found = {r.doc_id for r in clean.collect()}
    assert held and found == left - held

    mix = P.mixed(spark, clean, SF)
    assert mix.columns == columns
    taken = Counter(r.doc_id for r in mix.collect())
    size = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text))
    by_source, got = Counter(), Counter()
    for i in found:
        by_source[rows[i].source] += size(i)
        got[rows[i].source] += size(i) * taken[i]
    aim = targets(by_source)
    assert set(taken) <= found and max(taken.values()) <= 3
    assert abs(sum(got.values()) - sum(aim.values())) < 0.2 * sum(aim.values())

    out = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.tokens(spark, mix, SF).collect())
    assert out == want([(i, rows[i].text) for i, n in taken.items() for _ in range(n)])
    assert sorted(tuple(r) for r in P.run(spark, SF).collect()) == [tuple(r) for r in out]


def test_keep_good_keeps_every_column(spark):
    df = spark.createDataFrame([("t", None, 1.5), (None, 2, None)], "text string, score long, predicted double")
    model = quality.fit(np.zeros((3, len(quality.FEATURES))), np.ones(3))
    assert sorted(map(str, quality.keep_good(df, model).collect())) == sorted(map(str, df.collect()))


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows and ids, empty and very long texts, an extra column with a clashing name."""
    long_text = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (None, "some text without an id", None, None, None, "x"), (1, None, "en", "a", 3, None), (2, "", "en", "a", 0, "x"), (3, "the same row twice", "en", None, 5, "x"),
        (3, "the same row twice", "en", None, 5, "x"), (3, "an id that repeats with another text", "en", "b", 5, "x"), (4, long_text, "en", "b", 9, "x"), (5, "ends \n\n here", "en", "b", 9, "x"),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, size string"
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        columns = docs.columns
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == columns, name
            got = out.collect()
            assert set(map(str, got)) <= set(map(str, docs.collect())), name
            docs = spark.createDataFrame(got, kind)
        last = P.STAGES[-1][1](spark, docs, SF).collect()
        assert len(last) == docs.count() and sorted(r.start for r in last)[:1] == [0][: len(last)]
