import random
import re
from collections import Counter

from epochfold.llm import decontaminate as D

UP = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def grams(w, k):
    return Counter(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, items, least=0.8):
    """Every window of every document against every item."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            if not v or not w:
                continue
            k, n = min(5, len(v)), len(v)
            want = grams(v, k)
            best = max(sum((grams(w[s : s + n], k) & want).values()) for s in range(max(1, len(w) - n + 1)))
            if best / sum(want.values()) >= least:
                out[d, i] = best / sum(want.values())
    return out


def make():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.choice([12, 30, 60]))) for i in range(25)] + [(100, "a b"), (101, None), (102, ""), (103, "one"), (104, "x y x y x y x y x y")]
    docs = []
    for i in range(60):
        t = text(rnd.randint(0, 120)).split()
        if i % 2:
            own = items[i % 25][1].upper().split() if i % 3 else items[i % 25][1].split()
            for _ in range(i % 4):
                own[rnd.randrange(len(own))] = "edit"
            if i % 5 == 0:
                own.insert(len(own) // 2, "added")
            if i % 7 == 0:
                del own[0]
            at = rnd.randint(0, len(t))
            t[at:at] = own
        docs.append((i, (", " if i % 4 == 1 else " ").join(t)))
    return [*docs, (200, None), (201, ""), (202, "say A, b!"), (203, "one"), (204, "x y " * 30), (205, "pad " * 20_000 + items[3][1])], items


def test_against_every_window(spark):
    docs, items = make()
    df = spark.createDataFrame([(*r, "x", 1.0) for r in docs], "doc_id long, text string, item_id string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.contaminated(df, bench).collect()}
    want = brute(docs[:-1], items) | {(205, 3): 1.0}
    assert want.keys() == got.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    whole = D.PIECE
    try:
        D.PIECE = 200
        assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == want.keys()
    finally:
        D.PIECE = whole
    kept = D.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_nulls_repeats_empty(spark):
    item = "alpha beta gamma delta epsilon zeta"
    df = spark.createDataFrame([(None, item), (1, item), (1, item), (1, "fine"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item), (None, "q r s t u v"), (None, item)], "item_id long, text string")
    got = sorted(((str(r.doc_id), r.item_id) for r in D.contaminated(df, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in ("None", "1", "1") for i in (7, 8, None)], key=str)
    assert sorted((str(r.doc_id), r.text) for r in D.clean(df, bench).collect()) == [("1", "fine"), ("2", None)]
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_words_moved_twice(spark):
    """Two insertions in an item, so that no shingle is in its place in the best window."""
    item = [f"w{i}" for i in range(60)]
    moved = [*item[2:20], "new", "new", *item[20:40], "more", *item[40:57]]
    docs = [(1, " ".join(["lead"] * 7 + moved + ["tail"] * 9)), (2, " ".join(["lead"] * 70 + item[:30] + item[33:]))]
    items = [(5, " ".join(item))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.contaminated(df, bench, 0.6).collect()}
    assert got == {k: round(v, 9) for k, v in brute(docs, items, 0.6).items()} and len(got) == 2


def test_recall_of_the_query(spark):
    """The query over the smallest tables against every window of every document: recall and precision are 1."""
    from epochfold.llm import queries

    sf = "/root/testdata/sf0.001"
    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    own = {i: set(grams(words(t), 5)) for i, t in items}
    want = {}
    for d, t in docs:  # a document that holds no shingle of an item has no window like it
        has = set(grams(words(t), 5))
        want |= brute([(d, t)], [(i, it) for i, it in items if has & own[i]])
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op9_decontamination(spark, sf).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
