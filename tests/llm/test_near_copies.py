import random
import re

import numpy as np

import corpus_pipeline as P
from epochfold.llm import near_copies, word_hashes

SF = "/root/testdata/sf0.001"
UP = {i: i + 32 for i in range(65, 91)}


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts: dict):
    """Smallest key that each reaches over pairs of Jaccard 0.8 or more, by brute force."""
    sets, label = {k: grams(t) for k, t in texts.items()}, {k: k for k in texts}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def made():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    line = [word() for _ in range(40)]
    out = []
    for n in (3, 5, 9, 30, 60, 200, 400):
        for _ in range(6):
            base = [word() for _ in range(n)] + (line if n > 30 else [])
            out.append(base)
            for edits in (1, 2, 3, n // 25, n // 20):
                copy = list(base)
                for _ in range(edits):
                    copy[rnd.randrange(len(copy))] = word()
                out.append(copy)
    # a large group of near copies in steps, each like the next alone
    step = [word() for _ in range(100)]
    for _ in range(60):
        step = list(step)
        step[rnd.randrange(100)] = word()
        out.append(step)
    return [" ".join(x) for x in out] + [None, "", " \n", " ".join(out[40]).upper()]


def found_share(want: dict, got: dict) -> float:
    """How many of the rows that have a smaller one in their class are found; found classes are never larger ones."""
    assert all(want[c] == want[k] for k, c in got.items())
    copies = [k for k, c in want.items() if c != k]
    return sum(got.get(k, k) != k for k in copies) / max(1, len(copies))


def test_against_brute_force_jaccard(spark):
    texts = {i * 17 % 1009: t for i, t in enumerate(made())}
    df = spark.createDataFrame([(k, t, "c") for k, t in texts.items()], "doc_id long, text string, component string").repartition(3)
    want = classes(texts)
    first = None
    for chunk in (2048, 5):
        got = {r.key: r.component for r in near_copies.near_copies(df, chunk=chunk).collect()}
        assert found_share(want, got) >= 0.95
        assert first in (None, got)
        first = got


def test_fingerprint_by_bit():
    g = np.array([3, 2**63 + 5, 77, 12345678901], np.uint64)
    for k, word in enumerate(near_copies.fingerprint(g)):
        h = [int(x) for x in word_hashes.mixed(g + np.uint64(k + 1))]
        want = [2 * sum(x >> b & 1 for x in h) > len(h) for b in range(64)]
        # bits are laid out byte by byte, the highest of a byte first
        assert [bool(int(word) >> (b // 8 * 8 + 7 - b % 8) & 1) for b in range(64)] == [want[b // 8 * 8 + 7 - b % 8] for b in range(64)]
    assert not near_copies.fingerprint(g[:0]).any()


def test_word_hashes(monkeypatch):
    texts = ["A b  c\td", "", "é É\x0bZ", " a", "x" * 500, "a b c d e f"]
    monkeypatch.setattr(word_hashes, "PIECE", 7)
    h, at = word_hashes.word_hashes([t.encode() for t in texts])
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(UP)) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert len({(x, y) for x, y in zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))
    for n in (1, 2, 3, 5, 8):
        r = word_hashes.runs(h, n)
        assert len({(tuple(flat[i : i + n]), x) for i, x in enumerate(r.tolist())}) == len({tuple(flat[i : i + n]) for i in range(len(r))}) == len(set(r.tolist()))


def test_stage_against_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = classes({r.doc_id: r.text for r in docs.collect()})
    left = P.one_of_each(spark, docs, SF)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.collect()}
    assert set(want.values()) <= kept
    copies = [k for k, c in want.items() if c != k]
    assert sum(k not in kept for k in copies) >= 0.95 * len(copies) > 0


def test_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, "p q r s t u"), (None, "v w x y z a b"), (None, "v w x y z a b"), (3, "v w x y z a b"), (3, "v w x y z a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text[0]) for r in near_copies.keep_one(df).collect()) == [("3", "v"), ("None", "p")]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_no_pair_at_the_similarity_is_lost(spark, monkeypatch):
    """Pairs at just 0.8 or a little more, many of which share none of the index's triples or differ by too many bits."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    line, texts = [word() for _ in range(12)], {}
    for i in range(300):
        base = [word() for _ in range(rnd.randrange(28, 120))] + line
        copy, n = list(base), len(base) - 4
        while True:
            more = list(copy)
            more[rnd.randrange(len(more))] = word()
            both = len(grams(" ".join(base)) & grams(" ".join(more)))
            if both * 5 < (2 * n - both) * 4:
                break
            copy = more
        texts |= {2 * i: " ".join(base), 2 * i + 1: " ".join(copy)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = {k: c for k, c in classes(texts).items() if k != c}
    assert len(want) > 270
    monkeypatch.setattr(near_copies, "COMMON", 1)
    got = {r.key: r.component for r in near_copies.near_copies(df, chunk=500).collect() if r.key != r.component}
    assert got == want
