import random
import re

import xxhash

from epochfold.llm import queries, simhash
from epochfold.llm.components import components

UP = {i: i + 32 for i in range(65, 91)}


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps: dict, bits=4):
    """Smallest reachable id by brute force; fps: id -> fingerprint."""
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= bits:
                    label[i], changed = label[j], True
    return label


def texts():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(rnd.choice([1, 3, 4, 5, 200, 400]))) for _ in range(40)]
    out = list(base)
    for t in base:
        w = t.split()
        w[len(w) // 2] = "changed"
        out += [" ".join(w), t.upper(), t]
    return [*out, None, "", " \t\n", "\x1c", "É É é", "one", "two words", "x " * 30000]


def test_fingerprints_and_components(spark):
    rows = [(i * 3 % 401, t, "c", 5) for i, t in enumerate(texts())]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int")).collect()
    want = {r[0]: brute(r[1]) for r in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in out} == want
    assert {r.doc_id: r.component_id for r in out} == classes(want)


def test_close_fingerprints_and_chunks(spark):
    rnd = random.Random(4)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
    fps |= {(1 << 63) | k for k in range(64)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for chunk in (2048, 5):
        got = {r.node: r.component for r in components(simhash.links(df, chunk=chunk)).collect()}
        ids = {signed(x): x for x in fps}
        want = classes(ids)
        assert {k: got.get(k, k) for k in ids} == want


def test_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert out == sorted([(None, 5), (5, 5), (5, 5), (7, 7)], key=repr)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [5, 7]
    odd = spark.createDataFrame([(None, "p q r s t u"), (None, "v w x y z a b"), (None, "v w x y z a b"), (3, "v w x y z a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text[0]) for r in simhash.keep_one(odd).collect()) == [("3", "v"), ("None", "p")]
    whole = spark.createDataFrame([(2, "same text here for all"), (1, "same text here for all"), (9, "other")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(whole).collect()) == [1, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    rows = [((i * 7919) % 100003, ((i + 1) * 7919) % 100003) for i in range(n)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*rows, (5, 5), (None, 1)], "a long, b long")).collect()}
    assert set(got.values()) == {min(min(r) for r in rows)} and len(got) == n + 1


def test_query(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = {i: brute(t) for i, t in docs.items()}
    want = classes(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in docs}
