import hashlib
import random

from epochfold.llm import lines


def brute(rows):
    """rows of (id, text), ids unique -> id: (n_lines, n_removed, text)."""
    seen, out = set(), {}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for i, t in sorted(rows):
        if t is None:
            out[i] = (0, 0, None)
            continue
        own, kept, chunk = t.split("\n"), [], []
        marks = [int(md5((md5(own[n - 1]) if n else "") + md5(x))[:4], 16) % 4 == 0 for n, x in enumerate(own)]
        for n, x in enumerate(own):
            chunk.append(x)
            if n == len(own) - 1 or (0 < n < len(own) - 2 and marks[n] and not marks[n - 1]):
                key = "\n".join(chunk)
                if len(chunk) < 2 or key not in seen:
                    kept += chunk
                if len(chunk) >= 2:
                    seen.add(key)
                chunk = []
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def make():
    rnd = random.Random(2)
    pool = [f"line {i} {'x' * rnd.randint(0, 9)}" for i in range(400)]
    shared = [rnd.choice(pool) for _ in range(30)]
    rows = []
    for i in range(80):
        own = [rnd.choice(pool) + str(i) for _ in range(rnd.randint(0, 9))]
        at = rnd.randint(0, 15)
        rows.append((i * 7 % 83, "\n".join(own + (shared[at : at + 15] if i % 3 else []) + own[:2])))
    return [*rows, (100, None), (101, ""), (102, ""), (103, "\n\n\n"), (104, "\n\n\n"), (105, "a\nb\n" * 500), (106, "é\nü"), (107, "é\nü"), (108, "long " * 50_000)]


def test_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, text string, n_lines string, k int").repartition(3)
    want = brute(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(df).collect()} == want
    few = lines.FEW
    try:
        lines.FEW = 0
        assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(df).collect()} == want
    finally:
        lines.FEW = few


def test_borders_resist_shifts():
    a = [f"line {i}" for i in range(200)]
    got = [brute([(0, "\n".join(a)), (1, "\n".join([*a[:90], "new", *a[90:]]))])[1][1]]
    assert got[0] > 150


def test_copies_of_several_lines_go_as_a_whole(spark):
    rnd = random.Random(4)
    texts = ["\n".join(f"{i} {rnd.random()}" for i in range(n)) for n in range(2, 40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string")
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert all(out[k].n_removed == 0 and out[k + len(texts)].n_removed == out[k].n_lines for k in range(len(texts)))


def test_repeated_rows_nulls_empty(spark):
    t = "\n".join(f"l{i}" for i in range(40))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (6, None)], "doc_id long, text string")
    out = lines.dedup_lines(df).collect()
    assert sorted(r.n_lines for r in out) == [0, 40, 40, 40]
    assert sum(r.n_removed == 0 for r in out) == 2 and len(out) == 4
    assert lines.dedup_lines(df.limit(0)).count() == 0
