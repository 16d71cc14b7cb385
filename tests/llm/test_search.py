import heapq
import math
import random
import re
from collections import Counter

import numpy as np

from epochfold.llm import queries
from epochfold.llm import search as S


def brute(docs, items, k=10):
    """Every document's score for every item, in whole numbers."""
    bag = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(bag(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    N, L = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        want = Counter(bag(text))
        scored = []
        for i, c, n in bags:
            m = 100 - 75 + (75 * n * N) // L
            s = sum(r * w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in want.items() if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def got(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(queries.op12_search(spark, sf)) == brute(docs, items)


def test_odd_rows_in_many_shards_and_blocks(spark, monkeypatch):
    """Ties, repeated rows and ids, nulls, texts without terms, long texts, items that repeat or hold nothing known."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("alpha beta Gamma delta-eps zeta É2 x1 the the the".split()) for _ in range(n))
    docs = [(i // 2, text(rng.randint(0, 12)), "c") for i in range(300)] + [(7, None, "c"), (8, "", None), (9, "?!", "c"), (None, "alpha beta", "c"), (None, "alpha beta", "c"), (11, "alpha beta", "c")]
    docs += [(1000, "alpha " * 60_000, "c")]
    items = [(1, "alpha beta zeta"), (1, "alpha beta zeta"), (2, "alpha alpha GAMMA the"), (3, None), (4, "unknown words"), (None, "eps x1 é2"), (5, "the É2 É2 delta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute([d[:2] for d in docs], items)
    assert got(S.rank(frame, asked)) == want
    monkeypatch.setattr(S, "SHARD_POSTINGS", 40)
    monkeypatch.setattr(S, "BLOCK_BYTES", 30)
    assert got(S.rank(frame, asked)) == want
    assert S.rank(frame.limit(0), asked).count() == 0 and S.rank(frame, asked.limit(0)).count() == 0


def test_wand_skips_and_loses_nothing():
    rng = np.random.default_rng(1)
    n, skipped = 4000, 0
    for _ in range(6):
        lists = []
        for df in (2500, 1500, 700, 90, 30):
            d = np.sort(rng.choice(n, df, replace=False))
            x = rng.integers(1, 4_000_000 // df, df)
            lists.append((d.tolist(), x.tolist(), int(x.max()), int(rng.integers(1, 3))))
        ids = np.arange(n)
        full = Counter()
        for d, x, _, r in lists:
            for i, v in zip(d, x, strict=True):
                full[i] += v * r
        heap = []
        scored = S.wand(lists, ids, heap, 10)
        assert sorted(heap, reverse=True) == heapq.nlargest(10, ((s, -i) for i, s in full.items()))
        skipped += len(full) - scored
    assert skipped > 3 * n
