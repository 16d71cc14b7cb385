import re
from collections import Counter
from itertools import permutations

import pytest

from epochfold.llm import filter_audit as A
from epochfold.llm import queries


def brute(docs, labels, part_of="lang"):
    """The report by applying the five filters one after the other in all 120 orders."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = {}
    for i, text, _ in docs:
        ids.setdefault(text or "", []).append(i)
    least = {t: min((i for i in own if i is not None), default=None) for t, own in ids.items()}
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least[t]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": first is not None and (i is None or i > first),
        }
        rows.append((part or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            own = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(order), step] = (len(left), len(gone), sum(r[1][f] for r in own) - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone), f)
                shapley[part, f] += len(gone)
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def run(docs, labels):
    return A.audit(A.measures(docs, labels), queries.AUDITED, {"good_lost": "good", "toxic_lost": "toxic"})


def test_query_against_all_orders(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert got(queries.op11_filter_audit(spark, sf)) == brute(docs, labels)


def test_odd_rows(spark):
    """Nulls, empty, repeated and very long texts, repeated ids and labels, columns of the operator's own names."""
    words = " ".join(f"w{i}" for i in range(50_000))
    docs = [
        (None, "the same", "en", 1), (None, "the same", "en", 1), (5, "the same", None, 2), (5, "the same", None, 2), (6, "the same", "", 3), (None, None, "de", 4),
        (8, "", "de", None), (8, words, "de", 6), (9, words, "de", 7), (9, "AB CD | #", "en", 8), (None, "alone", "en", 9), (None, "alone", "en", 9),
    ]
    labels = [(5, 1, 0), (5, 0, 1), (None, 1, 1), (9, None, 1), (8, 1, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, part int")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(run(frame, told)) == brute([d[:3] for d in docs], labels)
    assert run(frame.limit(0), told).count() == 0


def test_filters_by_any_condition_and_their_number(spark):
    rows = spark.range(100).selectExpr("'x' AS part", "id AS v", "id AS kept")
    out = A.audit(rows, {"P": "v % 2 = 0", "Q": "v < 10 OR (NULL AND v = 50)"}, {"low": "kept < 4"}).collect()
    assert {(r.filter_order, r.step): (r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.low, r.shapley) for r in out} == {
        ("PQ", 1): ("P", 50, 50, 0, 45, 2, 95), ("PQ", 2): ("Q", 45, 5, 5, 5, 2, 15), ("QP", 1): ("Q", 90, 10, 0, 5, 4, 15), ("QP", 2): ("P", 45, 45, 5, 45, 0, 95),
    }
    for n in (0, 7):
        with pytest.raises(ValueError, match="filters"):
            A.walk(rows, {f"f{i}": "true" for i in range(n)}, {})


def test_each_state_is_visited_once(spark, monkeypatch):
    frames = []
    where = type(spark.range(1)).where
    monkeypatch.setattr(type(spark.range(1)), "where", lambda self, c: (frames.append(c), where(self, c))[1])
    rows = spark.range(40).selectExpr("'x' AS part", "id AS v")
    nodes, edges = A.walk(rows, {c: f"v % {k} = 0" for k, c in enumerate("ABCDE", 2)}, {})
    assert len(frames) == 31 + 1  # one filter for each state but the first, and one in reading the edges
    assert nodes.count() == 32 and edges.count() == 80
