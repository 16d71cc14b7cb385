import hashlib
import random
import re
from collections import Counter

import numpy as np

from epochfold.llm import queries, repeats


def brute(raws):
    """By id: n_bytes, n_removed, n_spans, kept hash; every 400-byte string of every text is compared."""
    seen = Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def make():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (60, 70, 75, 80, 90, 200, 700)]
    out = [text(rnd.randint(0, 500)) for _ in range(30)]
    for i in range(40):
        parts = [text(rnd.randint(0, 60)) for _ in range(3)]
        t = parts[0] + rnd.choice(shared) + parts[1] + rnd.choice(shared) + parts[2]
        out.append(t)
        w = list(t)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = "#"
        out.append("".join(w))
    same = shared[5].encode()[:400].decode(errors="ignore")
    return [*out, out[5], None, "", "a" * 399, "a" * 1000, "b" * 400, "ab" * 600, "x" * 401 + text(100), same, same + "!", "?" + same, "c" * 399 + "d" * 399, "period " * 300]


def result(df, **kw):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(repeats.remove_repeats(df, **kw).collect(), key=lambda r: r.doc_id)]


def test_against_every_string(spark):
    texts = make()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, k string").repartition(3)
    want = brute([(t or "").encode() for t in texts])
    assert result(df) == want
    assert result(df, giant=2) == want


def test_small_segments_and_batches(spark, monkeypatch):
    texts = make()[25:60]
    for name, v in (("SEGMENT", 500),):
        monkeypatch.setattr(repeats, name, v)
        lo, hi, q = repeats.phrases(texts[9].encode())
        assert (lo[1:] == hi[:-1] + 1).all() and lo[0] == 0 and hi[-1] == len(texts[9].encode()) - 400
        assert ((q >= hi) & (q - lo < 256)).all()


def test_repeated_rows_and_null_ids(spark):
    t = make()[0] * 5
    df = spark.createDataFrame([(1, t), (1, t), (None, t + "end"), (None, None)], "doc_id long, text string")
    out = repeats.remove_repeats(df, with_text=True).collect()
    assert len(out) == 4
    want = Counter(brute([(x or "").encode() for x in (t, t, t + "end", None)]))
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_repeats(spark, sf).collect()}
    assert got == dict(zip([d.doc_id for d in docs], brute([(d.text or "").encode() for d in docs]), strict=True))


def passages(texts, least=50):
    """By text: runs of words covered by strings of so many words that another text holds, and their words."""
    up = {i: i + 32 for i in range(65, 91)}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up)) for t in texts]
    held = {}
    for k, w in enumerate(words):
        for i in range(len(w) - least + 1):
            held.setdefault(tuple(w[i : i + least]), set()).add(k)
    out = []
    for w in words:
        gone = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - least + 1):
            if len(held[tuple(w[i : i + least])]) > 1:
                gone[i : i + least] = True
        out.append((int((gone[1:] < gone[:-1]).sum()), int(gone.sum())))
    return out


def test_passages_against_every_string(spark):
    rnd = random.Random(2)
    text = lambda n: [rnd.choice("abcdefgh") + rnd.choice("xyzXYZ") * rnd.randint(0, 3) for _ in range(n)]
    shared = [text(n) for n in (49, 50, 51, 52, 60, 75, 130)]
    texts = [" ".join(text(rnd.randint(0, 80)) + a + text(rnd.randint(0, 40)) + rnd.choice(shared) + text(3)) for a in shared for _ in range(3)]
    texts += [texts[5].upper(), texts[7].replace(" ", " \n"), " ".join(["up", "and", "down"] * 200), " ".join(["and", "down", "up"] * 30), " ".join(shared[4] * 3), " ".join(text(400)), None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = [(r.n_passages, r.passage_words) for r in sorted(repeats.remove_repeats(df).collect(), key=lambda r: r.doc_id)]
    assert got == passages(texts) and sum(n for n, _ in got) > 20
