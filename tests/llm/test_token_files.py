import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochfold.llm import queries
from epochfold.llm import token_files as T


@given(st.lists(st.integers(0, 50256), max_size=400), st.integers(1, 30))
@settings(max_examples=40, deadline=None)
def test_round_trip(ids, times):
    x = np.array(ids * times, np.uint32)
    got, lengths = T.decode_block(T.encode_block(x, np.array([len(x)])))
    assert np.array_equal(got, x) and lengths.tolist() == [len(x)]


def test_skewed_ids_shrink_and_carries_hold():
    rng = np.random.default_rng(1)
    for n in (1 << 16, (1 << 16) + 77):
        x = np.minimum(rng.geometric(0.02, n), 50000).astype(np.uint32)
        data = T.encode_block(x, np.array([n]))
        assert np.array_equal(T.decode_block(data)[0], x) and len(data) < 1.1 * n
    same = np.full(200_000, 7, np.uint32)
    data = T.encode_block(same, np.array([200_000]))
    assert len(data) < 50_000 and np.array_equal(T.decode_block(data)[0], same)


def test_damage_is_found():
    data = bytearray(T.encode_block(np.arange(5000, dtype=np.uint32), np.array([5000])))
    for at in (0, 5, 30, len(data) // 2):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises((ValueError, IndexError)):
            T.decode_block(bytes(bad))
    with pytest.raises(ValueError):
        T.decode_block(bytes(data[:-4]))
    with pytest.raises(ValueError):
        T.encode_block(np.array([T.MOST_ID + 1], np.uint32), np.array([1]))


def want(rows):
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_rows(spark, monkeypatch):
    texts = ["", None, "one two", " \n\t x", "é\u0085\x1c\x00 ᠎'S 's", "a<|endoftext|>b", "w " * 30_000, "word " * 900, "dup", "dup"]
    rows = [(9 * i % 11, t) for i, t in enumerate(texts)] + [(5, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(4)
    out = T.through_files(df, queries.tokenizer_path(), with_ids=True).collect()
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=lambda r: r[1])
    assert got == want(rows)
    assert all(zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    assert T.through_files(df.limit(0), queries.tokenizer_path()).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_tokens(spark, sf).collect())
    assert got == want(docs)


def entropy_bytes(ids):
    p = np.bincount(ids)
    p = p[p > 0] / len(ids)
    return -(p * np.log2(p)).sum() * len(ids) / 8


def test_contexts_shrink_what_they_foretell():
    rng = np.random.default_rng(7)
    table = rng.integers(0, 900, (900, 4))
    one, two = [5], [5, 6]
    for pick in rng.integers(0, 4, 600_000):
        one.append(int(table[one[-1], pick]))  # the id before leaves four ids open
        two.append(int(two[-1] * 31 + two[-2] * 17 + pick // 3) % 60)  # two ids before leave one and a rarer one
    for ids, share in ((one, 0.45), (two, 0.6), (rng.integers(0, 900, 120_000).tolist(), 1.15)):
        ids = np.array(ids, np.uint32)
        data = T.encode_block(ids, np.array([len(ids)]))
        assert len(data) < share * entropy_bytes(ids)
        assert np.array_equal(T.decode_block(data)[0], ids)


def test_files_are_a_fifth_smaller_than_order_0(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 10 < 2").select("text").collect()
    ids = np.concatenate([np.append(x, 0) for x in T.encoder(queries.tokenizer_path()).encode([(r.text or "").encode() for r in rows])]).astype(np.uint32)[: T.BLOCK]
    assert len(T.encode_block(ids, np.array([len(ids)]))) <= 0.8 * entropy_bytes(ids)


def test_order_0_ids_are_told_by_the_guide():
    m = T._Model(5000)
    rng = np.random.default_rng(3)
    m.counts += np.minimum(rng.geometric(0.01, 5000) ** 3, 10**6) * (rng.random(5000) < 0.2)
    m._shares()
    v = np.concatenate([m.start, m.start + m.freq - 1, rng.integers(0, 1 << T._LIT_BITS, 10_000)])
    assert np.array_equal(m.told(v), np.searchsorted(m.start, v, side="right") - 1)


def test_pieces_forgotten_are_learnt_again(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 40)
    enc = T.PieceEncoder(queries.tokenizer_path())
    for k in range(6):
        texts = [" ".join(f"word{j}x{i % 3}" for j in range(k, k + 9)) for i in range(4)]
        got = enc.encode([t.encode() for t in texts])
        assert [g.tolist() for g in got] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.known) == enc.count and not enc.stored


def test_pieces_met_again_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 60)
    enc, learnt = T.PieceEncoder(queries.tokenizer_path()), []
    monkeypatch.setattr(enc, "_learn", lambda pieces, learn=enc._learn: (learnt.extend(pieces), learn(pieces)))
    for k in range(8):
        text = " ".join(f"often rare{chr(97 + k)}{chr(97 + j)}" for j in range(24))
        assert enc.encode([text.encode()])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids
        assert len(enc.known) == enc.count
    assert len(learnt) > 3 * 60 and sum("often" in str(p) for p in learnt) == 2  # with and without a space before it


def test_a_wave_is_coded_in_one_step(monkeypatch):
    steps = []
    for name in ("put", "take"):
        monkeypatch.setattr(T._Coder, name, lambda self, *a, f=getattr(T._Coder, name), name=name: (steps.append(name), f(self, *a))[1])
    x = np.random.default_rng(2).integers(0, 300, 20_000).astype(np.uint32)
    assert np.array_equal(T.decode_block(T.encode_block(x, np.array([len(x)])))[0], x)
    waves = T._shape(len(x))[1]
    assert steps.count("put") == waves and steps.count("take") == waves


def test_carries_go_through_full_words():
    coder = T._Coder(2, 4)
    coder.out[:3], coder.lane[:3], coder.last[:3] = (5, 2**32 - 1, 9), (1, 1, 0), (-1, 0, -1)
    coder.newest[:], coder.fill = (2, 1), 3
    coder.low[:], coder.range[:] = (7, 2**64 - 5), 2**40
    coder.put(np.array([3, 3], np.uint64), np.array([1 << 31, 1 << 31], np.uint64))
    assert coder.out[:3].tolist() == [6, 0, 9] and coder.low.tolist() == [7 + 3 * 2**8, 3 * 2**8 - 5]


def test_long_rows_keep_a_share_for_each_id():
    rng = np.random.default_rng(4)
    x = np.where(rng.random(1_300_000) < 0.02, rng.integers(0, 5000, 1_300_000), 7).astype(np.uint32)
    data = T.encode_block(x, np.array([len(x)]))
    assert np.array_equal(T.decode_block(data)[0], x) and len(data) < 210_000  # 216,400 with two steps a wave
    rows = T._Rows(10)
    rows.keys, rows.counts = np.array([11, 12, 13, 25]), np.array([5_000_000, 1, 1, 3])
    rows._index()
    share = rows.end - rows.start
    assert share.min() > 0 and rows.end[[2, 3]].tolist() == [1 << T._LIT_BITS] * 2 and share[0] > 0.99 * (1 << T._LIT_BITS)


def test_simple_texts_are_told_at_once():
    enc = T.PieceEncoder(queries.tokenizer_path())
    texts = ["plain", "", "it's", "Größe é", "2×3", "6÷2", "\u0085", "日本", "Ā", "a<|endoftext|>b", "<|endof", "text|>"]
    assert enc._hard([t.encode() for t in texts]).tolist() == [0, 0, 1, 0, 1, 1, 1, 1, 1, 1, 0, 0]
    for t, ids in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == enc.tok.encode(t, add_special_tokens=False).ids
