import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochfold.llm import media as M


@given(st.binary(max_size=200_000))
@settings(max_examples=30, deadline=None)
def test_round_trip(data):
    payload = M.pad(data)
    assert len(payload) % 64 == 0 and payload[: len(data)] == data and len(payload) > 0
    stored = M.write(payload)
    assert M.payload_of(stored, M.parse(stored)) == payload


def test_cues_point_at_clusters_and_times_rise():
    stored = M.write(bytes(range(256)) * 2000)
    found = M.parse(stored)
    assert len(found["cues"]) == found["clusters"] > 1
    assert all(stored[p : p + 4] == M.CLUSTER.to_bytes(4, "big") for _, _, p in found["cues"])
    times = [p[2] for p in found["packets"]]
    assert times == sorted(times)


def block(lacing: int, head: bytes, frames: list[bytes]) -> bytes:
    data = M._vint(1) + struct.pack(">hB", 7, lacing << 1) + head + b"".join(frames)
    cluster = M._element(M.CLUSTER, M._uint(M.CLUSTER_TIME, 1000) + M._element(M.BLOCK_GROUP, M._element(M.BLOCK, data)))
    return M._element(M.EBML, b"") + M._element(M.SEGMENT, cluster)


def test_all_lacings():
    frames = [b"a" * 300, b"b" * 5, b"c" * 70]
    xiph = bytes([2, 255, 45, 5])
    ebml = bytes([2]) + M._vint(300) + M._vint(5 - 300 + 8191, 2)
    for lacing, head in ((M.XIPH, xiph), (M.EBML_LACING, ebml)):
        file = block(lacing, head, frames)
        got = M.parse(file)["packets"]
        assert [file[p[4] : p[4] + p[5]] for p in got] == frames and [p[2] for p in got] == [1_007_000_000] * 3
    file = block(M.NO_LACING, b"", frames[:1])
    assert [p[5] for p in M.parse(file)["packets"]] == [300]


def test_unknown_size_and_damage():
    stored = M.write(M.pad(b"x" * 1000))
    at = stored.index(M.SEGMENT.to_bytes(4, "big")) + 4
    width = 9 - stored[at].bit_length()
    unknown = stored[:at] + b"\x01" + b"\xff" * 7 + stored[at + width :]
    assert M.payload_of(unknown, M.parse(unknown)) == M.pad(b"x" * 1000)
    with pytest.raises(ValueError):
        M.parse(stored[:-3])


def test_query_rows(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 500_000, "a", "a\x00"]
    df = spark.createDataFrame([(i if i != 6 else None, t, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, feature double")
    out = M.digests(df).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[6 if r.doc_id is None else r.doc_id] or "").encode()
        payload = M.pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(M.write(payload)), hashlib.sha256(M.write(payload)).hexdigest())
    assert M.digests(df.limit(0)).count() == 0
    table = M.packets(M.encode(df), ["doc_id"]).where("doc_id = 4").collect()
    assert [(p.track, p.length, p.error) for p in table] == [(1, 64, None)]
    bad = spark.createDataFrame([(1, b"\x00\x01"), (2, None), (3, b"")], "doc_id long, media binary")
    assert [r.doc_id for r in M.packets(bad, ["doc_id"]).where("error is not null").collect()] == [1]


def test_clusters_of_unknown_size_and_times_of_laced_frames():
    stored = M.write(M.pad(bytes(range(256)) * 600))
    want = M.parse(stored)
    assert want["clusters"] == 3
    assert [p[2] for p in want["packets"]] == [k * 1_000_000 for k in range(len(want["packets"]))]
    parts, at = [], 0
    for a, b in [(a, b) for i, a, b in M.elements(stored, *next((x, y) for k, x, y in M.elements(stored, 0, len(stored)) if k == M.SEGMENT)) if i == M.CLUSTER]:
        head = stored.rindex(M.CLUSTER.to_bytes(4, "big"), 0, a)
        parts += [stored[at : head + 4], b"\x01" + b"\xff" * 7, stored[a:b]]
        at = b
    live = b"".join([*parts, stored[at:]])
    seg = live.index(M.SEGMENT.to_bytes(4, "big")) + 4
    live = live[:seg] + b"\x01" + b"\xff" * 7 + live[seg + 9 - live[seg].bit_length() :]
    got = M.parse(live)
    assert got["clusters"] == 3 and [p[2] for p in got["packets"]] == [p[2] for p in want["packets"]]
    assert M.payload_of(live, got) == M.payload_of(stored, want)


def test_a_file_of_one_packet_byte_by_byte():
    """The whole file, put together by hand from the format's description."""
    payload = bytes(range(64))
    text = lambda x: bytes.fromhex(x.replace(" ", ""))
    head = text("1A45DFA3 A3 4286 81 01 42F7 81 01 42F2 81 04 42F3 81 08 4282 88 6D6174726F736B61 4287 81 04 4285 81 02")
    info = text("1549A966 9F 2AD7B1 83 0F4240 4D80 89") + b"epochfold" + text("5741 89") + b"epochfold"
    track = text("D7 81 01 73C5 81 01 83 81 02 23E383 83 0F4240 86 8D") + b"A_PCM/INT/LIT" + text("E1 91 B5 88 40EF400000000000 9F 81 01 6264 81 08")
    tracks = text("1654AE6B B5 AE B3") + track
    cluster = text("1F43B675 C9 E7 81 00 A3 C4 81 0000 80") + payload
    at = len(info) + len(tracks)
    cues = text("1C53BB6B 8D BB 8B B3 81 00 B7 86 F7 81 01 F1 81") + bytes([at])
    body = info + tracks + cluster + cues
    size = len(body).to_bytes(2, "big")
    want = head + text("18538067") + bytes([size[0] | 0x40, size[1]]) + body
    assert M.write(payload) == want
