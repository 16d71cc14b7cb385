"""Media columns: Matroska files in a column, parsed into packet tables with timestamps, tracks and byte ranges.

The writer stores bytes losslessly as 8-bit PCM in one audio track: clusters of laced SimpleBlocks, with cues. The parser
takes any file of EBML elements: it walks the segment, reads tracks, clusters and blocks with all four lacings, and cues.
Both work on one file at a time, inside the executors.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, CUE, CUE_TRACK = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7
DOC_TYPE, TIMESTAMP_SCALE, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, RATE, CHANNELS, DEPTH, CLUSTER_TIME = 0x4282, 0x2AD7B1, 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264, 0xE7
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUE_TIME, CUE_TRACK_NUMBER, CUE_POSITION = 0xA3, 0xA0, 0xA1, 0xB3, 0xF7, 0xF1
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_VERSION, DOC_READ_VERSION, MUXING_APP, WRITING_APP = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285, 0x4D80, 0x5741
DEFAULT_DURATION, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x23E383, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Ids that end an element of unknown size: those of files and segments, and inside a segment its own parts.
OUTER = frozenset((EBML, SEGMENT))
PARTS = OUTER | {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}

#: Samples a second, bytes in a packet, packets in a block, blocks in a cluster.
SAMPLE_RATE, PACKET, LACE, BLOCKS = 64_000, 64, 16, 64
UNIT = 64


def _vint(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones of a width mean an unknown size, so they are never used."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(id_: int, data: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + _vint(len(data)) + data


def _uint(id_: int, n: int) -> bytes:
    return _element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """data with bytes 0 up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit if data else unit)


def write(payload: bytes) -> bytes:
    """A Matroska file that holds payload (a multiple of 64 bytes) as unsigned 8-bit mono samples."""
    # blocks without a group need version 2 of the format
    limits = _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8)
    head = _element(EBML, limits + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"epochfold") + _element(WRITING_APP, b"epochfold"))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, PACKET * 1_000_000_000 // SAMPLE_RATE) + _element(CODEC, b"A_PCM/INT/LIT") + audio
    parts = [info, _element(TRACKS, _element(TRACK, track))]
    at, cues = sum(map(len, parts)), []
    step = PACKET * LACE
    for c in range(0, len(payload), step * BLOCKS):
        time = c * 1000 // SAMPLE_RATE
        body = [_uint(CLUSTER_TIME, time)]
        for b in range(c, min(c + step * BLOCKS, len(payload)), step):
            data = payload[b : b + step]
            frames = len(data) // PACKET
            lacing = FIXED if frames > 1 else NO_LACING
            lead = _vint(1) + struct.pack(">hB", b * 1000 // SAMPLE_RATE - time, 0x80 | lacing << 1) + (bytes([frames - 1]) if lacing else b"")
            body.append(_element(SIMPLE_BLOCK, lead + data))
        cues.append(_element(CUE, _uint(CUE_TIME, time) + _element(CUE_TRACK, _uint(CUE_TRACK_NUMBER, 1) + _uint(CUE_POSITION, at))))
        parts.append(_element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(parts))


def _number(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length number and the offset after it; -1 for the unknown size."""
    if at >= end or data[at] == 0:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def _unknown_end(data: bytes, at: int, end: int, id_: int) -> int:
    """Where an element of unknown size ends: before the first element that can't stand inside it."""
    stops = OUTER if id_ == SEGMENT else PARTS
    while at < end:
        child, after = _number(data, at, end, keep_marker=True)
        if child in stops:
            return at
        n, after = _number(data, after, end)
        at = _unknown_end(data, after, end, child) if n < 0 else after + n
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the data of each element in a range."""
    while at < end:
        id_, at = _number(data, at, end, keep_marker=True)
        n, at = _number(data, at, end)
        stop = _unknown_end(data, at, end, id_) if n < 0 else at + n
        if stop > end:
            raise ValueError(f"element {id_:x} at byte {at} reaches beyond its parent")
        yield id_, at, stop
        at = stop


def _value(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError(f"no lace head at byte {at}")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError(f"{end - at} bytes in {n} equal frames")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"cut off at byte {at}")
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
        elif k == 0:
            size, at = _number(data, at, end)
        else:
            width = 9 - data[at].bit_length()
            delta, at = _number(data, at, end)
            size = sizes[-1] + (delta if delta >= 0 else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("frames beyond their block")
    return [*sizes, last], at


def parse(data: bytes) -> dict:
    """tracks, cues, and packets: (track, cluster, time in nanoseconds, frame in its block, start, length).

    The frames of a block follow each other by their track's duration of a frame; where it has none they share its time.
    """
    out: dict = {"scale": 1_000_000, "tracks": {}, "cues": [], "packets": [], "clusters": 0}

    def block(a: int, b: int, time: int) -> None:
        track, at = _number(data, a, b)
        if at + 3 > b:
            raise ValueError(f"block cut off at byte {a}")
        rel, flags = struct.unpack_from(">hB", data, at)
        sizes, at = _lace_sizes(data, at + 3, b, flags >> 1 & 3)
        for k, n in enumerate(sizes):
            out["packets"].append((track, out["clusters"] - 1, time + rel, k, at, n))
            at += n

    for top, a, b in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for id_, c, d in elements(data, a, b):
            if id_ == INFO:
                out["scale"] = next((_value(data, x, y) for k, x, y in elements(data, c, d) if k == TIMESTAMP_SCALE), out["scale"])
            elif id_ == TRACKS:
                for k, x, y in elements(data, c, d):
                    if k == TRACK:
                        own = {i: (p, q) for i, p, q in elements(data, x, y)}
                        sound = {i: (p, q) for i, p, q in elements(data, *own[AUDIO])} if AUDIO in own else {}
                        out["tracks"][_value(data, *own[TRACK_NUMBER])] = {"codec": data[slice(*own.get(CODEC, (0, 0)))].decode(), "depth": _value(data, *sound.get(DEPTH, (0, 0))), "frame_ns": _value(data, *own.get(DEFAULT_DURATION, (0, 0)))}
            elif id_ == CLUSTER:
                out["clusters"] += 1
                time = 0
                for k, x, y in elements(data, c, d):
                    if k == CLUSTER_TIME:
                        time = _value(data, x, y)
                    elif k == SIMPLE_BLOCK:
                        block(x, y, time)
                    elif k == BLOCK_GROUP:
                        for k2, x2, y2 in elements(data, x, y):
                            if k2 == BLOCK:
                                block(x2, y2, time)
            elif id_ == CUES:
                for k, x, y in elements(data, c, d):
                    if k == CUE:
                        own = {i: (p, q) for i, p, q in elements(data, x, y)}
                        inner = {i: (p, q) for i, p, q in elements(data, *own[CUE_TRACK])}
                        out["cues"].append((_value(data, *own[CUE_TIME]), _value(data, *inner[CUE_TRACK_NUMBER]), a + _value(data, *inner[CUE_POSITION])))
    frame_ns = {t: own["frame_ns"] for t, own in out["tracks"].items()}
    out["packets"] = [(t, c, ticks * out["scale"] + k * frame_ns.get(t, 0), k, at, n) for t, c, ticks, k, at, n in out["packets"]]
    return out


def payload_of(data: bytes, found: dict, track: int = 1) -> bytes:
    return b"".join(data[p[4] : p[4] + p[5]] for p in found["packets"] if p[0] == track)


def digest(text: str | None) -> tuple:
    """The row of one text: written, read back from the stored bytes, and described."""
    raw = (text or "").encode()
    stored = write(pad(raw))
    found = parse(stored)
    got = payload_of(stored, found)
    packets, cues = found["packets"], found["cues"]
    cued = all(data_id == CLUSTER for data_id in (int.from_bytes(stored[p : p + 4], "big") for _, _, p in cues))
    feature = f"{found['tracks'][1]['codec']};depth={found['tracks'][1]['depth']};packets={len(packets)};clusters={found['clusters']};cues={len(cues)}{'' if cued else '!'};last_ms={packets[-1][2] // 1_000_000};mean={sum(got) / len(got):.4f}"
    return len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


DIGEST = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """docs with the texts' files as a binary column; a null text counts as empty."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write(pad((t or "").encode())))

    return docs.withColumn(out_col, run(F.col(text_col)))


def packets(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The packet table: keep's columns, track, cluster, timestamp_ns, frame, start and length, a row for each packet.

    A null or empty file has none; bytes that aren't a whole file give one row with error, and no packets.
    """
    kind = "array<struct<track:bigint,cluster:bigint,timestamp_ns:bigint,frame:int,start:bigint,length:bigint,error:string>>"

    @F.pandas_udf(kind)
    def run(files: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> list[dict]:
            try:
                found = parse(data or b"")
            except (ValueError, KeyError, UnicodeDecodeError, struct.error) as e:
                return [{"error": str(e)}]
            return [{"track": t, "cluster": c, "timestamp_ns": ns, "frame": k, "start": a, "length": n} for t, c, ns, k, a, n in found["packets"]]

        return files.map(one)

    return media.select(*keep, F.explode(run(F.col(media_col))).alias("_p")).select(*keep, "_p.*")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs with what its file holds, read back from the stored bytes.

    Defined cases: a null text counts as empty, and an empty one is a unit of zeros; equal texts give equal values; a
    null id, repeated rows and an empty table need nothing special; other columns of docs are not read.
    """
    kinds = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = [digest(t) for t in batch.column(1).to_pylist()]
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["id", *DIGEST])

    long, text = pa.int64(), pa.string()
    types = [long, long, text, long, long, text, text]
    C.small_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {kinds}").withColumnRenamed("id", id_col)
