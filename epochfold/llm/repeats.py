"""Removal of repeated passages by prefix-free parsing: phrases, a dictionary of them, and suffix orders of both sides.

Rolling-hash triggers cut every text into phrases. A modulus alone can leave a long stretch without a trigger, so the
trigger of a position is the smallest hash of 8 bytes among the next 256 (the leftmost of equal ones): it depends on the
400 bytes from that position alone, and no stretch lacks one. All positions with the same trigger form a phrase; its
span reaches from its first position to the end of its last position's 400 bytes. Every string of 400 bytes thus has
one trigger, 0 to 255 bytes after its start, and contains the 145 bytes from there (its context).

Strings can only be equal if their contexts are. So phrases are counted by context first, and only counts are shuffled:
a context that stands once rules its phrases out, and one with a single distinct span settles them all. What is left
is the dictionary of distinct spans of contexts with several, each once. In a context's group, the spans' left sides,
read backwards, and right sides are sorted (the suffix order of the dictionary, and the order of what follows it in the
parse), with the lengths of common prefixes; two strings s bytes before a trigger are equal exactly if the left sides
share s bytes and the right sides 255 - s. Bytes are compared, not hashes, but for the 64-bit keys of context and span.

A context of very many distinct spans is not gathered: its strings are counted by a 128-bit key instead, with the same
result.

Passages of PASSAGE words are told as well, though they may be shorter than 400 bytes: strings of so many words
(A-Z lower-cased, whatever spaces stand between) that also stand in another document. They are found in the same way,
with words for bytes: the trigger of such a string is the smallest hash of its runs of ANCHOR words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C
from epochfold.llm import word_hashes as W

LENGTH, GRAM, WINDOW = 400, 8, 256
CONTEXT = LENGTH - (WINDOW - 1)
SIDE = WINDOW - 1
#: Contexts with more distinct spans than this are counted string by string; spans that are matched at once.
GIANT, BATCH = 20_000, 8_000
#: Words of a passage, and of the runs among which its trigger is chosen.
PASSAGE, ANCHOR = 50, 26
#: Up to so many rows of 16 bytes, a table is broadcast.
FEW = 500_000
#: Bytes of a text that are cut at once; the rest follows with an overlap, so nothing is lost.
SEGMENT = 1 << 26
_POSITION = np.uint64((1 << 27) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def phrases(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, last position and trigger of each phrase; nothing for fewer than 400 bytes."""
    out = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
        part = raw[at : at + SEGMENT + LENGTH - 1]
        grams = np.ndarray((len(part) - GRAM + 1,), "<u8", part, strides=(1,))
        v = grams * _MIX
        v ^= v >> np.uint64(29)
        v *= _MIX
        v &= ~_POSITION
        v |= np.arange(len(v), dtype=np.uint64)
        step = 1
        while step < WINDOW:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        trigger = (v[: len(part) - LENGTH + 1] & _POSITION).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(trigger) - 1]])
        out.append((first + at, last + at, trigger[first] + at))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _slices(batches, rows: int = 256):
    """Batches cut small, so that what a worker makes of one stays small beside it."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _cut(batches):
    """(k, text) -> a row for each phrase: k, lo, n (positions after the first), o (trigger's offset), context and span keys."""
    for b in _slices(batches):
        rows = []
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            lo, hi, q = phrases(raw)
            if len(lo):
                key = xxhash.xxh3_64_intdigest
                ctx = _signed([key(raw[x : x + CONTEXT]) for x in q.tolist()])
                span = _signed([key(raw[x : y + LENGTH]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
                rows.append((np.full(len(lo), k, np.int64), lo, (hi - lo).astype(np.int32), (q - lo).astype(np.int32), ctx, span))
        if rows:
            cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "lo", "n", "o", "ctx", "span"])


def _pack(batches):
    """(k, ..., text) with the text compressed, for the shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for b in _slices(batches):
        texts = pa.array([z.compress((t or "").encode()) for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*b.schema.names[:-1], "z"])


def _sides(batches):
    """(k, z, at: the phrases wanted) -> a row for each with the bytes before its trigger and after its context."""
    for b in _slices(batches):
        z = zstandard.ZstdDecompressor()
        out = []
        for k, packed, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = z.decompress(packed)
            for w in wanted:
                q = w["lo"] + w["o"]
                out.append((w["ctx"], w["once"], w["giant"], k, w["lo"], w["n"], w["o"], raw[w["lo"] : q], raw[q + CONTEXT : w["lo"] + w["n"] + LENGTH]))
        if out:
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            names = ["ctx", "once", "giant", "k", "lo", "n", "o", "left", "right"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _order(group: np.ndarray, sides: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place in the order by group and bytes, and the common prefix of each with the one before (-1: other group)."""
    lead = group.astype(">u4").view(np.uint8).reshape(len(group), 4)
    body = np.frombuffer(b"".join(s.ljust(SIDE, b"\0") for s in sides), np.uint8).reshape(len(sides), SIDE)
    rows = np.ascontiguousarray(np.concatenate([lead, body], axis=1))
    order = np.argsort(rows.view(f"S{4 + SIDE}").ravel(), kind="stable")
    ordered = rows[order]
    same = ordered[1:] == ordered[:-1]
    common = np.where(same.all(axis=1), SIDE, same.argmin(axis=1) - 4)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, np.concatenate([[-1], np.where(common < 0, -1, common)])


def match(group: np.ndarray, n: np.ndarray, o: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For distinct spans, which of their strings also start in another span of their group: (spans, offset before the trigger)."""
    a, lcp_a = _order(group, [x[::-1] for x in left])
    b, lcp_b = _order(group, right)
    found = np.zeros((len(group), WINDOW), bool)
    for s in range(WINDOW):
        own = np.flatnonzero((s <= o) & (s >= o - n))
        if len(own) < 2:
            continue
        keys = np.cumsum(lcp_a < s)[a[own]] * (len(group) + 1) + np.cumsum(lcp_b < SIDE - s)[b[own]]
        order = np.argsort(keys)
        k = keys[order]
        twin = np.zeros(len(k), bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
        found[own[order[twin]], s] = True
    return found


def _ranges(k, lo, o, found) -> list[tuple[int, int, int]]:
    """(k, first, end) of the bytes that runs of found strings cover."""
    out = []
    for i in range(len(k)):
        hits = np.flatnonzero(found[i])
        if len(hits):
            starts = np.sort(lo[i] + o[i] - hits)
            breaks = np.flatnonzero(np.diff(starts) > 1)
            for x, y in zip(starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])], strict=True):
                out.append((int(k[i]), int(x), int(y) + LENGTH))
    return out


def _match_groups(batches):
    """Rows sorted by context -> ranges (k, a, b) of spans that stand once; groups may reach over batches."""

    def work(rows):
        t = pa.Table.from_batches(rows)
        ctx, once = t.column("ctx").to_numpy(), t.column("once").to_numpy()
        k, lo, n, o = (t.column(c).to_numpy() for c in ("k", "lo", "n", "o"))
        group = np.concatenate([[0], np.cumsum(ctx[1:] != ctx[:-1])])
        found = match(group, n, o, t.column("left").to_pylist(), t.column("right").to_pylist())
        return _batch(_ranges(k[once], lo[once], o[once], found[once]))

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ctx = b.column("ctx").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(ctx[1:] != ctx[:-1]) + 1
        if held and held[-1].column("ctx")[-1].as_py() != ctx[0]:
            edges = np.concatenate([[0], edges])
        at = 0
        for e in edges.tolist():
            if size + e - at >= BATCH:
                held.append(b.slice(at, e - at))
                yield work(held)
                held, size, at = [], 0, e
        held.append(b.slice(at))
        size += b.num_rows - at
    if held:
        yield work(held)


def _batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["k", "a", "b"])


def _strings(batches):
    """Each string of giant groups' spans by a 128-bit key: ctx, h1, h2, k, p, once."""
    for b in _slices(batches):
        out = []
        for r in b.to_pylist():
            for s in range(max(0, r["o"] - r["n"]), r["o"] + 1):
                h = xxhash.xxh3_128_intdigest(r["left"][len(r["left"]) - s :] + b"|" + r["right"][: SIDE - s] + s.to_bytes(2, "big"))
                out.append((r["ctx"], h >> 64, h & ((1 << 64) - 1), r["k"], r["lo"] + r["o"] - s, r["once"]))
        if out:
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(_signed(c[1])), pa.array(_signed(c[2])), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.bool_())], names=["ctx", "h1", "h2", "k", "p", "once"])


def _cover(raw: bytes, ranges) -> np.ndarray:
    mask = np.zeros(len(raw) + 1, np.int32)
    if ranges:
        np.add.at(mask, [r["a"] for r in ranges], 1)
        np.add.at(mask, [r["b"] for r in ranges], -1)
    return np.cumsum(mask[:-1]) > 0


def _removed(with_text: bool):
    def run(batches):
        for b in _slices(batches):
            z = zstandard.ZstdDecompressor()
            out = []
            for k, ranges, passages, words, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = z.decompress(packed)
                gone = _cover(raw, ranges)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                edges = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
                out.append((k, len(raw), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), passages, words, *((kept,) if with_text else ())))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words", *["kept"] * with_text])

    return run


def repeated_ranges(keyed: DataFrame, giant: int = GIANT) -> DataFrame:
    """keyed(k, text), k unique -> (k, a, b): byte ranges whose union is what repeated strings cover."""
    cut = C.stash(keyed.mapInArrow(_cut, "k long, lo long, n int, o int, ctx long, span long"), "repeats-phrases")
    # stored, so that the join below shuffles both sides for itself and a hot context can be split
    seen = C.stash(cut.groupBy("ctx").agg(F.count("*").alias("c"), (F.min("span") != F.max("span")).alias("mixed")).where("c > 1").select("ctx", "mixed"), "repeats-seen")
    again = C.stash(cut.join(seen, "ctx"), "repeats-again")
    whole = again.where("NOT mixed").select("k", F.col("lo").alias("a"), (F.col("lo") + F.col("n") + LENGTH).alias("b"))
    mixed = again.where("mixed")
    spans = mixed.groupBy("ctx", "span").agg(F.count("*").alias("c"), F.min(F.struct("k", "lo", "n", "o")).alias("at"))
    spans = C.stash(spans, "repeats-spans")
    # a span that stands twice is repeated as a whole, wherever it stands; sent to the rows, which a hot span holds many of
    often = spans.where("c > 1").select("ctx", "span")
    twice = C.stash(mixed.join(F.broadcast(often) if often.count() <= FEW else often, ["ctx", "span"], "left_semi"), "repeats-twice")
    twice = twice.select("k", F.col("lo").alias("a"), (F.col("lo") + F.col("n") + LENGTH).alias("b"))
    per = spans.groupBy("ctx").agg((F.count("*") > giant).alias("giant"), (F.min("c") == 1).alias("open"))
    wanted = spans.join(per.where("open"), "ctx").select("at.k", F.struct("ctx", (F.col("c") == 1).alias("once"), "giant", "at.lo", "at.n", "at.o").alias("w"))
    wanted = wanted.groupBy("k").agg(F.collect_list("w").alias("at"))
    packed = keyed.select("k", "text").mapInArrow(_pack, "k long, z binary")
    sides = packed.join(wanted, "k").select("k", "z", "at").mapInArrow(_sides, "ctx long, once boolean, giant boolean, k long, lo long, n int, o int, left binary, right binary")
    sides = C.stash(sides, "repeats-sides")
    groups = sides.where("NOT giant").repartition("ctx").sortWithinPartitions("ctx").mapInArrow(_match_groups, "k long, a long, b long")
    strings = sides.where("giant").mapInArrow(_strings, "ctx long, h1 long, h2 long, k long, p long, once boolean")
    counted = strings.groupBy("ctx", "h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    single = strings.where("once").join(counted, ["ctx", "h1", "h2"], "left_semi").select("k", F.col("p").alias("a"), (F.col("p") + LENGTH).alias("b"))
    return whole.unionByName(twice).unionByName(groups).unionByName(single)


def _word_phrases(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One text's word hashes to its strings of PASSAGE words, each by its hash, and its phrases: runs of strings with one trigger.

    strings, and for each phrase its first string, its trigger, and the hash of its strings (its span).
    """
    if len(h) < PASSAGE:
        return (np.empty(0, np.int64),) * 4
    v, width, left = W.runs(h, ANCHOR), 1, PASSAGE - ANCHOR + 1
    while width < left:
        step = min(width, left - width)
        v = np.minimum(v[:-step], v[step:])
        width += step
    strings = W.runs(h, PASSAGE)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    place = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
    span = W.mixed(np.add.reduceat(strings * W.powers(place.max() + 1)[place], first))
    return strings.view(np.int64), first, v[first].view(np.int64), span.view(np.int64)


def _anchors(batches):
    """(k, text) -> k and the trigger and span of each phrase, once each."""
    for b, raws in W.slices(batches):
        h, at = W.word_hashes(raws)
        own = []
        for x, y in zip(at[:-1], at[1:], strict=True):
            _, _, trigger, span = _word_phrases(h[x:y])
            once = np.unique(W.mixed(trigger.view(np.uint64)) + span.view(np.uint64), return_index=True)[1]
            own.append((trigger[once], span[once]))
        k = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(t) for t, _ in own])
        every = [np.concatenate(c) for c in zip(*own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k, *every)], names=["k", "anchor", "span"])


def _passage_strings(batches):
    """(k, z, at: anchor, span, whole, each) -> rows (k, anchor, h, at: first words).

    A whole phrase stands in another document as it is: one row for all its strings, without h. Of an each phrase, a row
    for each distinct string.
    """
    for b in _slices(batches):
        z = zstandard.ZstdDecompressor()
        ks, anchors, hashes, places = [], [], [], []
        for k, packed, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            strings, first, trigger, span = _word_phrases(W.word_hashes([z.decompress(packed)])[0])
            ask = {(w["anchor"], w["span"]): w for w in wanted}
            own: dict = {}
            for x, y, key in zip(first.tolist(), [*first[1:].tolist(), len(strings)], zip(trigger.tolist(), span.tolist(), strict=True), strict=True):
                w = ask.get(key)
                if w and w["whole"]:
                    own.setdefault((key[0], None), []).extend(range(x, y))
                if w and w["each"]:
                    for i, s in enumerate(strings[x:y].tolist(), x):
                        own.setdefault((key[0], s), []).append(i)
            for (anchor, s), at in own.items():
                ks.append(k)
                anchors.append(anchor)
                hashes.append(s)
                places.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(anchors, pa.int64()), pa.array(hashes, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["k", "anchor", "h", "at"])


def repeated_passages(keyed: DataFrame) -> DataFrame:
    """keyed(k, text), k unique -> (k, n_passages, passage_words) of texts that hold PASSAGE words of another one.

    A span that two documents hold is settled as a whole. Where a trigger also has spans of one document alone, their
    strings are compared one by one, with those of two documents for each shared span.
    """
    phrases = C.stash(keyed.mapInArrow(_anchors, "k long, anchor long, span long"), "repeats-anchors")
    ends = lambda df, *keys: df.groupBy(*keys).agg(F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    common = C.stash(ends(phrases, "anchor").where("_lo <> _hi").select("anchor"), "repeats-common")
    # stored before they are gathered, so that the rows of a hot trigger can be split in the joins
    again = C.stash(phrases.join(common, "anchor", "left_semi"), "repeats-shared")
    spans = C.stash(ends(again, "anchor", "span").withColumn("whole", F.col("_lo") != F.col("_hi")), "repeats-kinds")
    mixed = C.stash(spans.where("NOT whole").select("anchor").distinct(), "repeats-mixed")
    spans = spans.join(mixed.withColumn("_mixed", F.lit(True)), "anchor", "left")
    spans = C.stash(spans.select("anchor", "span", "whole", "_lo", "_hi", F.coalesce("_mixed", F.lit(False)).alias("_mixed")), "repeats-kinds")
    each = F.col("_mixed") & F.col("k").isin(F.col("_lo"), F.col("_hi"))
    wanted = C.stash(again.join(spans, ["anchor", "span"]).select("k", F.struct("anchor", "span", "whole", each.alias("each")).alias("w")), "repeats-wanted")
    wanted = wanted.groupBy("k").agg(F.collect_list("w").alias("at"))
    packed = keyed.select("k", "text").mapInArrow(_pack, "k long, z binary")
    strings = packed.join(wanted, "k").select("k", "z", "at").mapInArrow(_passage_strings, "k long, anchor long, h long, at array<int>")
    strings = C.stash(strings, "repeats-strings")
    twice = C.stash(ends(strings.where("h IS NOT NULL"), "anchor", "h").where("_lo <> _hi").select("anchor", "h"), "repeats-passages")
    found = C.stash(strings.join(twice, ["anchor", "h"], "left_semi").select("k", "at"), "repeats-held").unionByName(strings.where("h IS NULL").select("k", "at"))
    found = found.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("_at"))
    gaps = F.transform("_at", lambda x, i: F.when(i == 0, F.lit(PASSAGE + 1)).otherwise(x - F.get("_at", i - 1)))
    n = F.aggregate("_gaps", F.lit(0).cast("long"), lambda a, g: a + F.when(g > PASSAGE, 1).otherwise(0))
    words = F.aggregate("_gaps", F.lit(0).cast("long"), lambda a, g: a + F.least(g, F.lit(PASSAGE)))
    return found.select("k", gaps.alias("_gaps")).select("k", n.alias("n_passages"), words.alias("passage_words"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, with_text: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_words (and kept, the
    remaining bytes).

    A byte goes if a 400-byte string that covers it also starts anywhere else, in any document or the same one. Passages
    are told, not removed: passage_words are the words covered by strings of 50 words that another document holds too,
    n_passages their maximal runs.

    Defined cases: a null text counts as empty; texts under 400 bytes keep everything; repeated rows are documents each,
    so they are each other's copies; ids that are null, repeat or aren't integers are replaced inside by row numbers of
    a stored copy; an empty table gives an empty result; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    plain = dict(base.dtypes)["_id"] in ("bigint", "int", "smallint", "tinyint")
    if plain and base.groupBy("_id").count().where("count > 1 OR _id IS NULL").isEmpty():
        keyed, own = base.select(F.col("_id").cast("long").alias("k"), "text"), None
    else:
        own = C.stash(base.withColumn("k", F.monotonically_increasing_id()), "repeats-rows")
        keyed = own.select("k", "text")
    ranges = repeated_ranges(keyed, giant).groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    known = ranges.join(repeated_passages(keyed), "k", "full")
    packed = keyed.mapInArrow(_pack, "k long, z binary")
    kinds = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long" + ", kept binary" * with_text
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_passages", "passage_words")]
    out = packed.join(known, "k", "left").select("k", "ranges", *none, "z").mapInArrow(_removed(with_text), kinds)
    if own is None:
        return out.withColumn("k", F.col("k").cast(dict(base.dtypes)["_id"])).withColumnRenamed("k", id_col)
    return out.join(own.select("k", F.col("_id").alias(id_col)), "k").select(id_col, *out.columns[1:])
