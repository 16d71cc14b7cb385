"""Token ids in files of independent blocks, coded by an adaptive context-mixing range coder.

Ids are coded in blocks of whole documents. A block is cut into lanes of equal length that are coded side by side, a
wave of one id a lane at a time, each with a range coder of its own; the model is the block's. It counts which ids
followed the id before (order 1) and all ids (order 0), and keeps for the two ids before (order 2, by a hash) the id
that followed them most lately with its hits less its misses. A mix, chosen by that count, by how often the order-1
context was met and among how many ids it shares its counts, and learnt from what it led to, gives the shares of "the id
that order 2 says", "one that order 1 has met here" and "another"; the last two are coded by their shares in that order's
counts. All of it is learnt from ids already coded, in lessons after 1, 4, 16 ... waves, so a decoder follows along. A
block starts afresh, holds its own lengths, and ends in a checksum of its ids.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochfold.llm import common as C

#: Ids in a block at most, but for a single longer document; ids in a lane at least; most lanes; waves between lessons.
BLOCK, LANE, LANES, LESSON = 1 << 21, 256, 4096, 256
#: Bits of a mix's share, of an id's share in it, and of both; a range is 1 << _BITS at least. Bits of an order-2 slot.
_MIX_BITS, _LIT_BITS, _BITS, _SLOT_BITS = 12, 20, 32, 18
#: Parts of an order-1 row's guide for each id in it.
_FINE = 2
#: Bits of order 0's guide, and where the parts of a share and of a row start in their number.
_GUIDE_BITS, _ID_BITS, _START_AT, _PARTS_AT, _FIRST_AT = 18, 17, 37, 5, 26
#: Waves that are told at once: few enough for the processor's own memory.
WAVES = 16
#: Borders of how often a row was met, and of how many ids share it, between which its sureness is kept apart.
_MET, _SHARED = np.array([2, 4, 16, 64]), np.array([2, 8])
_SURE, _MOST = 2 + len(_MET) * 3 + len(_SHARED), 4
MOST_ID = (1 << _ID_BITS) - 1
_HEAD = struct.Struct("<4sIIIII")
_MAGIC = b"CMR2"


class _Coder:
    """Range coders side by side: 64-bit low and range, words of 32 bits, carries taken into words already out.

    Words lie in the order in which a decoder asks for them: two of each lane, then wave by wave those of the lanes
    whose range has become small.
    """

    def __init__(self, lanes: int, steps: int, words: np.ndarray | None = None):
        self.lanes = lanes
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        if words is None:
            self.low = np.zeros(lanes, np.uint64)
            # words in the order they go out, the lane of each, and the lane's word before it
            self.out, self.lane, self.last = (np.empty(lanes * steps, t) for t in (np.uint32, np.uint16, np.int32))
            self.newest, self.fill = np.full(lanes, -1, np.int32), 0
        else:
            if len(words) < 2 * lanes:
                raise ValueError("block cut off")
            first = words[: 2 * lanes].astype(np.uint64).reshape(2, lanes)
            self.words, self.at, self.code = words, 2 * lanes, first[0] << np.uint64(32) | first[1]

    def put(self, start: np.ndarray, freq: np.ndarray) -> None:
        r = self.range >> np.uint64(_BITS)
        low = start * r
        low += self.low
        at = self.newest[low < self.low]
        while len(at):
            self.out[at] += np.uint32(1)
            at = self.last[at[self.out[at] == 0]]
        self.low, self.range = low, r * freq
        full = np.flatnonzero(self.range < np.uint64(1 << 32))
        if len(full):
            new = slice(self.fill, self.fill + len(full))
            self.out[new], self.lane[new], self.last[new] = low[full] >> np.uint64(32), full, self.newest[full]
            self.newest[full] = np.arange(new.start, new.stop)
            self.fill = new.stop
            low[full] <<= np.uint64(32)
            self.range[full] <<= np.uint64(32)

    def finish(self) -> np.ndarray:
        order = np.argsort(self.lane[: self.fill], kind="stable")
        held = np.bincount(self.lane[: self.fill], minlength=self.lanes)
        ends = np.cumsum(held + 2)
        by_lane = np.empty(self.fill + 2 * self.lanes, np.uint32)
        place = np.arange(self.fill) + 2 * np.repeat(np.arange(self.lanes), held)
        by_lane[place] = self.out[order]
        by_lane[ends - 2], by_lane[ends - 1] = self.low >> np.uint64(32), self.low & np.uint64((1 << 32) - 1)
        first = ends - held - 2
        words = np.concatenate([by_lane[first], by_lane[first + 1], self.out[: self.fill]])
        words[2 * self.lanes + order] = by_lane[place + 2]  # a decoder is two words ahead
        return words

    def peek(self) -> np.ndarray:
        self.step = self.range >> np.uint64(_BITS)
        return np.minimum(self.code // self.step, np.uint64((1 << _BITS) - 1)).view(np.int64)

    def take(self, start: np.ndarray, freq: np.ndarray) -> None:
        self.code -= start.view(np.uint64) * self.step
        self.range = self.step * freq.view(np.uint64)
        full = np.flatnonzero(self.range < np.uint64(1 << 32))
        if len(full):
            self.code[full] = self.code[full] << np.uint64(32) | self.words[self.at : self.at + len(full)]
            self.at += len(full)
            self.range[full] <<= np.uint64(32)


class _Lookup:
    """Places of ascending keys: by two hash tables, and by a search of the few keys that found no slot of their own."""

    factors = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, keys: np.ndarray):
        self.tables = []
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        left = np.arange(len(keys), dtype=np.int32)
        for factor in self.factors:
            table, slot = np.full(1 << (64 - int(self.shift)), -1, np.int32), self._slot(keys[left], factor)
            table[slot] = left
            self.tables.append(table)
            left = left[table.take(slot) != left]
        self.rest, self.rest_keys = left, keys[left]

    def _slot(self, keys: np.ndarray, factor: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> self.shift).view(np.int64)

    def maybe(self, keys: np.ndarray, which: int) -> np.ndarray:
        """The one place where each key may stand by a table, or -1; who asks looks whether it does."""
        return self.tables[which].take(self._slot(keys, self.factors[which]))

    def others(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key that is in neither table, or -1."""
        if not len(self.rest):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.rest_keys, keys), len(self.rest) - 1)
        return np.where(self.rest_keys[at] == keys, self.rest[at], -1)


class _Rows:
    """Counts of ids by context: for each context a row of the ids that followed it, with their shares of the row.

    Built anew at each lesson from all (context, id) pairs so far; a row's shares add up to 1 << _LIT_BITS.
    """

    def __init__(self, size: int):
        self.size = size
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._index()

    def add(self, context: np.ndarray, ids: np.ndarray) -> None:
        keys = context * self.size
        keys += ids
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.diff(np.append(first, len(keys)))
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        self.counts[at[known]] += counts[known]
        new = ~known
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.counts = np.insert(self.counts, at[new], counts[new])
        self._index()

    def _index(self) -> None:
        context = self.keys // self.size
        self.first = first = np.flatnonzero(np.diff(context, prepend=-1))
        self.contexts = context[first]
        self.held = held = np.diff(np.append(first, len(context)))
        count = self.counts
        total = met = np.add.reduceat(count, first) if len(first) else count
        over = np.maximum(0, np.frexp(total)[1] - (_LIT_BITS - 1))
        if over.any():  # counts of a very long row are scaled, so that each id keeps a share
            count = np.maximum(1, count >> np.repeat(over, held))
            total = np.add.reduceat(count, first)
        end = np.cumsum(count)
        end -= np.repeat(end[first] - count[first], held)
        total = np.repeat(total, held)
        self.start = ((end - count) << _LIT_BITS) // total
        self.end = (end << _LIT_BITS) // total
        # sureness of a row: how often it was met, and how many ids share it
        self.sure = 1 + np.searchsorted(_MET, met, side="right") * 3 + np.searchsorted(_SHARED, held, side="right")
        self.id_of = self.keys - context * self.size


def _guide(start: np.ndarray, end: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """How many parts of its row start within each share, if the row is cut into so many equal parts."""
    return (end * parts + ((1 << _LIT_BITS) - 1) >> _LIT_BITS) - (start * parts + ((1 << _LIT_BITS) - 1) >> _LIT_BITS)


class _Model:
    """What a block has taught so far; the same on both sides. It is taught in lessons, between which it stands still.

    Shares of all ids lie in one table (share's start, its size less 1, id): the rows of order 1, then order 0, then one
    share of everything for what order 2 says. A row is told by where its guide starts and how many parts that has.
    """

    def __init__(self, size: int):
        self.size = size
        self.one = _Rows(size)
        self.says, self.count2 = np.zeros(1 << _SLOT_BITS, np.int32), np.zeros(1 << _SLOT_BITS, np.int32)
        self.counts = np.zeros(size, np.int64)
        self.hits = np.ones(((_MOST + 1) * _SURE, 3)) * [1, 1, 2]
        self._shares()

    def _shares(self) -> None:
        p = self.hits / self.hits.sum(axis=1, keepdims=True)
        f = np.maximum(1, (p * ((1 << _MIX_BITS) - 3)).astype(np.int64))
        f[:, 2] += (1 << _MIX_BITS) - f.sum(axis=1)
        edge = (np.cumsum(f, axis=1) - f) << _LIT_BITS
        self.share, self.edge = f.ravel(), edge.ravel()
        self.edge1, self.edge2 = edge[:, 1].copy(), edge[:, 2].copy()
        total, room = int(self.counts.sum()), (1 << _LIT_BITS) - self.size
        self.freq = np.ones(self.size, np.int64)
        if total:
            self.freq += (self.counts * (room / total)).astype(np.int64)
        self.freq[0] += (1 << _LIT_BITS) - int(self.freq.sum())
        end = np.cumsum(self.freq)
        self.start = end - self.freq
        one, ids = self.one, np.arange(self.size)
        n = self.zero = len(one.keys)
        self.table = np.empty(n + self.size + 1, np.int64)
        self.table[:n] = _share(one.start, one.end - one.start, one.id_of)
        self.table[n:-1] = _share(self.start, self.freq, ids)
        self.table[-1] = _share(0, 1 << _LIT_BITS, 0)
        self.rows = np.zeros(self.size, np.int64)  # 0 stands for no row
        self.rows[one.contexts] = _FINE * one.first << _FIRST_AT | _FINE * one.held << _PARTS_AT | one.sure
        self.whole = np.array([(_FINE * n + (1 << _GUIDE_BITS)) << _FIRST_AT | 1 << _PARTS_AT, 0, _FINE * n << _FIRST_AT | 1 << _GUIDE_BITS << _PARTS_AT])
        self.said = np.minimum(self.count2, _MOST) * np.int32(_SURE << _ID_BITS) | self.says
        self.places, self.guide = None, None

    def look(self, before2: np.ndarray, before1: np.ndarray) -> tuple[np.ndarray, ...]:
        """The order-2 slot, what it says, the order-1 row, and the mix."""
        slot = before2 * 0x9E3779B1
        slot ^= before1 * 0x85EBCA6B
        slot >>= 7
        slot &= (1 << _SLOT_BITS) - 1
        said, row = self.said.take(slot), self.rows.take(before1)
        return slot, said & MOST_ID, row, (said >> _ID_BITS) + (row & ((1 << _PARTS_AT) - 1))

    def tell(self, says: np.ndarray, row: np.ndarray, before1: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind, share) of ids: kind 0 where order 2 says the id, 1 where order 1 has met it, else 2."""
        kind = np.where(says == ids, 0, 2)
        share = np.full(len(ids), self.table[-1])
        left = np.flatnonzero(kind)
        self.places = self.places or _Lookup(self.one.keys)
        key, own, row = before1.take(left), ids.take(left), row.take(left)
        key *= self.size
        key += own
        first, held = row >> _FIRST_AT, row >> _PARTS_AT & ((1 << _FIRST_AT - _PARTS_AT) - 1)
        for find in (lambda k: self.places.maybe(k, 0), lambda k: self.places.maybe(k, 1), self.places.others):
            place = find(key)
            got = self.table.take(place)
            right = (got & MOST_ID) == own
            place = place * np.int64(_FINE) - first
            right &= (place >= 0) & (place < held)
            met = left[right]
            kind[met], share[met] = 1, got[right]
            wrong = np.flatnonzero(~right)
            left, key, own, first, held = left.take(wrong), key.take(wrong), own.take(wrong), first.take(wrong), held.take(wrong)
        share[left] = self.table.take(own + self.zero)
        return kind, share

    def find(self, row: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, start and size of the share of its row that holds v: from the guide for v's part of the row, onwards."""
        if self.guide is None:
            one, end = self.one, self.start + self.freq
            parts = [_guide(one.start, one.end, np.repeat(_FINE * one.held, one.held)), _guide(self.start, end, 1 << _GUIDE_BITS), [1]]
            self.guide = np.repeat(np.arange(len(self.table), dtype=np.int32), np.concatenate(parts))
        part = v * (row >> _PARTS_AT & ((1 << _FIRST_AT - _PARTS_AT) - 1))
        part >>= _LIT_BITS
        part += row >> _FIRST_AT
        at = self.guide.take(part)
        got = self.table.take(at)
        on = np.flatnonzero(v - (got >> _START_AT) > (got >> _ID_BITS & ((1 << _LIT_BITS) - 1)))
        if len(on):
            at, rest, new = at.take(on), v.take(on), got.take(on)
            go = np.arange(len(on))
            while len(go):
                at[go] += 1
                new[go] = own = self.table.take(at[go])
                go = go[rest[go] - (own >> _START_AT) > (own >> _ID_BITS & ((1 << _LIT_BITS) - 1))]
            got[on] = new
        return _parts(got)

    def told(self, v: np.ndarray) -> np.ndarray:
        """The id whose share of order 0 holds v."""
        return self.find(np.full(len(v), self.whole[2]), v)[0]

    def lesson(self, slot: np.ndarray, before1: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """at: three times the mix, and the kind."""
        self.one.add(before1, ids)
        self.counts += np.bincount(ids, minlength=self.size)
        self.hits += np.bincount(at, minlength=self.hits.size).reshape(self.hits.shape)
        right = at % 3 == 0
        self.count2 += np.bincount(slot[right], minlength=1 << _SLOT_BITS).astype(np.int32)
        self.count2 -= np.bincount(slot[~right], minlength=1 << _SLOT_BITS).astype(np.int32)
        new = np.flatnonzero(~right & (self.count2.take(slot) < 0))
        self.says[slot[new]] = ids[new]
        np.maximum(self.count2, 0, out=self.count2)
        self._shares()


def _share(start, freq, ids):
    return start << _START_AT | freq - 1 << _ID_BITS | ids


def _parts(share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id, start and size."""
    return share & MOST_ID, share >> _START_AT, (share >> _ID_BITS & ((1 << _LIT_BITS) - 1)) + 1


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE))
    return lanes, -(-n // lanes)


def _lessons(steps: int) -> list[tuple[int, int]]:
    """The waves between lessons: after 1, 4, 16 ... waves, and after every LESSON."""
    ends = [w for w in range(1, steps) if w % LESSON == 0 or (w & (w - 1) == 0 and w.bit_length() % 2)]
    return list(zip([0, *ends], [*ends, steps], strict=True))


def _learn(model: _Model, grid: np.ndarray, a: int, b: int, said: list) -> None:
    """A lesson from the waves from a to b."""
    slot, at = (np.concatenate(x) for x in zip(*said, strict=True))
    model.lesson(slot, grid[a + 1 : b + 1].ravel(), grid[a + 2 : b + 2].ravel(), at)


def encode_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block of ids (uint32, at most MOST_ID) and the lengths of its documents."""
    n, size = len(ids), int(ids.max(initial=0)) + 1
    if size - 1 > MOST_ID:
        raise ValueError(f"id {size - 1} is beyond {MOST_ID}")
    lanes, steps = _shape(n)
    grid = np.zeros((steps + 2, lanes), np.int64)  # two waves of 0 before the first
    grid[2:] = np.append(ids, np.zeros(lanes * steps - n, ids.dtype)).reshape(lanes, steps).T
    coder, model = _Coder(lanes, steps), _Model(size)
    for a, b in _lessons(steps):
        said = []
        for c in range(a, b, WAVES):
            d = min(b, c + WAVES)
            now, before1, before2 = (grid[c + k : d + k].ravel() for k in (2, 1, 0))
            slot, says, row, at = model.look(before2, before1)
            kind, share = model.tell(says, row, before1, now)
            at *= 3
            at += kind
            _, start, freq = _parts(share)
            width = model.share.take(at)
            start *= width
            start += model.edge.take(at)
            freq *= width
            for own, width in zip(*(x.view(np.uint64).reshape(d - c, lanes) for x in (start, freq)), strict=True):
                coder.put(own, width)
            if b < steps:
                said.append((slot.astype(np.int32), at.astype(np.int16)))
        if b < steps:
            _learn(model, grid, a, b, said)
    tail = np.asarray(lengths, "<u4").tobytes() + coder.finish().astype("<u4").tobytes()
    return _HEAD.pack(_MAGIC, n, size, len(lengths), lanes, zlib.crc32(np.asarray(ids, "<u4").tobytes())) + tail


def decode_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids and document lengths of a block; ValueError where it is damaged."""
    if len(data) < _HEAD.size or len(data) % 4:
        raise ValueError("block cut off")
    magic, n, size, docs, lanes, crc = _HEAD.unpack_from(data)
    if magic != _MAGIC or lanes != _shape(n)[0] or not 0 < size <= MOST_ID + 1:
        raise ValueError("not a token block")
    rest = np.frombuffer(data, "<u4", offset=_HEAD.size)
    lengths, words = rest[:docs], rest[docs:]
    if lengths.sum() != n:
        raise ValueError("block cut off")
    _, steps = _shape(n)
    coder, model = _Coder(lanes, steps, words), _Model(size)
    grid = np.zeros((steps + 2, lanes), np.int64)
    for a, b in _lessons(steps):
        said = []
        for w in range(a, b):
            slot, says, row, at = model.look(grid[w], grid[w + 1])
            v = coder.peek()
            kind = (v >= model.edge1.take(at)).view(np.int8) + (v >= model.edge2.take(at)).view(np.int8)
            at *= 3
            at += kind
            edge, width = model.edge.take(at), model.share.take(at)
            v -= edge
            v //= width
            own = model.whole.take(kind)
            np.copyto(own, row, where=kind == 1)
            now, start, freq = model.find(own, v)
            np.copyto(now, says, where=kind == 0)
            start *= width
            start += edge
            freq *= width
            coder.take(start, freq)
            grid[w + 2] = now
            if b < steps:
                said.append((slot.astype(np.int32), at.astype(np.int16)))
        if b < steps:
            _learn(model, grid, a, b, said)
    ids = grid[2:].T.ravel()[:n].astype(np.uint32)
    if coder.at != len(words) or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a token block differs")
    return ids, lengths


#: Pieces whose ids a worker remembers; beyond that it forgets those not met again since it last forgot.
REMEMBERED = 600_000

# Classes of bytes in text of ASCII and the letters from U+00C0 to U+00FF. 0: not handled here, as are the
# second bytes of the signs for times and divided by; any other character beyond those letters has a first byte of class 0.
_LETTER, _DIGIT, _SPACE, _BREAK, _MARK = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_CLASS[48:58], _CLASS[32], _CLASS[[9, 10, 13]] = _DIGIT, _SPACE, _BREAK
_CLASS[[ord("'"), 0x97, 0xB7]] = 0
_CLASSES = _CLASS.tobytes()
#: New pieces that are encoded end to end.
RUN = 128


class PieceEncoder:
    """Ids of texts by the tokenizers library, each distinct piece of text encoded once.

    A byte-level tokenizer cuts a text into pieces (a word with the space before it, digits, marks, white space) and
    encodes each by itself. For texts of simple characters the cuts are found on whole batches of bytes, by the class
    of each byte and the one before it; the library encodes the distinct pieces. Any other text goes to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        rule = self.tok.pre_tokenizer
        self.by_piece = type(rule).__name__ == "ByteLevel" and rule.use_regex and not rule.add_prefix_space and self.tok.normalizer is None
        # the same model for pieces that are cut already
        self.cut = Tokenizer(self.tok.model)
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\0"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        #: bytes that an id stands for: a character of a byte-level token is a byte
        vocabulary = self.tok.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known, self.stored = pa.array([], pa.binary()), []
        self.ids, self.fill = np.zeros(1 << 20, np.int32), 0
        #: ends of the pieces' ids, after a 0, and whether a piece was met again since the last forgetting
        self.ends, self.met, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, bool), 0

    def _learn(self, pieces: pa.Array) -> None:
        """Pieces are encoded end to end, many at a call: the library is told to cut at a byte 0, which no piece holds.

        An id stands for a fixed number of bytes, so the pieces' borders are found again among the ids; where they are
        not, each piece is encoded by itself.
        """
        runs = pa.ListArray.from_arrays(np.append(np.arange(0, len(pieces), RUN), len(pieces)).astype(np.int32), pieces.cast(pa.string()))
        sizes = pc.binary_length(pieces).to_numpy()
        texts = pc.binary_join(runs, "\0").to_pylist()
        for at in range(0, len(texts), 128):
            got = [e.ids for e in self.cut.encode_batch_fast(texts[at : at + 128], add_special_tokens=False)]
            ids = np.concatenate([np.array(g, np.int32) for g in got])
            ends, borders = np.cumsum(self.bytes_of.take(ids)), np.cumsum(sizes[at * RUN : (at + 128) * RUN])
            last = np.searchsorted(ends, borders)
            if last[-1] + 1 != len(ends) or not np.array_equal(ends[last], borders):
                alone = [x.decode() for x in pieces[at * RUN : (at + 128) * RUN].to_pylist()]
                got = [e.ids for e in self.cut.encode_batch_fast(alone, add_special_tokens=False)]
                ids, last = np.concatenate([np.array(g, np.int32) for g in got]), np.cumsum([len(g) for g in got]) - 1
            self._store(ids, last + 1)
        self.stored.append(pieces)

    def _store(self, ids: np.ndarray, ends: np.ndarray) -> None:
        if self.fill + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.int32)])
        self.ids[self.fill : self.fill + len(ids)] = ids
        if self.count + len(ends) >= len(self.ends):
            more = np.zeros(len(self.ends) + len(ends), np.int64)
            self.ends, self.met = np.concatenate([self.ends, more]), np.concatenate([self.met, more.astype(bool)])
        self.ends[self.count + 1 : self.count + 1 + len(ends)] = ends + self.fill
        self.met[self.count : self.count + len(ends)] = False
        self.count += len(ends)
        self.fill += len(ids)

    def _keep(self, kept: np.ndarray) -> None:
        """Forgets all pieces but those at the given places."""
        start, size = self.ends[kept], self.ends[kept + 1] - self.ends[kept]
        self.known = self.known.take(pa.array(kept))
        ids = self._ids(start, size)
        self.count = self.fill = 0
        self._store(ids, np.cumsum(size))

    def _ids(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Stored ids from the given starts, end to end."""
        stop = np.cumsum(size)
        at = np.repeat(start - stop + size, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids.take(at)

    def _pieces(self, raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces of texts that lie end to end, and how many each text has. edges: texts' borders."""
        c = np.frombuffer(raw.translate(_CLASSES), np.uint8)
        white = (c == _SPACE) | (c == _BREAK)
        before, first = np.roll(c, 1), np.zeros(len(c) + 1, bool)
        first[edges[:-1]] = True
        first, last = first[:-1], np.roll(first, -1)[: len(c)]
        white_before = np.roll(white, 1) & ~first
        # not white: after a line break, or after another class that isn't white
        start = ~white & (first | ((c != before) & ~(before == _SPACE)))
        # white: the first of its run, and the last of a run that text follows
        text_after = np.roll(~white, -1)
        text_after[-1:] = False
        start |= white & (~white_before | (text_after & ~last))
        starts = np.flatnonzero(start)
        return starts, np.diff(np.searchsorted(starts, edges))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None if t else np.empty(0, np.int32) for t in texts]
        left = [i for i, t in enumerate(texts) if t]
        hard = self._hard([texts[i] for i in left])
        simple, hard = ([i for i, h in zip(left, hard, strict=True) if h == which] for which in (False, True))
        for i, e in zip(hard, self.tok.encode_batch_fast([texts[i].decode() for i in hard], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int32)
        if simple:
            raw = b"".join(texts[i] for i in simple)
            edges = np.concatenate([[0], np.cumsum([len(texts[i]) for i in simple])])
            starts, per_text = self._pieces(raw, edges)
            bounds = np.append(starts, len(raw)).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
            del raw, starts, bounds
            place, indices = self._places(coded.dictionary), coded.indices.to_numpy()
            start, size = self.ends[place], self.ends[place + 1] - self.ends[place]
            del coded
            start, size = start.take(indices), size.take(indices)
            flat = self._ids(start, size)
            cuts = np.concatenate([[0], np.cumsum(size)])[np.cumsum(per_text)]
            for i, own in zip(simple, np.split(flat, cuts[:-1]), strict=True):
                out[i] = own
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand among the known ones, once those that are new are learnt."""
        at = pc.index_in(pieces, self.known)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        place = at.fill_null(-1).to_numpy().copy()
        old = place[place >= 0]
        self.met[old] = True
        if len(self.known) + len(new) > REMEMBERED:
            kept = np.flatnonzero(self.met[: self.count])
            if len(kept) + len(new) > REMEMBERED:
                kept = np.sort(old)
            self._keep(kept)
            place[place >= 0] = np.searchsorted(kept, old)
        if len(new):
            place[new] = np.arange(self.count, self.count + len(new))
            self._learn(pieces.take(pa.array(new)))
            self.known, self.stored = pa.concat_arrays([self.known, *self.stored]), []
        return place

    def _hard(self, texts: list[bytes]) -> np.ndarray:
        """Which texts are not of simple characters, or hold a special token: the library cuts those."""
        if not self.by_piece:
            return np.ones(len(texts), bool)
        hard, raw = np.zeros(len(texts), bool), b"".join(texts)
        kinds = raw.translate(_CLASSES)
        if 0 in kinds:
            ends = np.cumsum([len(t) for t in texts])
            hard[np.searchsorted(ends, np.flatnonzero(np.frombuffer(kinds, np.uint8) == 0), side="right")] = True
        if any(s in raw for s in self.special):
            hard |= [any(s in t for s in self.special) for t in texts]
        return hard


_encoders: dict = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _gathered(batches, most: int = 8 << 20):
    """(ids, texts as bytes) of some MB at a time, so that a piece is looked up once for many texts."""
    ids, texts, size = [], [], 0
    for b in batches:
        ids.append(b.column(0))
        texts += b.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
        size += b.column(1).nbytes
        if size >= most:
            yield pa.concat_arrays(ids), texts
            ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), texts


def _encode(path: str, end_id: int):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(path)
        part, seq, n = TaskContext.get().partitionId(), 0, 0
        keys, ids, lengths = [], [], []

        def block():
            nonlocal seq, n, keys, ids, lengths
            data = encode_block(np.concatenate(ids), np.array(lengths))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([keys], pa.list_(kind)), pa.array([data], pa.binary())], names=["part", "seq", "n", "ids", "data"])
            seq, n, keys, ids, lengths = seq + 1, 0, [], [], []
            return row

        for names, texts in _gathered(batches):
            kind = names.type
            pa.default_memory_pool().release_unused()
            for key, got in zip(names.to_pylist(), enc.encode(texts), strict=True):
                own = np.append(got, end_id).astype(np.uint32)
                if n and n + len(own) > BLOCK:
                    yield block()
                keys.append(key)
                ids.append(own)
                lengths.append(len(own))
                n += len(own)
        if n:
            yield block()

    return run


def _decode(with_ids: bool):
    def run(batches):
        for b in batches:
            for part, seq, keys, data in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("ids"), b.column("data").to_pylist(), strict=True):
                ids, lengths = decode_block(data)
                ends = np.cumsum(lengths.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                m = len(lengths)
                cols = [keys.values, pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, seq, np.int32)), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[e - n : e].astype(np.int32) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "part", "seq", "at", "n_tokens", "ids_crc32", *["token_ids"] * with_ids])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token files of docs at path, in ascending order of the id (null first, equal ids by text): rows of blocks."""
    C.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    blocks = ordered.mapInArrow(_encode(tokenizer_path, end_id), f"part int, seq int, n long, ids array<{kind}>, data binary")
    blocks.write.mode("errorifexists").option("compression", "uncompressed").option("parquet.block.size", 1 << 24).parquet(path)


def read_tokens(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row for each document from its token file: id, start (ids of all documents before it), n_tokens, ids_crc32.

    with_ids adds token_ids. A damaged block raises.
    """
    files = spark.read.parquet(path)
    kind = dict(files.dtypes)["ids"][len("array<") : -1]
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_p"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_s")).join(parts, "part").select("part", "seq", (F.col("_p") + F.col("_s")).alias("_start"))
    more = ", token_ids array<int>" if with_ids else ""
    docs = files.select("part", "seq", "ids", "data").mapInArrow(_decode(with_ids), f"id {kind}, part int, seq int, at long, n_tokens long, ids_crc32 long{more}")
    out = docs.join(starts, ["part", "seq"])
    return out.select(F.col("id").alias(id_col), (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["token_ids"] * with_ids)


def through_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """docs written as token files in the shared folder and read back.

    Defined cases: a null or empty text is its end id alone; null ids come first, and repeated ids stand in a row, by
    text; an empty table gives an empty result; other columns of docs are not read.
    """
    path = C.scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path, id_col, with_ids)
