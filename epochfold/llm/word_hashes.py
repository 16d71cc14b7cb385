"""Hashes of words and of word runs for whole batches of texts, in NumPy; words as in common.WORD, A-Z lower-cased."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed at once; a longer word is taken whole.
PIECE = 1 << 18
_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """h spread over all 64 bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data."""
    b = np.frombuffer(data, np.uint8)
    inside = (b != 32) & ((b < 9) | (b > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.flatnonzero(inside)
    word = np.cumsum(first[at]) - 1
    rel = at - starts[word]
    v = b[at].astype(np.uint64)
    v += np.uint64(32) * ((v >= 65) & (v <= 90))
    v = (v + np.uint64(1)) * _powers(_BYTE, int(rel.max()) + 1)[rel]
    return mixed(np.add.reduceat(v, np.flatnonzero(first[at]))), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts, and where each text's begin among them (one entry more than texts)."""
    data = b"\n".join([*texts, b""])
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = max(data.rfind(s, at, end) for s in (b" ", b"\n", b"\t"))
            end = cut + 1 if cut >= at else min(x for x in (data.find(s, end) for s in (b" ", b"\n", b"\t")) if x >= 0) + 1
        h, s = _piece(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), edges)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring values of h, in order; texts' borders are the caller's to mind."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, done, power, width = np.zeros(len(h) - n + 1, np.uint64), 0, h, 1
    left = n
    while left:
        if left & 1:
            scale = _powers(_WORD, done + 1)[done]
            out += power[done : done + len(out)] * scale
            done += width
        left >>= 1
        if left:
            scale = _powers(_WORD, width + 1)[width]
            power = power[: len(power) - width] + power[width:] * scale
            width *= 2
    return mixed(out)


def powers(n: int) -> np.ndarray:
    """The first n weights of places in a run."""
    return _powers(_WORD, n)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of a text's n-word shingles, repeats included; all words as one where there are fewer, none without words."""
    return runs(h, min(n, len(h))) if len(h) else h


def slices(batches, rows: int = 256, size: int = PIECE):
    """Arrow batches (.., text last) cut to so many rows and about so many bytes of text, as (batch, texts)."""
    for b in batches:
        if not b.num_rows:
            continue
        raw = [(t or "").encode() for t in b.column(b.num_columns - 1).to_pylist()] if b.num_rows <= rows else None
        if raw is not None and sum(map(len, raw)) <= size:
            yield b, raw
            continue
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows)
            raw, total = [], 0
            for t in part.column(part.num_columns - 1):
                x = (t.as_py() or "").encode()
                if raw and total + len(x) > size:
                    break
                raw.append(x)
                total += len(x)
            yield b.slice(at, len(raw)), raw
            at += len(raw)
