"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from tabsift.llm.common import mixed, slices

WORDS = 5
PIECE = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the step and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        rows = []
        for base in (_STEP, pow(_STEP, -1, 2**64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            rows.append(np.cumprod(row))
        _powers[:] = rows
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and last two bytes of every word, as one number.

    Words are runs of bytes but white space, A to Z in lower case.

    A rolling sum over the bytes gives each word's polynomial hash as a difference, so the cost
    does not depend on the number of words.
    """
    c = _LOWER[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(c) + 2, np.int8)
    inside[1:-1] = ~_SPACE[c]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _steps(len(c))
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(_BYTE[c] * up, out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    tails = c[np.maximum(ends - 2, starts)].astype(np.int64) * 256 + c[ends - 1]
    return starts, mixed(value + (ends - starts).astype(np.uint64)), tails


def _runs(h: np.ndarray) -> np.ndarray:
    """The hash of every ``WORDS`` neighbours."""
    n = len(h) - WORDS + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, WORDS):
        total += h[k:k + n] * _PLACE[k]
    return mixed(total)


def _short(h: np.ndarray) -> np.ndarray:
    """The hash of a text of fewer words, as one shingle."""
    with np.errstate(over="ignore"):
        total = (h * _PLACE[:len(h)]).sum(keepdims=True, dtype=np.uint64)
        return mixed(total + _PLACE[WORDS] * np.uint64(len(h)))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes.

    A shingle is five words; a text of fewer has all its words as one, a text without words none.
    Neighbouring short texts are hashed together and long ones in pieces cut at white space.
    """
    out: list[np.ndarray] = []
    for a, b in slices([len(t) + 1 for t in texts], PIECE):
        if b - a == 1 and len(texts[a]) > PIECE:
            out.append(_distinct(np.concatenate([h for _, h, _ in pieces(texts[a])])))
            continue
        starts, h, _ = word_hashes(b"\n".join(texts[a:b]))
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        stops = np.searchsorted(starts, ends)
        runs = _runs(h) if len(h) >= WORDS else h[:0]
        first = 0
        for stop in stops.tolist():
            n = stop - first
            out.append(np.unique(runs[first:stop - WORDS + 1]) if n >= WORDS else _distinct(h[first:stop]))
            first = stop
    return out


def _distinct(h: np.ndarray) -> np.ndarray:
    if len(h) >= WORDS:
        return np.unique(_runs(h))
    return _short(h) if len(h) else h


def pieces(text: bytes):
    """``word_hashes`` of a long text, piece by piece; a piece ends where a word does."""
    at = 0
    while at < len(text):
        stop = min(at + PIECE, len(text))
        while stop < len(text) and not _SPACE[text[stop]]:
            stop += 1
        yield word_hashes(text[at:stop])
        at = stop
