"""Words of Arrow text columns as 64-bit hashes, computed on whole byte buffers with numpy.

A word is a maximal run of kept bytes; A-Z count as a-z.  Both word rules of
this subpackage keep every byte of a multi-byte UTF-8 character, so words can be
found on bytes.  Null and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.ones(256, bool)
ALNUM[:128] = False
ALNUM[48:58] = ALNUM[97:123] = True
#: ``[^\x20\x09-\x0D]``: all but white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_MUL = 0x9E3779B97F4A7C15
_BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n, _BLOCK) + 1
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64))), dtype=np.uint64)
                      for x in (_MUL, pow(_MUL, -1, 1 << 64))]
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body


def find(offsets: np.ndarray, low: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses from one text into the next."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kept[low]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(low)]
    before[first] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece low[start:end]; pieces are sorted and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        n = int(ends[j - 1] - base)
        up, down = _up_to(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low[base: base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def words(texts: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts one after the other, first word of each text and the total)."""
    offsets, body = buffers(texts)
    low = LOWER[body]
    starts, ends = find(offsets, low, kept)
    return hashes(low, starts, ends), np.searchsorted(starts, offsets)


def split(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]
