"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes that are worked on at once; a longer text is worked on in pieces.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(256, dtype=np.uint64) + _M1)
#: A-Z count as a-z.
_LETTER[65:91] = _LETTER[97:123]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_place = mix(np.arange(1 << 12, dtype=np.uint64) * _M1) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = mix(np.arange(2 * n, dtype=np.uint64) * _M1) | np.uint64(1)
    return _place


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of each word of one text's bytes: the bytes times factors of their places, added up and scrambled."""
    if len(data) > PIECE:
        gaps = np.flatnonzero(~_IN_WORD[data[PIECE:]])
        if len(gaps):
            cut = PIECE + int(gaps[0])
            return np.concatenate([word_hashes(data[:cut]), word_hashes(data[cut:])])
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    return _summed(data[inside], np.flatnonzero(first[inside]))


def _summed(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return mix(np.add.reduceat(_LETTER[data] * _places(int(place.max()) + 1)[place], starts))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, nulls as empty, and the offsets of its rows."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words."""
    data, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    row = 0
    while row < len(column):
        # As many rows as fit into a piece, or one longer one.
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        if end == row + 1:
            hashes = word_hashes(data[offsets[row] : offsets[end]])
            bounds = np.array([0, len(hashes)])
        else:
            part, local = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            inside = _IN_WORD[part]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            begins = local[:-1][local[:-1] < len(part)]
            first[begins] = inside[begins]
            hashes = _summed(part[inside], np.flatnonzero(first[inside]))
            bounds = np.concatenate(([0], np.cumsum(first)))[local]
        chained = np.full(max(0, len(hashes) - size + 1), size, np.uint64)
        for k in range(size):
            chained = mix(chained * _M1 + hashes[k : len(hashes) - size + 1 + k]) if len(chained) else chained
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= size:
                out.append(np.unique(chained[a : b - size + 1]))
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for h in hashes[a:b]:
                    short = mix(short * _M1 + h)
                out.append(short)
            else:
                out.append(np.zeros(0, np.uint64))
        row = end
    return out
