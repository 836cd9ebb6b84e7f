"""Distinct word shingles of whole texts as 64-bit hashes, computed with numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import worker_state

#: White space between words: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, the same for A-Z as for a-z.
_BYTE = np.random.default_rng(20).integers(1, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULT = np.random.default_rng(21).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of text handled at once; a longer text is handled alone.
BATCH = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits look random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make(size: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (_BASE, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        return out[0], out[1]

    return worker_state("powers", lambda: make(BATCH)) if n <= BATCH else make(n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) of texts that lie in a row."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    begin, end = ~space, ~space
    begin[1:] &= space[:-1]
    end[:-1] &= space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = ~space[inner]
    end[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def text_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of ``size`` words of each text; fewer words: the whole sequence as one; none: empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH, "right")) - 1)
        own = offsets[at : stop + 1] - offsets[at]
        h, first = words(data[offsets[at] : offsets[stop]], own)
        n = len(h) - size + 1
        whole = np.zeros(max(n, 0), np.uint64)
        for j in range(size if n > 0 else 0):
            whole += h[j : j + n] * _MULT[j]
        whole = mix(whole)
        for i in range(stop - at):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                part = np.append(h[a:b], np.uint64(b - a)) * np.append(_MULT[: b - a], _MULT[63])
                yield mix(part.sum(dtype=np.uint64, keepdims=True))
            else:
                yield np.empty(0, np.uint64)
        at = stop
