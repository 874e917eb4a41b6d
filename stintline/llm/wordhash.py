"""Words of UTF-8 texts as 64-bit hashes, a batch of documents at a time, without decoding them.

A batch is cut into runs of whole documents of about a megabyte. Within a run every word gets
H = sum(T[byte] * P^position) * P^-start (mod 2^64), read off one prefix sum, then a finalising mix with the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)  # a word is a run of anything but space, tab, newline, vertical tab, form feed, return
SPACED[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)  # a word is a run of letters, digits and bytes above 127
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(RUN_BYTES.bit_length(), n.bit_length())
    if size not in _powers:
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INVERSE, np.uint64)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * RUN_BYTES:
            return tables
        _powers[size] = tables
    return _powers[size]


def _hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(low) + 1)
    sums = np.empty(len(low) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[low] * up[: len(low)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, kind: np.ndarray = SPACED, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one buffer. A very long buffer goes in pieces cut between words."""
    parts, at = [], 0
    while at < len(data):
        stop = len(data)
        if stop - at > 2 * RUN_BYTES:
            stop = at + RUN_BYTES
            while stop < len(data) and kind[data[stop]]:
                stop += 1
        piece = data[at:stop]
        low = LOWER[piece] if fold else piece
        edge = np.flatnonzero(np.diff(kind[low].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edge[0::2], edge[1::2]
        parts.append((starts + at, ends + at, _hash_spans(low, starts, ends)))
        at = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of given spans of one buffer."""
    return _hash_spans(low, starts, ends)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column with one space after each text; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8), offsets


ROWS = 512  # texts that are copied at once


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past, bytes, offsets from 0) of successive runs of whole documents."""
    for base in range(0, len(column), ROWS):
        part = column.slice(base, ROWS)
        data, offsets = raw(part)
        first = 0
        while first < len(part):
            past = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "left"))
            past = min(max(past, first + 1), len(part))
            yield base + first, base + past, data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]
            first = past


def word_runs(column: pa.Array, kind: np.ndarray = SPACED) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, bounds of each document among the words, starts, ends, hashes) of successive runs."""
    for first, _, data, offsets in runs(column):
        starts, ends, hashes = words(data, kind)
        yield first, np.searchsorted(starts, offsets), starts, ends, hashes


_STEP = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of consecutive words; the whole sequence as one gram where it has fewer words, but any."""
    n = min(n, len(hashes))
    if not n:
        return hashes[:0]
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _STEP[k % 64] ^ np.uint64(k)
    return mix(total + np.uint64(n))
