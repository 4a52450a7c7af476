"""Vectorised text kernels on Arrow buffers.

All of them treat text as UTF-8 bytes and work on slices of bounded size, so a
worker's memory follows the largest single document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised pass takes at most (one longer text goes alone).
SLICE_BYTES = 2 << 20


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z were lower-cased.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_BYTE_CODE = np.random.default_rng(0x51175).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base modulo 2**64 and their inverses, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            done = 1
            while done < size:  # doubling: p[done:2*done] = p[:done] * base**done
                p[done : 2 * done] = p[:done] * U64(pow(base, done, 1 << 64))
                done *= 2
            out.append(p)
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into the bytes) of runs of rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null("" if pa.types.is_large_string(wide.type) else b"")
    _, where, data = wide.buffers()
    ends = np.frombuffer(where, dtype=np.int64, count=len(wide) + 1 + wide.offset)[wide.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(wide):
        stop = int(np.searchsorted(ends, ends[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(wide))
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row plus the total); words never cross rows."""
    flags = is_word[data]
    before = np.empty_like(flags)
    after = np.empty_like(flags)
    if len(flags):
        before[0] = after[-1] = False
        before[1:] = flags[:-1]
        after[:-1] = flags[1:]
        inner = offsets[(offsets > 0) & (offsets < len(flags))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(flags & ~before)
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words each, len(words) - k + 1 of them (none if fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # unrelated factors: with factors in a progression, (x, y, y, x) and (y, x, x, y) would be equal
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += words[j : j + n] * factors[j]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each row; fewer words than k are one shingle."""
    text = LOWER[data]
    starts, ends, first = word_spans(text, offsets, NON_SPACE)
    words = span_hashes(text, starts, ends)
    grams = shingle_hashes(words, k)
    for row in range(len(offsets) - 1):
        a, b = first[row], first[row + 1]
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = shingle_hashes(words[a:b], int(b - a)) ^ U64(0xA5A5A5A5A5A5A5A5)
        else:
            own = np.zeros(0, dtype=np.uint64)
        yield own


def as_binary(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start+1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(np.asarray(starts, dtype=np.int64) - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift
