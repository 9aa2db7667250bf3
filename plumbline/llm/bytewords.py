"""Word hashes of whole texts, computed over Arrow buffers without a Python step per word.

A separator is a byte, and no byte of a multi-byte UTF-8 character is one, so splitting bytes splits characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a text beyond it is cut at separators and its words are joined up again.
CHUNK = 1 << 20
#: Rows of a column taken at a time.
ROWS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    word = np.ones(256, dtype=bool)
    for lo, hi in separators:
        word[lo : hi + 1] = False
    return word


#: True for bytes inside words, after A-Z have been lower-cased.
SPACE_WORDS = _table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM_WORDS = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

#: Bytes hashed in one step, the longest span hashed in such steps (longer ones by BLAKE2b), and the hash's fixed key.
_LANE, _LONG, _KEY = 8, 256, np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(_LANE + 1)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place of a buffer (and at its end), as one number; zeros follow the buffer."""
    padded = np.concatenate((buf, np.zeros(_LANE, np.uint8)))
    return np.ndarray(len(buf) + 1, np.uint64, padded, strides=(1,))


def span_hashes(buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span of a block.

    A span is taken eight bytes at a step, each through a bijective mixer, so that no arithmetic relation between
    spans (a Thue-Morse word and its complement, say) makes them collide; spans of one length of at most eight bytes
    never do. Long spans are hashed by BLAKE2b.
    """
    size = end - first
    eight = lanes(buf)
    h = mix(size.astype(np.uint64) * _KEY + _KEY)
    live, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(live):
        left = size[live] - at
        h[live] = mix((h[live] ^ (eight[first[live] + at] & _MASK[np.minimum(left, _LANE)])) * _KEY)
        live, at = live[left > _LANE], at + _LANE
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[first[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(left: np.ndarray, first: np.ndarray, size: np.ndarray, right: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether spans of one buffer hold the bytes of spans of another; buffers are given by their lanes."""
    same = size == other_size
    live, at = np.flatnonzero(same & (size > 0)), 0
    while len(live):
        rest = size[live] - at
        differ = ((left[first[live] + at] ^ right[other[live] + at]) & _MASK[np.minimum(rest, _LANE)]) != 0
        same[live[differ]] = False
        live, at = live[~differ & (rest > _LANE)], at + _LANE
        if len(live) < 64:
            for k in live.tolist():
                a, b = left[first[k] : first[k] + size[k] - _LANE + 1], right[other[k] : other[k] + size[k] - _LANE + 1]
                same[k] = np.array_equal(a, b)
            break
    return same


def _word_spans(low: np.ndarray, starts_of_docs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words of a lower-cased block; no word spans a place in starts_of_docs."""
    n = len(low)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts_of_docs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    return first, end


@dataclass
class Words:
    """Words of consecutive rows: hashes, n + 1 word offsets by row, and each word's place in the lower-cased bytes."""

    row: int
    end_row: int
    hashes: np.ndarray
    bounds: np.ndarray
    low: np.ndarray
    first: np.ndarray
    end: np.ndarray


def word_blocks(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[Words]:
    """The words of all rows, some rows at a time."""
    rows, row = len(offsets) - 1, 0
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1
        end = min(max(end, row + 1), rows)
        lo, hi = int(offsets[row]), int(offsets[end])
        low = _LOWER[raw[lo:hi]]
        if hi - lo <= CHUNK or end > row + 1:
            first, stop = _word_spans(low, offsets[row:end] - lo, table)
            bounds = np.searchsorted(first, offsets[row : end + 1] - lo)
            yield Words(row, end, span_hashes(low, first, stop), bounds, low, first, stop)
        else:
            firsts, stops, hashes, at, size = [], [], [], 0, hi - lo
            while at < size:
                cut = min(at + CHUNK, size)
                while cut < size and table[low[cut - 1]] and table[low[cut]]:
                    gap = np.flatnonzero(~table[low[cut : min(cut + CHUNK, size)]])
                    cut = cut + int(gap[0]) if len(gap) else min(cut + CHUNK, size)
                first, stop = _word_spans(low[at:cut], np.zeros(1, np.int64), table)
                hashes.append(span_hashes(low[at:cut], first, stop))
                firsts.append(first + at)
                stops.append(stop + at)
                at = cut
            h = np.concatenate(hashes)
            yield Words(row, end, h, np.array([0, len(h)]), low, np.concatenate(firsts), np.concatenate(stops))
        row = end


def column_words(column: pa.Array, table: np.ndarray) -> Iterator[Words]:
    """The words of all rows of a string column; it is taken some rows at a time, so that little of it is copied at once."""
    for at in range(0, len(column), ROWS):
        for words in word_blocks(*buffers(column.slice(at, ROWS)), table):
            words.row, words.end_row = words.row + at, words.end_row + at
            yield words


_SHINGLE = mix(np.arange(1, 129, dtype=np.uint64) * _KEY) | np.uint64(1)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words (128 at most) that begin at each place, for all but the last k - 1 places."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _SHINGLE[0]
    for j in range(1, k):
        out += h[j : j + n] * _SHINGLE[j]
    return mix(out + np.uint64(k))
