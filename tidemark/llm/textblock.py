"""Vectorised text kernels shared by the corpus operators.

A column of texts arrives as Arrow buffers.  ``blocks`` cuts it, at document
borders, into runs of about ``BLOCK_BYTES`` so that the working memory of a
Python worker does not depend on the Arrow batch size; a single longer text
is one block of its own and is never cut.  All functions here work on the
UTF-8 bytes of a block with NumPy; nothing is done row by row.

Hashes are 64-bit.  A span of symbols is hashed by a polynomial over
per-symbol random values (prefix sums modulo 2**64) and a final mixer, so any
span costs O(1) after one pass over the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, _U) ^ _U(seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE), salt)


_BYTE_VALUES = seeds(256, 0x51)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16, min(2 * len(_powers), n + (1 << 22)))
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, _U)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers[:n], _inverses


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``span``."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _tables(len(values))[0], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of symbols start..end (exclusive) of what ``prefix`` summed."""
    inverses = _tables(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def runs(sums: np.ndarray, borders: np.ndarray, width: int) -> np.ndarray:
    """``span`` of every ``width`` consecutive symbols between borders, without a gather for each."""
    at, inverse = sums[borders], _tables(len(sums))[1][borders]
    size = (borders[width:] - borders[:-width]).astype(_U)
    return mix((at[width:] - at[:-width]) * inverse[:-width] + size * _U(0xD6E8FEB86659FD93))


@dataclass
class Block:
    """Texts first..first+len of a batch: their bytes and offsets into them."""

    first: int
    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1


def blocks(column: pa.Array | pa.ChunkedArray, most: int | None = None) -> Iterator[Block]:
    """The texts of an Arrow column, nulls as empty texts, in blocks."""
    most = most or BLOCK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    offs = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Block(at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block: byte spans, and offsets of each text's words."""

    start: np.ndarray
    end: np.ndarray
    offs: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))


def words(block: Block) -> Words:
    buf, offs = block.buf, block.offs
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offs), np.int64))
    solid = ~_SPACE[buf]
    border = np.zeros(n + 1, bool)
    border[offs] = True
    gap = np.ones(n + 2, bool)
    np.logical_not(solid, out=gap[1 : n + 1])
    start = np.flatnonzero(solid & (gap[:n] | border[:n]))
    end = np.flatnonzero(solid & (gap[2:] | border[1:])) + 1
    return Words(start, end, np.searchsorted(start, offs))


def word_hashes(block: Block, found: Words, lower: bool) -> np.ndarray:
    """One hash a word; lower: A-Z as a-z."""
    buf = _LOWER[block.buf] if lower else block.buf
    return span(prefix(_BYTE_VALUES[buf]), found.start, found.end)


def windows(hashes: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every run of ``width`` words within one text."""
    last = np.repeat(offs[1:], np.diff(offs)) - width
    at = np.flatnonzero(np.arange(len(hashes)) <= last)
    return at, span(prefix(hashes), at, at + width)


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's set of ``width``-word shingles, by text.

    Words are lower-cased (A-Z).  A text of fewer words has its whole word
    sequence as its one shingle; one without words has none.
    """
    found = words(block)
    hashes = word_hashes(block, found, lower=True)
    at, h = windows(hashes, found.offs, width)
    text = np.searchsorted(found.offs, at, "right") - 1
    count = np.diff(found.offs)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = span(prefix(hashes), found.offs[short], found.offs[short + 1])
        text, h = np.concatenate([text, short]), np.concatenate([h, whole])
        order = np.argsort(text, kind="stable")
        text, h = text[order], h[order]
    first = firsts(h ^ mix(text.astype(_U), 0x7E))
    return text[first], h[first]


def firsts(keys: np.ndarray) -> np.ndarray:
    """Ascending indices of one element of each distinct key."""
    order = np.argsort(keys)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    return np.sort(order[fresh])


def pair_overlaps(text: np.ndarray, h: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the members (repeats allowed) of texts 2i and 2i+1: sizes of intersection and union, for each i."""
    if not len(h):
        return np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    pair = text >> 1
    keys = h ^ mix(np.arange(pairs), 0x35).take(pair)
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sides = np.bitwise_or.reduceat(np.left_shift(1, text[order] & 1).astype(np.uint8), fresh)
    owner = pair[order[fresh]]
    return np.bincount(owner[sides == 3], minlength=pairs), np.bincount(owner, minlength=pairs)


def densify(least: np.ndarray, empty: np.uint64, order: np.ndarray) -> np.ndarray:
    """A copy of (n, buckets) in which an empty bucket has the value of the first that isn't, in its row of order."""
    flat, width = least.ravel(), least.shape[1]
    probes = np.ascontiguousarray(order.T)
    full, gaps, tried = least.copy(), least == empty, 0
    # while many buckets are empty whole columns are moved, then single buckets
    while tried < min(3, len(probes)) and 8 * np.count_nonzero(gaps) > gaps.size:
        np.copyto(full, least.take(probes[tried], axis=1), where=gaps)
        gaps, tried = full == empty, tried + 1
    out = full.ravel()
    todo = np.flatnonzero(gaps)
    column = todo % max(width, 1)
    row = todo - column
    for probe in probes[tried:]:
        if not len(todo):
            break
        found = flat.take(row + probe.take(column))
        good = found != empty
        out[todo[good]] = found[good]
        rest = ~good
        todo, row, column = todo[rest], row[rest], column[rest]
    return full


def fixed_binary(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow binary column."""
    n, width = matrix.shape[0], matrix.shape[1] * matrix.itemsize
    ends = np.arange(0, (n + 1) * width, width, dtype=np.int32) if n else np.zeros(1, np.int32)
    data = np.ascontiguousarray(matrix).tobytes()
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's longs."""
    return np.ascontiguousarray(x).view(np.int64)
