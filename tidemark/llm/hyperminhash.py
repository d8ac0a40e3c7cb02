"""HyperMinHash: registers of leading zeros and mantissa bits, and Jaccard estimates from them.

A sketch has PASSES x BUCKETS registers.  In each pass an element falls in a
bucket by the first bits of its hash for that pass; of the bucket's least
remaining hash the register keeps the number of leading zeros (6 bits) and the
MANTISSA bits that follow the leading one.  A bucket that no element falls in
takes the register of another bucket of its pass, by a fixed order of its own
(densification), so that small sets compare as large ones do.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm import textblock as tb

PASSES, BUCKETS, MANTISSA = 8, 16, 10
REGISTERS = PASSES * BUCKETS
ROWS = 4  # registers of a band
BANDS = REGISTERS // ROWS
_BUCKET_BITS = BUCKETS.bit_length() - 1
_SEEDS = tb.seeds(PASSES, 0xA5)
_ORDER = np.argsort(tb.seeds(PASSES * BUCKETS * BUCKETS, 0xB7).reshape(PASSES, BUCKETS, BUCKETS), axis=2)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Registers of each band: four passes, a different bucket in each.
BAND_REGISTERS = np.array([[p * BUCKETS + (b + 5 * p) % BUCKETS for p in range(g * ROWS, (g + 1) * ROWS)] for g in range(PASSES // ROWS) for b in range(BUCKETS)])
#: Fixed value: the collision constant of the HyperMinHash paper (Yu and Weber), for registers without a match.
_COLLISION = 0.169919487159739


def _codes(least: np.ndarray) -> np.ndarray:
    """16 bits a register of a bucket's least hash."""
    top = (least >> np.uint64(11)).astype(np.float64)  # 53 bits: exact
    exponent = np.frexp(top)[1].astype(np.int64)  # bit length, 0 for 0
    zeros = np.minimum(53 - exponent, 62)
    shift = np.minimum(zeros + 1, 63).astype(np.uint64)
    mantissa = (least << shift) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def sketch(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Registers (n, REGISTERS) of uint16 of the sets that (text, hash) lists; an empty set has all ones."""
    out = np.empty((n, REGISTERS), np.uint16)
    base = text.astype(np.int64) << _BUCKET_BITS
    for p in range(PASSES):
        x = tb.mix(h, int(_SEEDS[p]))
        bucket = (x >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        least = np.full(n * BUCKETS, _EMPTY)
        np.minimum.at(least, base | bucket, x << np.uint64(_BUCKET_BITS))
        least = least.reshape(n, BUCKETS)
        empty = least == _EMPTY
        codes = _codes(tb.densify(least, _EMPTY, _ORDER[p]))
        codes[empty.all(axis=1)] = 0xFFFF
        out[:, p * BUCKETS : (p + 1) * BUCKETS] = codes
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys of the registers of each band."""
    four = registers[:, BAND_REGISTERS].astype(np.uint64)
    packed = four[..., 0] | four[..., 1] << np.uint64(16) | four[..., 2] << np.uint64(32) | four[..., 3] << np.uint64(48)
    return tb.mix(packed ^ tb.seeds(BANDS, 0xC3)[None, :])


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the expected chance matches."""
    matches = (a == b).sum(axis=1)
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    ratio = large / np.maximum(small, 1)
    chance = _COLLISION * REGISTERS * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.clip((matches - chance) / (REGISTERS - chance), 0, 1)
