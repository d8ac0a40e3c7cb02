"""Token shards as wavelet matrices.

A shard file holds the token ids of consecutive documents as bit-planes, most
significant bit first; each plane orders the tokens by the bits above it
(zeros before ones, otherwise stable).  With the number of ones before every
512th bit, ``access``, ``rank`` (count of an id before a place) and ``select``
(place of the k-th occurrence) take one step a plane and never unpack the
shard.

File: 8 bytes magic, little-endian u64 length of a JSON header, the header,
then doc ids (i64), document ends (u64), planes (packed bits, big-endian in a
byte, padded to 64 bytes) and directories (u32 a 512 bits and one more), as
the header says.
"""

from __future__ import annotations

import json

import numpy as np

MAGIC = b"TMWAVE01"
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _type(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


class WaveletMatrix:
    """Planes, directories and zero counts over n ids of ``bits`` bits."""

    STEP = 64  # bytes of a plane for each directory entry

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], directories: list[np.ndarray], zeros: list[int]):
        self.n, self.bits, self.planes, self.directories, self.zeros = n, bits, planes, directories, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        a = ids.astype(_type(bits))
        planes, directories, zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            one = (a >> a.dtype.type(b)) & a.dtype.type(1) == 1
            zero = ~one
            packed = np.packbits(one)
            padded = np.zeros(-(-max(len(packed), 1) // cls.STEP) * cls.STEP, np.uint8)
            padded[: len(packed)] = packed
            ones = _POP[padded].reshape(-1, cls.STEP).sum(1, dtype=np.uint32)
            planes.append(padded)
            directories.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]))
            low = a[zero]
            zeros.append(len(low))
            a = np.concatenate([low, a[one]])
        return cls(n, bits, planes, directories, zeros)

    def _rank(self, plane: int, i: int) -> int:
        """Ones before place i."""
        step = i // (8 * self.STEP)
        data = self.planes[plane]
        byte, rest = divmod(i, 8)
        total = int(self.directories[plane][step]) + int(_POP[data[step * self.STEP : byte]].sum())
        return total + (int(data[byte]) >> (8 - rest)).bit_count() if rest else total

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value."""
        ones = self.directories[plane].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * 8 * self.STEP - ones
        step = int(np.searchsorted(before, k, "right")) - 1
        own = np.unpackbits(self.planes[plane][step * self.STEP : (step + 1) * self.STEP])
        return step * 8 * self.STEP + int(np.flatnonzero(own == bit)[k - int(before[step])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            bit = int(self.planes[p][i >> 3]) >> (7 - (i & 7)) & 1
            ones = self._rank(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        for p in range(self.bits):
            a, b = self._rank(p, start), self._rank(p, end)
            if value >> (self.bits - 1 - p) & 1:
                start, end = self.zeros[p] + a, self.zeros[p] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, end: int | None = None) -> int:
        """How often value occurs before place ``end`` (default: at all)."""
        if value < 0 or value >> self.bits or not self.n:
            return 0
        start, end = self._range(value, self.n if end is None else min(max(end, 0), self.n))
        return end - start

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence, from 0; IndexError if there are fewer."""
        if value < 0 or value >> self.bits or not self.n or k < 0:
            raise IndexError(k)
        start, end = self._range(value, self.n)
        if k >= end - start:
            raise IndexError(k)
        at = start + k
        for p in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - p) & 1
            at = self._select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids."""
        kind = _type(self.bits)
        value = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n).view(bool)
            value[self.zeros[p] :] |= kind(1 << (self.bits - 1 - p))
            out = np.empty(self.n, kind)
            out[~one] = value[: self.zeros[p]]
            out[one] = value[self.zeros[p] :]
            value = out
        return value


def dump(shard: tuple[int, int], doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard file."""
    m = WaveletMatrix.build(ids)
    known = [d is not None for d in doc_ids]
    header = json.dumps({"shard": list(shard), "docs": len(doc_ids), "tokens": m.n, "bits": m.bits, "zeros": m.zeros, "plane": len(m.planes[0]), "null_ids": [i for i, k in enumerate(known) if not k]}).encode()
    parts = [MAGIC, len(header).to_bytes(8, "little"), header]
    parts.append(np.array([d if k else 0 for d, k in zip(doc_ids, known, strict=True)], "<i8").tobytes())
    parts.append(np.asarray(ends, "<u8").tobytes())
    parts += [p.tobytes() for p in m.planes]
    parts += [d.astype("<u4").tobytes() for d in m.directories]
    return b"".join(parts)


class Shard:
    """A shard file's documents and matrix, over its bytes without copies."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(data[8:16], "little")
        h = json.loads(bytes(data[16 : 16 + size]))
        at = 16 + size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.key = tuple(h["shard"])
        self.doc_ids = take("<i8", h["docs"])
        self.null_ids = set(h["null_ids"])
        self.ends = take("<u8", h["docs"]).astype(np.int64)
        planes = [take("u1", h["plane"]) for _ in range(h["bits"])]
        directories = [take("<u4", h["plane"] // WaveletMatrix.STEP + 1) for _ in range(h["bits"])]
        self.matrix = WaveletMatrix(h["tokens"], h["bits"], planes, directories, h["zeros"])

    def starts(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), self.ends[:-1]]) if len(self.ends) else self.ends
