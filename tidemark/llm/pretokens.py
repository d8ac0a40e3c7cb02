"""Splitting text for byte-level byte-pair encoding, and a cache of what each piece encodes to.

``piece_starts`` finds the borders that the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

gives, for all texts of a block at once.  ``PieceCache`` maps the hash of a
piece to its value (a count, or its ids); a piece is handed to the encoder
only when the cache doesn't hold it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from tidemark.llm import textblock as tb

LETTER, NUMBER, SPACE, OTHER = range(4)
_KINDS = ((LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s")))


def _kind(char: str) -> int:
    return next((k for k, rx in _KINDS if rx.fullmatch(char)), OTHER)


_ASCII = np.array([_kind(chr(i)) for i in range(128)] + [OTHER] * 128, np.uint8)
_wide: dict[int, int] = {}


def _wide_kinds(points: np.ndarray) -> np.ndarray:
    values, back = np.unique(points, return_inverse=True)
    for v in values.tolist():
        if v not in _wide:
            _wide[v] = _kind(chr(v))
    return np.array([_wide[v] for v in values.tolist()], np.uint8)[back]


def _kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    kind = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
        b0, b1, b2, b3 = (padded[lead + i] for i in range(4))
        two, three = b0 < 0xE0, b0 < 0xF0
        point = np.where(two, (b0 & 31) << 6 | b1 & 63, np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        k = _wide_kinds(point)
        kind[lead] = k
        kind[lead + 1] = k
        kind[lead[~two] + 2] = k[~two]
        kind[lead[~three] + 3] = k[~three]
    return kind


def piece_starts(block: tb.Block) -> np.ndarray:
    """Byte positions where pieces start; every text's first byte is one."""
    buf, offs = block.buf, block.offs
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds(buf)
    border = np.zeros(n + 1, bool)
    border[offs] = True
    change = border[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = buf[:-1] == 32
    after_blank &= ~border[:n]
    space = kind == SPACE
    start = change & (space | ~after_blank)
    # the last white space before something else stands alone, or goes with it if it's a blank
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~border[1:n])
    while len(back := np.flatnonzero((buf[last] & 0xC0) == 0x80)):
        last[back] -= 1
    start[last] = True
    _contractions(buf, start, border)
    return np.flatnonzero(start)


def _contractions(buf: np.ndarray, start: np.ndarray, border: np.ndarray) -> None:
    quote = np.flatnonzero((buf == 39) & start)
    if not len(quote):
        return
    padded = np.concatenate([buf, np.zeros(2, np.uint8)])
    same1 = np.concatenate([~border[1:], [False, False]])  # byte i+1 is in the text of byte i
    a, b = padded[quote + 1], padded[quote + 2]
    one = same1[quote] & np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = same1[quote] & same1[quote + 1] & ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    for at, width in ((quote[one], 2), (quote[two], 3)):
        for i in range(1, width):
            start[at + i] = False
        ends = at + width
        start[ends[ends < len(start)]] = True


class PieceCache:
    """Direct-mapped: hash of a piece -> offset and length of its ids in a pool.

    ``encode`` takes a list of byte pieces and gives all their ids in one array
    and how many each has.  When the pool passes a fixed bound everything is
    dropped, so memory stays bounded on any input.
    """

    SLOTS = 1 << 22
    POOL = 1 << 23

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: type = np.uint32):
        self.encode, self.dtype = encode, dtype
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int32)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.pool = np.zeros(1 << 18, self.dtype)
        self.used = 0

    def _add(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(ids)), self.dtype)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def look_up(self, block: tb.Block, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length in the pool, for each piece of the block."""
        if self.used > self.POOL:
            self._clear()
        end = np.append(start[1:], len(block.buf))
        h = tb.span(tb.prefix(tb._BYTE_VALUES[block.buf]), start, end)
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        missed = np.flatnonzero(self.keys[slot] != h)
        if len(missed):
            new, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
            raw = block.buf.tobytes()
            spans = zip(start[missed][first].tolist(), end[missed][first].tolist(), strict=True)
            flat, sizes = self.encode([raw[a:b] for a, b in spans])
            sizes = sizes.astype(np.int32)
            places = (self._add(flat) + np.cumsum(sizes) - sizes).astype(np.int32)
            at[missed], size[missed] = places[back], sizes[back]
            into = (new & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.keys[into], self.at[into], self.size[into] = new, places, sizes
        return at, size

    def ids(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after the other."""
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(at - (ends - size), size) + np.arange(total)]
