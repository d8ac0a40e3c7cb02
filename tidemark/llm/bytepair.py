"""Counting byte-pair tokens by a heap over a linked list, and the vocabulary files behind it.

The count of a piece is its number of byte symbols less the merges done:
adjacent pairs wait in a heap by rank (then by place); popping the lowest
joins two neighbours of a doubly linked list and pushes the two new pairs.
No identifier is looked up or given out.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm import textblock as tb
from tidemark.llm.pretokens import PieceCache, piece_starts


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, the others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeTable:
    """Merges of a byte-level vocabulary file: (left, right) -> rank and the joined symbol."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str]):
        names = {bytes([b]): b for b in range(256)}
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            joined = names.setdefault(a + b, len(names))
            self.ranks.setdefault(names[a] << 20 | names[b], (rank, joined))
        self.special = special

    @classmethod
    def from_json(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_alphabet()
        raw = lambda s: bytes(stand_in[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        return cls([(raw(a), raw(b)) for a, b in pairs], [t["content"] for t in spec.get("added_tokens", [])])

    def count(self, piece: bytes) -> int:
        """Symbols left when no adjacent pair has a rank."""
        n = len(piece)
        if n < 2:
            return n
        ranks = self.ranks
        symbol = list(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (found := ranks.get(symbol[i] << 20 | symbol[i + 1])) is not None:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, joined = heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = joined, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (found := ranks.get(joined << 20 | symbol[k])) is not None:
                    heappush(heap, (found[0], i, joined, symbol[k], found[1]))
            if (p := before[i]) >= 0 and (found := ranks.get(symbol[p] << 20 | joined)) is not None:
                heappush(heap, (found[0], p, symbol[p], joined, found[1]))
        return n - merges


class TokenCounter:
    """Tokens of every text of a column, by cached counts of its pieces."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.cache = PieceCache(self._counts, np.uint32)

    def _counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.table.count(p) for p in pieces], np.uint32), np.ones(len(pieces), np.int32)

    def _plain(self, column: pa.Array) -> np.ndarray:
        total = np.zeros(len(column), np.int64)
        for block in tb.blocks(column):
            start = piece_starts(block)
            at, _ = self.cache.look_up(block, start)
            sums = np.concatenate([[0], np.cumsum(self.cache.pool[at], dtype=np.int64)])
            total[block.first : block.first + len(block)] = np.diff(sums[np.searchsorted(start, block.offs)])
        return total

    def count(self, column: pa.Array) -> np.ndarray:
        """Special strings of the vocabulary are one token each, and part the text; the longest at a place wins."""
        texts, extra = split_special(column, self.table.special)
        if extra is None:
            return self._plain(column)
        rows, parts, specials = extra
        counts = np.bincount(rows, weights=self._plain(parts), minlength=len(texts)).astype(np.int64)
        return counts + specials


def split_special(column: pa.Array, special: list[str]) -> tuple[pa.Array, tuple[np.ndarray, pa.Array, np.ndarray] | None]:
    """None when no text holds a special string; else (text of each part, parts, special strings of each text)."""
    import re

    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    held = [pc.fill_null(pc.match_substring(column, s), False) for s in special]
    if not any(pc.any(h).as_py() for h in held):
        return column, None
    rx = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    rows, parts, specials = [], [], np.zeros(len(column), np.int64)
    for i, text in enumerate(column.to_pylist()):
        own = rx.split(text or "")
        specials[i] = len(own) - 1
        rows += [i] * len(own)
        parts += own
    return column, (np.array(rows), pa.array(parts, pa.large_string()), specials)


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One a process; its cache serves all batches of a worker."""
    return TokenCounter(MergeTable.from_json(path))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs without ``text``, plus ``n_bytes`` (UTF-8) and ``name`` (tokens), both long.

    One row out for every row in, in whatever order; repeated rows are counted
    each.  A null or empty text has 0 bytes and 0 tokens.  A text is never
    cut, however long.  An empty table gives an empty result.  If docs has
    columns of the new names, they are replaced.  ``vocabulary`` is the path
    of a byte-level vocabulary file that all executors can open.
    """
    shared.small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "n_bytes", name)]
    frame = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").alias("__text"))
    out = frame.drop("__text").withColumns({"n_bytes": F.lit(0).cast("long"), name: F.lit(0).cast("long")}).schema

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            column = batch.column(len(rest))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(_sizes(column)), pa.array(count.count(column))], names=[*rest, "n_bytes", name])

    return frame.mapInArrow(run, out)


def _sizes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)
