"""Token ids of whole columns with the tokenizers library, each distinct piece encoded once a worker."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemark.llm import textblock as tb
from tidemark.llm.bytepair import byte_alphabet, split_special
from tidemark.llm.pretokens import PieceCache, piece_starts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that may stand side by side in one call: each starts with a blank and a character that isn't white space.
_APART = re.compile(rb" [^\s\x80-\xff]|  ?$")


class ColumnEncoder:
    """Ids of the texts of a byte-level vocabulary file of the tokenizers library.

    The library's own pre-tokenizer pattern is applied to a block at a time
    (``piece_starts``); the library then encodes the pieces.  Texts with one of
    the vocabulary's special strings go to the library whole.
    """

    TOGETHER = 400

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_alphabet()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for name, i in spec["model"]["vocab"].items():
            if name not in self.special:
                self.width[i] = sum(c in stand_in for c in name)
        self.cache = PieceCache(self._pieces, np.uint32)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        sizes = np.zeros(n, np.int64)
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
        apart = [i for i, p in enumerate(pieces) if len(p) > 1 and _APART.match(p)]
        other = sorted(set(range(n)) - set(apart))
        groups = [apart[i : i + self.TOGETHER] for i in range(0, len(apart), self.TOGETHER)]
        texts = [b"".join([pieces[i] for i in g]).decode() for g in groups]
        for g, found in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            row = np.array(found.ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.width[row]), np.cumsum([len(pieces[i]) for i in g])) + 1
            for i, a, b in zip(g, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                ids[i], sizes[i] = row[a:b], b - a
        for i, found in zip(other, self.library.encode_batch_fast([pieces[i].decode() for i in other], add_special_tokens=False), strict=True):
            ids[i] = np.array(found.ids, np.uint32)
            sizes[i] = len(ids[i])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), sizes

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [np.zeros(0, np.uint32)], np.zeros(len(column), np.int64)
        for block in tb.blocks(column):
            start = piece_starts(block)
            at, size = self.cache.look_up(block, start)
            flat.append(self.cache.ids(at, size))
            sums = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            sizes[block.first : block.first + len(block)] = np.diff(sums[np.searchsorted(start, block.offs)])
        return np.concatenate(flat), sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; null as empty."""
        column, extra = split_special(column, self.special)
        if extra is None:
            return self._plain(column)
        whole = np.flatnonzero(extra[2])
        flat, sizes = self._plain(pa.array([None if i in set(whole.tolist()) else t for i, t in enumerate(column.to_pylist())], pa.large_string()))
        ends = np.cumsum(sizes)
        parts, at = [], 0
        for i in whole.tolist():
            ids = np.array(self.library.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
            parts += [flat[at : ends[i]], ids]
            at, sizes[i] = ends[i], len(ids)
        return np.concatenate([*parts, flat[at:]]), sizes


@lru_cache(maxsize=2)
def encoder(path: str) -> ColumnEncoder:
    """One a process."""
    return ColumnEncoder(path)
