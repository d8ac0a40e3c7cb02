"""Benchmark items in documents, within an edit distance: pigeonhole pieces and Myers verification.

An item of m characters has an error budget of k = m // CHARS_PER_ERROR edits
(none for short ones) and is cut into k + 1 pieces: k edits leave one piece untouched, so every
occurrence within the budget holds a piece exactly.  One Aho-Corasick pass
over a text finds the piece hits; each hit names a stretch of the text where
the item could lie; overlapping stretches of an item are joined and searched
once with Myers' bit-parallel algorithm.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared

CHARS_PER_ERROR = 16
#: Shorter items (normalised) have no budget and are found between word borders only: with edits, or inside words, they match by chance.
FUZZY_CHARS = 32
#: Characters of items that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 4 << 20


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of pattern to any part of text, and the first place where such a part ends; None beyond the budget."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    get = masks.get
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for place, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, place
        up = up << 1 & full
        plus = (down << 1 & full) | (full & ~(vertical | up))
        minus = up & vertical
    return (best, end) if best <= budget else None


def budget(m: int) -> int:
    """Edits allowed for an item of m normalised characters."""
    return m // CHARS_PER_ERROR if m >= FUZZY_CHARS else 0


def _as_words(pattern: str, text: str, end: int) -> bool:
    """Whether the pattern that ends at ``end`` is cut off from the letters and digits around it."""
    start = end - len(pattern)
    before = start > 0 and text[start - 1].isalnum() and pattern[0].isalnum()
    after = end < len(text) and text[end].isalnum() and pattern[-1].isalnum()
    return not before and not after


class Finder:
    """Items (id, text) and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, raw in items:
            text = normalise(raw)
            m = len(text)
            if not m:
                continue
            k = budget(m)
            cuts = [j * m // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces[text[a:b]].append((len(self.items), a))
            self.items.append((item, text, k))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[tuple[int, int]]:
        """(item id, least distance) of each item in a text."""
        if not raw or not self.items:
            return []
        text = normalise(raw)
        starts: dict[int, list[int]] = defaultdict(list)
        out = []
        short: set[int] = set()
        for last, (size, owners) in self.automaton.iter(text):
            for i, offset in owners:
                if self.items[i][2]:
                    starts[i].append(last + 1 - size - offset)
                elif i not in short and _as_words(self.items[i][1], text, last + 1):
                    short.add(i)
                    out.append((self.items[i][0], 0))
        for i, at in starts.items():
            item, pattern, k = self.items[i]
            best: int | None = None
            if pattern in text:
                best = 0
            else:
                m = len(pattern)
                at.sort()
                low = None
                for a in [*at, None]:
                    if low is not None and (a is None or a - k > high):
                        found = myers(pattern, text[max(0, low) : high], k if best is None else best - 1)
                        if found and (best is None or found[0] < best):
                            best = found[0]
                        low = None
                        if best == 1:
                            break
                    if a is not None:
                        if low is None:
                            low = a - k
                        high = a + m + k
            if best is not None:
                out.append((item, best))
        return sorted(out, key=lambda x: (x[0] is not None, x))


@lru_cache(maxsize=1)
def _finder(items: tuple[tuple[int, str], ...]) -> Finder:
    return Finder(list(items))


def find_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """docs with a column ``name``: array<struct<item_id: long, distance: int>>, the items that each text holds.

    benchmark(item_id, text): null or repeated ids and texts are allowed;
    items without a character other than white space (so null and empty ones)
    are never found, those under FUZZY_CHARS normalised characters only as
    they are and between word borders, and equal items are found each.  Texts
    and items are compared in lower case with white space runs as one blank.
    A null or empty text holds nothing.  Every row of docs comes out once,
    with all its columns; a column of the new name is replaced.  Empty tables
    work: no documents, or no items and empty arrays.

    The items go to every executor, at most PASS_CHARS characters at once; a
    larger benchmark is dealt over several passes, each written before the
    next, so neither the driver nor a task ever holds more.  A document is
    searched whole and alone, so nothing is shuffled.
    """
    shared.small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(chars / PASS_CHARS))
    out = docs.withColumn(name, F.array().cast("array<struct<item_id: bigint, distance: int>>"))
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        chosen = tuple(sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is not None, r)))
        sent = docs.sparkSession.sparkContext.broadcast(chosen)
        out = _search(out, sent, name)
        if passes > 1:
            out = shared.materialise(out, "searched")
            sent.destroy()
    return out


def _search(docs: DataFrame, sent: Broadcast, name: str) -> DataFrame:
    """docs with what the items (id, text) add to the column ``name``."""
    at = docs.columns.index("text")
    into = docs.columns.index(name)

    def run(batches):
        finder = _finder(sent.value)
        for batch in batches:
            found = [finder.find(t.as_py()) for t in batch.column(at)]
            before = batch.column(into).to_pylist()
            rows = [old + [{"item_id": i, "distance": d} for i, d in new] for old, new in zip(before, found, strict=True)]
            columns = list(batch.columns)
            columns[into] = pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
