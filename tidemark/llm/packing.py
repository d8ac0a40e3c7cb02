"""Packing documents into training sequences of several permitted lengths.

Each permitted length has a price.  By default that is the work of training on
such a sequence: a share that grows with its tokens and one, attention's, with
their square.  So many short sequences are cheaper than few long ones as long as documents
fill them as well, and the lengths have to be chosen together.

Best-fit decreasing with bins of more than one size: each document goes into
the open bin that it leaves the least room in; where none has room, a bin is
opened, of the length that will cost the least a token with what the documents
not yet placed can fill of it.  In the end each bin gets the cheapest permitted
length that holds its contents.  The same best fit with one length alone is
tried too, and the cheapest packing of the shard is taken, so several lengths
never cost more than one.

Documents are packed in shards of bounded size, dealt by a hash of the id, so
no task holds more than a shard; a corpus has many shards and each leaves at
most a few bins half full.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_DOCS = 20_000
#: Tokens of a sequence at which attention's part of the work equals the rest.
EVEN_TOKENS = 16_384


def prices(capacities: Sequence[int]) -> list[float]:
    """The default price of each length, in tokens of linear work."""
    return [c + c * c / EVEN_TOKENS for c in capacities]


class _Unplaced:
    """The documents after a given one (sizes descending): how far they fill a room, greedily, largest first."""

    def __init__(self, sizes: np.ndarray):
        values, first = np.unique(-sizes, return_index=True)
        self.values = (-values).tolist()  # distinct sizes, descending
        self.ascending = values.tolist()  # their negatives, for searches
        self.first = first.tolist()
        self.ends = [*self.first[1:], len(sizes)]

    def fill(self, room: int, after: int) -> int:
        """Tokens of documents behind place ``after`` that fit into the room."""
        left = room
        k = max(bisect_left(self.ascending, -left), bisect_right(self.first, after) - 1)
        while left > 0 and k < len(self.values):
            size = self.values[k]
            there = self.ends[k] - max(self.first[k], after + 1)
            if there > 0:
                left -= size * min(there, left // size)
            k = max(k + 1, bisect_left(self.ascending, -left))
        return room - left


def _place(sizes: np.ndarray, capacities: Sequence[int], price: Sequence[float]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each document, and the tokens of each bin: best fit, opening what costs the least a token."""
    unplaced = _Unplaced(sizes) if len(capacities) > 1 else None
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    used: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted: the first that suffices is the best fit
    for i, size in enumerate(sizes.tolist()):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            least = bisect_left(capacities, size)
            room = capacities[least]
            if unplaced is not None and least + 1 < len(capacities):
                # ties: the shorter
                room = min((p / (size + unplaced.fill(c - size, i)), c) for c, p in zip(capacities[least:], price[least:], strict=True))[1]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    return bins, offsets, used


def pack(sizes: np.ndarray, capacities: Sequence[int], price: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each piece; sizes are descending, positive, and at most the largest capacity."""
    price = prices(capacities) if price is None else price
    best = None
    # the choices: all lengths together, then each alone that holds the largest document
    for lengths in [range(len(capacities)), *([k] for k in range(len(capacities)) if len(sizes) and capacities[k] >= sizes[0])]:
        bins, offsets, used = _place(sizes, [capacities[k] for k in lengths], [price[k] for k in lengths])
        cheapest = [min(range(bisect_left(capacities, u), len(capacities)), key=lambda k: (price[k], capacities[k])) for u in used]
        cost = sum(price[k] for k in cheapest)
        if best is None or cost < best[0] - 1e-9 * abs(best[0]):
            best = cost, bins, offsets, np.array([capacities[k] for k in cheapest], np.int64)
    _, bins, offsets, final = best
    return bins, offsets, final[bins] if len(bins) else final


def pack_documents(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_docs: int = SHARD_DOCS, price: Sequence[float] | None = None) -> DataFrame:
    """Place every document of lengths(doc_id, n_tokens): doc_id, piece, n_tokens, shard, bin, bin_offset, bin_length.

    A document longer than the largest capacity is cut into pieces of that
    capacity and a rest; its pieces are packed as documents are.  Documents
    of no tokens (or null) get one piece of 0 tokens in no bin (bin,
    bin_offset and bin_length null).  Repeated rows are packed each.  An empty
    table gives no rows.  Ties go by doc_id, then piece.  Other columns are
    not read.  All lengths are whole tokens.  ``price`` has the cost of a
    sequence of each capacity (see ``prices``).
    """
    if price is not None and len(price) != len(capacities):
        raise ValueError("price must have a cost for each capacity")
    priced = dict(zip(map(int, capacities), prices(capacities) if price is None else price, strict=True))
    capacities = sorted(priced)
    costs = [priced[c] for c in capacities]
    if not capacities or capacities[0] < 1 or shard_docs < 1:
        raise ValueError("capacities and shard_docs must be positive")
    most = capacities[-1]
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("size"))
    rows = rows.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / most)).cast("int"))
    total = rows.agg(F.sum("n_pieces")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_docs))
    pieces = rows.select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(most), F.col("size") - F.col("piece").cast("long") * most).alias("n_tokens"))
    # by id and piece: the pieces of one very long document spread over shards too
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = g["n_tokens"].to_numpy(np.int64)
        n = int((sizes > 0).sum())
        for name, values in zip(("bin", "bin_offset", "bin_length"), pack(sizes[:n], capacities, costs), strict=True):
            g[name] = pd.array(np.concatenate([values, np.zeros(len(g) - n, np.int64)]), "Int64")
            g.loc[n:, name] = pd.NA
        return g

    return pieces.groupBy("shard").applyInPandas(run, "doc_id long, piece int, n_tokens long, shard long, bin long, bin_offset long, bin_length long")
