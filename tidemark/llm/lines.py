"""Fuzzy line dedup: one line stays of each group of near-equal lines of the corpus.

A line (between line feeds, ASCII white space off its ends, A-Z lower-cased)
has as its set the runs of WIDTH characters in it.  Its signature has one
minimum for each of BUCKETS parts of the hash space, empty parts filled from
others; bands of ROWS minima make candidate pairs, sizes and profiles drop those
that can't be similar, exact Jaccard similarity confirms the others, and of each
component of links the first line in the corpus, by (doc_id, line), is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm import textblock as tb
from tidemark.llm.bands import Measure, Sets, bucket_mates, link

WIDTH = 5
THRESHOLD = 0.8
#: At the threshold a pair shares a band with probability 0.9995.  Lines of one
#: language share a few in a hundred runs; six rows keep those apart.
BUCKETS, ROWS = 150, 6
BANDS = BUCKETS // ROWS
_EMPTY = np.uint32(0xFFFFFFFF)
_ORDER = np.argsort(tb.seeds(BUCKETS * BUCKETS, 0x1D).reshape(BUCKETS, BUCKETS), axis=1)
_BAND_SEEDS = tb.seeds(BANDS, 0x2E)
_ROW_FACTORS = tb.seeds(BUCKETS, 0x4F) | np.uint64(1)
_RUN_FACTORS = tb.seeds(3, 0x95) | np.uint64(1)
_BAG_VALUES = tb.seeds(256, 0x83)
_NO_ID = -(1 << 63)
#: Counts of a profile.
PROFILE = 64
#: Lines whose signatures are filled up together, and lines that a task remembers so as to have their keys once.
GROUP, SEEN = 2000, 1 << 18
# glibc keeps twice the largest array under 32 MB that it was given back, and
# returns the rest to the system; a block's arrays would be faulted in each time
np.empty(24 << 20, np.uint8)


def _trimmed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without white space at their ends."""
    start, end = start.copy(), end.copy()
    for at, step in ((start, 1), (end, -1)):
        todo = np.flatnonzero(start < end)
        for _ in range(64):
            todo = todo[tb._SPACE[buf[at[todo] - (step < 0)]]]
            if not len(todo):
                break
            at[todo] += step
            todo = todo[start[todo] < end[todo]]
        if len(todo):  # long runs of white space
            solid = np.flatnonzero(~tb._SPACE[buf])
            edge = np.append(solid, len(buf)) if step > 0 else np.insert(solid, 0, -1) + 1
            found = np.searchsorted(solid, at[todo], "left")
            at[todo] = np.minimum(edge[found], end[todo]) if step > 0 else np.maximum(edge[found], start[todo])
    return start, end


def _mixed(h: np.ndarray) -> np.ndarray:
    """``tb.mix`` in place."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


class Lines:
    """The lines of a block that have a word: bytes start..end, number in the text, 64-bit hash (node) and a second hash (check)."""

    def __init__(self, block: tb.Block):
        buf = tb._LOWER.take(block.buf)
        feeds = np.flatnonzero(buf == 10)
        # a line begins at each text and after each feed, and ends before the next of them
        start = np.concatenate([block.offs[:-1], feeds + 1])
        text = np.concatenate([np.arange(len(block)), np.searchsorted(block.offs, feeds, "right") - 1])
        order = np.argsort(start, kind="stable") if len(feeds) else np.arange(len(start))
        # an empty text begins where the next one does: texts come first in the order, feeds' lines are later
        order = order[np.argsort(text[order], kind="stable")]
        start, text = start[order], text[order]
        end = np.append(start[1:] - 1, len(buf))
        last = np.ones(len(start), bool)
        last[:-1] = text[1:] != text[:-1]
        end[last] = block.offs[text[last] + 1]
        number = np.arange(len(start)) - np.searchsorted(text, text)
        start, end = _trimmed(buf, start, end)
        some = start < end
        self.buf = buf
        self.start, self.end, self.text, self.number = start[some], end[some], text[some], number[some]

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """Each line's sum of values of the block's bytes."""
        edges = np.stack([self.start, self.end], axis=1).ravel()
        # a line at the block's end has no byte behind it
        return np.add.reduceat(values, edges[:-1] if len(edges) and edges[-1] == len(values) else edges)[::2] if len(edges) else np.zeros(0, np.uint64)

    @cached_property
    def node(self) -> np.ndarray:
        values = tb._BYTE_VALUES.take(self.buf)
        powers, inverses = tb._tables(len(values))
        values *= powers
        size = (self.end - self.start).astype(np.uint64)
        return tb.signed(tb.mix(self._sums(values) * inverses[self.start] + size * _RUN_FACTORS[0]))

    @cached_property
    def check(self) -> np.ndarray:
        return tb.signed(tb.mix(self._sums(_BAG_VALUES.take(self.buf))))

    def shingles(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in use, hash) of the characters' runs of the lines ``use``, ascending; a shorter line is one run."""
        # characters as code points of 21 bits; runs of the whole block, then those that lie in one line
        chars = np.frombuffer(self.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(chars) == len(self.buf):
            a, b = self.start[use], self.end[use]
        else:
            lead = np.flatnonzero((self.buf & 0xC0) != 0x80)
            a, b = np.searchsorted(lead, self.start[use]), np.searchsorted(lead, self.end[use])
        long = b - a >= WIDTH
        pairs = chars[1:] << np.uint64(21) | chars[:-1]
        h = _mixed(pairs[:-3] * _RUN_FACTORS[0] + pairs[2:-1] * _RUN_FACTORS[1] + chars[4:] * _RUN_FACTORS[2]) if len(chars) >= WIDTH else np.zeros(0, np.uint64)
        size = np.where(long, b - a - WIDTH + 1, 0)
        owner = np.repeat(np.arange(len(use)), size)
        # a run lies in a line from its start to WIDTH - 1 before its end; lines don't overlap, and few runs lie between them
        gap = np.insert(b[long] - WIDTH + 1, 0, 0)
        size = np.append(a[long], len(h)) - gap
        inside = np.ones(len(h), bool)
        inside[np.repeat(gap - np.cumsum(size) + size, size) + np.arange(size.sum())] = False
        h = h[inside]
        if not long.all():
            few = np.flatnonzero(~long)
            owner = np.concatenate([owner, few])
            h = np.concatenate([h, self.node[use[few]].view(np.uint64)])
            order = np.argsort(owner, kind="stable")
            owner, h = owner[order], h[order]
        return owner, h


def _minima(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) minima, _EMPTY in empty parts: the high half of a hash names the part, the low half is the value."""
    least = np.full(n * BUCKETS, _EMPTY)
    part = (h >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)
    np.minimum.at(least, owner * BUCKETS + part.view(np.int64), h.astype(np.uint32))
    return least.reshape(n, BUCKETS)


def signatures(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) minima, empty parts filled from others."""
    return tb.densify(_minima(owner, h, n), _EMPTY, _ORDER)


def profiles(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the n sets, and (n, PROFILE) counts of their members by hash, 255 at most.

    Two sets differ in at least as many members as their counts do.
    """
    keys = h ^ tb.mix(np.arange(n), 0x7E).take(owner)
    order = np.argsort(keys)
    keys = keys[order]
    own = order[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    # any six bits will do, members are hashes
    part = owner * PROFILE + (h & np.uint64(PROFILE - 1)).view(np.int64)
    counts = np.bincount(part[own], minlength=n * PROFILE).reshape(n, PROFILE)
    return counts.sum(axis=1), np.minimum(counts, 255).astype(np.uint8)


def possible(size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes and profiles may have the threshold; no pair that has it is refused.

    Sets with common part i and union u have sizes of sum i + u and differ in
    u - i members, so i >= t * u allows (1 - t) / (1 + t) of the sum.
    """
    t = round(1000 * threshold)
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return (1000 * np.minimum(size_a, size_b) >= t * np.maximum(size_a, size_b)) & ((1000 - t) * (size_a + size_b) >= (1000 + t) * apart)


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys."""
    rows = minima.astype(np.uint64) * _ROW_FACTORS
    return tb.mix(np.add.reduce(rows.reshape(-1, BANDS, ROWS), axis=2) + _BAND_SEEDS)


def _keys(batches: Iterator[pa.RecordBatch]):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[int] = set()
    size = 0

    def filled() -> tuple[np.ndarray, np.ndarray]:
        nodes, minima = map(np.concatenate, zip(*held, strict=True))
        return band_keys(tb.densify(minima, _EMPTY, _ORDER)).ravel(), np.repeat(nodes, BANDS)

    for block in (block for batch in batches for block in tb.blocks(batch.column(0))):
        lines = Lines(block)
        use = tb.firsts(lines.node.view(np.uint64))
        nodes = lines.node[use].tolist()
        use = use[np.fromiter((x not in seen for x in nodes), bool, len(nodes))]
        if len(seen) > SEEN:
            seen.clear()
        seen.update(nodes)
        owner, h = lines.shingles(use)
        for at in range(0, len(use), GROUP):
            few = use[at : at + GROUP]
            i, j = np.searchsorted(owner, [at, at + GROUP])
            held.append((lines.node[few], _minima(owner[i:j] - at, h[i:j], len(few))))
            size += len(few)
            if size >= GROUP:
                yield filled()
                held, size = [], 0
    if held:
        yield filled()


def _occurrences(rows: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for block in tb.blocks(batch.column(2)):
            lines = Lines(block)
            for held, own in zip(parts, (lines.text + block.first, lines.number, lines.node, lines.check), strict=True):
                held.append(own)
        row, number, node, check = map(np.concatenate, parts)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(number), pa.array(node), pa.array(check)], names=["id", "version", "line", "node", "check"])

    return rows.mapInArrow(shared.each_batch(run), "id long, version long, line long, node long, check long")


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """node, text, size and profile of places(node, id, version, line), the text as it is compared."""
    asked = places.groupBy("id", "version").agg(F.collect_list(F.struct("line", "node")).alias("asked"))

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = batch.column(1).flatten()
        ends = np.cumsum(batch.column(1).value_lengths().to_numpy()).tolist()
        line, node = wanted.field("line").to_pylist(), wanted.field("node")
        text: list[bytes] = []
        # bytes have the white space and the lower case that lines are compared with
        for whole, end in zip(batch.column(0).cast(pa.binary()).to_pylist(), ends, strict=True):
            own = whole.split(b"\n")
            text += [own[k].strip().lower() for k in line[len(text) : end]]
        column = pa.array(text, pa.binary()).cast(pa.string())
        size, profile = np.zeros(len(text), np.int64), np.zeros((len(text), PROFILE), np.uint8)
        for block in tb.blocks(column):
            rows = slice(block.first, block.first + len(block))
            size[rows], profile[rows] = profiles(*_members(block), len(block))
        return pa.RecordBatch.from_arrays([node, column, pa.array(size), tb.fixed_binary(profile)], names=["node", "text", "size", "profile"])

    return docs.join(asked, ["id", "version"]).select("text", "asked").mapInArrow(shared.each_batch(pick), "node long, text string, size long, profile binary")


def _members(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    lines = Lines(block)
    owner, h = lines.shingles(np.arange(len(lines.start)))
    return lines.text[owner], h


def _hopeful(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that sizes and profiles leave; all links are among them."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("profile").alias(f"profile_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "profile_a", "profile_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PROFILE) for i in (4, 5))
        keep = possible(batch.column(2).to_numpy(), batch.column(3).to_numpy(), a, b, threshold)
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(shared.each_batch(run), "a long, b long")


def _gone(lines: DataFrame, firsts: DataFrame, found: DataFrame) -> DataFrame:
    """(id, version, line) of all lines but the first of their component.

    A line whose second hash isn't that of its node's first is another line
    that meets the node by chance; it stays.
    """
    place = ("id", "version", "line")
    # a line without a link that occurs once stays
    named = firsts.join(found, "node", "left").where("component is not null or n > 1").withColumn("component", F.coalesce("component", "node"))
    named = shared.materialise(named, "named")
    groups = named.groupBy("component").agg(F.min(F.struct(*place)).alias("first"), F.sum("n").alias("lines"), F.count("*").alias("n"))
    groups = shared.materialise(groups.where("lines > 1"), "groups")
    named = named.select("component", "node", "n", F.col("check").alias("own"))
    heads = shared.materialise(shared.spread_join(named, groups.select("component", "first"), ["component"], groups.select("component", "n")).drop("component"), "heads")
    met = shared.spread_join(lines, heads.select("node", "own", "first"), ["node"], heads.select("node", "n"))
    return met.where((F.col("check") == F.col("own")) & (F.struct(*place) != F.col("first"))).select(*place)


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, counts: tuple[str, str, str] = ("n_lines", "n_removed", "removed_lines")) -> DataFrame:
    """docs with the lines of ``text`` that repeat others taken out, and three columns more.

    ``counts`` names them: lines with a word (long), lines taken out (long)
    and their numbers from 0, ascending (array<long>).  Columns of these
    names are replaced; all others and every row stay.  A line is compared
    without ASCII white space at its ends and with A-Z in lower case; lines
    without a word are never compared or taken out.  Of a component of lines
    with |intersection| >= threshold * |union| the first by (doc_id, line)
    stays; null doc_ids come first.  Null and empty texts stay as they are.
    Rows of equal doc_id and text are one document; of other texts with one
    doc_id the order is fixed, by a hash.  A text that loses lines is the
    rest of its lines joined by line feeds.  An empty table gives an empty
    result.
    """
    shared.small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in counts]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    identity = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("version")]
    rows = docs.select(*identity, F.col("text").cast("string").alias("text"))
    lines = shared.materialise(_occurrences(rows), "lines")
    # of equal lines the first; n is how many there are
    firsts = lines.groupBy("node").agg(F.min(F.struct("check", "id", "version", "line")).alias("at"), F.count("*").alias("n"))
    firsts = shared.materialise(firsts.select("node", "at.*", "n"), "firsts")
    mates = bucket_mates(rows.select("text"), BANDS * firsts.count(), _keys)

    def fetch(wanted: DataFrame) -> DataFrame:
        return _texts(rows, firsts.join(wanted, "node").select("node", "id", "version", "line"))

    found = link(mates, Sets(Measure(_members, threshold), fetch, lambda pairs, texts: _hopeful(pairs, texts, threshold)))
    joined = docs.select("*", *(c.alias(f"__{n}") for c, n in zip(identity, ("id", "version"), strict=True)))
    gone = _gone(lines, firsts, found).groupBy("id", "version").agg(F.sort_array(F.collect_set("line")).alias("__gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("version").alias("__version"), "__gone")
    joined = joined.join(gone, ["__id", "__version"], "left").drop("__id", "__version")
    at = {c: i for i, c in enumerate(names)}
    schema = docs.withColumns({counts[0]: F.lit(0).cast("long"), counts[1]: F.lit(0).cast("long"), counts[2]: F.array().cast("array<bigint>")}).schema

    def rebuild(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at["text"]).cast(pa.binary()).to_pylist()
        gone = [[] if g is None else g for g in batch.column(len(names)).to_pylist()]
        found = [0] * len(texts)
        for i, text in enumerate(texts):
            if text is None:
                continue
            own = text.split(b"\n")
            found[i] = sum(map(bool, map(bytes.strip, own)))
            if gone[i]:
                lost = set(gone[i])
                texts[i] = b"\n".join([line for k, line in enumerate(own) if k not in lost])
        columns = list(batch.columns[: len(names)])
        columns[at["text"]] = pa.array(texts, pa.binary()).cast(pa.string())
        columns += [pa.array(found, pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *counts])

    return joined.select(*(F.col(f"`{c}`") for c in names), "__gone").mapInArrow(shared.each_batch(rebuild), schema)
