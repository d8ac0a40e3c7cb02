"""Buckets of equal band keys, and links within them.

Band keys are dealt to buckets in packed arrays.  Before dealing, a task
settles what it has buffered: of the nodes with one key only the least goes
on, the others are reported with it as their centre.  So a bucket gets a key
at most once a flush, and no task holds a hot key's nodes.  In the bucket the
least node of all is the centre of those that arrive.  All nodes of a key are
mates under that key, whatever task or flush they come from.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm import textblock as tb
from tidemark.llm.components import components

#: Keys that a bucket holds, and that a task buffers.
BUCKET_KEYS, FLUSH = 1 << 21, 1 << 20
_PACKED = "kind int, bucket int, keys binary, nodes binary, centres binary"
_MATES = "key long, node long, centre long"


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, node), the least node of each key, and whether the key has others."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    # most keys have one node; only the others' nodes are sorted
    alone = first.copy()
    alone[:-1] &= first[1:]
    again = np.flatnonzero(~alone)
    nodes[again] = nodes[again][np.lexsort((nodes[again], keys[again]))]
    fresh = first.copy()
    fresh[1:] |= nodes[1:] != nodes[:-1]
    keys, nodes, first = keys[fresh], nodes[fresh], first[fresh]
    group = np.cumsum(first) - 1
    centres = nodes[first][group] if len(keys) else nodes
    many = np.bincount(group)[group] > 1 if len(keys) else first
    return keys, nodes, centres, many


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << 8 * width) - 1)


def _cut(keys: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of keys: (n, width)."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _rows(kind: int, bucket: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    packed = [pa.array([a[order[i:j]].tobytes() for i, j in spans], pa.binary()) for a in arrays]
    packed += [pa.array([b""] * len(spans), pa.binary())] * (3 - len(packed))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(spans), pa.int32()), pa.array([int(bucket[i]) for i, _ in spans], pa.int32()), *packed], names=["kind", "bucket", "keys", "nodes", "centres"])


def bucket_mates(source: DataFrame, expected: int, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(key, node, centre) of all nodes that share a key with another; keys_of gives (keys, nodes) of parts of a task's batches.

    A key that only two nodes have gives one row, of the second with the first
    as its centre and no key.  expected: about how many keys there are.
    """
    least = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # as many tasks as buckets, so that neither grows with the corpus
    buckets = max(least, math.ceil(expected / BUCKET_KEYS))
    # a bucket has the high bits; of the low ones as many travel as make a chance match rare among this many keys
    width = min(8, max(4, math.ceil((math.log2(max(expected, 1)) + 16) / 8)))

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, nodes, centres, many = _stars(*map(np.concatenate, zip(*held, strict=True)))
        lead = nodes == centres
        yield _rows(0, _bucket(keys[lead], buckets), _cut(keys[lead], width), nodes[lead], many[lead])
        if many.any():
            # a hot key's nodes spread over the buckets by the node
            yield _rows(1, _bucket(tb.mix(nodes[many].view(np.uint64), 0x5B), buckets), _cut(keys[many] & _mask(width), 8), nodes[many], centres[many])

    def deal(batches):
        held, size = [], 0
        for part in keys_of(batches):
            held.append(part)
            size += len(part[0])
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def meet(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist())])
        known = table.column("kind")[0].as_py() == 1
        nodes = read("nodes", np.int64)
        raw = read("keys", np.uint8).reshape(len(nodes), -1) if len(nodes) else np.zeros((0, 8), np.uint8)
        keys = np.zeros((len(nodes), 8), np.uint8)
        keys[:, : raw.shape[1]] = raw
        keys = keys.view("<u8").ravel()
        if known:
            return pa.table({"key": tb.signed(keys), "node": nodes, "centre": read("centres", np.int64)})
        more = np.unique(keys[read("centres", bool)])
        # most keys come once; only the others are sorted by the node
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        again = order[np.append(same, False)[: len(order)] | np.insert(same, 0, False)[: len(order)]]
        keys, nodes, centres, many = _stars(keys[again], nodes[again])
        keys, nodes, centres = keys[many], nodes[many], centres[many]
        # two nodes and no others: the pair says all
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        two = (np.diff(first, append=len(keys)) == 2) & ~np.isin(keys[first], more)
        pair = np.zeros(len(keys), bool)
        pair[first[two]] = pair[first[two] + 1] = True
        use = ~pair
        use[first[two] + 1] = True
        return pa.table({"key": pa.array(tb.signed(keys), mask=pair).filter(pa.array(use)), "node": nodes[use], "centre": centres[use]})

    return source.mapInArrow(deal, _PACKED).repartition(buckets, "bucket").groupBy("kind", "bucket").applyInArrow(meet, _MATES)


#: Rounds of tests against drawn members, and tests a node and key in each, while blocks would compare more pairs than WORK.
ROUNDS, DRAWN, WORK = 3, 2, 20_000_000
#: Components whose outsiders make more pairs than this are compared in blocks of nodes, others pair by pair.
LISTED, BLOCK = 2000, 512


@dataclass(frozen=True)
class Measure:
    """members(block) gives (text, hash) of each text's members, by text; sets are similar from the Jaccard threshold."""

    members: Callable[[tb.Block], tuple[np.ndarray, np.ndarray]]
    threshold: float

    def listing(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all texts of a column, by text."""
        texts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for block in tb.blocks(column):
            text, h = self.members(block)
            texts.append(text + block.first)
            hashes.append(h)
        return np.concatenate(texts), np.concatenate(hashes)

    def similar(self, inter: np.ndarray, union: np.ndarray) -> np.ndarray:
        return (union > 0) & (1000 * inter >= round(1000 * self.threshold) * union)


@dataclass(frozen=True)
class Sets:
    """The sets behind nodes: fetch(nodes(node)) gives (node, text, ...); hopeful(pairs(a, b), texts) may drop pairs that can't be links."""

    measure: Measure
    fetch: Callable[[DataFrame], DataFrame]
    hopeful: Callable[[DataFrame, DataFrame], DataFrame]


def link(mates: DataFrame, sets: Sets) -> DataFrame:
    """(node, component) of all nodes with a link: bucket mates whose sets have the threshold.

    Nodes are tested against their centres first.  If groups are very large,
    what then lies outside the largest component of one of its keys is tested
    against a few members of that component, drawn by hash, round by round: in
    a group of near copies nearly all that have links find one that way, at a
    cost linear in the group.  At last all bucket mates that still are in different components
    are compared, so every two nodes that share a key either are in one
    component or have been compared on their full sets.
    """
    mates = shared.materialise(mates, "mates")
    nodes = mates.where("key is not null").select("key", "node").distinct()
    wanted = mates.select("node").union(mates.where("key is null").select("centre")).distinct()
    texts = shared.materialise(sets.fetch(shared.materialise(wanted, "wanted")), "texts")
    pairs = mates.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = _verified(pairs, sets, texts)
    for turn in range(ROUNDS + 1):
        found = shared.materialise(components(links), "found")
        mixed = _mixed(nodes, found)
        outsiders = shared.materialise(mixed.where("c <> top").select("top", "node", "c").distinct(), "outsiders")
        if outsiders.isEmpty():
            return found
        sizes = found.groupBy("component").agg(F.count("*").alias("n")).withColumnRenamed("component", "top")
        heads = outsiders.groupBy("top").agg(F.count("*").alias("o")).join(sizes, "top", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        large = shared.materialise(heads.where(F.col("o") * (F.col("o") + F.col("n")) > LISTED), "large")
        work = large.agg(F.sum(F.col("o") * (F.col("o") + F.col("n")))).first()[0] or 0
        stars = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
        if turn == ROUNDS or work <= WORK:
            break
        links = stars.union(_verified(_drawn(mixed, turn), sets, texts))
        nodes = mixed.select("key", "node")
    listed = _verified(_listed(mixed.join(large, "top", "left_anti")), sets, texts)
    return components(stars.union(listed).union(_compared(outsiders, found, large, sets.measure, texts)))


def _verified(pairs: DataFrame, sets: Sets, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    pairs = sets.hopeful(pairs, texts)
    side = lambda x, y: texts.select(F.col("node").alias(x), F.col("text").alias(y))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    measure = sets.measure

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                n = len(batch)
                # nodes come in several pairs; each one's members are listed once
                _, first, place = np.unique(np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()]), return_index=True, return_inverse=True)
                column = pa.concat_arrays([batch.column(2).cast(pa.large_string()), batch.column(3).cast(pa.large_string())]).take(pa.array(first))
                text, h = measure.listing(column)
                size = np.bincount(text, minlength=len(first))
                # texts 2i and 2i+1 are the pair i
                turn = place.reshape(2, n).T.ravel()
                count = size[turn]
                at = np.repeat((np.cumsum(size) - size)[turn] - (np.cumsum(count) - count), count)
                at += np.arange(len(at))
                keep = measure.similar(*tb.pair_overlaps(np.repeat(np.arange(2 * n), count), h[at], n))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return shared.materialise(both.mapInArrow(run, "a long, b long").distinct(), "links")


def _compared(outsiders: DataFrame, found: DataFrame, large: DataFrame, measure: Measure, texts: DataFrame) -> DataFrame:
    """Links of the outsiders of large components with members of those, and with each other; one a node and component in each block.

    Blocks of outsiders meet blocks of all, by a hash of the node, so a task
    holds 2 * BLOCK sets however large the component.
    """
    if large.isEmpty():
        return found.select(F.col("component").alias("a"), F.col("node").alias("b")).limit(0)
    out = outsiders.join(large, "top")
    inside = found.select(F.col("component").alias("top"), "node", F.col("component").alias("c")).join(large, "top")
    alone = large.join(found.select(F.col("component").alias("top")), "top", "left_anti")
    every = out.unionByName(inside).unionByName(alone.select("top", F.col("top").alias("node"), F.col("top").alias("c"), "o", "n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows, columns = blocks(F.col("o")), blocks(F.col("o") + F.col("n"))
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = out.select("top", "node", "c", dealt(rows).alias("i"), F.explode(F.sequence(F.lit(0), columns - 1)).alias("j"))
    right = every.select("top", "node", "c", dealt(columns).alias("j"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"))


    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        n, m = len(a), len(b)
        (ta, ha), (tb_, hb) = measure.listing(a.column("text")), measure.listing(b.column("text"))
        # sets: a repeated member counts once
        (ta, ha), (tb_, hb) = ((t[f], x[f]) for t, x in ((ta, ha), (tb_, hb)) for f in [tb.firsts(x ^ tb.mix(t.astype(np.uint64), 0x7E))])
        size_a, size_b = np.bincount(ta, minlength=n), np.bincount(tb_, minlength=m)
        common = np.intersect1d(ha, hb)
        inter = np.zeros((n, m), np.float32)
        at_a, at_b = np.searchsorted(common, ha), np.searchsorted(common, hb)
        in_a, in_b = np.isin(ha, common), np.isin(hb, common)
        (ta, at_a), (tb_, at_b) = (ta[in_a], at_a[in_a]), (tb_[in_b], at_b[in_b])
        order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
        ta, at_a, tb_, at_b = ta[order_a], at_a[order_a], tb_[order_b], at_b[order_b]
        step = 2048
        for low in range(0, len(common), step):
            dense = []
            for text, at, size in ((ta, at_a, n), (tb_, at_b, m)):
                i, j = np.searchsorted(at, [low, low + step])
                part = np.zeros((size, min(step, len(common) - low)), np.float32)
                part[text[i:j], at[i:j] - low] = 1
                dense.append(part)
            inter += dense[0] @ dense[1].T
        node_a, node_b, ca, cb = (np.asarray(x) for x in (a.column("node"), b.column("node"), a.column("c"), b.column("c")))
        whole = inter.astype(np.int64)
        hit = measure.similar(whole, size_a[:, None] + size_b[None, :] - whole) & (ca[:, None] != cb[None, :])
        x, y = np.nonzero(hit)
        _, first = np.unique(np.stack([x, cb[y]], 1), axis=0, return_index=True)
        return pa.table({"a": node_a[x[first]], "b": node_b[y[first]]})

    names = ["node", "top", "c", "i", "j", "text"]
    sides = [f.join(texts.select("node", "text"), "node").select(*names).toDF(*names).groupBy("top", "i", "j") for f in (left, right)]
    return shared.materialise(sides[0].cogroup(sides[1]).applyInArrow(compare, "a long, b long"), "block-links")


def _mixed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, component c, the key's largest component top and its nodes n_top, of keys with several components."""
    placed = nodes.join(found.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    keys = shared.materialise(keys.select("key", F.col("most.c").alias("top"), F.col("most.n").alias("n_top"), "n"), "keys")
    return shared.materialise(shared.spread_join(placed, keys.drop("n"), ["key"], keys.select("key", "n")), "mixed")


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _drawn(mixed: DataFrame, turn: int) -> DataFrame:
    """Each node outside the largest component of a key, with about DRAWN members of that component."""
    slots = F.greatest(F.lit(1), F.floor(F.col("n_top") / DRAWN))
    slot = lambda *by: F.pmod(F.xxhash64(*by, F.lit(turn)), slots)
    outside = mixed.where("c <> top").select("key", slot("node", "key").alias("slot"), F.col("node").alias("x"))
    inside = mixed.where("c = top").select("key", slot("node").alias("slot"), F.col("node").alias("y"))
    return _pairs(outside.join(inside, ["key", "slot"]))


def _listed(mixed: DataFrame) -> DataFrame:
    """All pairs of nodes that share a key and are in different components, one of them outside the key's largest."""
    outside = mixed.where("c <> top").select("key", F.col("node").alias("x"), F.col("c").alias("cx"))
    others = mixed.select("key", F.col("node").alias("y"), F.col("c").alias("cy"), "top")
    # two outsiders meet once, from the smaller node
    return _pairs(outside.join(others, "key").where("cx <> cy and (cy = top or x < y)"))
