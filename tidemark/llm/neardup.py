"""Near-duplicate documents: HyperMinHash sketches, banding, exact verification, components.

1. One pass over the texts gives each document's shingle count, set digest and
   sketch.  Documents of equal digest are one class, named by its least id.
2. Band keys of the classes' registers make buckets.  In each bucket every
   member is a candidate with a centre, so m members give about m pairs.
3. Sizes and the corrected sketch estimate drop hopeless pairs; the others are
   verified on full shingle sets, made from the whole texts.
4. Components of the verified links.  Bucket mates that still are in different
   components are compared too (all of them, see ``bands.link``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hyperminhash as hm
from tidemark.llm import shared
from tidemark.llm import textblock as tb
from tidemark.llm.bands import Measure, Sets, bucket_mates, link

WIDTH = 5
THRESHOLD = 0.75
#: Sets of this size or more are dropped on their estimate; 128 registers put the margin beyond five standard deviations.
ESTIMATE_FROM, MARGIN = 128, 0.2
_NO_ID = -(1 << 63)


def sketches(docs: DataFrame) -> DataFrame:
    """Of docs(id, version, text): id, version, n_shingles, c1 and c2 (digest of the set), registers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(batch)
        size = np.zeros(n, np.int64)
        digest = np.zeros((2, n), np.uint64)
        registers = np.full((n, hm.REGISTERS), 0xFFFF, np.uint16)
        for block in tb.blocks(batch.column(2)):
            text, h = tb.shingles(block, WIDTH)
            rows = slice(block.first, block.first + len(block))
            size[rows] = np.bincount(text, minlength=len(block))
            registers[rows] = hm.sketch(text, h, len(block))
            ends = np.searchsorted(text, np.arange(len(block) + 1))
            for k, salt in enumerate((0x11, 0x22)):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(h, salt))])
                digest[k, rows] = tb.mix(np.diff(sums[ends]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(tb.signed(digest[0])), pa.array(tb.signed(digest[1])), tb.fixed_binary(registers)], names=["id", "version", "n_shingles", "c1", "c2", "registers"])

    return docs.mapInArrow(shared.each_batch(run), "id long, version long, n_shingles long, c1 long, c2 long, registers binary")


def _keys(batches: Iterator[pa.RecordBatch]):
    """Band keys of classes(node, registers)."""
    for batch in batches:
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, hm.REGISTERS)
        yield hm.band_keys(registers).ravel(), np.repeat(batch.column(0).to_numpy(), hm.BANDS)


def _hopeful(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that sizes and estimates leave."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("registers").alias(f"registers_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # the intersection is the smaller set at most, the union the larger at least
    both = both.where(F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, hm.REGISTERS) for i in (2, 3))
        size_a, size_b = (batch.column(i).to_numpy() for i in (4, 5))
        keep = (np.minimum(size_a, size_b) < ESTIMATE_FROM) | (hm.estimate(a, b, size_a, size_b) >= threshold - MARGIN)
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "registers_a", "registers_b", "size_a", "size_b").mapInArrow(shared.each_batch(run), "a long, b long")


def _identity() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version")]


def _judged(docs: DataFrame, threshold: float) -> DataFrame:
    """id, version (hash of the text), n_shingles and component_id of each row of docs."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select(*_identity(), F.col("text").cast("string").alias("text"))
    sketched = shared.materialise(sketches(rows), "sketches")
    # classes have numbers of their own: ids may be null or repeat; one of its rows stands for a class
    own = sketched.where("n_shingles > 0")
    real = F.coalesce("id", F.lit(_NO_ID))
    classes = own.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.min(F.struct(real.alias("row"), "version")).alias("at"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("registers").alias("registers"))
    classes = shared.materialise(classes.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "id", "at.*", "n", "size", "registers"), "classes")
    mates = bucket_mates(classes.select("node", "registers"), hm.BANDS * classes.count(), _keys)

    def fetch(wanted: DataFrame) -> DataFrame:
        places = classes.join(wanted, "node").select("node", "row", "version")
        return rows.select(real.alias("row"), "version", "text").join(places, ["row", "version"]).dropDuplicates(["node"]).select("node", "text")

    sets = Sets(Measure(lambda block: tb.shingles(block, WIDTH), threshold), fetch, lambda pairs, texts: _hopeful(pairs, classes, threshold))
    linked = shared.materialise(classes.select("node", "c1", "c2", "id").join(link(mates, sets), "node"), "linked")
    groups = shared.materialise(linked.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "groups")
    heads = shared.spread_join(linked, groups.drop("n"), ["component"], groups.select("component", "n")).select("c1", "c2", "component_id")
    alone = classes.join(linked, "node", "left_anti").select("c1", "c2", F.col("id").alias("component_id"))
    heads = shared.materialise(heads.union(alone), "heads")
    out = shared.spread_join(own.select("id", "version", "n_shingles", "c1", "c2"), heads, ["c1", "c2"], classes.select("c1", "c2", "n"))
    nothing = sketched.where("n_shingles = 0").select("id", "version", "n_shingles", F.col("id").alias("component_id"))
    return out.select(*nothing.columns).union(nothing)


def _kept() -> Column:
    return F.coalesce(F.col("component_id") == F.col("id"), F.col("component_id").isNull())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    A text's set is its distinct 5-word shingles (A-Z lower-cased, words split
    at ASCII white space); fewer words are one shingle; a null or empty text
    has the empty set and is its own component.  Documents with
    |intersection| >= threshold * |union| are linked; component_id is the
    least doc_id reachable, kept marks it.  Rows that repeat a doc_id are
    compared each by its own text.  A row without a doc_id gets the least
    doc_id that it is linked to, and isn't kept; if all its component has
    none, component_id is null and the rows are kept.  Other columns are not
    read.  An empty table gives an empty result.  Links are found if a band of
    registers matches: at the threshold with probability above 0.99999.
    """
    return _judged(docs, threshold).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", _kept().alias("kept"))


def drop_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, that ``near_duplicates`` keeps; of rows of equal doc_id and text one."""
    judged = shared.materialise(_judged(docs, threshold).select(F.coalesce("id", F.lit(_NO_ID)).alias("__id"), F.col("version").alias("__version"), _kept().alias("__kept")), "judged")
    row = ["__id", "__version"]
    named = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__version": F.xxhash64("text")})
    rest = named.join(judged.where("not __kept").select(*row).distinct(), row, "left_anti")
    again = shared.materialise(judged.where("__kept").groupBy(*row).count().where("count > 1").select(*row), "again")
    if not again.isEmpty():
        rest = rest.join(again, row, "left_anti").unionByName(rest.join(again, row, "left_semi").dropDuplicates(row))
    return rest.select(*(F.col(f"`{c}`") for c in docs.columns))
