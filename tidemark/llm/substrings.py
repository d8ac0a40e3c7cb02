"""Removing word windows that occur earlier in the corpus, found by difference-cover anchors.

A window is ``width`` consecutive words.  Anchors are shorter windows, hashed
only where a word's index modulo PERIOD lies in COVER.  COVER is a difference
cover: for any two places i and j some shift below PERIOD takes both into it.
So two equal windows share an anchor at the same offset, and a window none of
whose anchors occurs twice in the corpus is unique.

1. Anchor hashes are dealt into buckets; a bucket finds those seen twice.
   They are only a filter, so as many bits are kept as make a chance match
   rare for this corpus (they grow with its logarithm).
2. Documents meet their repeated anchors and extend each to the whole windows
   around it, hashed with 96 bits.
3. Windows are dealt into buckets by their hash; all but the first of each are
   sent back to their documents, which drop the words they cover.

Texts equal word for word are settled by a digest beforehand: all but the one
with the least doc_id lose everything.  Hashes travel in packed arrays, a row
for each bucket, not a row for each hash.  Occurrences that repeat within one
flush of a task are reported without passing through the hash's bucket, so a
bucket gets a hash at most once a flush, however common the passage is.  The
numbers of buckets follow the counted words and bytes, so a bucket's size does
not grow with the corpus.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm import textblock as tb

WIDTH = 20
#: A perfect difference set modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: What a task holds of one bucket, and what it buffers before it deals.
BUCKET_HASHES, BUCKET_BYTES, FLUSH = 1 << 21, 24 << 20, 1 << 20
_NO_ID = -(1 << 63)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)

#: kind 0: places with hashes; 1: places known to repeat; 2: a copy's digest
_PACKED = "kind int, bucket int, docs binary, counts binary, places binary, hashes binary"


def _squeeze(a: np.ndarray) -> bytes:
    """Ascending runs shrink to their steps."""
    raw = np.diff(a, prepend=a.dtype.type(0)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _spread(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, kind), dtype=kind)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return _bucket(tb.mix(doc.astype(np.int64).view(np.uint64), 0x3D), n)


def _bytes(a: np.ndarray) -> np.ndarray:
    """Little-endian bytes of unsigned integers, a row each."""
    return np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"))).view(np.uint8).reshape(len(a), a.itemsize)


def _rows(kind: int, bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, h: np.ndarray | None, hash_bytes: int, more: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket with places, in the order of documents; more: 32 bits that follow each hash."""
    order = np.lexsort((place, doc, bucket))
    bucket, doc, place = bucket[order], doc[order], place[order]
    wide = np.zeros((len(order), 0), np.uint8) if h is None else _bytes(h[order])[:, :hash_bytes]
    if more is not None:
        wide = np.hstack([wide, _bytes(more[order])])
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    out: list[list] = [[], [], [], [], [], []]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, at = doc[a:b], place[a:b]
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        packed = wide[a:b].tobytes()
        for column, value in zip(out, (kind, int(bucket[a]), _squeeze(own[starts]), np.diff(starts, append=b - a).astype(np.uint32).tobytes(), _squeeze(at.astype(np.int64)), packed), strict=True):
            column.append(value)
    types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["kind", "bucket", "docs", "counts", "places", "hashes"])


def _read(table: pa.Table, kind: int, hash_bytes: int = 0, more: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, place and hash of all packed rows of a kind, and the 32 bits after each hash if there are more."""
    docs, places, hashes, rests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    columns = [table.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]
    for k, d, c, p, h in zip(*columns, strict=True):
        if k != kind:
            continue
        docs.append(np.repeat(_spread(d, np.int64), np.frombuffer(c, np.uint32)))
        places.append(_spread(p, np.int64))
        if hash_bytes:
            raw = np.frombuffer(h, np.uint8).reshape(len(places[-1]), hash_bytes + 4 * more)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :hash_bytes] = raw[:, :hash_bytes]
            hashes.append(wide.view("<u8").ravel())
            if more:
                rests.append(np.ascontiguousarray(raw[:, hash_bytes:]).view("<u4").ravel())
    return np.concatenate(docs), np.concatenate(places), np.concatenate(hashes), np.concatenate(rests)


def _first(h: np.ndarray, doc: np.ndarray, place: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and which of them is the first there.

    With more bits, those must be equal too, and the first is the least (doc, place).
    """
    order = np.argsort(h, kind="stable") if more is None else np.lexsort((place, doc, more, h))
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[order[1:]] != h[order[:-1]]
    if more is not None:
        fresh[1:] |= more[order[1:]] != more[order[:-1]]
    return order, fresh


def _deal(h: np.ndarray, doc: np.ndarray, place: np.ndarray, more: np.ndarray | None, buckets: int, doc_buckets: int, hash_bytes: int) -> Iterator[pa.RecordBatch]:
    """One occurrence of each hash to its bucket; further ones, known to repeat, to their documents.

    Whole windows have more bits; the first of equal ones is not reported as
    repeating.  Of equal anchors, all repeat.
    """
    order, fresh = _first(h, doc, place, more)
    h, doc, place = h[order], doc[order], place[order]
    again = ~fresh
    if more is None:
        again[:-1] |= ~fresh[1:]
    # the low bytes travel; the bucket has the high ones
    yield _rows(0, _bucket(h[fresh], buckets), doc[fresh], place[fresh], h[fresh], hash_bytes, None if more is None else more[order][fresh])
    if again.any():
        yield _rows(1, _doc_bucket(doc[again], doc_buckets), doc[again], place[again], None, 0)


def _repeats(dealt: DataFrame, doc_buckets: int, hash_bytes: int, whole: bool) -> DataFrame:
    """Packed rows of kind 1, by the bucket of their documents: what repeats (whole: all but the first)."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table
        doc, place, h, more = _read(table, 0, hash_bytes, whole)
        order, fresh = _first(h, doc, place, more if whole else None)
        doc, place, again = doc[order], place[order], ~fresh
        if not whole:
            again[:-1] |= ~fresh[1:]
        return pa.Table.from_batches([_rows(1, _doc_bucket(doc[again], doc_buckets), doc[again], place[again], None, 0)])

    return dealt.groupBy("kind", "bucket").applyInArrow(run, _PACKED)


def _summaries(rows: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(batch)
        count, size, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
        second = np.zeros(n, np.uint64)
        for block in tb.blocks(batch.column(1)):
            found = tb.words(block)
            h = tb.word_hashes(block, found, lower=False)
            at = slice(block.first, block.first + len(block))
            count[at], size[at] = np.diff(found.offs), np.diff(block.offs)
            digest[at] = _digests(h, found)
            second[at] = tb.span(tb.prefix(tb.mix(h, 0x99)), found.offs[:-1], found.offs[1:])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(size), pa.array(tb.signed(digest)), pa.array(tb.signed(second))], names=["doc_id", "n_words", "n_bytes", "c1", "c2"])

    return rows.mapInArrow(shared.each_batch(run), "doc_id long, n_words long, n_bytes long, c1 long, c2 long")


def _digests(h: np.ndarray, found: tb.Words) -> np.ndarray:
    return tb.span(tb.prefix(h), found.offs[:-1], found.offs[1:])


class _Texts:
    """The documents of one bucket: words, with places that run on over texts that share a doc_id."""

    def __init__(self, table: pa.Table, copies: dict[int, set[int]], width: int):
        self.table = table
        ids = table.column("doc_id").to_numpy()
        self.parts: list[tuple[tb.Block, tb.Words, np.ndarray, np.ndarray, np.ndarray]] = []
        counts, digests = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.uint64)
        found = []
        for block in tb.blocks(table.column("text")):
            w = tb.words(block)
            h = tb.word_hashes(block, w, lower=False)
            at = slice(block.first, block.first + len(block))
            counts[at], digests[at] = np.diff(w.offs), _digests(h, w)
            found.append((block, w, h))
        self.counts = counts
        self.copy = np.array([int(d) in copies.get(int(i), ()) for i, d in zip(ids.tolist(), tb.signed(digests).tolist(), strict=True)], bool) & (counts >= width) if copies else np.zeros(len(ids), bool)
        # the first place of each text in its document; equal texts of one doc_id have the same places
        order = np.lexsort((digests, ids))
        base = np.zeros(len(ids), np.int64)
        for k in range(1, len(order)):
            i, j = order[k - 1], order[k]
            if ids[i] == ids[j]:
                base[j] = base[i] if digests[i] == digests[j] else base[i] + counts[i]
        self.repeated = np.zeros(len(ids), bool)
        same = (ids[order[1:]] == ids[order[:-1]]) & (digests[order[1:]] == digests[order[:-1]])
        self.repeated[order[1:][same]] = True
        self.ids, self.base = ids, base
        self.listed, self.rank = np.unique(ids, return_inverse=True)
        self.found = found

    def keys(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A number for each place of the document that a row is of, to test membership by."""
        return (self.rank[row] << 40) + place

    def marks(self, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """These numbers for places of documents of this bucket, ascending."""
        return np.sort((np.searchsorted(self.listed, doc) << 40) + place)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_words, n_removed, kept_sha256, text.

    A word goes if it lies in a window of ``width`` words that also starts
    earlier: in a smaller doc_id, or before it in the same document.  Windows
    are judged on the input.  ``text`` is the kept words joined by one blank,
    kept_sha256 its SHA-256 in hexadecimal.  Null and empty texts, and texts
    of white space, have no words and an empty ``text``.  Rows of the same
    doc_id and words are one document and get equal results; other texts of
    the same doc_id follow one another in a fixed order, as one document whose
    windows do not cross texts.  A null doc_id comes before all others, and
    stays null.  Other columns are not read.  An empty table gives an empty
    result.
    """
    if width <= PERIOD:
        raise ValueError(f"width must be above {PERIOD}")
    spark = docs.sparkSession
    anchor = width - PERIOD + 1
    shared.small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = shared.materialise(_summaries(rows), "digests")
    total = known.agg(F.sum("n_words").alias("w"), F.sum("n_bytes").alias("b")).first()
    n_words, n_bytes = total["w"] or 0, total["b"] or 0
    n_anchors = n_words * len(COVER) // PERIOD + 1
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(n_anchors / BUCKET_HASHES))
    doc_buckets = max(least, math.ceil(n_bytes / BUCKET_BYTES))
    # bits below the bucket's, and eight more, that anchors need to be told apart
    hash_bytes = min(8, max(4, math.ceil((math.log2(n_anchors) + 8) / 8)))

    def anchors(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in tb.blocks(batch.column(1)):
                found = tb.words(block)
                at, h = tb.windows(tb.word_hashes(block, found, lower=False), found.offs, anchor)
                text = np.searchsorted(found.offs, at, "right") - 1
                place = at - found.offs[text]
                use = _IN_COVER[place % PERIOD]
                held.append((h[use], ids[block.first + text[use]], place[use]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from _deal(*map(np.concatenate, zip(*held, strict=True)), None, buckets, doc_buckets, hash_bytes)
                    held, size = [], 0
        if size:
            yield from _deal(*map(np.concatenate, zip(*held, strict=True)), None, buckets, doc_buckets, hash_bytes)

    # a document with the words of a smaller doc_id: kind 2, its digest in place of hashes
    first = known.where(F.col("n_words") >= width).groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = shared.materialise(first, "classes")
    copies = shared.spread_join(known, first.drop("n"), ["c1", "c2"], first.select("c1", "c2", "n")).where("doc_id <> first").select("doc_id", "c1").distinct()

    def name_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(batch)
        ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rest = [pa.array([b""] * n, pa.binary())] * 2
        return pa.RecordBatch.from_arrays([pa.array([2] * n, pa.int32()), pa.array(_doc_bucket(ids, doc_buckets).astype(np.int32)), tb.fixed_binary(ids.reshape(-1, 1)), *rest, tb.fixed_binary(digests.reshape(-1, 1))], names=["kind", "bucket", "docs", "counts", "places", "hashes"])

    copies = shared.materialise(copies.mapInArrow(shared.each_batch(name_copies), _PACKED), "copies")

    def add_bucket(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket = _doc_bucket(batch.column(0).to_numpy(), doc_buckets).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "doc_id", "text"])

    texts = rows.mapInArrow(shared.each_batch(add_bucket), "bucket int, doc_id long, text string").groupBy("bucket")

    def bucket_of(left: pa.Table, right: pa.Table) -> tuple[_Texts, np.ndarray]:
        copied: dict[int, set[int]] = {}
        for k, d, c in zip(*(right.column(x).to_pylist() for x in ("kind", "docs", "hashes")), strict=True):
            if k == 2:
                copied.setdefault(int.from_bytes(d, "little", signed=True), set()).add(int.from_bytes(c, "little", signed=True))
        own = _Texts(left, copied, width)
        doc, place, *_ = _read(right, 1)
        return own, own.marks(doc, place)

    def is_in(keys: np.ndarray, marked: np.ndarray) -> np.ndarray:
        if not len(marked):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(marked, keys), len(marked) - 1)
        return marked[at] == keys

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        own, marked = bucket_of(left, right)
        held = []
        for block, found, h in own.found:
            at, x = tb.windows(h, found.offs, width)
            rest = tb.prefix(tb.mix(h, 0x99))
            if not len(at):
                continue
            text = np.searchsorted(found.offs, at, "right") - 1
            row = block.first + text
            place = at - found.offs[text]
            # anchors are marked by their place in the text
            word_text = found.text_of()
            word_place = np.arange(len(h)) - found.offs[word_text]
            hit = is_in(own.keys(block.first + word_text, word_place), marked) & _IN_COVER[word_place % PERIOD]
            seen = np.concatenate([[0], np.cumsum(hit)])
            use = (seen[at + PERIOD] > seen[at]) & ~own.copy[row] & ~own.repeated[row]
            more = (tb.span(rest, at[use], at[use] + width) >> np.uint64(32)).astype(np.uint32)
            held.append((x[use], own.ids[row[use]], own.base[row[use]] + place[use], more))
        if not held:
            return pa.Table.from_batches([_rows(0, *[np.zeros(0, np.int64)] * 3, None, 8)])
        return pa.Table.from_batches(list(_deal(*map(np.concatenate, zip(*held, strict=True)), buckets, doc_buckets, 8)))

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        own, marked = bucket_of(left, right)
        n = len(left)
        removed = np.zeros(n, np.int64)
        kept: list[bytes] = [b""] * n
        for block, found, h in own.found:
            word_text = found.text_of()
            row = block.first + word_text
            place = np.arange(len(h)) - found.offs[word_text] + own.base[row]
            hit = is_in(own.keys(row, place), marked)
            steps = np.zeros(len(h) + width + 1, np.int64)
            starts = np.flatnonzero(hit)
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + width, -1)
            gone = (np.cumsum(steps)[: len(h)] > 0) | own.copy[row]
            np.add.at(removed, row[gone], 1)
            raw = block.buf.tobytes()
            lost = np.zeros(len(block), np.int64)
            np.add.at(lost, word_text[gone], 1)
            for i in range(len(block)):
                if lost[i] == 0:
                    kept[block.first + i] = b" ".join(raw[block.offs[i] : block.offs[i + 1]].split())
                elif lost[i] < found.offs[i + 1] - found.offs[i]:
                    stay = np.flatnonzero(~gone[found.offs[i] : found.offs[i + 1]]) + found.offs[i]
                    kept[block.first + i] = b" ".join([raw[a:b] for a, b in zip(found.start[stay].tolist(), found.end[stay].tolist(), strict=True)])
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        ids = pa.array(own.ids, pa.int64(), mask=own.ids == _NO_ID)
        return pa.table({"doc_id": ids, "n_words": pa.array(own.counts), "n_removed": pa.array(removed), "kept_sha256": pa.array(sha, pa.string()), "text": pa.array(kept, pa.binary()).cast(pa.string())})

    repeated = _repeats(rows.mapInArrow(anchors, _PACKED), doc_buckets, hash_bytes, whole=False)
    flagged = repeated.union(copies)
    windows = texts.cogroup(flagged.groupBy("bucket")).applyInArrow(extend, _PACKED)
    windows = shared.materialise(windows, "windows")
    again = _repeats(windows, doc_buckets, 8, whole=True).union(copies)
    return texts.cogroup(again.groupBy("bucket")).applyInArrow(drop, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
