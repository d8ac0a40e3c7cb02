"""Writing a table of documents as wavelet token shards, and reading shards back.

Documents are sorted by id over the whole table (range partitioning), encoded,
and cut into shards of about ``SHARD_TOKENS`` ids; a document is never split
over shards.  A partition's tasks write each shard under a fixed name and only
when it is whole, so a task that runs again after a lost executor replaces its
own files with equal ones.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import shared
from tidemark.llm.encode import encoder
from tidemark.llm.wavelet import Shard, dump

SHARD_TOKENS = 1 << 21


@dataclass(frozen=True)
class TokenFiles:
    """Shards in a folder; ``index`` has part, shard, path, docs, tokens and first_token of each."""

    folder: str
    index: DataFrame

    def shards(self) -> DataFrame:
        """path and content of each file, by Spark's own reader."""
        spark = self.index.sparkSession
        if self.index.isEmpty():  # no shard, no folder
            return spark.createDataFrame([], "path string, content binary")
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(self.folder)

    def documents(self) -> DataFrame:
        """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian u32 ids)."""

        def read(batches):
            for batch in batches:
                for content in batch.column(0):
                    yield _digest(Shard(content.as_buffer()))

        found = self.shards().select("content").mapInArrow(read, "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
        index = self.index.select("part", "shard", "first_token")
        return found.join(index, ["part", "shard"]).select("doc_id", (F.col("first_token") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")

    def count_ids(self, ids: list[int]) -> DataFrame:
        """How often each id occurs, by rank queries on every shard: id, n."""

        def read(batches):
            for batch in batches:
                for content in batch.column(0):
                    m = Shard(content.as_buffer()).matrix
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([m.rank(i) for i in ids], pa.int64())], names=["id", "n"])

        return self.shards().select("content").mapInArrow(read, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))

    def find_id(self, token: int) -> DataFrame:
        """Every occurrence of an id, by select queries: doc_id, place (in its document)."""

        def read(batches):
            for batch in batches:
                for content in batch.column(0):
                    s = Shard(content.as_buffer())
                    at = np.array([s.matrix.select(token, k) for k in range(s.matrix.rank(token))], np.int64)
                    doc = np.searchsorted(s.ends, at, "right")
                    yield pa.RecordBatch.from_arrays([_ids(s, doc), pa.array(at - s.starts()[doc])], names=["doc_id", "place"])

        return self.shards().select("content").mapInArrow(read, "doc_id long, place long")


def _ids(s: Shard, doc: np.ndarray) -> pa.Array:
    null = np.isin(doc, list(s.null_ids)) if s.null_ids else None
    return pa.array(s.doc_ids[doc], pa.int64(), mask=null)


def _digest(s: Shard) -> pa.RecordBatch:
    ids = memoryview(s.matrix.decode().astype("<u4")).cast("B")
    starts = s.starts()
    n = len(starts)
    crc = np.fromiter((zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), s.ends.tolist(), strict=True)), np.int64, n)
    part, shard = s.key
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), _ids(s, np.arange(n)), pa.array(starts), pa.array(s.ends - starts), pa.array(crc)],
        names=["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"],
    )


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> TokenFiles:
    """Encode docs(doc_id, text, ...) and write the shards; ids of each document, then ``end_id``.

    Null and empty texts are the end id alone.  Null doc_ids come first; rows
    of equal doc_id stand in the order of their texts, each with its own
    entry.  Other columns are not read.  An empty table writes no shard.  A
    text longer than a shard makes one larger shard.
    """
    spark = docs.sparkSession
    shared.small_batches(docs.sparkSession)
    folder = folder or shared.scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary).encode
        doc_ids, sizes, ids, held, shard = [], [], [], 0, 0

        def flush():
            nonlocal doc_ids, sizes, ids, held, shard
            path = f"{folder}/{part:06d}-{shard:06d}.wm"
            with shared.new_file(path) as f:
                f.write(dump((part, shard), doc_ids, np.cumsum(sizes), np.concatenate(ids)))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64())], names=["part", "shard", "path", "docs", "tokens"])
            doc_ids, sizes, ids, held, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            for at in range(0, len(batch), 500):
                few = batch.slice(at, 500)
                flat, n = encode(few.column(1))
                ends = np.cumsum(n)
                names = few.column(0).to_pylist()
                done = 0
                while done < len(names):
                    # as many documents as fit in the open shard, one at least
                    base = ends[done - 1] if done else 0
                    fit = int(np.searchsorted(ends[done:] - base + np.arange(1, len(names) - done + 1), shard_tokens - held, "right"))
                    to = done + max(fit, 0 if held else 1)
                    if to > done:
                        ids.append(np.insert(flat[base : ends[to - 1]], ends[done:to] - base, end_id))
                        sizes += (n[done:to] + 1).tolist()
                        doc_ids += names[done:to]
                        held += len(ids[-1])
                    if to < len(names):
                        yield flush()
                    done = to
        if doc_ids:
            yield flush()

    index = shared.materialise(ordered.mapInArrow(write, "part int, shard int, path string, docs long, tokens long"), "token-index")
    # two steps, so that no window holds more than the partitions, or one partition's shards
    parts = index.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("base", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    own = Window.partitionBy("part").orderBy("shard")
    index = index.join(parts.select("part", "base"), "part").withColumn("first_token", F.col("base") + F.sum("tokens").over(own) - F.col("tokens")).drop("base")
    return TokenFiles(folder, index)
