"""Intermediate tables and files in the folder that all executors share.

Written tables cut lineage and survive lost executors; they go when the
driver ends (see ``tidemark.sources.storage``).
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import scratch


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read again; what was shuffled for it goes as soon as it is written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Texts that one Arrow batch may hold; batches of Spark's default size can outgrow a Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Keys that are joined apart from the others have one row in HOT of the left side at least, so there are at most HOT of them.
HOT, LEAST_HOT = 1000, 100


def spread_join(left: DataFrame, right: DataFrame, by: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """left.join(right, by, how) for a right side with one row a key, whatever share of the left rows a key has.

    counts(*by, n): how many rows of the left side each key has; a written
    table, as the right side is.  Rows of the at most HOT keys that have more than one in
    HOT of them stay where they are and meet these keys' rows by broadcast;
    the others are dealt by the key.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(LEAST_HOT, math.ceil(total / HOT))).select(*by)
    if hot.isEmpty():
        return left.join(right, by, how)
    hot = F.broadcast(materialise(hot, "hot"))
    few = F.broadcast(right.join(hot, by, "left_semi"))
    return left.join(hot, by, "left_semi").join(few, by, how).unionByName(left.join(hot, by, "left_anti").join(right, by, how))


@contextmanager
def new_file(path: str) -> Iterator:
    """A file of the shared folder, seen under its name only when whole; writing it again replaces it."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    folder, _, name = place.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        yield f
    store.move(part, place)


def each_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """f for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)

    return run
