"""The same kernels on streams: keyed filters, windowed aggregates with watermarks."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.kernels import tracker
from tidemark.operators.cleaning import channels
from tidemark.operators.filters import ESTIMATES, LINEAR, LinearKalman
from tidemark.plans.config import FilterConfig
from tidemark.sources.storage import scratch


def stream_kalman(rows: DataFrame, model: LinearKalman) -> DataFrame:
    """``kalman_1d`` on a stream of rows(session_id, event_id, t, z).

    Rows are sorted within a micro-batch; rows at or before the last one of
    an earlier batch are late and dropped.  The state is six numbers a
    session, so a restart from the checkpoint goes on where it was.
    """

    def run(key: tuple, batches, state: GroupState):
        s = tuple(state.get) if state.exists else None
        rows_ = pd.concat(list(batches)).sort_values(["t", "event_id"], kind="stable")
        if s is not None:
            rows_ = rows_[rows_["t"] > s[0]]
        out = []
        for event, t, z in zip(rows_["event_id"], rows_["t"], rows_["z"], strict=True):
            s, loglik, used = model.step(s, t, None if z is None or z != z else z)
            out.append((key[0], event, *s, loglik, used))
        if s is not None:
            state.update(tuple(map(float, s)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LINEAR.split(", ")])

    kept = "t double, x double, v double, xx double, xv double, vv double"
    return rows.select("session_id", "event_id", "t", "z").groupBy("session_id").applyInPandasWithState(run, LINEAR, kept, "append", GroupStateTimeout.NoTimeout)


def stream_track(rows: DataFrame, cfg: FilterConfig, first_mean: list[float], first_cov: list[float], dt_first: float) -> DataFrame:
    """The extended filter on one stream of samples and frames.

    rows(session_id, kind, t, gz, ax, ay, az, x1, y1, x2, y2): kind is sample
    or frame.  A frame is settled when a sample after it has come, as only
    then all samples of its interval are known; until then it waits in the
    state.  Rows before the last settled frame are dropped.
    """
    names = [c.split()[0] for c in ESTIMATES.split(", ")]
    n = cfg.layout.n
    inertial = [c for c in channels(cfg.state_mode) if c in rows.columns] or ["gz", "ax", "ay"]

    def run(key: tuple, batches, state: GroupState):
        kernel = tracker.ExtendedTracker(cfg, (np.array(first_mean), np.array(first_cov).reshape(n, n)), dt_first)
        settled, waiting = -np.inf, []
        if state.exists:
            kept, settled, waiting = pickle.loads(state.get[0])
            kernel.restore(kept)
        fresh = pd.concat(list(batches))
        waiting = waiting + fresh[fresh["t"] > settled].to_dict("records")
        waiting.sort(key=lambda r: (r["t"], r["kind"] == "frame"))
        last = max((r["t"] for r in waiting if r["kind"] == "sample"), default=-np.inf)
        out, rest = [], []
        for r in waiting:
            if r["kind"] == "frame" and r["t"] >= last:
                rest.append(r)
            elif rest:
                rest.append(r)
            elif r["kind"] == "sample":
                kernel.sample(r["t"], np.array([r[c] for c in inertial]))
            else:
                leds = np.array([[r["x1"], r["y1"]], [r["x2"], r["y2"]]], float)
                e = kernel.frame(tracker.Frame(r["t"], leds))
                settled = r["t"]
                out.append((key[0], kernel.frames - 1, r["t"], e.mean, e.cov.ravel(), e.predicted_mean, e.predicted_cov.ravel(), e.loglik, e.vision, e.nis, e.nis_dim))
        state.update((pickle.dumps((kernel.state(), settled, rest)),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("session_id").applyInPandasWithState(run, ESTIMATES, "kept binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows of events(ts timestamp, event_type, value): count, sum and largest value."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))


def session_windows(events: DataFrame, gap: str = "12 hours", late: str = "2 hours") -> DataFrame:
    """Windows of a user's activity that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder or file of the events table as a stream, ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    # a single file is watched by its name in its folder
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else reader.parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and read its result; complete results replace each other."""
    spark = stream.sparkSession
    out, schema = scratch(spark, name), stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)
