"""Readers of recorded sessions, and sinks of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calibration, cleaning, temporal, validation
from tidemark.operators.filters import correct_identity, run_metadata
from tidemark.plans.config import SessionConfig


def read_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Whitespace-separated numbers, one row a line, with ``row`` from 0; a row of another width or without numbers is an error.

    Meant for small hand-made files: the row numbers of a text file need it in one partition.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").coalesce(1).withColumn("row", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    checked = F.when(F.size(parts) == len(columns), parts).otherwise(F.raise_error(F.concat(F.lit(f"{path}: expected {len(columns)} numbers: "), "value")))
    return lines.select("row", checked.alias("__p")).select("row", *(F.get("__p", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)))


def _session(df: DataFrame, session: int | str) -> DataFrame:
    return df if "session_id" in df.columns else df.withColumn("session_id", F.lit(session).cast("bigint"))


def read_imu(spark: SparkSession, path: str, cfg: SessionConfig, session: int = 0) -> DataFrame:
    """session_id, t, six SI channels, sample-and-hold repeats removed.  Only the columns named in the settings are read."""
    raw = spark.read.parquet(path)
    validation.require_columns(raw, [cfg.imu.time, *cfg.imu.axes.values()], "inertial table")
    keep = [cfg.imu.time, *cfg.imu.axes.values()] + (["session_id"] if "session_id" in raw.columns else [])
    raw = _session(raw.select(*keep), session).withColumnRenamed(cfg.imu.time, "t").withColumn("t", F.col("t").cast("double"))
    watched = {"none": [], "gyro_z": [cfg.imu.axes["gz"]], "any_axis": list(cfg.imu.axes.values())}[cfg.imu.dedup]
    return cleaning.to_si(cleaning.change_only(raw, watched), cfg.imu)


def read_camera(spark: SparkSession, path: str, cfg: SessionConfig, session: int = 0) -> DataFrame:
    """session_id, t, x1, y1, x2, y2 in metres (null where unseen), mask, and confidence if named."""
    raw, c = spark.read.parquet(path), cfg.camera
    names = [c.x1, c.y1, c.x2, c.y2]
    validation.require_columns(raw, [c.time, *names, *(c.confidence or ())], "position table")
    scaled = [(F.col(f"`{n}`").cast("double") * c.meters_per_pixel).alias(a) for n, a in zip(names, ("x1", "y1", "x2", "y2"), strict=True)]
    conf = [F.array(*(F.col(f"`{c.confidence[i]}`").cast("double") for i in (0, 0, 1, 1))).alias("confidence")] if c.confidence else []
    keep = (["session_id"] if "session_id" in raw.columns else []) + [F.col(f"`{c.time}`").cast("double").alias("t"), *scaled, *conf]
    df = cleaning.nan_to_null(_session(raw.select(*keep), session), ["x1", "y1", "x2", "y2"])
    return df.withColumn("mask", cleaning.led_mask())


def read_events(spark: SparkSession, path: str, session: int = 0) -> DataFrame:
    """session_id, event_id, t, source_id, edge; strict about types and values."""
    raw = spark.read.parquet(path)
    validation.require_columns(raw, ["time", "source_id", "edge"], "event table")
    kinds = dict(raw.dtypes)
    if kinds["source_id"] in ("string", "boolean"):
        raise ValueError("source_id must be a number")
    whole = raw.where((F.col("source_id") != F.floor("source_id")) | ~cleaning.finite(F.col("time").cast("double")) | ~F.col("edge").isin("rise", "fall") | F.col("edge").isNull())
    if found := whole.head(1):
        raise ValueError(f"an event can't be read: {found[0].asDict()}")
    df = _session(raw, session).select("session_id", F.col("time").cast("double").alias("t"), F.col("source_id").cast("bigint").alias("source_id"), "edge")
    return df.withColumn("event_id", F.monotonically_increasing_id())


@dataclass
class Session:
    """Filter-ready tables."""

    config: SessionConfig
    samples: DataFrame
    frames: DataFrame
    accounting: DataFrame | None = None
    #: Calibration reports with ``problem``, the reason not to fuse a session's inertial data.
    calibration: DataFrame | None = None


def load_session(spark: SparkSession, cfg: SessionConfig) -> Session:
    """Read, clean, put on one clock, correct LED labels, and attach trigger events to frames."""
    streams = [read_imu(spark, cfg.imu_file, cfg), read_camera(spark, cfg.position_file, cfg)]
    if cfg.events_file and cfg.sources:
        streams.append(read_events(spark, cfg.events_file))
    # triggers are stamped by the camera's clock
    samples, frames, *triggers = cleaning.rebase(streams, offsets=[cfg.imu_offset_s, cfg.camera_offset_s, cfg.camera_offset_s][: len(streams)], leading=2)
    for df, name in ((samples, "samples"), (frames, "frames")):
        validation.require(validation.time_violations(df), f"{name}: times must be finite and ascend")
    if cfg.led_identity.mode == "auto":
        frames = cleaning.swap_leds(correct_identity(frames, cfg.led_identity, cfg.filter.led_distance, samples.select("session_id", "t", "gz")))
    if "mask" in frames.columns:
        validation.require(validation.mask_violations(frames), "frames: mask must be 0 or 1")
    judged = None
    if cfg.gates.run:
        fused = cfg.filter.state_mode != "vision_only"
        moved = cfg.filter.state_mode != "2d_cam_6dof_imu_orientation" or cfg.filter.enable_experimental_accel_translation
        judged = calibration.verdicts(calibration.calibrate(samples, frames), cfg.gates, fused, fused and moved)
    accounting = None
    if triggers:
        listed = {s.source_id: s for s in cfg.sources}
        source_rows = ", ".join(f"({s.source_id}L, '{s.active_edge}', array({', '.join(f'{v!r}D' for v in (*s.anchor, *s.cov))}))" for s in listed.values())
        sources = spark.sql(f"SELECT * FROM VALUES {source_rows} AS s(source_id, active_edge, fix)")
        numbered = temporal.numbered_frames(frames, tie="t")
        bucketed = temporal.bucket_events(triggers[0], sources, numbered)
        temporal.check_bucketed(bucketed, cfg.max_events_per_frame)
        accounting = temporal.drop_accounting(bucketed)
        kept = bucketed.where("fate = 'kept'").join(sources.select("source_id", "fix"), "source_id")
        fixes = kept.groupBy("session_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "fix"))), lambda e: e["fix"]).alias("fixes"))
        frames = numbered.join(fixes, ["session_id", "frame"], "left").drop("frame")
    return Session(cfg, samples, frames, accounting, judged)


def write_estimates(df: DataFrame, path: str) -> None:
    """Means, covariances (row-major) and the rest as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_metadata(spark: SparkSession, cfg: SessionConfig, path: str, **extra) -> None:
    """A run's settings as one JSON row."""
    spark.sql("SELECT 1 AS one").select(F.lit(run_metadata(cfg.filter, **extra)).alias("settings")).coalesce(1).write.mode("overwrite").text(path)


def write_diagnostics(df: DataFrame, path: str) -> None:
    """A table of diagnostics as JSON lines."""
    df.write.mode("overwrite").json(path)
