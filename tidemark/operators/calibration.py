"""Inertial calibration reports of sessions, and the gates they have to pass before data are fused."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.kernels import calibration
from tidemark.operators.filters import _together
from tidemark.operators.validation import calibration_verdicts
from tidemark.plans.config import CalibrationGates

REPORT = (
    "session_id bigint, gyro_bias double, gravity_x double, gravity_y double, gravity_z double, stationary_samples bigint, stationary_fraction double, "
    "yaw_lag double, yaw_corr double, yaw_slope double, yaw_intercept double, yaw_r2 double, yaw_n bigint, "
    + ", ".join(f"body_{a}_axis string, body_{a}_sign int, body_{a}_lag double, body_{a}_corr double, body_{a}_n bigint" for a in "xy")
    + ", failure string"
)


def _leds(f: pd.DataFrame) -> np.ndarray:
    return f[["x1", "y1", "x2", "y2"]].to_numpy(float).reshape(-1, 2, 2)


def calibrate(samples: DataFrame, frames: DataFrame, **options) -> DataFrame:
    """One row a session: gyro bias and gravity over calm samples, the lag scan of the gyroscope against the camera's turn, and which accelerometer axis, with which sign, follows which body direction.

    samples(session_id, t, gz, ax, ay, az) in SI units; frames(session_id, t,
    x1, y1, x2, y2).  A session that can't be judged has nulls and the reason
    in ``failure``.  A session is one task's work, as its 101 lags share one
    interpolation; options are those of the kernel.
    """
    names = [c.split()[0] for c in REPORT.split(", ")]
    strings = [c.split()[0] for c in REPORT.split(", ") if c.endswith(" string")]

    def run(key: tuple, s: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        s, f = s.sort_values("t", kind="stable"), f.sort_values("t", kind="stable")
        row = {"session_id": key[0], "failure": None}
        try:
            row |= calibration.calibrate(s["t"].to_numpy(float), s["gz"].to_numpy(float), s[["ax", "ay", "az"]].to_numpy(float), f["t"].to_numpy(float), _leds(f), **options)
        except ValueError as e:
            row["failure"] = str(e)
        # strings as plain objects: Arrow-backed ones come out chunked
        return pd.DataFrame([row], columns=names).astype(dict.fromkeys(strings, object))

    return _together(samples, frames).applyInPandas(run, REPORT)


def body_acceleration(frames: DataFrame, sigma_s: float = 0.1) -> DataFrame:
    """session_id, t, abx, aby: the camera's acceleration in the body's frame; sessions with fewer than three dual frames have no rows."""
    schema = "session_id bigint, t double, abx double, aby double"

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t", kind="stable")
        t, leds = f["t"].to_numpy(float), _leds(f)
        if np.isfinite(leds).all(axis=(1, 2)).sum() < 3:
            return pd.DataFrame(columns=["session_id", "t", "abx", "aby"])
        body = calibration.camera_motion(t, leds, sigma_s)[3]
        return pd.DataFrame({"session_id": key[0], "t": t, "abx": body[:, 0], "aby": body[:, 1]})

    return frames.groupBy("session_id").applyInPandas(run, schema)


def verdicts(reports: DataFrame, gates: CalibrationGates, fused: bool = True, translation: bool = False) -> DataFrame:
    """reports with ``problem``: the reason a session's inertial data mustn't be fused, or null.

    fused: the filter uses inertial data at all; translation: it moves by
    acceleration, so gravity and the accelerometer's axes count too.
    """
    if not fused:
        return reports.withColumn("problem", F.lit(None).cast("string"))
    weak = F.least("body_x_corr", "body_y_corr")
    judged = calibration_verdicts(reports.withColumn("min_abs_accel_corr", weak if translation else F.lit(1.0)), gates, translation)
    return judged.withColumn("problem", F.coalesce("failure", "problem")).drop("min_abs_accel_corr")


def report_text() -> Column:
    """A report's row as lines of text."""
    fit = lambda name, at: F.format_string(f"  {name}: %s%s, lag %+.3f s, correlation %+.3f, n %d", F.when(F.col(f"{at}_sign") > 0, "+").otherwise("-"), f"{at}_axis", f"{at}_lag", f"{at}_corr", f"{at}_n")
    whole = F.concat_ws(
        "\n",
        F.format_string("inertial calibration of session %d", "session_id"),
        F.format_string("gyro bias %.6f rad/s", "gyro_bias"),
        F.format_string("gravity %.6f, %.6f, %.6f m/s^2", "gravity_x", "gravity_y", "gravity_z"),
        F.format_string("stationary samples %d, fraction %.3f", "stationary_samples", "stationary_fraction"),
        F.format_string("yaw rate: lag %+.3f s, correlation %+.3f, slope %+.3f, intercept %+.3f, r2 %.3f, n %d", "yaw_lag", "yaw_corr", "yaw_slope", "yaw_intercept", "yaw_r2", "yaw_n"),
        F.lit("acceleration:"), fit("body x", "body_x"), fit("body y", "body_y"),
    )
    return F.when(F.col("failure").isNotNull(), F.format_string("inertial calibration of session %d failed: %s", "session_id", "failure")).otherwise(whole)
