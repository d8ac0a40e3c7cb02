"""Checks on streams: tables of violations, and ``require`` to raise on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cleaning import finite


def require_columns(df: DataFrame, columns: list[str], source: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks columns {missing}; it has {df.columns}")


def time_violations(df: DataFrame, by: str = "session_id", order: list[str] | None = None, t: str = "t") -> DataFrame:
    """Sessions whose times aren't finite and strictly ascending in row order: n, n_bad, first_bad (row from 0)."""
    w = Window.partitionBy(by).orderBy(*(order or [t]))
    row = (F.row_number().over(w) - 1).cast("long")
    bad = ~(F.col(t) > F.lag(t).over(w)) | ~finite(F.col(t).cast("double"))
    found = df.withColumns({"__row": row, "__bad": F.coalesce(bad, F.col(t).isNull())})
    return found.groupBy(by).agg(F.count("*").alias("n"), F.count_if("__bad").alias("n_bad"), F.min(F.when(F.col("__bad"), F.col("__row"))).alias("first_bad"))


def finite_violations(df: DataFrame, columns: list[str], by: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """Sessions' rows with a null, NaN or infinite value: n_bad, first_bad."""
    good = F.lit(True)
    for c in columns:
        good = good & finite(F.col(c).cast("double"))
    row = (F.row_number().over(Window.partitionBy(by).orderBy(*(order or ["t"]))) - 1).cast("long")
    return df.withColumns({"__row": row, "__bad": ~good}).groupBy(by).agg(F.count_if("__bad").alias("n_bad"), F.min(F.when(F.col("__bad"), F.col("__row"))).alias("first_bad"))


def mask_violations(df: DataFrame, mask: str = "mask", by: str = "session_id") -> DataFrame:
    """Sessions' mask values other than 0 and 1 (or false and true)."""
    value = F.col(mask).cast("double")
    return df.groupBy(by).agg(F.count_if(value.isNull() | ~value.isin(0.0, 1.0)).alias("n_bad"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require(violations: DataFrame, what: str) -> None:
    """Raise with the first violation."""
    if found := violations.where("n_bad > 0").head(1):
        raise ValueError(f"{what}: {found[0].asDict()}")


def calibration_verdicts(reports: DataFrame, gates, translation: bool = True) -> DataFrame:
    """reports(stationary_samples, yaw_corr, gravity_x, gravity_y, min_abs_accel_corr) with ``problem``: the first gate failed, or null.

    The last two gates hold only where acceleration moves the estimate.
    """
    horizontal = F.hypot("gravity_x", "gravity_y")
    problem = (
        F.when(F.col("stationary_samples") < gates.min_stationary, "too few stationary samples")
        .when(F.coalesce(F.col("yaw_corr"), F.lit(-1.0)) < gates.min_yaw_corr, "yaw rate doesn't follow the camera")
        .when(F.lit(translation) & (horizontal > gates.max_horizontal_gravity), "gravity isn't along the vertical axis")
        .when(F.lit(translation) & (F.coalesce(F.col("min_abs_accel_corr"), F.lit(-1.0)) < gates.min_accel_corr), "acceleration doesn't follow the camera")
    )
    return reports.withColumn("problem", problem)
