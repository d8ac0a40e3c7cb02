"""Accuracy and consistency metrics, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import chi2_bounds
from tidemark.operators.cleaning import finite
from tidemark.operators.temporal import wrap


def rmse(df: DataFrame, pairs: list[tuple[str, str]], by: str = "session_id", mask: Column | None = None, out: str = "rmse") -> DataFrame:
    """Root mean squared distance of (truth, estimate) column pairs over rows where all are finite and the mask holds."""
    good = mask if mask is not None else F.lit(True)
    error = F.lit(0.0)
    for a, b in pairs:
        good = good & finite(a) & finite(b)
        error = error + (F.col(a) - F.col(b)) ** 2
    return df.groupBy(by).agg(F.sqrt(F.avg(F.when(good, error))).alias(out), F.count_if(good).alias("n"))


def heading_errors(df: DataFrame, truth: str, estimate: str, by: str = "session_id") -> DataFrame:
    """Mean absolute and root mean squared heading error, the short way round."""
    e = F.when(finite(truth) & finite(estimate), wrap(F.col(estimate) - F.col(truth)))
    return df.groupBy(by).agg(F.avg(F.abs(e)).alias("heading_mae"), F.sqrt(F.avg(e**2)).alias("heading_rmse"))


def mahalanobis_2d(ex: Column, ey: Column, pxx: Column, pxy: Column, pyy: Column) -> Column:
    """e' P^-1 e of two components; infinite if P isn't positive definite."""
    det = pxx * pyy - pxy * pxy
    return F.when((det > 0) & (pxx > 0), (pyy * ex * ex - 2 * pxy * ex * ey + pxx * ey * ey) / F.nullif(det, F.lit(0.0))).otherwise(F.lit(float("inf")))


def envelope_stats(df: DataFrame, value: str, dof: int, by: str = "session_id", confidence: float = 0.95) -> DataFrame:
    """Mean, spread, range and share inside the two-sided chi-square bounds, over finite values."""
    low, high = chi2_bounds(dof, confidence)
    v = F.when(finite(value), F.col(value))
    return df.groupBy(by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.lit(low).alias("chi2_lower"), F.lit(high).alias("chi2_upper"),
        (100 * F.avg(F.when(v.isNotNull(), v.between(low, high).cast("double")))).alias("pct_in_bounds"),
    )


def autocorrelation(df: DataFrame, value: str, max_lag: int, by: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """by, lag, acf for lags 0 to max_lag: mean lagged product over the sample variance; 1 at lag 0, null without variance."""
    w = Window.partitionBy(by).orderBy(*(order or ["t"]))
    every = Window.partitionBy(by)
    centred = df.withColumns({"__c": F.col(value) - F.avg(value).over(every), "__var": F.var_samp(value).over(every)})
    lags = centred.select(by, "__var", *((F.col("__c") * F.lag("__c", k).over(w)).alias(f"__{k}") for k in range(1, max_lag + 1)))
    means = lags.groupBy(by).agg(F.first("__var").alias("__var"), *(F.avg(f"__{k}").alias(f"__{k}") for k in range(1, max_lag + 1)))
    values = F.array(F.lit(1.0), *(F.col(f"__{k}") / F.nullif(F.col("__var"), F.lit(0.0)) for k in range(1, max_lag + 1)))
    return means.select(by, F.posexplode(values).alias("lag", "acf"))


def dropout_runs(df: DataFrame, valid: str, by: str = "session_id", t: str = "t") -> DataFrame:
    """Runs of invalid rows: run, start_t, end_t, n and duration.

    A run inside ends at the next valid row; one at the end adds its own
    median step (the session's for a single row).
    """
    w = Window.partitionBy(by).orderBy(t)
    df = df.withColumns({"__change": F.when(F.col(valid).eqNullSafe(F.lag(valid).over(w)), 0).otherwise(1), "__next": F.lead(t).over(w), "__dt": F.lead(t).over(w) - F.col(t)})
    df = df.withColumn("__run", F.sum("__change").over(w))
    session = Window.partitionBy(by)
    df = df.withColumns({"__session_dt": F.median("__dt").over(session), "__last": F.max(t).over(session)})
    own = F.when(F.col("__next") <= F.max(t).over(Window.partitionBy(by, "__run")), F.col("__dt"))
    runs = df.withColumn("__own", own).where(~F.col(valid)).groupBy(by, "__run").agg(
        F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("n"), F.max_by("__next", t).alias("__after"), F.median("__own").alias("__own"), F.first("__session_dt").alias("__session_dt"),
    )
    tail = F.when(F.col("n") >= 2, F.col("end_t") - F.col("start_t") + F.col("__own")).otherwise(F.coalesce("__session_dt", F.lit(0.0)))
    duration = F.when(F.col("__after").isNotNull(), F.col("__after") - F.col("start_t")).otherwise(tail)
    return runs.select(by, "start_t", "end_t", "n", duration.alias("duration"))


def dropout_drift(df: DataFrame, valid: str, error: str, least: float, by: str = "session_id", t: str = "t") -> DataFrame:
    """The first run of invalid rows of at least that duration: its start and end errors, and their difference."""
    runs = dropout_runs(df, valid, by, t).where(F.col("duration") >= least)
    first = runs.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy("start_t"))).where("__rank = 1").drop("__rank")
    errors = df.select(by, F.col(t).alias("__t"), F.col(error).alias("__e"))
    joined = first.join(errors, by).where((F.col("__t") == F.col("start_t")) | (F.col("__t") == F.col("end_t")))
    out = joined.groupBy(by, "start_t", "end_t", "duration").agg(F.max(F.when(F.col("__t") == F.col("start_t"), F.col("__e"))).alias("start_error"), F.max(F.when(F.col("__t") == F.col("end_t"), F.col("__e"))).alias("end_error"))
    return out.withColumn("drift", F.col("end_error") - F.col("start_error"))


def circular_stats(df: DataFrame, angle: str | Column, by: str = "session_id") -> DataFrame:
    """Circular mean, standard deviation sqrt(-2 ln R), and mean and median absolute value."""
    a = F.col(angle) if isinstance(angle, str) else angle
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    r = F.least(F.hypot(s, c), F.lit(1.0))
    return df.groupBy(by).agg(F.atan2(s, c).alias("mean_angle"), F.sqrt(F.greatest(-2 * F.ln(r), F.lit(0.0))).alias("circular_std"), F.avg(F.abs(wrap(a))).alias("mean_abs"), F.median(F.abs(wrap(a))).alias("median_abs"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0 below, bins + 1 from high up), n."""
    return df.where(finite(value)).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def covariance_ellipse(pxx: Column, pxy: Column, pyy: Column, n_std: float = 2.0) -> dict[str, Column]:
    """Full axes and the tilt of the larger one."""
    middle, half = (pxx + pyy) / 2, F.sqrt(((pxx - pyy) / 2) ** 2 + pxy**2)
    axis = lambda e: 2 * n_std * F.sqrt(F.greatest(e, F.lit(0.0)))
    return {"width": axis(middle + half), "height": axis(middle - half), "tilt": 0.5 * F.atan2(2 * pxy, pxx - pyy)}


def position_std_cm(pxx: Column, pyy: Column) -> Column:
    return 100 * F.sqrt(pxx + pyy)


def mode_comparison(df: DataFrame, by: str = "session_id") -> DataFrame:
    """df(t, mx, my, ax, ay, bx, by_): two estimates against the camera midpoint: RMSE and mean second difference (smoothness) of each."""
    w = Window.partitionBy(by).orderBy("t")
    second = lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)
    out = df.withColumns({f"__s{k}": F.hypot(second(x), second(y)) for k, x, y in (("a", "ax", "ay"), ("b", "bx", "by_"))})
    e = lambda x, y: F.sqrt(F.avg((F.col(x) - F.col("mx")) ** 2 + (F.col(y) - F.col("my")) ** 2))
    return out.groupBy(by).agg(e("ax", "ay").alias("rmse_a"), e("bx", "by_").alias("rmse_b"), F.avg("__sa").alias("roughness_a"), F.avg("__sb").alias("roughness_b"))


def report(df: DataFrame, by: str = "session_id", state_dim: int = 10) -> DataFrame:
    """One row a session of df(t, x, y, vx, vy, heading, their *_true, nees): the QA summary and whether targets are met.

    Targets: position 2 cm, velocity 10 cm/s, heading 7 degrees.
    """
    parts = [
        rmse(df, [("x_true", "x"), ("y_true", "y")], by, out="position_rmse").drop("n"),
        rmse(df, [("vx_true", "vx"), ("vy_true", "vy")], by, out="velocity_rmse").drop("n"),
        heading_errors(df, "heading_true", "heading", by),
        envelope_stats(df, "nees", state_dim, by).select(by, F.col("mean").alias("nees_mean"), F.col("pct_in_bounds").alias("nees_pct_in_bounds")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by)
    met = (F.col("position_rmse") <= 0.02) & (F.col("velocity_rmse") <= 0.1) & (F.degrees("heading_rmse") <= 7)
    return out.withColumn("targets_met", met)
