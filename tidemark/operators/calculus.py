"""Derivatives, smoothing, stationarity, biases, lag scans, axis assignment and safety envelopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cleaning import fill_gaps
from tidemark.operators.temporal import interpolate


def _w(by: str, t: str) -> Window:
    return Window.partitionBy(by).orderBy(t)


def gradient(df: DataFrame, value: str, by: str = "session_id", t: str = "t", out: str | None = None) -> DataFrame:
    """Second-order derivative of unevenly spaced values, one-sided at the ends; null for sessions of fewer than three rows."""
    w = _w(by, t)
    at = lambda c, k: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)
    # Lagrange's parabola through three points, differentiated at the row's own time
    def slope(k0: int, k1: int, k2: int) -> Column:
        x = [F.col(t) if k == 0 else at(t, k) for k in (k0, k1, k2)]
        y = [F.col(value) if k == 0 else at(value, k) for k in (k0, k1, k2)]
        total = None
        for i in range(3):
            j, m = (n for n in range(3) if n != i)
            term = y[i] * ((F.col(t) - x[j]) + (F.col(t) - x[m])) / F.nullif((x[i] - x[j]) * (x[i] - x[m]), F.lit(0.0))
            total = term if total is None else total + term
        return total

    middle = slope(1, 0, -1)
    first, last = slope(0, -1, -2), slope(2, 1, 0)
    return df.withColumn(out or f"d_{value}", F.when(at(t, 1).isNull(), first).when(at(t, -1).isNull(), last).otherwise(middle))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """A normalised kernel of radius ceil(truncate * sigma), 1 at least."""
    if sigma <= 0:
        return [1.0]
    radius = max(1, math.ceil(truncate * sigma))
    raw = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def smooth(df: DataFrame, value: str, sigma_rows: float, by: str = "session_id", t: str = "t", out: str | None = None) -> DataFrame:
    """Gaussian smoothing by rows, gaps filled first, mirrored at the ends (the end itself isn't repeated).

    Sessions shorter than the kernel's radius are mirrored as often as needed.
    """
    weights = gaussian_weights(sigma_rows)
    radius = len(weights) // 2
    df = fill_gaps(df, value, t, by, "__v")
    # a session of n rows repeats, mirrored, every 2(n - 1): places are folded into it by arithmetic
    row, n = F.row_number().over(_w(by, t)) - 1, F.count("*").over(Window.partitionBy(by))
    df = df.withColumns({"__row": row, "__n": n, "__all": F.collect_list("__v").over(_w(by, t).rowsBetween(-radius, radius))})
    first = F.greatest(F.lit(0), F.col("__row") - radius)
    period = F.greatest(F.lit(1), 2 * (F.col("__n") - 1))
    total = F.lit(0.0)
    for k, wt in enumerate(weights):
        place = F.pmod(F.col("__row") + (k - radius), period)
        folded = F.least(place, period - place)
        folded = F.when(F.col("__n") == 1, F.lit(0)).otherwise(folded)
        total = total + F.get("__all", (folded - first).cast("int")) * wt
    return df.withColumn(out or f"smooth_{value}", total).drop("__v", "__row", "__n", "__all")


def median_dt(df: DataFrame, by: str = "session_id", t: str = "t") -> DataFrame:
    """Median step, and its inverse as the sampling rate."""
    steps = df.withColumn("__dt", F.col(t) - F.lag(t).over(_w(by, t)))
    return steps.groupBy(by).agg(F.median("__dt").alias("median_dt")).withColumn("rate", 1 / F.nullif(F.col("median_dt"), F.lit(0.0)))


def lookback_speed(df: DataFrame, x: str, y: str, window: int, by: str = "session_id", t: str = "t") -> DataFrame:
    """``speed`` over exactly ``window`` rows back; null before that."""
    w = _w(by, t)
    step = F.hypot(F.col(x) - F.lag(x, window).over(w), F.col(y) - F.lag(y, window).over(w))
    return df.withColumn("speed", step / F.greatest(F.col(t) - F.lag(t, window).over(w), F.lit(1e-6)))


def bounded_hold(df: DataFrame, value: str, rows: int, by: str = "session_id", t: str = "t", out: str = "held") -> DataFrame:
    """The value, or the last one known within so many rows before."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_w(by, t).rowsBetween(-rows, 0)))


def range_mean(df: DataFrame, value: str, width: float, by: str = "session_id", t: str = "t", out: str = "window_mean") -> DataFrame:
    """Mean and count of rows within width / 2 in time, both ends included."""
    # the frame's bounds are doubles, which the window builder doesn't take
    over = f"OVER (PARTITION BY `{by}` ORDER BY `{t}` RANGE BETWEEN {width / 2!r}D PRECEDING AND {width / 2!r}D FOLLOWING)"
    return df.withColumns({out: F.expr(f"avg(`{value}`) {over}"), "window_n": F.expr(f"count(`{value}`) {over}")})


def stationary(samples: DataFrame, gyro: str, limit: float, speeds: DataFrame | None = None, speed_limit: float = 0.05, by: str = "session_id") -> DataFrame:
    """``stationary``: little turn and, with speeds(t, speed), little camera speed; never outside the camera's span."""
    df = samples.withColumn("stationary", F.coalesce(F.abs(gyro) < limit, F.lit(False)))
    if speeds is None:
        return df
    df = interpolate(df, speeds, "speed", outside="null", by=by)
    return df.withColumn("stationary", F.col("stationary") & F.coalesce(F.col("interp_speed") < speed_limit, F.lit(False)))


def stationary_medians(df: DataFrame, columns: list[str], by: str = "session_id") -> DataFrame:
    """Median of each column over stationary rows: gyro bias, gravity; and how many rows and what share those are."""
    return df.groupBy(by).agg(*(F.median(F.when(F.col("stationary"), F.col(c))).alias(f"median_{c}") for c in columns), F.count_if("stationary").alias("stationary_samples"), F.avg(F.col("stationary").cast("double")).alias("stationary_fraction"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation over a group; null for fewer than three rows or a constant side, which the built-in one divides by."""
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when((F.count("*") >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.covar_pop(x, y) / spread)


def lag_fits(source: DataFrame, value: str, target: DataFrame, goal: str, lags: list[float], by: str = "session_id", t: str = "t") -> DataFrame:
    """For each session and lag, the least-squares line of target on the source interpolated at t + lag: correlation, slope, intercept, r2, n.

    The lags are a short list of the caller's; each target row is repeated for each.
    """
    shifted = target.select(by, F.col(t).alias("__t"), goal, F.explode(F.array(*(F.lit(float(x)) for x in lags))).alias("lag")).withColumn(t, F.col("__t") + F.col("lag"))
    pairs = interpolate(shifted, source, value, outside="null", by=by, t=t).where(F.col(f"interp_{value}").isNotNull() & F.col(goal).isNotNull())
    x, y = f"interp_{value}", goal
    return pairs.groupBy(by, "lag").agg(
        F.count("*").alias("n"), correlation(x, y).alias("correlation"),
        F.when(F.count("*") >= 3, F.regr_slope(y, x)).alias("slope"), F.when(F.count("*") >= 3, F.regr_intercept(y, x)).alias("intercept"), F.when(F.count("*") >= 3, F.regr_r2(y, x)).alias("r2"),
    )


def best_lag(fits: DataFrame, by: list[str] | None = None, signed: bool = False, digits: int = 9) -> DataFrame:
    """The fit with the largest (absolute) correlation; of equal ones, to so many digits, the first lag."""
    by = by or ["session_id"]
    score = F.round(F.col("correlation") if signed else F.abs("correlation"), digits)
    w = Window.partitionBy(*by).orderBy(score.desc_nulls_last(), "lag")
    return fits.where(F.col("correlation").isNotNull()).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def assign_axes(scores: DataFrame, by: str = "session_id") -> DataFrame:
    """scores(target, axis, sign, correlation) -> the pair of distinct axes for the two targets x and y with the largest sum of correlations.

    Ties go by axis and sign, -1 first.
    """
    side = lambda k: scores.where(F.col("target") == k).select(by, F.col("axis").alias(f"axis_{k}"), F.col("sign").alias(f"sign_{k}"), F.col("correlation").alias(f"corr_{k}"))
    # six candidates a session and target: the pairs stay a constant number
    pairs = side("x").join(side("y"), by).where("axis_x <> axis_y")
    score = F.round(F.coalesce("corr_x", F.lit(float("-inf"))) + F.coalesce("corr_y", F.lit(float("-inf"))), 9)
    w = Window.partitionBy(by).orderBy(score.desc(), "axis_x", "sign_x", "axis_y", "sign_y")
    return pairs.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def gravity_axis(samples: DataFrame, columns: list[str], by: str = "session_id", order: str | None = None) -> DataFrame:
    """The axis with the largest absolute mean, the first of equal ones, and its sign; one that can't be compared with a later one gives way to it.

    Rounding decides between means that are equal but for it; with ``order``
    each group's values are added up in that order, wherever the rows lie.
    """
    if order is not None:
        samples = samples.repartition(by).sortWithinPartitions(by, order)
    means = samples.groupBy(by).agg(*(F.avg(c).alias(c) for c in columns))

    def pick(f):
        out = f(columns[-1])
        for i in range(len(columns) - 2, -1, -1):
            wins = F.lit(True)
            for c in columns[i + 1 :]:
                wins = wins & (F.abs(columns[i]) >= F.abs(c))
            out = F.when(wins, f(columns[i])).otherwise(out)
        return out

    return means.select(by, pick(F.lit).alias("axis"), pick(F.signum).cast("int").alias("sign"), pick(F.col).alias("mean"))


def safety_report(estimates: DataFrame, limits, by: str = "session_id") -> DataFrame:
    """estimates(t, x, y, vx_x, vx_y, mx, my) -> whether the fused path is plausible against the camera's and the vision-only one.

    x, y: fused position; vx_x, vx_y: vision-only position; mx, my: camera
    midpoint, null where it isn't seen.
    """
    w = _w(by, "t")
    speed = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-6))
    off = F.when(F.col("mx").isNotNull(), F.hypot(F.col("x") - F.col("vx_x"), F.col("y") - F.col("vx_y")))
    seen = lambda c: F.when(F.col("mx").isNotNull() & F.col("my").isNotNull(), F.col(c))
    span = lambda c: F.max(c) - F.min(c)
    out = estimates.withColumns({"__speed": speed, "__off": off}).groupBy(by).agg(
        span(seen("mx")).alias("camera_range_x"), span(seen("my")).alias("camera_range_y"), span("x").alias("fused_range_x"), span("y").alias("fused_range_y"),
        F.coalesce(F.max("__speed"), F.lit(0.0)).alias("max_speed"), F.max("__off").alias("max_deviation"), F.percentile("__off", 0.95).alias("p95_deviation"), F.count("mx").alias("dual_frames"),
    )
    fits = lambda a: F.col(f"fused_range_{a}") <= F.col(f"camera_range_{a}") * limits.envelope_multiplier + limits.extra_range_m
    passed = fits("x") & fits("y") & (F.col("max_speed") <= limits.max_speed_mps) & (F.col("max_deviation") <= limits.max_position_deviation_m) & (F.col("p95_deviation") <= limits.p95_position_deviation_m) & (F.col("dual_frames") >= limits.min_dual_led_frames)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))
