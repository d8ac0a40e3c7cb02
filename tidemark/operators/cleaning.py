"""Unit conversion, repeats, masks, LED geometry and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.temporal import unwrap, wrap
from tidemark.plans.config import ImuColumns

#: Standard gravity, and the channels a state mode reads.
G_M_S2 = 9.80665
CHANNELS = {"vision_only": (), "2d_full": ("gz", "ax", "ay"), "imu_only": ("gz", "ax", "ay"), "2d_cam_3d_imu": ("gz", "ax", "ay", "az")}
SIX = ("gx", "gy", "gz", "ax", "ay", "az")


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values as null, once at the border."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def change_only(df: DataFrame, columns: list[str], by: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """The first row of each session, and rows where any of the columns differs from the row before; no columns keep all."""
    if not columns:
        return df
    w = Window.partitionBy(by).orderBy(*(order or ["t"]))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("__keep", (F.row_number().over(w) == 1) | ~same).where("__keep").drop("__keep")


def to_si(df: DataFrame, imu: ImuColumns) -> DataFrame:
    """Raw counts as rad/s and m/s^2, under canonical names; other columns stay."""
    gyro, accel = imu.gyro_dps_per_lsb * 0.017453292519943295, imu.accel_g_per_lsb * G_M_S2
    scaled = {axis: F.col(f"`{imu.axes[axis]}`").cast("double") * (imu.signs[axis] * (gyro if axis[0] == "g" else accel)) for axis in SIX}
    return df.select(*(c for c in df.columns if c not in imu.axes.values()), *(c.alias(a) for a, c in scaled.items()))


def channels(mode: str) -> tuple[str, ...]:
    """Inertial channels that a state mode is fed."""
    return CHANNELS.get(mode, SIX)


def rebase(streams: list[DataFrame], by: str = "session_id", t: str = "t", offsets: list[float] | None = None, leading: int | None = None) -> list[DataFrame]:
    """Streams on one clock that starts, in each session, at the earliest first stamp of the ``leading`` ones (default all); then their own offsets."""
    firsts = None
    for s in streams[:leading]:
        one = s.groupBy(by).agg(F.min(t).alias("__first"))
        firsts = one if firsts is None else firsts.unionByName(one)
    start = firsts.groupBy(by).agg(F.min("__first").alias("__start"))
    return [s.join(start, by).withColumn(t, F.col(t) - F.col("__start") + F.lit(o)).drop("__start") for s, o in zip(streams, offsets or [0.0] * len(streams), strict=True)]


def led_mask(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    """Either LED is whole."""
    return (finite(x1) & finite(y1)) | (finite(x2) & finite(y2))


def dual_mask(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    return finite(x1) & finite(y1) & finite(x2) & finite(y2)


def midpoint(df: DataFrame) -> DataFrame:
    """mx, my between the LEDs; null unless both are whole."""
    return df.withColumns({m: F.when(dual_mask(), (F.col(a) + F.col(b)) / 2) for m, a, b in (("mx", "x1", "x2"), ("my", "y1", "y2"))})


def median_spacing(frames: DataFrame, by: str = "session_id", fallback: float | None = None) -> DataFrame:
    """Median LED distance of each session's dual frames; null, or the fallback, without any."""
    d = F.when(dual_mask(), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    out = frames.groupBy(by).agg(F.median(d).alias("spacing"))
    return out if fallback is None else out.withColumn("spacing", F.coalesce("spacing", F.lit(fallback)))


def led_heading(frames: DataFrame, by: str = "session_id", order: list[str] | None = None) -> DataFrame:
    """``heading`` of the LED pair, continuous over dual frames and linear by row number between them; the ends hold."""
    order = order or ["t"]
    raw = F.when(dual_mask(), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    df = unwrap(frames.withColumn("__raw", raw), "__raw", by, order, "__smooth")
    row = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("double")
    return fill_gaps(df.withColumn("__row", row), "__smooth", "__row", by, "heading").drop("__raw", "__smooth", "__row")


def fill_gaps(df: DataFrame, value: str, axis: str = "t", by: str = "session_id", out: str | None = None) -> DataFrame:
    """df with null values on the line between their neighbours along ``axis``; the ends hold."""
    w = Window.partitionBy(by).orderBy(axis)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(axis).alias("x"), F.col(value).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"__a": a, "__b": b})
    ax, av, bx, bv = (F.col(c) for c in ("__a.x", "__a.v", "__b.x", "__b.v"))
    line = av + (bv - av) * ((F.col(axis) - ax) / F.nullif(bx - ax, F.lit(0.0)))
    return df.withColumn(out or value, F.coalesce(F.when(bx > ax, line), av, bv)).drop("__a", "__b")


def swap_leds(frames: DataFrame, swapped: str = "swapped") -> DataFrame:
    """LEDs (and their confidences, if there are) exchanged where ``swapped``."""
    pairs = [("x1", "x2"), ("y1", "y2")] + [(a, b) for a, b in (("conf1", "conf2"),) if a in frames.columns]
    change = {}
    for a, b in pairs:
        change[a] = F.when(F.col(swapped), F.col(b)).otherwise(F.col(a))
        change[b] = F.when(F.col(swapped), F.col(a)).otherwise(F.col(b))
    return frames.withColumns(change)


def label_anomaly(frames: DataFrame, yaw: str = "yaw") -> Column:
    """The LED vector points against the heading."""
    return (F.col("x2") - F.col("x1")) * F.cos(yaw) + (F.col("y2") - F.col("y1")) * F.sin(yaw) < 0


def heading_rate(df: DataFrame, heading: str, by: str = "session_id", t: str = "t") -> DataFrame:
    """``rate``: turn since the row before, the short way, over the time between."""
    w = Window.partitionBy(by).orderBy(t)
    return df.withColumn("rate", wrap(F.col(heading) - F.lag(heading).over(w)) / F.nullif(F.col(t) - F.lag(t).over(w), F.lit(0.0)))
