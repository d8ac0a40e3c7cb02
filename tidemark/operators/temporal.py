"""Joins of streams on different clocks: as-of, nearest, interpolation, intervals, buckets, resampling.

All of them are one pattern: both streams are unioned, sorted once within
their session, and window functions carry the neighbour's values over.  It
costs one shuffle and one sort, O((M + N) log), whatever the clocks do; a
range join would compare every pair of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A neighbour is joined as a struct named by these.
PREV, NEXT = "prev", "next"


def neighbours(left: DataFrame, right: DataFrame, values: list[str], by: str = "session_id", t: str = "t", tie: str | None = None) -> DataFrame:
    """left with structs ``prev`` and ``next`` of right(t, *values): the last row at or before, the first at or after.

    Of right rows at one time, ``prev`` is the last by ``tie`` and ``next``
    the first.  Missing neighbours are null.  A right row at left's own time
    is both.
    """
    keys = [t, *values] + ([tie] if tie and tie not in values else [])
    mine = left.select(F.struct(*left.columns).alias("__row"), F.col(by).alias("__by"), F.col(t).alias("__t"), F.lit(None).cast(right.select(F.struct(*keys)).schema[0].dataType).alias("__r"))
    theirs = right.select(F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), F.col(by).alias("__by"), F.col(t).alias("__t"), F.struct(*keys).alias("__r"))
    both = mine.unionByName(theirs).withColumn("__is_left", F.col("__r").isNull().cast("int"))
    tied = F.col(f"__r.{tie}") if tie else F.lit(0)
    # up to a left row: right rows of its time come first; from it on: they come after
    before = Window.partitionBy("__by").orderBy("__t", "__is_left", tied).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("__by").orderBy(F.col("__t").desc(), "__is_left", tied.desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({PREV: F.last("__r", ignorenulls=True).over(before), NEXT: F.last("__r", ignorenulls=True).over(after)})
    return found.where("__is_left = 1").select("__row.*", PREV, NEXT)


def asof(left: DataFrame, right: DataFrame, values: list[str], direction: str = "backward", **options) -> DataFrame:
    """left with the values of right's row at or before (backward), at or after (forward), or nearest; ties of nearest go to the earlier."""
    found = neighbours(left, right, values, **options)
    t = options.get("t", "t")
    if direction == "nearest":
        closer = F.col(f"{NEXT}.{t}").isNull() | (F.col(t) - F.col(f"{PREV}.{t}") <= F.col(f"{NEXT}.{t}") - F.col(t))
        pick = F.when(F.col(PREV).isNotNull() & closer, F.col(PREV)).otherwise(F.col(NEXT))
    elif direction in ("backward", "forward"):
        pick = F.col(PREV if direction == "backward" else NEXT)
    else:
        raise ValueError("direction must be backward, forward or nearest")
    return found.withColumn("__pick", pick).select(*left.columns, F.col(f"__pick.{t}").alias(f"right_{t}"), *(F.col(f"__pick.{v}").alias(f"right_{v}") for v in values))


def interpolate(left: DataFrame, right: DataFrame, value: str, outside: str = "clamp", **options) -> DataFrame:
    """left with right's value at left's times, linear between neighbours; beyond the ends the end value (clamp) or null."""
    found = neighbours(left, right, [value], **options)
    t = options.get("t", "t")
    t0, t1, v0, v1 = (F.col(f"{n}.{c}") for n, c in ((PREV, t), (NEXT, t), (PREV, value), (NEXT, value)))
    inside = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * ((F.col(t) - t0) / F.nullif(t1 - t0, F.lit(0.0))))
    ends = F.coalesce(v0, v1) if outside == "clamp" else F.lit(None).cast("double")
    return found.select(*left.columns, F.when(t0.isNotNull() & t1.isNotNull(), inside).otherwise(ends).alias(f"interp_{value}"))


def unwrap(df: DataFrame, angle: str, by: str = "session_id", order: list[str] | None = None, out: str = "unwrapped") -> DataFrame:
    """df with the angle made continuous: jumps beyond pi lose a turn; nulls stay null and are skipped."""
    order = order or ["t"]
    w = Window.partitionBy(by).orderBy(*order)
    last = F.last(angle, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    jump = F.col(angle) - last
    # np.unwrap's rule: a jump of exactly half a turn keeps its sign
    two_pi = 2 * F.pi()
    rest = jump + F.pi() - two_pi * F.floor((jump + F.pi()) / two_pi) - F.pi()
    rest = F.when((rest == -F.pi()) & (jump > 0), F.pi()).otherwise(rest)
    turn = F.when(F.abs(jump) < F.pi(), F.lit(0.0)).otherwise(rest - jump)
    return df.withColumn("__turn", F.coalesce(turn, F.lit(0.0))).withColumn(out, F.col(angle) + F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turn")


def numbered_frames(frames: DataFrame, by: str = "session_id", tie: str = "event_id") -> DataFrame:
    """frames with their number from 0 in each session."""
    return frames.withColumn("frame", (F.row_number().over(Window.partitionBy(by).orderBy("t", tie)) - 1).cast("long"))


def interval_frames(samples: DataFrame, frames: DataFrame, by: str = "session_id") -> DataFrame:
    """samples with the ``frame`` whose interval (t[k-1], t[k]] they lie in; those up to frame 0 or after the last go."""
    found = neighbours(samples, frames, ["frame"], by=by, tie="frame").withColumn("frame", F.col(f"{NEXT}.frame"))
    return found.where("frame >= 1").drop(PREV, NEXT)


def bucket_events(triggers: DataFrame, sources: DataFrame, frames: DataFrame, by: str = "session_id", tie: str = "event_id") -> DataFrame:
    """triggers with their fate, frame and slot.

    fate: unknown_source, edge_mismatch, before (at or before frame 0), after
    (the last frame) or kept.  Kept events have the frame that ends their
    interval, and a slot from 0 in it by ``tie``.  The sources are broadcast:
    a hand-written list, small by nature.
    """
    known = triggers.join(sources.select("source_id", "active_edge"), "source_id", "left").select(*triggers.columns, "active_edge")
    placed = neighbours(known, frames, ["frame"], by=by, tie="frame").withColumn("__frame", F.col(f"{NEXT}.frame")).drop(PREV, NEXT)
    fate = F.when(F.col("active_edge").isNull(), "unknown_source").when(F.col("edge") != F.col("active_edge"), "edge_mismatch").when(F.col("__frame").isNull(), "after").when(F.col("__frame") == 0, "before").otherwise("kept")
    placed = placed.withColumn("fate", fate).withColumn("frame", F.when(F.col("fate") == "kept", F.col("__frame"))).drop("__frame", "active_edge")
    slots = Window.partitionBy(by, "frame").orderBy(tie)
    return placed.withColumn("slot", F.when(F.col("fate") == "kept", (F.row_number().over(slots) - 1).cast("long")))


def drop_accounting(bucketed: DataFrame, by: str = "session_id") -> DataFrame:
    """Events of each fate, by session."""
    fates = ("unknown_source", "edge_mismatch", "before", "after", "kept")
    return bucketed.groupBy(by).agg(F.count("*").alias("n_total"), *(F.count_if(F.col("fate") == f).alias(f"n_{f}") for f in fates))


def check_bucketed(bucketed: DataFrame, max_events_per_frame: int | None = None) -> None:
    """Raise if a source is unknown, a frame has too many events, or a session loses all of its events."""
    bad = bucketed.groupBy("session_id").agg(F.count_if(F.col("fate") == "unknown_source").alias("unknown"), F.max("slot").alias("slot"), F.count_if(F.col("fate") == "kept").alias("kept"))
    rule = (F.col("unknown") > 0) | (F.col("kept") == 0)
    if max_events_per_frame is not None:
        rule = rule | (F.col("slot") >= max_events_per_frame)
    if found := bad.where(rule).head(1):
        raise ValueError(f"trigger events can't be used: {found[0].asDict()}")


def events_per_frame(bucketed: DataFrame, frames: DataFrame, by: str = "session_id") -> DataFrame:
    """Every frame with its kept events' source ids in slot order (no padding)."""
    kept = bucketed.where("fate = 'kept'").groupBy(by, "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "source_id"))), lambda e: e["source_id"]).alias("source_ids"))
    return frames.select(by, "frame").join(kept, [by, "frame"], "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<bigint>")))


def regular_grid(df: DataFrame, step: float, by: str = "session_id", t: str = "t") -> DataFrame:
    """by, tick, t: times from a session's first to its last at a fixed step."""
    spans = df.groupBy(by).agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    ticks = spans.withColumn("tick", F.explode(F.sequence(F.lit(0), F.floor((F.col("__b") - F.col("__a")) / step).cast("int"))))
    return ticks.select(by, F.col("tick").cast("long").alias("tick"), (F.col("__a") + F.col("tick") * step).alias(t))


def interpolate_angle(left: DataFrame, right: DataFrame, angle: str, **options) -> DataFrame:
    """Unwrap, interpolate, wrap again."""
    t = options.get("t", "t")
    smooth = unwrap(right, angle, options.get("by", "session_id"), [t] + ([options["tie"]] if "tie" in options else []), "__angle")
    out = interpolate(left, smooth, "__angle", **options)
    return out.withColumn(f"interp_{angle}", wrap(F.col("interp___angle"))).drop("interp___angle")


def wrap(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))
