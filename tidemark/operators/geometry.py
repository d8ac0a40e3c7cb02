"""Quaternions as columns, trigger sources, and events that a path sets off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Quaternion = tuple[Column, Column, Column, Column]


def normalize(q: Quaternion) -> Quaternion:
    size = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return tuple(F.when(size > 1e-12, c / F.nullif(size, F.lit(0.0))).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(q))


def multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (aw * bw - ax * bx - ay * by - az * bz, aw * bx + bw * ax + ay * bz - az * by, aw * by + bw * ay + az * bx - ax * bz, aw * bz + bw * az + ax * by - ay * bx)


def conjugate(q: Quaternion) -> Quaternion:
    return q[0], -q[1], -q[2], -q[3]


def rotate(q: Quaternion, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Body to world, by a unit quaternion."""
    return multiply(multiply(q, (F.lit(0.0), *v)), conjugate(q))[1:]


def euler(q: Quaternion) -> tuple[Column, Column, Column]:
    """Roll, pitch, yaw of a unit quaternion."""
    w, x, y, z = q
    one = F.lit(1.0)
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(F.greatest(-one, F.least(one, 2 * (w * y - z * x)))), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def beam_fix(ex: Column, ey: Column, rx: Column, ry: Column, sigma: Column) -> dict[str, Column]:
    """Anchor and covariance of a light beam between emitter and receiver."""
    dx, dy = rx - ex, ry - ey
    length = F.hypot(dx, dy)
    ux, uy = F.coalesce(dx / F.nullif(length, F.lit(0.0)), F.lit(1.0)), F.coalesce(dy / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    across = sigma * sigma
    along = F.when(length > 0, F.greatest(sigma, length / F.sqrt(F.lit(12.0))) ** 2).otherwise(across)
    return {"anchor_x": (ex + rx) / 2, "anchor_y": (ey + ry) / 2, "cov_xx": along * ux * ux + across * uy * uy, "cov_xy": (along - across) * ux * uy, "cov_yy": along * uy * uy + across * ux * ux}


def _steps(path: DataFrame, by: str, t: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(t)
    return path.withColumns({"t1": F.lead(t).over(w), "x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "t_end": F.max(t).over(Window.partitionBy(by))}).where("t1 is not null")


def opposite(edge: Column) -> Column:
    return F.when(edge == "rise", "fall").otherwise("rise")


def beam_events(path: DataFrame, beams: DataFrame, reset_delay: float, by: str = "session_id", t: str = "t") -> DataFrame:
    """by, t, source_id, edge: where path(x, y) crosses beams(source_id, ex, ey, rx, ry, active_edge), and the reset edges.

    The side of the beam's line changes from one row to the next and the
    crossing lies within the beam.  A reset after the session's end is left
    out.  The beams are a hand-written list and are broadcast.
    """
    df = _steps(path, by, t).crossJoin(F.broadcast(beams))
    sx, sy = F.col("rx") - F.col("ex"), F.col("ry") - F.col("ey")
    side = lambda x, y: sx * (F.col(y) - F.col("ey")) - sy * (F.col(x) - F.col("ex"))
    s0, s1 = side("x", "y"), side("x1", "y1")
    df = df.where(((s0 > 0) & (s1 <= 0)) | ((s0 < 0) & (s1 >= 0)))
    part = s0 / F.nullif(s0 - s1, F.lit(0.0))
    cx, cy = F.col("x") + part * (F.col("x1") - F.col("x")), F.col("y") + part * (F.col("y1") - F.col("y"))
    along = ((cx - F.col("ex")) * sx + (cy - F.col("ey")) * sy) / F.nullif(sx * sx + sy * sy, F.lit(0.0))
    hit = df.where(along.between(0, 1)).select(by, (F.col(t) + part * (F.col("t1") - F.col(t))).alias("t"), "source_id", F.col("active_edge").alias("edge"), "t_end")
    reset = hit.select(by, (F.col("t") + reset_delay).alias("t"), "source_id", opposite(F.col("edge")).alias("edge"), "t_end").where("t <= t_end")
    return hit.unionByName(reset).drop("t_end")


def radius_events(path: DataFrame, discs: DataFrame, by: str = "session_id", t: str = "t") -> DataFrame:
    """by, t, source_id, edge: where path(x, y) enters (active edge) and leaves discs(source_id, cx, cy, radius, active_edge)."""
    df = _steps(path, by, t).crossJoin(F.broadcast(discs))
    d0, d1 = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), F.hypot(F.col("x1") - F.col("cx"), F.col("y1") - F.col("cy"))
    df = df.withColumns({"d0": d0, "d1": d1}).where("(d0 <= radius) <> (d1 <= radius)")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("radius") - F.col("d0")) / F.nullif(F.col("d1") - F.col("d0"), F.lit(0.0))))
    return df.select(by, (F.col(t) + part * (F.col("t1") - F.col(t))).alias("t"), "source_id", F.when(F.col("d1") <= F.col("radius"), F.col("active_edge")).otherwise(opposite(F.col("active_edge"))).alias("edge"))


def debounce(df: DataFrame, gap: float, by: str = "session_id", t: str = "t") -> DataFrame:
    """by, t of events kept greedily: each at least ``gap`` after the last kept one.

    The fold needs a session's event times in one array; sessions are the unit
    of a recording, and only times are gathered.
    """
    times = df.groupBy(by).agg(F.sort_array(F.collect_list(t)).alias("__t"))
    keep = F.aggregate(
        "__t", F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<double>").alias("kept")),
        lambda acc, x: F.when(x - acc["last"] >= gap, F.struct(x.alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc), lambda acc: acc["kept"],
    )
    return times.select(by, F.explode(keep).alias(t))


def confidence_variance(confidence: Column, base: float, clip: float = 0.01) -> Column:
    """Measurement variance for a confidence of 0 to 1."""
    return F.lit(base) / F.least(F.greatest(confidence, F.lit(clip)), F.lit(1.0))
