"""One query for each operator family over the driver's tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import chi2_bounds
from tidemark.operators import calculus, calibration, cleaning, filters, geometry, qa, temporal, validation
from tidemark.plans.config import CalibrationGates, FilterConfig, ImuColumns, LedIdentityConfig, OrientationConfig, SafetyLimits
from tidemark.sources import events as ev
from tidemark.sources import simulate
from tidemark.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BASE = ev.SQL


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, and 0 for -0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def q(names: str, digits: int = 6) -> str:
    """The same in SQL."""
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names.split())


# sources and cleaning

@query(BASE + f"SELECT session_id, event_id, round(value * CAST({0.061 * 0.017453292519943295!r} AS DOUBLE), 9) + 0.0 AS gz, round(-k * CAST({0.000061 * 9.80665!r} AS DOUBLE), 9) + 0.0 AS ax FROM samples")
def scan_project_si(spark, d):
    """Unit conversion: raw counts by sign and scale."""
    raw = ev.samples(spark, d).select("session_id", "event_id", F.col("value").alias("z"), F.col("k").alias("a"), F.lit(0).alias("o"))
    imu = ImuColumns(axes={"gx": "o1", "gy": "o2", "gz": "z", "ax": "a", "ay": "o3", "az": "o4"}, signs={"gx": 1, "gy": 1, "gz": 1, "ax": -1, "ay": 1, "az": 1})
    raw = raw.select("*", *(F.col("o").alias(f"o{i}") for i in range(1, 5)))
    return cleaning.to_si(raw, imu).select("session_id", "event_id", r("gz", 9).alias("gz"), r("ax", 9).alias("ax"))


@query(BASE + "SELECT session_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM rows_ WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM p")
def change_only_filter(spark, d):
    return cleaning.change_only(ev.rows(spark, d), ["event_type"], order=["t", "event_id"]).select("session_id", "event_id", "event_type")


@query(BASE + ", s AS (SELECT session_id, min(t) AS t0 FROM (SELECT * FROM frames UNION ALL SELECT * FROM samples) GROUP BY 1) SELECT session_id, event_id, round(t - t0 + 0.5, 6) + 0.0 AS t FROM frames JOIN s USING (session_id)")
def time_rebase(spark, d):
    frames, _ = cleaning.rebase([ev.frames(spark, d), ev.samples(spark, d)], offsets=[0.5, 0.0])
    return rounded(frames.select("session_id", "event_id", "t"), "t")


#: Frames as LED pairs: LED 1 is the row's (value, k), LED 2 the next row's; large values are missing.
def led_frames(spark: SparkSession, d: str) -> DataFrame:
    f = ev.frames(spark, d)
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    seen = lambda c: F.when(F.col("value") <= ev.DROPOUT_ABOVE, F.col(c).cast("double"))
    nxt = lambda c: F.lead(F.when(F.col("value") <= ev.DROPOUT_ABOVE, F.col(c).cast("double"))).over(w)
    return f.select("session_id", "event_id", "t", seen("value").alias("x1"), seen("k").alias("y1"), nxt("value").alias("x2"), nxt("k").alias("y2"))


LEDS = BASE + f""", leds AS (SELECT session_id, event_id, t, CASE WHEN value <= {ev.DROPOUT_ABOVE} THEN value END AS x1, CASE WHEN value <= {ev.DROPOUT_ABOVE} THEN CAST(k AS DOUBLE) END AS y1,
  lead(CASE WHEN value <= {ev.DROPOUT_ABOVE} THEN value END) OVER w AS x2, lead(CASE WHEN value <= {ev.DROPOUT_ABOVE} THEN CAST(k AS DOUBLE) END) OVER w AS y2
  FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))"""


@query(LEDS + " SELECT session_id, event_id, (x1 IS NOT NULL AND y1 IS NOT NULL) OR (x2 IS NOT NULL AND y2 IS NOT NULL) AS usable, x1 IS NOT NULL AND x2 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL AS dual FROM leds")
def valid_mask_or(spark, d):
    return led_frames(spark, d).select("session_id", "event_id", cleaning.led_mask().alias("usable"), cleaning.dual_mask().alias("dual"))


@query(LEDS + " SELECT session_id, event_id, round((x1 + x2) / 2, 6) + 0.0 AS mx, round((y1 + y2) / 2, 6) + 0.0 AS my FROM leds")
def led_midpoint(spark, d):
    return rounded(cleaning.midpoint(led_frames(spark, d)).select("session_id", "event_id", "mx", "my"), "mx", "my")


@query(LEDS + " SELECT session_id, round(median(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 6) + 0.0 AS spacing FROM leds GROUP BY 1")
def median_spacing(spark, d):
    return rounded(cleaning.median_spacing(led_frames(spark, d)), "spacing")


UNWRAP = LEDS + """, a AS (SELECT *, atan2(y2 - y1, x2 - x1) AS raw FROM leds), b AS (SELECT *, raw - last_value(raw IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j FROM a),
c AS (SELECT *, j + pi() - 2 * pi() * floor((j + pi()) / (2 * pi())) - pi() AS m FROM b), u AS (SELECT *, raw + sum(CASE WHEN j IS NULL OR abs(j) < pi() THEN 0.0 ELSE (CASE WHEN m = -pi() AND j > 0 THEN pi() ELSE m END) - j END) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS unwrapped FROM c)"""


@query(UNWRAP + " SELECT session_id, event_id, round(unwrapped, 6) + 0.0 AS unwrapped FROM u")
def unwrap_heading(spark, d):
    raw = led_frames(spark, d).withColumn("raw", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    return rounded(temporal.unwrap(raw, "raw", order=["t", "event_id"]).select("session_id", "event_id", "unwrapped"), "unwrapped")


@query(UNWRAP + """, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS i FROM u),
f AS (SELECT *, last_value(CASE WHEN unwrapped IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, last_value(unwrapped IGNORE NULLS) OVER p AS u0, first_value(CASE WHEN unwrapped IS NOT NULL THEN i END IGNORE NULLS) OVER g AS i1, first_value(unwrapped IGNORE NULLS) OVER g AS u1
 FROM n WINDOW p AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY session_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT session_id, event_id, round(coalesce(CASE WHEN i1 > i0 THEN u0 + (u1 - u0) * (i - i0) / (i1 - i0) END, u0, u1), 6) + 0.0 AS heading FROM f""")
def led_heading(spark, d):
    """Headings of the LED pair, continuous and without gaps."""
    return rounded(cleaning.led_heading(led_frames(spark, d), order=["t", "event_id"]).select("session_id", "event_id", "heading"), "heading")


@query(BASE + f""", v AS (SELECT *, CASE WHEN value <= {ev.DROPOUT_ABOVE} THEN value END AS z FROM frames), f AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, last_value(z IGNORE NULLS) OVER p AS z0, first_value(CASE WHEN z IS NOT NULL THEN t END IGNORE NULLS) OVER g AS t1, first_value(z IGNORE NULLS) OVER g AS z1
 FROM v WINDOW p AS (PARTITION BY session_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY session_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT session_id, event_id, round(coalesce(CASE WHEN t1 > t0 THEN z0 + (z1 - z0) * ((t - t0) / (t1 - t0)) END, z0, z1), 6) + 0.0 AS z FROM f""")
def fill_gaps(spark, d):
    v = ev.frames(spark, d).withColumn("z", F.when(F.col("value") <= ev.DROPOUT_ABOVE, F.col("value")))
    return rounded(cleaning.fill_gaps(v, "z").select("session_id", "event_id", "z"), "z")


# validation

@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE NOT (l_shipdate > p)) AS n_bad, min(CASE WHEN NOT (l_shipdate > p) THEN i END) AS first_bad FROM (SELECT *, lag(l_shipdate) OVER w AS p, row_number() OVER w - 1 AS i FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate)) GROUP BY 1")
def monotonic_violations(spark, d):
    """Long series: ship dates by order, whether strictly ascending."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("double").alias("t"))
    return validation.time_violations(li, "l_suppkey", ["l_orderkey", "l_linenumber", "t"])


@query(BASE + f"SELECT session_id, count(*) FILTER (WHERE value > {ev.DROPOUT_ABOVE}) AS n_bad, min(CASE WHEN value > {ev.DROPOUT_ABOVE} THEN i END) AS first_bad FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) - 1 AS i FROM frames) GROUP BY 1")
def finite_violations(spark, d):
    f = ev.frames(spark, d).withColumn("z", F.when(F.col("value") <= ev.DROPOUT_ABOVE, F.col("value")))
    return validation.finite_violations(f, ["z"], order=["t", "event_id"])


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return validation.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_suppkey"])


# temporal joins

NUMBERED = BASE + ", numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) - 1 AS frame FROM frames)"


@query(BASE + "SELECT session_id, event_id, source_id, edge, active_edge, edge = active_edge AS active FROM triggers LEFT JOIN sources USING (source_id)")
def edge_lookup_join(spark, d):
    s = F.broadcast(ev.sources(spark).select("source_id", "active_edge"))
    return ev.triggers(spark, d).join(s, "source_id", "left").select("session_id", "event_id", "source_id", "edge", "active_edge", (F.col("edge") == F.col("active_edge")).alias("active"))


@query(BASE + "SELECT source_id, count(*) AS n FROM triggers ANTI JOIN sources USING (source_id) GROUP BY 1")
def unknown_source_anti_join(spark, d):
    return ev.triggers(spark, d).join(F.broadcast(ev.sources(spark)), "source_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("n"))


BUCKETED = NUMBERED + """, nxt AS (SELECT e.*, n.frame AS f FROM triggers e ASOF LEFT JOIN numbered n ON e.session_id = n.session_id AND e.t <= n.t),
fated AS (SELECT nxt.*, CASE WHEN active_edge IS NULL THEN 'unknown_source' WHEN edge <> active_edge THEN 'edge_mismatch' WHEN f IS NULL THEN 'after' WHEN f = 0 THEN 'before' ELSE 'kept' END AS fate FROM nxt LEFT JOIN sources USING (source_id)),
bucketed AS (SELECT session_id, event_id, source_id, fate, CASE WHEN fate = 'kept' THEN f END AS frame, CASE WHEN fate = 'kept' THEN row_number() OVER (PARTITION BY session_id, CASE WHEN fate = 'kept' THEN f END ORDER BY event_id) - 1 END AS slot FROM fated)"""


def _bucketed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    frames = temporal.numbered_frames(ev.frames(spark, d))
    return temporal.bucket_events(ev.triggers(spark, d), ev.sources(spark), frames), frames


@query(BUCKETED + " SELECT * FROM bucketed")
def event_bucket_next_asof(spark, d):
    """Events to the frame that ends their interval, with what became of each and its slot in the frame."""
    return _bucketed(spark, d)[0].select("session_id", "event_id", "source_id", "fate", "frame", "slot")


@query(BUCKETED + " SELECT session_id, count(*) AS n_total, " + ", ".join(f"count(*) FILTER (WHERE fate = '{f}') AS n_{f}" for f in ("unknown_source", "edge_mismatch", "before", "after", "kept")) + " FROM bucketed GROUP BY 1")
def drop_accounting(spark, d):
    return temporal.drop_accounting(_bucketed(spark, d)[0])


@query(BUCKETED + " SELECT n.session_id, n.frame, coalesce(string_agg(CAST(b.source_id AS VARCHAR), ',' ORDER BY b.slot), '') AS sources FROM numbered n LEFT JOIN bucketed b ON n.session_id = b.session_id AND n.frame = b.frame GROUP BY 1, 2")
def events_per_frame_array(spark, d):
    return temporal.events_per_frame(*_bucketed(spark, d)).select("session_id", "frame", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("sources"))


@query(NUMBERED + ", p AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY frame) AS t0 FROM numbered) SELECT p.session_id, p.frame, count(s.event_id) AS n, round(avg(s.value), 6) + 0.0 AS mean FROM p JOIN samples s ON s.session_id = p.session_id AND s.t > p.t0 AND s.t <= p.t GROUP BY 1, 2")
def interval_join_imu_counts(spark, d):
    """Samples to frame intervals (t[k-1], t[k]], counted and averaged."""
    frames = temporal.numbered_frames(ev.frames(spark, d))
    return temporal.interval_frames(ev.samples(spark, d), frames).groupBy("session_id", "frame").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


def _asof(direction: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = temporal.asof(ev.samples(spark, d).select("session_id", "event_id", "t"), ev.frames(spark, d).select("session_id", "t", F.col("event_id").alias("frame_event"), "value"), ["frame_event", "value"], direction, tie="frame_event")
        return found.select("session_id", "event_id", F.col("right_frame_event").alias("frame_event"), F.col("right_value").alias("value"))

    return run


@query(BASE + "SELECT s.session_id, s.event_id, f.event_id AS frame_event, f.value FROM samples s ASOF LEFT JOIN frames f ON s.session_id = f.session_id AND s.t >= f.t")
def asof_prev(spark, d):
    return _asof("backward")(spark, d)


@query(BASE + "SELECT s.session_id, s.event_id, f.event_id AS frame_event, f.value FROM samples s ASOF LEFT JOIN frames f ON s.session_id = f.session_id AND s.t <= f.t")
def asof_next(spark, d):
    return _asof("forward")(spark, d)


@query(BASE + """, p AS (SELECT s.*, f.event_id AS pe, f.value AS pv, f.t AS pt FROM samples s ASOF LEFT JOIN frames f ON s.session_id = f.session_id AND s.t >= f.t),
n AS (SELECT p.*, f.event_id AS ne, f.value AS nv, f.t AS nt FROM p ASOF LEFT JOIN frames f ON p.session_id = f.session_id AND p.t <= f.t)
SELECT session_id, event_id, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN pe ELSE ne END AS frame_event, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN pv ELSE nv END AS value FROM n""")
def asof_nearest_tie(spark, d):
    return _asof("nearest")(spark, d)


INTERP = BASE + """, p AS (SELECT s.*, f.value AS pv, f.t AS pt FROM samples s ASOF LEFT JOIN frames f ON s.session_id = f.session_id AND s.t >= f.t),
n AS (SELECT p.*, f.value AS nv, f.t AS nt FROM p ASOF LEFT JOIN frames f ON p.session_id = f.session_id AND p.t <= f.t)"""


@query(INTERP + " SELECT session_id, event_id, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR nt = pt THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END, 6) + 0.0 AS clamped, round(CASE WHEN pt IS NULL OR nt IS NULL THEN NULL WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END, 6) + 0.0 AS inside FROM n")
def interp_join(spark, d):
    """Linear interpolation of one stream at the other's times, both ways to treat the outside."""
    left, right = ev.samples(spark, d).select("session_id", "event_id", "t"), ev.frames(spark, d).select("session_id", "t", "value")
    clamped = temporal.interpolate(left, right, "value").withColumnRenamed("interp_value", "clamped")
    both = temporal.interpolate(clamped, right, "value", outside="null").withColumnRenamed("interp_value", "inside")
    return rounded(both.select("session_id", "event_id", "clamped", "inside"), "clamped", "inside")


@query(BASE + """, g AS (SELECT session_id, tick, a + tick * 24.0 AS t FROM (SELECT session_id, min(t) AS a, unnest(range(0, CAST(floor((max(t) - min(t)) / 24.0) AS BIGINT) + 1)) AS tick FROM frames GROUP BY 1)),
p AS (SELECT g.*, f.value AS pv, f.t AS pt FROM g ASOF LEFT JOIN frames f ON g.session_id = f.session_id AND g.t >= f.t), n AS (SELECT p.*, f.value AS nv, f.t AS nt FROM p ASOF LEFT JOIN frames f ON p.session_id = f.session_id AND p.t <= f.t)
SELECT session_id, tick, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR nt = pt THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END, 6) + 0.0 AS value FROM n""")
def resample_grid(spark, d):
    """A regular clock of 24 hours a tick, filled by interpolation."""
    f = ev.frames(spark, d).select("session_id", "t", "value")
    out = temporal.interpolate(temporal.regular_grid(f, 24.0), f, "value")
    return out.select("session_id", "tick", r("interp_value").alias("value"))


@query(BASE + "SELECT session_id, event_id, round(atan2(sin(value), cos(value)), 6) + 0.0 AS wrapped FROM frames")
def wrap_angle(spark, d):
    return ev.frames(spark, d).select("session_id", "event_id", r(temporal.wrap(F.col("value"))).alias("wrapped"))


# calculus and search

def _slope(k0: int, k1: int, k2: int) -> str:
    at = lambda c, k: c if k == 0 else f"lag({c}, {k}) OVER w" if k > 0 else f"lead({c}, {-k}) OVER w"
    x, y = [at("t", k) for k in (k0, k1, k2)], [at("value", k) for k in (k0, k1, k2)]
    term = lambda i, j, m: f"{y[i]} * ((t - {x[j]}) + (t - {x[m]})) / nullif(({x[i]} - {x[j]}) * ({x[i]} - {x[m]}), 0)"
    return " + ".join((term(0, 1, 2), term(1, 0, 2), term(2, 0, 1)))


@query(BASE + f"SELECT session_id, event_id, round(CASE WHEN lag(t) OVER w IS NULL THEN {_slope(0, -1, -2)} WHEN lead(t) OVER w IS NULL THEN {_slope(2, 1, 0)} ELSE {_slope(1, 0, -1)} END, 4) + 0.0 AS d_value FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY t)")
def gradient_nonuniform(spark, d):
    return rounded(calculus.gradient(ev.frames(spark, d), "value").select("session_id", "event_id", "d_value"), "d_value", digits=4)


_WEIGHTS = calculus.gaussian_weights(1.5)
_RADIUS = len(_WEIGHTS) // 2


@query(BASE + f""", n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS m FROM frames), w AS (SELECT * FROM (VALUES {', '.join(f'({k - _RADIUS}, CAST({x!r} AS DOUBLE))' for k, x in enumerate(_WEIGHTS))}) AS w(o, wt)),
j AS (SELECT a.session_id, a.event_id, wt, CASE WHEN m = 1 THEN 0 ELSE least(((i + o) % (2 * (m - 1)) + 2 * (m - 1)) % (2 * (m - 1)), 2 * (m - 1) - ((i + o) % (2 * (m - 1)) + 2 * (m - 1)) % (2 * (m - 1))) END AS at FROM n a, w)
SELECT j.session_id, j.event_id, round(sum(wt * n.value), 4) + 0.0 AS smooth_value FROM j JOIN n ON n.session_id = j.session_id AND n.i = j.at GROUP BY 1, 2""")
def gaussian_smooth(spark, d):
    return rounded(calculus.smooth(ev.frames(spark, d), "value", 1.5).select("session_id", "event_id", "smooth_value"), "smooth_value", digits=4)


@query(BASE + "SELECT session_id, event_id, round(sqrt((value - lag(value, 3) OVER w) ** 2 + (k - lag(k, 3) OVER w) ** 2) / greatest(t - lag(t, 3) OVER w, 1e-6), 6) + 0.0 AS speed FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY t)")
def lookback_speed(spark, d):
    return rounded(calculus.lookback_speed(ev.frames(spark, d), "value", "k", 3).select("session_id", "event_id", "speed"), "speed")


@query(BASE + f"SELECT session_id, event_id, last_value(CASE WHEN value <= 60 THEN value END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS held FROM frames")
def bounded_hold(spark, d):
    f = ev.frames(spark, d).withColumn("z", F.when(F.col("value") <= 60, F.col("value")))
    return calculus.bounded_hold(f, "z", 2).select("session_id", "event_id", "held")


@query(BASE + "SELECT session_id, event_id, round(avg(value) OVER w, 6) + 0.0 AS window_mean, count(value) OVER w AS window_n FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 24.0 PRECEDING AND 24.0 FOLLOWING)")
def range_window(spark, d):
    return rounded(calculus.range_mean(ev.frames(spark, d), "value", 48.0).select("session_id", "event_id", "window_mean", "window_n"), "window_mean")


@query(BASE + "SELECT session_id, round(1 / median(dt), 6) + 0.0 AS rate FROM (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY t) AS dt FROM samples) GROUP BY 1")
def sampling_rate(spark, d):
    return rounded(calculus.median_dt(ev.samples(spark, d)).select("session_id", "rate"), "rate")


SPEEDS = BASE + ", speeds AS (SELECT * FROM (SELECT session_id, t, abs(value - lag(value) OVER w) / (t - lag(t) OVER w) AS speed FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY t)) WHERE speed IS NOT NULL)"


def _speeds(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("t")
    return ev.frames(spark, d).select("session_id", "t", (F.abs(F.col("value") - F.lag("value").over(w)) / (F.col("t") - F.lag("t").over(w))).alias("speed")).where("speed is not null")


STATIONARY = SPEEDS + """, p AS (SELECT s.*, f.speed AS pv, f.t AS pt FROM samples s ASOF LEFT JOIN speeds f ON s.session_id = f.session_id AND s.t >= f.t), n AS (SELECT p.*, f.speed AS nv, f.t AS nt FROM p ASOF LEFT JOIN speeds f ON p.session_id = f.session_id AND p.t <= f.t),
still AS (SELECT *, coalesce(abs(k - 50) < 30, false) AND coalesce(CASE WHEN pt IS NULL OR nt IS NULL THEN NULL WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END < 5.0, false) AS stationary FROM n)"""


def _still(spark: SparkSession, d: str) -> DataFrame:
    s = ev.samples(spark, d).withColumn("g", F.col("k") - 50)
    return calculus.stationary(s, "g", 30.0, _speeds(spark, d), 5.0)


@query(STATIONARY + " SELECT session_id, event_id, stationary FROM still")
def stationary_mask(spark, d):
    return _still(spark, d).select("session_id", "event_id", "stationary")


@query(STATIONARY + " SELECT session_id, round(median(CASE WHEN stationary THEN k - 50 END), 6) + 0.0 AS median_g, round(median(CASE WHEN stationary THEN value END), 6) + 0.0 AS median_value, count(*) FILTER (WHERE stationary) AS stationary_samples, round(avg(CAST(CAST(stationary AS INT) AS DOUBLE)), 6) + 0.0 AS stationary_fraction FROM still GROUP BY 1")
def gyro_bias_gravity_median(spark, d):
    """Gyro bias and gravity: medians over stationary samples."""
    return rounded(calculus.stationary_medians(_still(spark, d), ["g", "value"]), "median_g", "median_value", "stationary_fraction")


LAGS = [-24.0, -12.0, 0.0, 12.0, 24.0]
LAG_FITS = BASE + f""", l AS (SELECT unnest([{', '.join(map(str, LAGS))}]) AS lag), g AS (SELECT f.session_id, f.value AS goal, CAST(l.lag AS DOUBLE) AS lag, f.t + l.lag AS t FROM frames f, l),
p AS (SELECT g.*, s.value AS pv, s.t AS pt FROM g ASOF LEFT JOIN samples s ON g.session_id = s.session_id AND g.t >= s.t), n AS (SELECT p.*, s.value AS nv, s.t AS nt FROM p ASOF LEFT JOIN samples s ON p.session_id = s.session_id AND p.t <= s.t),
x AS (SELECT session_id, lag, goal, CASE WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END AS v FROM n WHERE pt IS NOT NULL AND nt IS NOT NULL),
fits AS (SELECT session_id, lag, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(v) > 0 AND var_pop(goal) > 0 THEN corr(goal, v) END AS correlation, CASE WHEN count(*) >= 3 THEN regr_slope(goal, v) END AS slope, CASE WHEN count(*) >= 3 THEN regr_intercept(goal, v) END AS intercept, CASE WHEN count(*) >= 3 THEN regr_r2(goal, v) END AS r2 FROM x GROUP BY 1, 2)"""


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return calculus.lag_fits(ev.samples(spark, d).select("session_id", "t", "value"), "value", ev.frames(spark, d).select("session_id", "t", F.col("value").alias("goal")), "goal", LAGS)


@query(LAG_FITS + " SELECT session_id, lag, n, " + q("correlation slope intercept r2", 5) + " FROM fits")
def lag_scan_fits(spark, d):
    return rounded(_fits(spark, d).select("session_id", "lag", "n", "correlation", "slope", "intercept", "r2"), "correlation", "slope", "intercept", "r2", digits=5)


@query(LAG_FITS + ", o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(abs(correlation), 9) DESC, lag) AS i FROM fits WHERE correlation IS NOT NULL) SELECT session_id, lag, n, round(correlation, 5) + 0.0 AS correlation FROM o WHERE i = 1")
def lag_scan_best_fit(spark, d):
    return calculus.best_lag(_fits(spark, d)).select("session_id", "lag", "n", r("correlation", 5).alias("correlation"))


AXES = {"a": "value", "b": "k", "c": "value * k"}
AXIS_SCORES = BASE + ", j AS (SELECT s.session_id, s.value, CAST(s.k AS DOUBLE) AS k, f.value AS gx, CAST(f.k AS DOUBLE) AS gy FROM samples s ASOF JOIN frames f ON s.session_id = f.session_id AND s.t >= f.t), scores AS (" + " UNION ALL ".join(
    f"SELECT session_id, '{target}' AS target, '{axis}' AS axis, {sign} AS sign, CASE WHEN count(*) >= 3 AND var_pop({e}) > 0 AND var_pop({goal}) > 0 THEN {sign} * corr({goal}, {e}) END AS correlation FROM j GROUP BY 1"
    for target, goal in (("x", "gx"), ("y", "gy")) for axis, e in AXES.items() for sign in (-1, 1)
) + ")"


@query(AXIS_SCORES + """, p AS (SELECT a.session_id, a.axis AS axis_x, a.sign AS sign_x, a.correlation AS corr_x, b.axis AS axis_y, b.sign AS sign_y, b.correlation AS corr_y FROM scores a JOIN scores b ON a.session_id = b.session_id AND a.target = 'x' AND b.target = 'y' AND a.axis <> b.axis),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(coalesce(corr_x, '-inf'::DOUBLE) + coalesce(corr_y, '-inf'::DOUBLE), 9) DESC, axis_x, sign_x, axis_y, sign_y) AS i FROM p)
SELECT session_id, axis_x, sign_x, axis_y, sign_y, round(corr_x, 5) + 0.0 AS corr_x, round(corr_y, 5) + 0.0 AS corr_y FROM o WHERE i = 1""")
def axis_sign_assignment(spark, d):
    """Which inertial axis, with which sign, follows each camera axis."""
    j = temporal.asof(ev.samples(spark, d), ev.frames(spark, d).select("session_id", "event_id", "t", F.col("value").alias("gx"), F.col("k").cast("double").alias("gy")), ["gx", "gy", "event_id"], tie="event_id").where("right_gx is not null")
    j = j.withColumns({a: F.expr(f"cast({e} as double)") for a, e in AXES.items()})
    wide = []
    for target, goal in (("x", "right_gx"), ("y", "right_gy")):
        for axis in AXES:
            c = calculus.correlation(axis, goal)
            wide.append(F.array(*(F.struct(F.lit(target).alias("target"), F.lit(axis).alias("axis"), F.lit(s).alias("sign"), (s * c).alias("correlation")) for s in (-1, 1))))
    scores = j.groupBy("session_id").agg(F.concat(*wide).alias("all")).select("session_id", F.inline("all"))
    return rounded(calculus.assign_axes(scores), "corr_x", "corr_y", digits=5)


@query(BASE + ", m AS (SELECT session_id, avg(value - 50) AS a, avg(k - 50) AS b, avg(value - k) AS c FROM samples GROUP BY 1) SELECT session_id, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 'a' WHEN abs(b) >= abs(c) THEN 'b' ELSE 'c' END AS axis, CAST(sign(CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN a WHEN abs(b) >= abs(c) THEN b ELSE c END) AS INTEGER) AS sign, round(CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN a WHEN abs(b) >= abs(c) THEN b ELSE c END, 6) + 0.0 AS mean FROM m")
def gravity_axis_top1(spark, d):
    s = ev.samples(spark, d).select("session_id", "event_id", (F.col("value") - 50).alias("a"), (F.col("k") - 50).alias("b"), (F.col("value") - F.col("k")).alias("c"))
    return rounded(calculus.gravity_axis(s, ["a", "b", "c"], order="event_id"), "mean")


@query(BASE + f""", e AS (SELECT session_id, t, value AS x, CAST(k AS DOUBLE) AS y, value + 1 AS vx, CAST(k AS DOUBLE) - 1 AS vy, CASE WHEN value <= {ev.DROPOUT_ABOVE} THEN value END AS m FROM frames),
s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / greatest(t - lag(t) OVER w, 1e-6) AS speed, CASE WHEN m IS NOT NULL THEN sqrt((x - vx) ** 2 + (y - vy) ** 2) END AS off FROM e WINDOW w AS (PARTITION BY session_id ORDER BY t)),
g AS (SELECT session_id, max(m) - min(m) AS cx, max(CASE WHEN m IS NOT NULL THEN y END) - min(CASE WHEN m IS NOT NULL THEN y END) AS cy, max(x) - min(x) AS fx, max(y) - min(y) AS fy, coalesce(max(speed), 0) AS max_speed, max(off) AS max_deviation, quantile_cont(off, 0.95) AS p95_deviation, count(m) AS dual_frames FROM s GROUP BY 1)
SELECT session_id, round(max_speed, 6) + 0.0 AS max_speed, round(max_deviation, 6) + 0.0 AS max_deviation, round(p95_deviation, 6) + 0.0 AS p95_deviation, dual_frames, coalesce(fx <= cx * 1.5 + 0.25 AND fy <= cy * 1.5 + 0.25 AND max_speed <= 1000 AND max_deviation <= 2 AND p95_deviation <= 2 AND dual_frames >= 1, false) AS passed FROM g""")
def safety_envelope(spark, d):
    seen = F.col("value") <= ev.DROPOUT_ABOVE
    e = ev.frames(spark, d).select("session_id", "t", F.col("value").alias("x"), F.col("k").cast("double").alias("y"), (F.col("value") + 1).alias("vx_x"), (F.col("k").cast("double") - 1).alias("vx_y"), F.when(seen, F.col("value")).alias("mx"), F.when(seen, F.col("k").cast("double")).alias("my"))
    out = calculus.safety_report(e, SafetyLimits(max_speed_mps=1000.0, max_position_deviation_m=2.0, p95_position_deviation_m=2.0))
    return rounded(out.select("session_id", "max_speed", "max_deviation", "p95_deviation", "dual_frames", "passed"), "max_speed", "max_deviation", "p95_deviation")


@query(LEDS + ", h AS (SELECT *, atan2(y2 - y1, x2 - x1) AS h FROM leds), l AS (SELECT *, lag(h) OVER w AS p, t - lag(t) OVER w AS dt FROM h WINDOW w AS (PARTITION BY session_id ORDER BY t)) SELECT session_id, event_id, round(atan2(sin(h - p), cos(h - p)) / nullif(dt, 0), 6) + 0.0 AS rate FROM l")
def angular_velocity(spark, d):
    h = led_frames(spark, d).withColumn("h", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    return rounded(cleaning.heading_rate(h, "h").select("session_id", "event_id", "rate"), "rate")


# metrics

@query(BASE + "SELECT session_id, round(sqrt(avg((value - (k + 0.5)) ** 2)), 6) + 0.0 AS rmse, count(*) AS n FROM frames WHERE value <= 60 GROUP BY 1")
def rmse(spark, d):
    f = ev.frames(spark, d).where("value <= 60").withColumn("e", F.col("k") + 0.5)
    return rounded(qa.rmse(f, [("e", "value")]), "rmse")


@query(BASE + "SELECT session_id, round(avg(abs(e)), 6) + 0.0 AS heading_mae, round(sqrt(avg(e ** 2)), 6) + 0.0 AS heading_rmse FROM (SELECT session_id, atan2(sin(k - value), cos(k - value)) AS e FROM frames) GROUP BY 1")
def heading_mae_rmse(spark, d):
    f = ev.frames(spark, d).withColumn("h", F.col("k").cast("double"))
    return rounded(qa.heading_errors(f, "value", "h"), "heading_mae", "heading_rmse")


NEES = BASE + ", e AS (SELECT session_id, event_id, value - 50 AS ex, k - 50.0 AS ey, 400 + k AS pxx, 0.5 * k AS pxy, 600.0 - k AS pyy FROM frames), n AS (SELECT *, (pyy * ex * ex - 2 * pxy * ex * ey + pxx * ey * ey) / (pxx * pyy - pxy * pxy) AS nees FROM e)"


def _nees(spark: SparkSession, d: str) -> DataFrame:
    f = ev.frames(spark, d)
    k = F.col("k")
    return f.select("session_id", "event_id", "t", qa.mahalanobis_2d(F.col("value") - 50, k - 50.0, (400 + k).cast("double"), 0.5 * k, 600.0 - k).alias("nees"))


@query(NEES + " SELECT session_id, event_id, round(nees, 6) + 0.0 AS nees FROM n")
def nees_2x2(spark, d):
    return rounded(_nees(spark, d).select("session_id", "event_id", "nees"), "nees")


_LOW, _HIGH = chi2_bounds(2)


@query(NEES + f" SELECT session_id, round(avg(nees), 6) + 0.0 AS mean, round(stddev_pop(nees), 6) + 0.0 AS std, round(min(nees), 6) + 0.0 AS min, round(max(nees), 6) + 0.0 AS max, round(CAST({_LOW!r} AS DOUBLE), 6) AS chi2_lower, round(CAST({_HIGH!r} AS DOUBLE), 6) AS chi2_upper, round(100 * avg(CASE WHEN nees BETWEEN {_LOW!r} AND {_HIGH!r} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS pct_in_bounds FROM n GROUP BY 1")
def chi2_envelope(spark, d):
    names = ("mean", "std", "min", "max", "chi2_lower", "chi2_upper", "pct_in_bounds")
    return rounded(qa.envelope_stats(_nees(spark, d), "nees", 2), *names)


@query(NEES + " SELECT CAST(CASE WHEN nees >= 6 THEN 13 ELSE floor(nees / 0.5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM n GROUP BY 1")
def nees_histogram(spark, d):
    return qa.histogram(_nees(spark, d), "nees", 0.0, 6.0, 12)


@query(BASE + ", c AS (SELECT session_id, t, event_id, value - avg(value) OVER (PARTITION BY session_id) AS c, var_samp(value) OVER (PARTITION BY session_id) AS v FROM frames), l AS (SELECT session_id, v, " + ", ".join(f"c * lag(c, {k}) OVER w AS l{k}" for k in range(1, 5)) + " FROM c WINDOW w AS (PARTITION BY session_id ORDER BY t)) " + " UNION ALL ".join(["SELECT session_id, 0 AS lag, 1.0 AS acf FROM l GROUP BY 1"] + [f"SELECT session_id, {k} AS lag, round(avg(l{k}) / nullif(any_value(v), 0), 6) + 0.0 AS acf FROM l GROUP BY 1" for k in range(1, 5)]))
def acf(spark, d):
    return rounded(qa.autocorrelation(ev.frames(spark, d), "value", 4), "acf")


RUNS = BASE + """, v AS (SELECT session_id, t, value, value <= 40 AS ok FROM frames), c AS (SELECT *, CASE WHEN ok IS NOT DISTINCT FROM lag(ok) OVER w THEN 0 ELSE 1 END AS ch, lead(t) OVER w AS nt FROM v WINDOW w AS (PARTITION BY session_id ORDER BY t)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY session_id ORDER BY t) AS run, median(nt - t) OVER (PARTITION BY session_id) AS sdt FROM c), h AS (SELECT *, max(t) OVER (PARTITION BY session_id, run) AS rl FROM g),
runs AS (SELECT session_id, run, min(t) AS start_t, max(t) AS end_t, count(*) AS n, arg_max(nt, t) AS after_t, bool_or(t = rl AND nt IS NULL) AS tail, median(CASE WHEN nt <= rl THEN nt - t END) AS own, any_value(sdt) AS sdt FROM h WHERE NOT ok GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN NOT tail THEN after_t - start_t WHEN n >= 2 THEN end_t - start_t + own ELSE coalesce(sdt, 0) END AS duration FROM runs)"""


@query(RUNS + " SELECT session_id, round(start_t, 6) + 0.0 AS start_t, round(end_t, 6) + 0.0 AS end_t, n, round(duration, 6) + 0.0 AS duration FROM d")
def dropout_islands(spark, d):
    f = ev.frames(spark, d).withColumn("ok", F.col("value") <= 40)
    return rounded(qa.dropout_runs(f, "ok"), "start_t", "end_t", "duration")


@query(RUNS + ", o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_t) AS i FROM d WHERE duration >= 48) SELECT o.session_id, round(duration, 6) + 0.0 AS duration, round(b.value - a.value, 6) + 0.0 AS drift FROM o JOIN v a ON a.session_id = o.session_id AND a.t = o.start_t JOIN v b ON b.session_id = o.session_id AND b.t = o.end_t WHERE i = 1")
def dropout_drift(spark, d):
    """The first dropout of two days or more: how far the error grew."""
    f = ev.frames(spark, d).withColumn("ok", F.col("value") <= 40)
    return rounded(qa.dropout_drift(f, "ok", "value", 48.0).select("session_id", "duration", "drift"), "duration", "drift")


@query(BASE + ", a AS (SELECT session_id, value / 20 AS a FROM frames) SELECT session_id, round(atan2(avg(sin(a)), avg(cos(a))), 6) + 0.0 AS mean_angle, round(sqrt(greatest(-2 * ln(least(sqrt(avg(sin(a)) ** 2 + avg(cos(a)) ** 2), 1.0)), 0.0)), 6) + 0.0 AS circular_std, round(avg(abs(atan2(sin(a), cos(a)))), 6) + 0.0 AS mean_abs, round(median(abs(atan2(sin(a), cos(a)))), 6) + 0.0 AS median_abs FROM a GROUP BY 1")
def circular_stats(spark, d):
    return rounded(qa.circular_stats(ev.frames(spark, d), F.col("value") / 20), "mean_angle", "circular_std", "mean_abs", "median_abs")


@query(NEES + ", m AS (SELECT *, (pxx + pyy) / 2 AS mid, sqrt(((pxx - pyy) / 2) ** 2 + pxy ** 2) AS half FROM n) SELECT session_id, event_id, round(4 * sqrt(greatest(mid + half, 0.0)), 6) + 0.0 AS width, round(4 * sqrt(greatest(mid - half, 0.0)), 6) + 0.0 AS height, round(0.5 * atan2(2 * pxy, pxx - pyy), 6) + 0.0 AS tilt, round(100 * sqrt(pxx + pyy), 6) + 0.0 AS std_cm FROM m")
def cov_ellipse_2x2(spark, d):
    k = F.col("k")
    pxx, pxy, pyy = (400 + k).cast("double"), 0.5 * k, 600.0 - k
    parts = qa.covariance_ellipse(pxx, pxy, pyy) | {"std_cm": qa.position_std_cm(pxx, pyy)}
    return ev.frames(spark, d).select("session_id", "event_id", *(r(c).alias(n) for n, c in parts.items()))


@query(BASE + ", w AS (SELECT *, sqrt((lead(value) OVER o - 2 * value + lag(value) OVER o) ** 2 + (lead(k) OVER o - 2 * k + lag(k) OVER o) ** 2) AS s FROM frames WINDOW o AS (PARTITION BY session_id ORDER BY t)) SELECT session_id, round(sqrt(avg(1.0 + 4.0)), 6) + 0.0 AS rmse_a, round(sqrt(avg(0.25 + 0.0)), 6) + 0.0 AS rmse_b, round(avg(s), 6) + 0.0 AS roughness_a, round(avg(s), 6) + 0.0 AS roughness_b FROM w GROUP BY 1")
def mode_comparison(spark, d):
    v, k = F.col("value"), F.col("k").cast("double")
    f = ev.frames(spark, d).select("session_id", "t", v.alias("mx"), k.alias("my"), (v + 1).alias("ax"), (k - 2).alias("ay"), (v - 0.5).alias("bx"), k.alias("by_"))
    return rounded(qa.mode_comparison(f), "rmse_a", "rmse_b", "roughness_a", "roughness_b")


# geometry

def _quaternions(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(8)))
    q0 = geometry.normalize(tuple(F.col(f"e{i}") for i in range(4)))
    return v.select("*", *(c.alias(n) for c, n in zip(q0, ("w", "x", "y", "z"), strict=True)))


QUAT = "WITH e AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(8)) + " FROM embeddings), n AS (SELECT *, sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) AS s FROM e), q AS (SELECT *, e0 / s AS w, e1 / s AS x, e2 / s AS y, e3 / s AS z FROM n)"


def _q() -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(c) for c in "wxyz")


@query(QUAT + " SELECT vec_id, round(w * e4 - x * e5 - y * e6 - z * e7, 6) + 0.0 AS pw, round(w * e5 + e4 * x + y * e7 - z * e6, 6) + 0.0 AS px, round(w * e6 + e4 * y + z * e5 - x * e7, 6) + 0.0 AS py, round(w * e7 + e4 * z + x * e6 - y * e5, 6) + 0.0 AS pz FROM q")
def quaternion_multiply(spark, d):
    p = geometry.multiply(_q(), tuple(F.col(f"e{i}") for i in range(4, 8)))
    return _quaternions(spark, d).select("vec_id", *(r(c).alias(n) for c, n in zip(p, ("pw", "px", "py", "pz"), strict=True)))


@query(QUAT + " SELECT vec_id, round(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 6) + 0.0 AS roll, round(asin(greatest(-1, least(1, 2 * (w * y - z * x)))), 6) + 0.0 AS pitch, round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) + 0.0 AS yaw FROM q")
def quaternion_to_rpy(spark, d):
    return _quaternions(spark, d).select("vec_id", *(r(c).alias(n) for c, n in zip(geometry.euler(_q()), ("roll", "pitch", "yaw"), strict=True)))


@query(QUAT + " SELECT vec_id, round((1 - 2 * (y * y + z * z)) * e4 + 2 * (x * y - w * z) * e5 + 2 * (x * z + w * y) * e6, 6) + 0.0 AS vx, round(2 * (x * y + w * z) * e4 + (1 - 2 * (x * x + z * z)) * e5 + 2 * (y * z - w * x) * e6, 6) + 0.0 AS vy, round(2 * (x * z - w * y) * e4 + 2 * (y * z + w * x) * e5 + (1 - 2 * (x * x + y * y)) * e6, 6) + 0.0 AS vz FROM q")
def rotate_vector(spark, d):
    v = geometry.rotate(_q(), tuple(F.col(f"e{i}") for i in range(4, 7)))
    return _quaternions(spark, d).select("vec_id", *(r(c).alias(n) for c, n in zip(v, ("vx", "vy", "vz"), strict=True)))


@query("WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS ex, s_acctbal / 1000 AS ey, CAST(s_suppkey % 7 AS DOUBLE) AS rx, CAST(s_suppkey % 5 AS DOUBLE) AS ry, 0.5 AS sg FROM supplier), l AS (SELECT *, sqrt((rx - ex) ** 2 + (ry - ey) ** 2) AS len FROM s), u AS (SELECT *, coalesce((rx - ex) / nullif(len, 0), 1) AS ux, coalesce((ry - ey) / nullif(len, 0), 0) AS uy, CASE WHEN len > 0 THEN greatest(sg, len / sqrt(12)) ** 2 ELSE sg * sg END AS al FROM l) SELECT s_suppkey, round((ex + rx) / 2, 6) + 0.0 AS anchor_x, round((ey + ry) / 2, 6) + 0.0 AS anchor_y, round(al * ux * ux + sg * sg * uy * uy, 6) + 0.0 AS cov_xx, round((al - sg * sg) * ux * uy, 6) + 0.0 AS cov_xy, round(al * uy * uy + sg * sg * ux * ux, 6) + 0.0 AS cov_yy FROM u")
def beam_source_geometry(spark, d):
    """Anchors and covariances of beams between points made of supplier rows."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    fix = geometry.beam_fix(F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 1000, (F.col("s_suppkey") % 7).cast("double"), (F.col("s_suppkey") % 5).cast("double"), F.lit(0.5))
    return s.select("s_suppkey", *(r(c).alias(n) for n, c in fix.items()))


def _path(spark: SparkSession, d: str) -> DataFrame:
    return ev.frames(spark, d).select("session_id", "t", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


BEAMS, DISCS = "(CAST(10 AS BIGINT), 50.5, -1.0, 50.5, 60.0, 'fall'), (CAST(11 AS BIGINT), 0.0, 30.5, 200.0, 30.5, 'rise')", "(CAST(20 AS BIGINT), 50.0, 50.0, 25.0, 'rise'), (CAST(21 AS BIGINT), 10.0, 20.0, 15.0, 'rise')"
STEPS = BASE + ", st AS (SELECT session_id, t, value AS x, CAST(k AS DOUBLE) AS y, lead(t) OVER w AS t1, lead(value) OVER w AS x1, lead(CAST(k AS DOUBLE)) OVER w AS y1, max(t) OVER (PARTITION BY session_id) AS t_end FROM frames WINDOW w AS (PARTITION BY session_id ORDER BY t))"
BEAM_SQL = f""", bm AS (SELECT * FROM (VALUES {BEAMS}) AS b(source_id, ex, ey, rx, ry, active_edge)), b0 AS (SELECT *, (rx - ex) * (y - ey) - (ry - ey) * (x - ex) AS s0, (rx - ex) * (y1 - ey) - (ry - ey) * (x1 - ex) AS s1 FROM st, bm WHERE t1 IS NOT NULL),
b1 AS (SELECT *, s0 / (s0 - s1) AS part FROM b0 WHERE (s0 > 0 AND s1 <= 0) OR (s0 < 0 AND s1 >= 0)), b2 AS (SELECT *, ((x + part * (x1 - x) - ex) * (rx - ex) + (y + part * (y1 - y) - ey) * (ry - ey)) / nullif((rx - ex) ** 2 + (ry - ey) ** 2, 0) AS along FROM b1),
hit AS (SELECT session_id, t + part * (t1 - t) AS t, source_id, active_edge AS edge, t_end FROM b2 WHERE along BETWEEN 0 AND 1), beams AS (SELECT session_id, t, source_id, edge FROM hit UNION ALL SELECT session_id, t + 1.0, source_id, CASE WHEN edge = 'rise' THEN 'fall' ELSE 'rise' END FROM hit WHERE t + 1.0 <= t_end)"""
DISC_SQL = f""", dc AS (SELECT * FROM (VALUES {DISCS}) AS b(source_id, cx, cy, radius, active_edge)), d0 AS (SELECT *, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d0, sqrt((x1 - cx) ** 2 + (y1 - cy) ** 2) AS d1 FROM st, dc WHERE t1 IS NOT NULL),
discs AS (SELECT session_id, t + greatest(0.0, least(1.0, (radius - d0) / nullif(d1 - d0, 0))) * (t1 - t) AS t, source_id, CASE WHEN d1 <= radius THEN active_edge WHEN active_edge = 'rise' THEN 'fall' ELSE 'rise' END AS edge FROM d0 WHERE (d0 <= radius) <> (d1 <= radius))"""


def _beams(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (10L, 50.5D, -1.0D, 50.5D, 60.0D, 'fall'), (11L, 0.0D, 30.5D, 200.0D, 30.5D, 'rise') AS b(source_id, ex, ey, rx, ry, active_edge)")


def _discs(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (20L, 50.0D, 50.0D, 25.0D, 'rise'), (21L, 10.0D, 20.0D, 15.0D, 'rise') AS b(source_id, cx, cy, radius, active_edge)")


@query(STEPS + BEAM_SQL + " SELECT session_id, round(t, 6) + 0.0 AS t, source_id, edge FROM beams")
def beam_crossings(spark, d):
    return rounded(geometry.beam_events(_path(spark, d), _beams(spark), 1.0), "t")


@query(STEPS + DISC_SQL + " SELECT session_id, round(t, 6) + 0.0 AS t, source_id, edge FROM discs")
def zone_entries(spark, d):
    return rounded(geometry.radius_events(_path(spark, d), _discs(spark)), "t")


@query(STEPS + BEAM_SQL + DISC_SQL + ", al AS (SELECT * FROM beams UNION ALL SELECT * FROM discs) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY round(t, 6), source_id, edge) AS seq, round(t, 6) + 0.0 AS t, source_id, edge FROM al")
def event_union_sort(spark, d):
    """All synthetic events of a path, numbered in time order."""
    both = geometry.beam_events(_path(spark, d), _beams(spark), 1.0).unionByName(geometry.radius_events(_path(spark, d), _discs(spark)))
    w = Window.partitionBy("session_id").orderBy("t", "source_id", "edge")
    return rounded(both, "t").withColumn("seq", F.row_number().over(w).cast("long"))


@query(BASE.replace("WITH rows_", "WITH RECURSIVE rows_") + ", n AS (SELECT session_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t) AS i FROM rows_), rec AS (SELECT session_id, t, i, t AS last, true AS kept FROM n WHERE i = 1 UNION ALL SELECT n.session_id, n.t, n.i, CASE WHEN n.t - rec.last >= 12 THEN n.t ELSE rec.last END, n.t - rec.last >= 12 FROM rec JOIN n ON n.session_id = rec.session_id AND n.i = rec.i + 1) SELECT session_id, round(t, 6) + 0.0 AS t FROM rec WHERE kept")
def debounce_greedy(spark, d):
    return rounded(geometry.debounce(ev.rows(spark, d), 12.0), "t")


@query(BASE + "SELECT session_id, event_id, round(0.01 / least(greatest(k / 100.0, 0.01), 1.0), 6) + 0.0 AS variance, round(0.002 / sqrt(0.05 + k / 100.0), 6) + 0.0 AS sim_std FROM frames")
def confidence_noise(spark, d):
    """What a confidence does to the noise: in the filter, and in the simulator."""
    c = F.col("k") / 100.0
    return ev.frames(spark, d).select("session_id", "event_id", r(geometry.confidence_variance(c, 0.01)).alias("variance"), r(0.002 / F.sqrt(0.05 + c)).alias("sim_std"))


# recursive operators

def _kalman_sql(rows: str, q_: float = 0.1, r_: float = 4.0, gate: float | None = None, p0: tuple[float, float] = (10.0, 1.0)) -> str:
    """A constant-velocity filter as a recursive query over rows(session_id, event_id, t, z)."""
    use = "n.z IS NOT NULL" + (f" AND (n.z - px) ** 2 / (pxx_ + {r_}) < {gate}" if gate else "")
    pred = f"rec.x + rec.v * (n.t - rec.t) AS px, rec.pxx + 2 * (n.t - rec.t) * rec.pxv + (n.t - rec.t) * (n.t - rec.t) * rec.pvv + {q_} * (n.t - rec.t) * (n.t - rec.t) * (n.t - rec.t) / 3 AS pxx_, rec.pxv + (n.t - rec.t) * rec.pvv + {q_} * (n.t - rec.t) * (n.t - rec.t) / 2 AS pxv_, rec.pvv + {q_} * (n.t - rec.t) AS pvv_"
    return BASE.replace("WITH rows_", "WITH RECURSIVE rows_") + f""", src AS ({rows}), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS i FROM src),
rec AS (SELECT session_id, event_id, i, t, coalesce(z, 0.0) AS x, 0.0::DOUBLE AS v, {p0[0]}::DOUBLE AS pxx, 0.0::DOUBLE AS pxv, {p0[1]}::DOUBLE AS pvv, 0.0::DOUBLE AS loglik, z IS NOT NULL AS used FROM n WHERE i = 1
UNION ALL SELECT session_id, event_id, i, t, CASE WHEN u THEN px + pxx_ / (pxx_ + {r_}) * (z - px) ELSE px END, CASE WHEN u THEN v0 + pxv_ / (pxx_ + {r_}) * (z - px) ELSE v0 END, CASE WHEN u THEN pxx_ - pxx_ / (pxx_ + {r_}) * pxx_ ELSE pxx_ END, CASE WHEN u THEN pxv_ - pxx_ / (pxx_ + {r_}) * pxv_ ELSE pxv_ END, CASE WHEN u THEN pvv_ - pxv_ / (pxx_ + {r_}) * pxv_ ELSE pvv_ END,
 CASE WHEN u THEN -0.5 * (ln(2 * pi() * (pxx_ + {r_})) + (z - px) ** 2 / (pxx_ + {r_})) ELSE 0.0 END, u FROM (SELECT *, {use.replace('n.', '')} AS u FROM (SELECT n.session_id, n.event_id, n.i, n.t, n.z, rec.v AS v0, {pred} FROM rec JOIN n ON n.session_id = rec.session_id AND n.i = rec.i + 1)))"""


_FRAMES_Z = "SELECT session_id, event_id, t, value AS z FROM frames"
_GAPPY_Z = f"SELECT session_id, event_id, t, CASE WHEN value <= {ev.DROPOUT_ABOVE} THEN value END AS z FROM rows_ WHERE event_type IN ('view', 'click')"


def frames_z(spark: SparkSession, d: str) -> DataFrame:
    return ev.frames(spark, d).withColumnRenamed("value", "z")


@query(_kalman_sql(_FRAMES_Z) + " SELECT session_id, event_id, " + q("x v pxx pxv pvv", 4) + " FROM rec")
def kalman_cv_filter(spark, d):
    out = filters.kalman_1d(frames_z(spark, d), filters.LinearKalman())
    return rounded(out.select("session_id", "event_id", "x", "v", "pxx", "pxv", "pvv"), "x", "v", "pxx", "pxv", "pvv", digits=4)


@query(_kalman_sql(_GAPPY_Z, gate=11.618) + " SELECT session_id, event_id, " + q("x pxx", 4) + ", used FROM rec")
def kalman_gated(spark, d):
    """Frames and samples together, large values missing, outliers gated."""
    z = ev.rows(spark, d).where("event_type in ('view', 'click')").withColumn("z", F.when(F.col("value") <= ev.DROPOUT_ABOVE, F.col("value")))
    return rounded(filters.kalman_1d(z, filters.LinearKalman(gate=11.618)).select("session_id", "event_id", "x", "pxx", "used"), "x", "pxx", digits=4)


@query(_kalman_sql(_FRAMES_Z) + " SELECT session_id, round(sum(loglik), 3) + 0.0 AS loglik, count(*) FILTER (WHERE used) AS n_used FROM rec GROUP BY 1")
def kalman_loglik(spark, d):
    out = filters.kalman_1d(frames_z(spark, d), filters.LinearKalman())
    return out.groupBy("session_id").agg(r(F.sum("loglik"), 3).alias("loglik"), F.count_if("used").alias("n_used"))


#: Of a filter's rows: an update leaves pxx = p r / (p + r), so the innovation's variance is r^2 / (r - pxx), and the log-likelihood holds the rest.
NIS = _kalman_sql(_FRAMES_Z) + ", n_ AS (SELECT session_id, event_id, -2 * loglik - ln(2 * pi() * 16.0 / (4.0 - pxx)) AS nis FROM rec WHERE used AND loglik <> 0)"
_LOW_1, _HIGH_1 = chi2_bounds(1)


def _nis(spark: SparkSession, d: str) -> DataFrame:
    out = filters.kalman_1d(frames_z(spark, d), filters.LinearKalman()).where("used and loglik <> 0")
    return out.select("session_id", "event_id", (-2 * F.col("loglik") - F.ln(2 * F.pi() * 16.0 / (4.0 - F.col("pxx")))).alias("nis"))


@query(NIS + f" SELECT session_id, round(avg(nis), 4) + 0.0 AS mean, round(stddev_pop(nis), 4) + 0.0 AS std, round(min(nis), 4) + 0.0 AS min, round(max(nis), 4) + 0.0 AS max, round(CAST({_LOW_1!r} AS DOUBLE), 4) AS chi2_lower, round(CAST({_HIGH_1!r} AS DOUBLE), 4) AS chi2_upper, round(100 * avg(CASE WHEN nis BETWEEN {_LOW_1!r} AND {_HIGH_1!r} THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS pct_in_bounds FROM n_ GROUP BY 1")
def nis_stats(spark, d):
    """Squared innovations over their variance against the chi-square envelope of one dimension."""
    return rounded(qa.envelope_stats(_nis(spark, d), "nis", 1), "mean", "std", "min", "max", "chi2_lower", "chi2_upper", "pct_in_bounds", digits=4)


@query(NIS + " SELECT CAST(CASE WHEN nis >= 6 THEN 13 WHEN nis < 0 THEN 0 ELSE floor(nis / 0.5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM n_ GROUP BY 1")
def nis_histogram(spark, d):
    return qa.histogram(_nis(spark, d), "nis", 0.0, 6.0, 12)


_EVENTS_Z = "SELECT session_id, event_id, t, value AS z FROM frames UNION ALL SELECT e.session_id, e.event_id, e.t, CASE WHEN e.edge = s.active_edge THEN s.ax END AS z FROM triggers e JOIN sources s USING (source_id)"


@query(_kalman_sql(_EVENTS_Z) + " SELECT session_id, event_id, " + q("x v", 4) + ", used FROM rec")
def kalman_with_events(spark, d):
    """Active trigger events fix the position at their source's anchor; inactive ones only predict."""
    e = ev.triggers(spark, d).join(F.broadcast(ev.sources(spark)), "source_id")
    z = F.when(F.col("edge") == F.col("active_edge"), F.get("anchor", F.lit(0)))
    both = frames_z(spark, d).select("session_id", "event_id", "t", "z").unionByName(e.select("session_id", "event_id", "t", z.alias("z")))
    return rounded(filters.kalman_1d(both, filters.LinearKalman()).select("session_id", "event_id", "x", "v", "used"), "x", "v", digits=4)


@query(_kalman_sql(_FRAMES_Z) + """, fw AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY i) - t AS dt, max(i) OVER (PARTITION BY session_id) AS m FROM rec),
a AS (SELECT *, pxx + 2 * dt * pxv + dt * dt * pvv + 0.1 * dt ** 3 / 3 AS a, pxv + dt * pvv + 0.1 * dt ** 2 / 2 AS b, pvv + 0.1 * dt AS c FROM fw),
g AS (SELECT *, ((pxx + dt * pxv) * c - pxv * b) / (a * c - b * b) AS g11, (pxv * a - (pxx + dt * pxv) * b) / (a * c - b * b) AS g12, ((pxv + dt * pvv) * c - pvv * b) / (a * c - b * b) AS g21, (pvv * a - (pxv + dt * pvv) * b) / (a * c - b * b) AS g22 FROM a),
bw AS (SELECT session_id, event_id, i, x AS xs, v AS vs FROM g WHERE i = m UNION ALL SELECT g.session_id, g.event_id, g.i, g.x + g11 * (bw.xs - (g.x + dt * g.v)) + g12 * (bw.vs - g.v), g.v + g21 * (bw.xs - (g.x + dt * g.v)) + g22 * (bw.vs - g.v) FROM bw JOIN g ON g.session_id = bw.session_id AND g.i = bw.i - 1)
SELECT session_id, event_id, round(xs, 3) + 0.0 AS xs, round(vs, 3) + 0.0 AS vs FROM bw""")
def rts_smoother_cv(spark, d):
    out = filters.kalman_1d(frames_z(spark, d), filters.LinearKalman(), smooth=True)
    return rounded(out.select("session_id", "event_id", "xs", "vs"), "xs", "vs", digits=3)


@query(LEDS.replace("WITH rows_", "WITH RECURSIVE rows_") + """, du AS (SELECT * , row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS i FROM leds WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL),
st AS (SELECT session_id, event_id, t, i, 0 AS s, x1, y1, x2, y2 FROM du UNION ALL SELECT session_id, event_id, t, i, 1, x2, y2, x1, y1 FROM du),
mv AS (SELECT b.session_id, b.i, a.s AS s0, b.s AS s1, CASE WHEN a.s <> b.s THEN 10.0 ELSE 0.0 END + ((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2 + (a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) / greatest(20.0 * dt, 0.02) ** 2
 + CASE WHEN sp > 20 THEN (sp / 20 - 1) ** 2 ELSE 0 END + (atan2(sin(hb - ha), cos(hb - ha)) / 0.75) ** 2 AS c FROM (SELECT b.*, greatest(b.t - a.t, 1e-6) AS dt, sqrt(((b.x1 + b.x2 - a.x1 - a.x2) / 2) ** 2 + ((b.y1 + b.y2 - a.y1 - a.y2) / 2) ** 2) / greatest(b.t - a.t, 1e-6) AS sp, atan2(a.y2 - a.y1, a.x2 - a.x1) AS ha, atan2(b.y2 - b.y1, b.x2 - b.x1) AS hb, a AS a, b AS b FROM st a JOIN st b ON a.session_id = b.session_id AND b.i = a.i + 1)),
w AS (SELECT session_id, i, max(CASE WHEN s0 = 0 AND s1 = 0 THEN c END) AS c00, max(CASE WHEN s0 = 1 AND s1 = 0 THEN c END) AS c10, max(CASE WHEN s0 = 0 AND s1 = 1 THEN c END) AS c01, max(CASE WHEN s0 = 1 AND s1 = 1 THEN c END) AS c11 FROM mv GROUP BY 1, 2),
fw AS (SELECT session_id, i, 0.0::DOUBLE AS k0, 'inf'::DOUBLE AS k1, 0 AS b0, 0 AS b1 FROM du WHERE i = 1 UNION ALL SELECT w.session_id, w.i, least(k0 + c00, k1 + c10), least(k0 + c01, k1 + c11), CASE WHEN k1 + c10 < k0 + c00 THEN 1 ELSE 0 END, CASE WHEN k1 + c11 < k0 + c01 THEN 1 ELSE 0 END FROM fw JOIN w ON w.session_id = fw.session_id AND w.i = fw.i + 1),
bk AS (SELECT f.session_id, f.i, CASE WHEN k1 < k0 THEN 1 ELSE 0 END AS s, b0, b1 FROM fw f JOIN (SELECT session_id, max(i) AS m FROM fw GROUP BY 1) x ON x.session_id = f.session_id AND f.i = x.m UNION ALL SELECT f.session_id, f.i, CASE WHEN bk.s = 1 THEN bk.b1 ELSE bk.b0 END, f.b0, f.b1 FROM bk JOIN fw f ON f.session_id = bk.session_id AND f.i = bk.i - 1)
SELECT du.session_id, du.event_id, bk.s = 1 AS swapped FROM bk JOIN du ON du.session_id = bk.session_id AND du.i = bk.i""")
def led_identity_viterbi(spark, d):
    """Labels of the dual frames."""
    out = filters.correct_identity(led_frames(spark, d), LedIdentityConfig(max_speed_mps=20.0, initial_state="original"))
    return out.where(cleaning.dual_mask()).select("session_id", "event_id", "swapped")


# full filters on all sessions of events: no SQL; tests hold the kernels to closed forms and acceptance thresholds on simulated sessions

SESSIONS, SECONDS = 8, 4.0


def _ascending(df: DataFrame) -> DataFrame:
    """Rows of one session and time in the order of events, so little apart that they don't pass others."""
    w = Window.partitionBy("session_id", "t").orderBy("event_id")
    return df.withColumn("t", F.col("t") + (F.row_number().over(w) - 1) * F.lit(1e-11))


def _inertial(spark: SparkSession, d: str) -> DataFrame:
    """Samples in SI units: the value turns about z, k is the first axis' acceleration, as in scan_project_si; level otherwise."""
    z = F.lit(0.0)
    gz, ax = F.col("value") * F.lit(0.061 * 0.017453292519943295), -F.col("k") * F.lit(0.000061 * 9.80665)
    return _ascending(ev.samples(spark, d)).select("session_id", "t", z.alias("gx"), z.alias("gy"), gz.alias("gz"), ax.alias("ax"), z.alias("ay"), F.lit(simulate.GRAVITY).alias("az"))


def _tracked(spark: SparkSession, d: str, mode: str, **options) -> DataFrame:
    samples, frames = _inertial(spark, d), _ascending(led_frames(spark, d))
    cfg = FilterConfig.vision_only() if mode == "vision_only" else FilterConfig(state_mode=mode)
    out = filters.track(samples, frames, cfg, **options)
    mean = "smoothed_mean" if options.get("smooth") else "mean"
    place = lambda i: F.get(mean, F.lit(i))
    return out.select("session_id", "frame", r(place(0)).alias("x"), r(place(1)).alias("y"), r(place(cfg.layout.heading[0])).alias("heading"), r("loglik", 3).alias("loglik"), "vision")


@query()
def ekf_2d_full(spark, d):
    return _tracked(spark, d, "2d_full")


@query()
def ekf_3d_imu(spark, d):
    return _tracked(spark, d, "2d_cam_3d_imu")


@query()
def ekf_vision_only(spark, d):
    return _tracked(spark, d, "vision_only")


@query()
def ekf_quaternion(spark, d):
    return _tracked(spark, d, "2d_cam_6dof_imu_orientation")


@query()
def ukf_2d_full(spark, d):
    return _tracked(spark, d, "2d_full", unscented=True)


@query()
def rts_smoother_2d(spark, d):
    return _tracked(spark, d, "2d_full", smooth=True)


@query()
def sigma_point_smoother_2d(spark, d):
    return _tracked(spark, d, "2d_full", unscented=True, smooth=True)


@query()
def ekf_3d(spark, d):
    led = lambda x, y: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.array(x, y, F.lit(0.0)))
    frames = _ascending(led_frames(spark, d)).select("session_id", "t", F.array(led("x1", "y1"), led("x2", "y2")).alias("leds"))
    out = filters.track_3d(_inertial(spark, d), frames, simulate.OFFSETS_3D, FilterConfig(state_mode="3d_cam_6dof_imu"))
    return out.select("session_id", "frame", *(r(F.get("mean", F.lit(i))).alias(c) for i, c in enumerate("xyz")), "vision")


@query()
def orientation_filter(spark, d):
    """Two frames with both LEDs give camera headings; sessions with fewer go without."""
    frames = _ascending(led_frames(spark, d)).withColumn("dual", F.count_if(cleaning.dual_mask()).over(Window.partitionBy("session_id"))).where("dual >= 2").drop("dual")
    out = filters.orient(_inertial(spark, d), OrientationConfig(gyro_norm_threshold_rad_s=1.0), frames)
    return rounded(out.select("session_id", "t", "roll", "pitch", "yaw", "bias_z"), "t", "roll", "pitch", "yaw", "bias_z")


@query()
def camera_body_acceleration(spark, d):
    """Acceleration of the LED pair in the body's frame, from smoothed positions and headings."""
    return rounded(calibration.body_acceleration(_ascending(led_frames(spark, d))), "t", "abx", "aby")


@query()
def imu_calibration(spark, d):
    """Every session's inertial calibration, the gate it fails, and its report as text."""
    out = calibration.verdicts(calibration.calibrate(_inertial(spark, d), _ascending(led_frames(spark, d)), gyro_limit=1.0, speed_limit=500.0, sigma_s=2.0, lags=np.linspace(-24.0, 24.0, 9)), CalibrationGates(), True, True)
    return out.withColumn("text", calibration.report_text())


@query()
def simulate_rat(spark, d):
    samples, _ = simulate.rat(spark, SESSIONS, SECONDS)
    return samples


# streams, over the whole events table as it is now

def _events(spark: SparkSession, d: str) -> DataFrame:
    return streams.event_stream(spark, f"{d}/events.parquet")


@query(_kalman_sql(_FRAMES_Z) + " SELECT session_id, event_id, " + q("x v", 4) + " FROM rec")
def stream_kalman_cv(spark, d):
    """The constant-velocity filter as a stateful stream; equals the batch filter."""
    e = _events(spark, d).where("event_type = 'view'")
    t = (F.unix_micros("ts") - F.lit(ev.EPOCH_US)) / F.lit(3.6e9)
    out = streams.drain(streams.stream_kalman(e.select(F.col("user_id").alias("session_id"), "event_id", t.alias("t"), F.col("value").alias("z")), filters.LinearKalman()), "kalman")
    return rounded(out.select("session_id", "event_id", "x", "v"), "x", "v", digits=4)


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total, max(value) AS largest FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    """Tumbling days with a watermark."""
    out = streams.drain(streams.windowed_counts(_events(spark, d)), "windows", "complete")
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", r("total", 4).alias("total"), "largest")


@query("WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM l) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS end_us, count(*) AS n FROM s GROUP BY user_id, i")
def stream_session_window(spark, d):
    out = streams.drain(streams.session_windows(_events(spark, d)), "sessions", "complete")
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
