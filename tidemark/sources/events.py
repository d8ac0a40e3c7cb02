"""The driver's tables as sensor streams.

``events`` holds many sessions (users).  Views are camera frames, clicks
inertial samples, sign-ups rising and errors falling trigger edges; k of the
JSON props is a second channel and, modulo 5, the trigger's source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.config import EventSource

#: Microseconds of 2024-01-01, where session clocks start.
EPOCH_US = 1_704_067_200_000_000
DROPOUT_ABOVE = 120.0

#: Sources of the trigger events; id 4 is left unknown.
SOURCES = (
    EventSource.beam(0, (0.0, 0.0), (100.0, 0.0), 1.0, "rise"),
    EventSource.zone(1, (50.0, 2.0), 5.0, "rise"),
    EventSource.rfid(2, (80.0, 3.0), 4.0, "fall"),
    EventSource.zone(3, (20.0, 1.0), 3.0, "fall"),
)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_id, t (hours), event_type, value, k."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)) / F.lit(3.6e9)
    return e.select(F.col("user_id").alias("session_id"), "event_id", t.alias("t"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where("event_type = 'view'").drop("event_type")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where("event_type = 'click'").drop("event_type")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_id, t, source_id, edge."""
    r = rows(spark, sf_dir).where("event_type in ('signup', 'error')")
    return r.select("session_id", "event_id", "t", (F.col("k") % 5).alias("source_id"), F.when(F.col("event_type") == "signup", "rise").otherwise("fall").alias("edge"))


def sources(spark: SparkSession, listed: tuple[EventSource, ...] = SOURCES) -> DataFrame:
    """The source dimension; a hand-written list, small by nature."""
    values = ", ".join(f"({s.source_id}L, '{s.kind}', '{s.active_edge}', array({', '.join(f'{a!r}D' for a in s.anchor)}), array({', '.join(f'{c!r}D' for c in s.cov)}))" for s in listed)
    return spark.sql(f"SELECT * FROM VALUES {values} AS s(source_id, kind, active_edge, anchor, cov)")


#: The same views for DuckDB.
SQL = f"""
WITH rows_ AS (SELECT user_id AS session_id, event_id, (epoch_us(ts) - {EPOCH_US}) / 3.6e9 AS t, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
frames AS (SELECT session_id, event_id, t, value, k FROM rows_ WHERE event_type = 'view'),
samples AS (SELECT session_id, event_id, t, value, k FROM rows_ WHERE event_type = 'click'),
triggers AS (SELECT session_id, event_id, t, k % 5 AS source_id, CASE WHEN event_type = 'signup' THEN 'rise' ELSE 'fall' END AS edge FROM rows_ WHERE event_type IN ('signup', 'error')),
sources AS (SELECT * FROM (VALUES {', '.join(f"(CAST({s.source_id} AS BIGINT), '{s.kind}', '{s.active_edge}', CAST({s.anchor[0]!r} AS DOUBLE), CAST({s.anchor[1]!r} AS DOUBLE))" for s in SOURCES)}) AS s(source_id, kind, active_edge, ax, ay))
"""
