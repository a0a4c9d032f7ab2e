"""The canonical streams: adapters from the test tables, and the same as SQL for the oracles.

An edge stream has (seq, t, src, dst, weight, label): seq is a unique total order, t an integer tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import with_scalars

HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 as written, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def events_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, us (microseconds since the first event), clock (whole seconds of it), user_id, event_type, value, key."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), micros("ts").alias("us_abs"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("key"))
    timed = with_scalars(ev, us_min=F.min("us_abs")).withColumn("us", F.col("us_abs") - F.col("us_min"))
    return timed.select("seq", "us", F.expr("us div 1000000").alias("clock"), "user_id", "event_type", "value", "key")


def events_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users to keys, by the hour; an error is the label."""
    return events_clock(spark, sf_dir).select(
        "seq",
        F.expr(f"us div {HOUR_US} + 1").alias("t"),
        F.col("user_id").cast("string").alias("src"),
        F.col("key").alias("dst"),
        F.lit(1.0).alias("weight"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        "clock",
    )


def events_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's session as a log of places: seq, stream_id, clock, path, label."""
    return events_clock(spark, sf_dir).select("seq", F.col("user_id").alias("stream_id"), "clock", F.col("event_type").alias("path"), (F.col("event_type") == "error").cast("int").alias("label"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, path: the url after its scheme."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.regexp_replace("url", "^[a-z]+://", "/").alias("path"))


def lineitem_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to parts, one row a line item (without a key of its own)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("u"), F.col("l_partkey").cast("long").alias("v"))


EV = f"""clocked AS (SELECT event_id AS seq, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS us, user_id, event_type, value,
  json_extract_string(props, '$.k') AS key FROM events),
ev AS (SELECT seq, us // {HOUR_US} + 1 AS t, CAST(user_id AS VARCHAR) AS src, key AS dst, 1.0 AS weight,
  CAST(event_type = 'error' AS INTEGER) AS label, us // 1000000 AS clock FROM clocked),
paths AS (SELECT seq, user_id AS stream_id, us // 1000000 AS clock, event_type AS path, CAST(event_type = 'error' AS INTEGER) AS label FROM clocked)"""

URL = "urls AS (SELECT page_id AS seq, regexp_replace(url, '^[a-z]+://', '/') AS path FROM pages)"
LI = "li AS (SELECT CAST(l_suppkey AS BIGINT) AS u, CAST(l_partkey AS BIGINT) AS v FROM lineitem)"
