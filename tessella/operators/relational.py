"""Relational and event operations beside the document ones: dedup of rows, sessions, latest per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by one aggregation rather than a sorted window."""
    packed = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(packed.alias("r")).select("r.*")


def sessions(events: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """Sessions of each key: events less than the gap apart, to the microsecond."""
    w = W.partitionBy(key).orderBy(F.asc_nulls_last(ts))
    at, before = F.col(ts), F.lag(ts).over(w)
    if isinstance(events.schema[ts].dataType, TimestampNTZType):  # whatever the session's time zone
        apart = at - before >= F.make_dt_interval(mins=F.lit(gap_minutes))
    else:
        apart = F.unix_micros(at.cast("timestamp")) - F.unix_micros(before.cast("timestamp")) >= gap_minutes * 60_000_000
    started = F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(w)
    return events.withColumn("session", started).groupBy(key, "session").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )


def hourly(events: DataFrame, ts: str, *keys: str, value: Column) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")
    )
