"""Registered queries of the time helpers (O-64, O-65, O-67, O-68, O-76) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow import functions as lf
from ledgerflow.plans.registry import register

_ZONE = "Asia/Jakarta"


@register("local_times", ["events_raw"], f"""
, e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts,
               (CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE '{_ZONE}' AS local_ts FROM events_raw)
SELECT event_id, local_ts, (ts AT TIME ZONE '{_ZONE}') AT TIME ZONE 'UTC' AS utc_ts,
       strftime(local_ts, '%Y-%m-%d') AS local_date, strftime(local_ts, '%Y-%m-%d %H:%M:%S') AS local_text,
       strftime(local_ts, '%d/%m/%Y %H.%M') AS local_custom, date_trunc('day', ts) AS day_start,
       date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS day_end
FROM e
""")
def local_times(fx):
    """O-64, O-65, O-67, O-68: zone changes, formats and day bounds of every event time."""
    ts = F.col("ts").cast("timestamp_ntz")
    return fx["events_raw"].select(
        "event_id", lf.to_local(ts, _ZONE).alias("local_ts"), lf.to_utc(ts, _ZONE).alias("utc_ts"),
        lf.format_date(ts, _ZONE).alias("local_date"), lf.format_datetime(ts, _ZONE).alias("local_text"),
        lf.format_datetime(ts, _ZONE, "dd/MM/yyyy HH.mm").alias("local_custom"),
        lf.start_of_day(ts).cast("timestamp_ntz").alias("day_start"), lf.end_of_day(ts).alias("day_end"))


@register("iso_times", ["events_raw"], """
SELECT event_id, CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS TIMESTAMP) AS parsed FROM events_raw
""")
def iso_times(fx):
    """O-76: ISO text with a T, read back as a time; text that is none gives NULL."""
    text = F.when(F.col("event_id") % 11 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return fx["events_raw"].select("event_id", lf.parse_iso(text).alias("parsed"))
