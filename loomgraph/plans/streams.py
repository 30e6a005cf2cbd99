"""The events table as a stream, drained once, against the same result in batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.queries import query, table
from loomgraph.streaming import streams as S


def _folder(spark) -> str:
    from loomgraph.storage import shared_folder

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    schema = table(spark, d, "events").schema
    stream = S.read_table_stream(spark, f"{d}/events.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = S.drain_latest(S.tumbling(_events(spark, d), "ts", "1 day", ["event_type"], "60 days"), _folder(spark), ["start", "event_type"])
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT w AS \"start\", count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY w")
def stream_sliding(spark, d):
    return S.drain_latest(S.sliding(_events(spark, d), "ts", "12 hours", "6 hours", "60 days"), _folder(spark), ["start"])


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def session_windows(spark, d):
    return S.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


@query("SELECT event_id FROM events")
def stream_dedup(spark, d):
    folder = _folder(spark)
    e = _events(spark, d)
    S.drain(S.deduplicated(e, "event_id", "ts", "60 days").select("event_id"), folder)
    return spark.read.parquet(f"{folder}/data")


@query("SELECT user_id, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY user_id")
def stream_stateful(spark, d):
    out = S.drain_latest(S.running_totals(_events(spark, d).where("value IS NOT NULL OR value IS NULL").na.fill(0.0, ["value"]), "user_id"), _folder(spark), ["user_id"])
    return out.select("user_id", "n", F.round("top", 6).alias("top"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_valid(props)")
def stream_decode(spark, d):
    folder = _folder(spark)
    decoded = S.decode(_events(spark, d), "k BIGINT", "props").where("ok").select("event_id", F.col("data.k").alias("k"))
    S.drain(decoded, folder)
    return spark.read.parquet(f"{folder}/data")
