"""Queries over streams: each replays a table as a stream and is checked like its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redlake.operators import delivery
from redlake.operators import events as ev
from redlake.streaming import streams

from .aggregates import _CHANGES, _PRESENCE
from .base import Inputs, query
from .joins import _ERRORS


@query("stream_change_detect", _CHANGES + " SELECT key, run, change FROM d", "captures")
def stream_change_detect(x: Inputs) -> DataFrame:
    return streams.drained(streams.detect_changes(streams.replay(x.spark, x.captures, "run")), "changes")


@query("stream_presence", _PRESENCE + " SELECT key, run + 2 AS run, 'document_removed' AS kind FROM s WHERE coalesce(nr, mr + 1) - run > 2 UNION ALL SELECT key, nr, 'document_restored' FROM s WHERE nr - run > 2", "captures")
def stream_presence(x: Inputs) -> DataFrame:
    return streams.presence_by_runs(streams.replay(x.spark, x.captures, "run"))


@query("stream_dedupe", f"SELECT kind, document_id, summary, count(*) AS n FROM (SELECT DISTINCT kind, document_id, summary FROM change_log WHERE kind IN {_ERRORS}) GROUP BY ALL", "change_log")
def stream_dedupe(x: Inputs) -> DataFrame:
    """Error fingerprints; the horizon is the whole month, as the engine remembers errors for good."""
    log = ev.errors(x.change_log).withColumn("day", F.col("created_at").cast("date"))
    stream = streams.replay(x.spark, log, "day")
    kept = streams.dedupe(stream, ["kind", "document_id", "summary"], "created_at", "60 days")
    return streams.drained(kept.select("kind", "document_id", "summary"), "deduped").groupBy("kind", "document_id", "summary").agg(F.count(F.lit(1)).alias("n"))


@query("stream_deliver_once", "SELECT DISTINCT id AS event_id, chat_id FROM change_log, recipients WHERE status = 'approved' AND kind = 'document_added'", "change_log", "recipients")
def stream_deliver_once(x: Inputs) -> DataFrame:
    pairs = delivery.fan_out(x.change_log.where("kind = 'document_added'"), delivery.approved(x.recipients)).select(F.col("id").alias("event_id"), "chat_id", F.pmod("id", F.lit(4)).alias("part"))
    again = pairs.withColumn("part", F.col("part") + 2)
    return streams.deliver_once(streams.replay(x.spark, pairs.union(again), "part").select("event_id", "chat_id"))


@query("latest_per_interval", "SELECT document_id, time_bucket(INTERVAL 2 SECONDS, created_at) AS start, max_by(kind, (created_at, id)) AS kind FROM change_log WHERE document_id IS NOT NULL GROUP BY document_id, time_bucket(INTERVAL 2 SECONDS, created_at) HAVING time_bucket(INTERVAL 2 SECONDS, created_at) + INTERVAL 62 SECONDS <= (SELECT max(created_at) FROM change_log WHERE document_id IS NOT NULL)", "change_log")
def latest_per_interval(x: Inputs) -> DataFrame:
    """Intervals that the watermark, a minute behind the last event, has passed."""
    log = x.change_log.where("document_id is not null").withColumn("day", F.col("created_at").cast("date"))
    stream = streams.replay(x.spark, log, "day").select("document_id", "kind", "created_at", "id")
    out = streams.drained(streams.latest_per_interval(stream, "document_id", "kind", "created_at", "id"), "latest")
    return out.select("document_id", F.col("start").cast("timestamp_ntz").alias("start"), "kind")
