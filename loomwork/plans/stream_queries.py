"""Streams over the project's tables, run over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from ..streaming import progress


def _progress(s, d):
    out = progress.progress(progress.table_stream(s, d, "attempts"))
    got = progress.run_now(out, f"progress_{uuid.uuid4().hex}", "complete")  # one row per condition
    return got.select("condition", "records", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("median_seconds", 6).alias("median_seconds"), "first_passed")


def _sunk(s, stream):
    root = Scratch(s).root
    progress.append(stream, f"{root}/out", f"{root}/checkpoint")
    return s.read.parquet(f"{root}/out")


def _windows(s, d):
    events = progress.table_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = progress.windowed(events, "10 minutes", "1 hour").select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))
    return _sunk(s, closed)


def _appended(s, d):
    return _sunk(s, progress.table_stream(s, d, "events").select("event_id", "user_id", "event_type", "value"))


def _folded(s, d):
    kind = F.when(F.col("event_type") == "view", "candidate").when(F.col("event_type") == "click", "verdict").otherwise("tool_call")
    events = progress.table_stream(s, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("kind"))
    root = Scratch(s).root

    def write(batch, number):
        batch.write.mode("append").parquet(f"{root}/out")

    progress.fold(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.parquet(f"{root}/out")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("candidates", "verdicts", "last_seq"), "last_seq").alias("r")).select("run_id", "r.*")


QUERIES = {"stream_progress": _progress, "stream_windows": _windows, "stream_append": _appended, "stream_fold": _folded}

SQL = {
    "stream_progress": """WITH p AS (SELECT *, (epoch_us(CAST(finished_at AS TIMESTAMPTZ)) - epoch_us(CAST(started_at AS TIMESTAMPTZ))) / 1e6 AS secs FROM attempts)
        SELECT condition, count(*) AS records, round(avg(secs), 6) AS mean_seconds, round(median(secs), 6) AS median_seconds, count(*) FILTER (attempt = 1 AND verdict.equivalent) AS first_passed FROM p GROUP BY 1""",
    "stream_windows": """SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
        WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""",
    "stream_append": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_fold": "SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(count(*) FILTER (event_type = 'view') AS INTEGER) AS candidates, CAST(count(*) FILTER (event_type = 'click') AS INTEGER) AS verdicts, max(event_id) AS last_seq FROM events GROUP BY 1",
}
