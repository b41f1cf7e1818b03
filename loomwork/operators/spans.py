"""Joins of points to labelled spans: the containing span, and the nearest span before that qualifies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containing(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """points (key, at) with ``label`` of the span lo..hi, both inclusive, that holds them, or null.

    Equi-join on the key with the interval as residual condition: no pair of different keys is ever formed.
    """
    s = spans.select(key, "label", "lo", "hi")
    return points.join(s, (points[key] == s[key]) & F.col("at").between(s["lo"], s["hi"]), "left").select(points["*"], s["label"])


def as_of(points: DataFrame, spans: DataFrame, key: str, qualifies) -> DataFrame:
    """points with ``entry``: the last qualifying label that starts at or before them, else the last label at all.

    One sort per key over the union of points and span starts; no join.
    """
    p = points.select(key, "at", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("good"))
    s = spans.select(key, F.col("lo").alias("at"), F.lit(0).alias("kind"), "label", qualifies.alias("good"))
    w = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    best = F.last(F.when(F.col("good"), F.col("label")), ignorenulls=True).over(w)
    any_ = F.last("label", ignorenulls=True).over(w)
    return s.unionByName(p).withColumn("entry", F.coalesce(best, any_)).where("kind = 1").select(key, "at", "entry")


def sessions(rows: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Adds ``session``, counted from 1 per key: a new one begins after a pause longer than the gap."""
    w = Window.partitionBy(key).orderBy(at)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    pause = us - F.lag(us).over(w) > gap_seconds * 1_000_000
    return rows.withColumn("session", F.sum(F.when(F.coalesce(pause, F.lit(True)), 1).otherwise(0)).over(w))


def fold_log(events: DataFrame) -> DataFrame:
    """Event log (run_id, condition, seq, kind, attempt): each verdict or tool call with the attempt it belongs to.

    A verdict goes to the last candidate of the same attempt number before it, else to the latest candidate.
    """
    run = Window.partitionBy("run_id", "condition").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("run_id", "condition", "attempt").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("kind") == "candidate", F.col("seq"))
    latest = F.last(mark, ignorenulls=True).over(run)
    exact = F.when(F.col("attempt").isNotNull(), F.last(mark, ignorenulls=True).over(same))
    return events.withColumn("owner", F.when(F.col("kind") == "verdict", F.coalesce(exact, latest)).when(F.col("kind") == "tool_call", latest).otherwise(mark))
