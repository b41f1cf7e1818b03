"""Streams: progress over trace files as they arrive, durable appends, windows with late data, ordered folds.

Files are read once by name, so producers put one small file per attempt into the watched folder. State: progress
keeps exact medians, hence one value per finished attempt; windows drop state behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import TRACE


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Attempt records of JSONL files in a folder as a stream; lines that do not parse are dropped."""
    raw = spark.readStream.option("pathGlobFilter", "*.json*").text(folder)
    return raw.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", TRACE).alias("r")).select("r.*").where(F.col("task_id").isNotNull())


def progress(stream: DataFrame) -> DataFrame:
    secs = (F.unix_micros(F.try_to_timestamp("finished_at")) - F.unix_micros(F.try_to_timestamp("started_at"))) / 1e6
    return stream.groupBy("condition").agg(F.count("*").alias("records"), F.avg(secs).alias("mean_seconds"), F.median(secs).alias("median_seconds"), F.count_if((F.col("attempt") == 1) & F.col("verdict.equivalent")).alias("first_passed"))


def run_now(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns the result table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def table_stream(spark: SparkSession, directory: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A Parquet table as a stream; its schema comes from the footers."""
    path = f"{directory}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(directory)  # a stream reads folders, not single files


def append(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends a stream to Parquet exactly once per input file."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window and event type; rows later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str, gap: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


FOLDED = "run_id string, candidates int, verdicts int, last_seq bigint"


def fold(events: DataFrame) -> DataFrame:
    """Per run the candidates and verdicts seen so far, kept as state across batches; events (run_id, seq, kind)."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        c, v, last = state.get if state.exists else (0, 0, -1)
        for b in batches:
            b = b[b["seq"] > last].sort_values("seq")
            c += int((b["kind"] == "candidate").sum())
            v += int((b["kind"] == "verdict").sum())
            last = max([last, *b["seq"].tolist()])
        state.update((c, v, last))
        yield pd.DataFrame({"run_id": [key[0]], "candidates": [c], "verdicts": [v], "last_seq": [last]})

    return events.groupBy("run_id").applyInPandasWithState(step, FOLDED, "candidates int, verdicts int, last_seq bigint", "update", "NoTimeout")
