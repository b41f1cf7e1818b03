"""Intermediate tables written to the folder that all executors share, so that a lost executor loses none of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where it is unset, as in tests, a folder of this machine is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        folder = tempfile.mkdtemp(prefix="loomwork-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


class Scratch:
    """Writes tables for one run and forgets those that a later round replaced."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/loomwork-{uuid.uuid4().hex}"
        self.count = 0
        self.kept: dict[int, tuple[DataFrame, str]] = {}  # holds the frames, so that no id is used twice

    def keep(self, df: DataFrame) -> DataFrame:
        """Materialises ``df`` as a written table; its lineage ends there."""
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(kept)] = (kept, path)
        return kept

    def drop(self, *frames: DataFrame | None) -> None:
        """Deletes tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            found = self.kept.pop(id(df), None) if df is not None else None
            if found:
                path = found[1]
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes a run's result and deletes every other table of the run."""
        kept = self.keep(df)
        self.drop(*[frame for frame, _ in list(self.kept.values()) if frame is not kept])
        return kept

    def close(self) -> None:
        """Deletes all tables of the run."""
        self.drop(*[frame for frame, _ in list(self.kept.values())])
