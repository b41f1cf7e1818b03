"""Equi-joins and rankings that survive a key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: A key is hot when it holds more than one in HOT_SHARE of a side's rows; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 200
#: Rows under which no key is worth splitting.
HOT_LEAST = 20_000


def hot_keys(df: DataFrame, keys: list[str], share: int | None = None, least: int | None = None) -> list[tuple]:
    """The hot keys with their counts: at most ``share`` of them, whatever the table's size. Null keys never join."""
    share, least = share or HOT_SHARE, HOT_LEAST if least is None else least
    present = df.dropna(subset=keys)
    counts = present.groupBy(*keys).agg(F.count("*").alias("n"))
    total = present.agg(F.count("*").alias("total"))
    rows = counts.where(F.col("n") > least).join(F.broadcast(total)).where(F.col("n") * share > F.col("total"))
    return [tuple(r) for r in rows.collect()]


def written_hot_keys(table: DataFrame, keys: list[str]) -> list[tuple]:
    """``hot_keys`` of a written table, whose row count costs nothing: small tables have none."""
    return hot_keys(table, keys) if table.count() > HOT_LEAST else []


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 32, hot: list[tuple] | None = None) -> DataFrame:
    """Join on ``keys`` where some keys of ``big`` hold many rows.

    Hot keys' rows of ``big`` are spread over ``salts`` by a hash of the whole row, and the matching rows of
    ``small`` are repeated once per salt; other keys join as usual. ``how``: inner, left, left_semi or left_anti.
    Nothing is broadcast but the list of hot keys, of which there are fewer than HOT_SHARE.
    """
    hot = hot_keys(big, keys) if hot is None else hot
    if not hot:
        return big.join(small, keys, how)
    is_hot = F.lit(False)
    for row in hot:
        one = F.lit(True)
        for k, v in zip(keys, row):
            one = one & (F.col(k) == F.lit(v))
        is_hot = is_hot | one
    is_hot = F.coalesce(is_hot, F.lit(False))
    left = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*[c for c, t in big.dtypes if "map<" not in t and t != "variant"]), F.lit(salts))).otherwise(0).cast("int"))
    all_salts = F.array(*[F.lit(i) for i in range(salts)])
    right = small.withColumn("_salt", F.explode(F.when(is_hot, all_salts).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int = 64) -> DataFrame:
    """Adds the 1-based rank of each row within ``group`` by a hash of ``order``, without one task per group.

    Rows fall into hash buckets; ranks within a bucket shift by the sizes of the buckets before it. ``order`` must
    name a key of the rows for a deterministic result. The order is that of the hash, not of the values.
    """
    h = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.shiftrightunsigned(F.col("_h"), 58).cast("int") % buckets)
    sizes = h.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(*group, "_b").orderBy("_h", *order)
    return (
        h.withColumn("_r", F.row_number().over(inner))
        .join(shifts, [*group, "_b"])
        .withColumn(out, (F.col("_r") + F.col("_shift")).cast("long"))
        .drop("_h", "_b", "_r", "_shift")
    )


def running_total(df: DataFrame, order: list, value, out: str, scratch: Scratch) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row in one global order, without one task for all rows.

    Rows are range-sorted and written with their range's number; sums within a range shift by those of ranges before
    it. ``order`` must name a key of the rows for a deterministic result. Null values count as 0.
    """
    ranged = df.withColumn("_v", F.coalesce(value, F.lit(0))).repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    kept = scratch.keep(ranged)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = kept.groupBy("_p").agg(F.sum("_v").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_shift"))  # one row per range
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("_run", F.sum("_v").over(within)).join(F.broadcast(shifts), "_p").withColumn(out, F.col("_run") + F.col("_shift")).drop("_v", "_p", "_run", "_shift")
