"""Near-duplicate sources by shared code lines, their clusters, and splits that no cluster straddles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_part, lines, masked
from ..sources.scratch import Scratch
from .graph import pair_components
from .skew import skew_join, written_hot_keys


def code_shingles(sources: DataFrame, key: str = "name", text: str = "source") -> DataFrame:
    """(key, line): the different indented code lines, strings masked, comments cut, blanks collapsed."""
    rows = sources.select(key, F.explode(lines(F.col(text))).alias("raw")).where(F.col("raw").rlike("^[ \t]"))
    bare = F.regexp_replace(F.trim(F.regexp_replace(masked(code_part(F.col("raw"))), r"[ \t]+", " ")), "^ | $", "")
    return rows.select(key, bare.alias("line")).where("line <> ''").distinct()


def line_classes(shingles: DataFrame, key: str = "name", least: int = 8, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members (key, rep), sets (rep, ls) of the keys with ``least`` lines or more.

    Keys with equal sets of lines (by md5 of the sorted lines, which hold no line break) are one class, named by its
    least key. All further work is on classes, so copies cost a row each and not a pair each.
    """
    scratch = scratch or Scratch(shingles.sparkSession)
    own = shingles.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("line").alias("ls")).where(F.size("ls") >= least)
    own = scratch.keep(own.withColumn("sig", F.md5(F.array_join(F.array_sort("ls"), "\n"))))
    reps = own.groupBy("sig").agg(F.min(key).alias("rep"))
    sets = own.join(reps.select(F.col("rep").alias(key)), key, "left_semi").select(F.col(key).alias("rep"), "ls")
    members = skew_join(own.select("sig", key), reps, ["sig"], hot=written_hot_keys(own, ["sig"])).select(key, "rep")
    return scratch.keep(members), scratch.keep(sets)


def similar_sets(sets: DataFrame, threshold: float = 0.6, scratch: Scratch | None = None) -> DataFrame:
    """(rep_a, rep_b, shared, similarity), rep_a < rep_b: different sets whose Jaccard similarity reaches ``threshold``.

    Lines have one global order, rarest first. Two similar sets share a line among the first n - ceil(t n) + 1 of
    each, and at the first line they share enough lines follow in both: so no pair is lost, however many keys a line
    has. Lines join by 64-bit hashes; the pairs are verified on the lines.
    """
    scratch = scratch or Scratch(sets.sparkSession)
    rows = scratch.keep(sets.select("rep", F.size("ls").alias("n"), F.explode(F.transform("ls", lambda x: F.xxhash64(x))).alias("h")))
    owners = rows.groupBy("h").agg(F.count("*").alias("owners")).where("owners > 1")  # the others come first and meet nothing
    met = skew_join(rows, owners, ["h"], hot=written_hot_keys(rows, ["h"])).groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("owners", "h"))).alias("alive"))
    alone = F.col("n") - F.size("alive")
    lead = F.greatest(F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    blocks = met.select("rep", "n", alone.alias("alone"), F.posexplode(F.slice("alive", 1, lead)).alias("at", "x"))
    blocks = scratch.keep(blocks.select("rep", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("x.h").alias("h")))
    side = lambda to: blocks.select("h", *[F.col(c).alias(c + to) for c in ("rep", "n", "left")])
    able = F.least("left_a", "left_b") >= (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9
    near = skew_join(side("_a"), side("_b"), ["h"], hot=written_hot_keys(blocks, ["h"])).where((F.col("rep_a") < F.col("rep_b")) & able)
    near = scratch.keep(near.select("rep_a", "rep_b").distinct())
    of = lambda to: sets.select(F.col("rep").alias("rep" + to), F.col("ls").alias("ls" + to))
    j = skew_join(skew_join(near, of("_a"), ["rep_a"], hot=written_hot_keys(near, ["rep_a"])), of("_b"), ["rep_b"], hot=written_hot_keys(near, ["rep_b"]))
    shared = F.size(F.array_intersect("ls_a", "ls_b"))
    alike = shared / (F.size("ls_a") + F.size("ls_b") - shared)
    return scratch.keep(j.select("rep_a", "rep_b", shared.alias("shared"), alike.alias("similarity")).where(F.col("similarity") >= threshold))


def line_pairs(shingles: DataFrame, key: str = "name", least: int = 8, threshold: float = 0.6, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, shared, similarity): all keys with ``least`` lines or more whose Jaccard similarity reaches ``threshold``.

    A class of m copies has m (m - 1) / 2 pairs; where only clusters are asked for, ``line_links`` gives fewer rows.
    """
    scratch = scratch or Scratch(shingles.sparkSession)
    members, sets = line_classes(shingles, key, least, scratch)
    alike = similar_sets(sets, threshold, scratch)
    hot = written_hot_keys(members, ["rep"])
    of = lambda to: members.select(F.col("rep").alias("rep" + to), F.col(key).alias("k" + to))
    across = skew_join(of("_b"), skew_join(of("_a"), alike, ["rep_a"], hot=hot), ["rep_b"], hot=hot).select("k_a", "k_b", "shared", F.round("similarity", 6).alias("similarity"))
    copies = members.groupBy("rep").agg(F.count("*").alias("copies")).where("copies > 1").select("rep")
    same = members.join(copies, "rep", "left_semi").select("rep", F.col(key).alias("k_a"))
    sizes = sets.select("rep", F.size("ls").alias("shared"))
    within = skew_join(skew_join(same, sizes, ["rep"], hot=hot), members.select("rep", F.col(key).alias("k_b")), ["rep"], hot=hot).where("k_a < k_b")
    both = across.unionByName(within.select("k_a", "k_b", "shared", F.lit(1.0).alias("similarity")))
    return both.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"), "shared", "similarity")


def line_links(shingles: DataFrame, key: str = "name", least: int = 8, threshold: float = 0.6, scratch: Scratch | None = None) -> DataFrame:
    """(a, b): similar keys that tie together the same clusters as all of ``line_pairs``; copies meet in their class's least."""
    scratch = scratch or Scratch(shingles.sparkSession)
    members, sets = line_classes(shingles, key, least, scratch)
    copies = members.where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"))
    return copies.unionByName(similar_sets(sets, threshold, scratch).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def clusters(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(name, cluster): members of clusters of two or more, named by their least member in string order."""
    scratch = scratch or Scratch(pairs.sparkSession)
    return pair_components(pairs, "a", "b", scratch).select("name", F.col("unit").alias("cluster"))


def units(names: DataFrame, members: DataFrame) -> DataFrame:
    """(name, unit_key, is_cluster): each name in one unit; a cluster with fewer than two present members is none."""
    here = names.select("name").distinct().join(members, "name", "left")
    present = here.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.count("*").alias("present"), F.min("name").alias("first"))
    j = skew_join(here, present, ["cluster"], "left")
    whole = F.coalesce(F.col("present") >= 2, F.lit(False))
    return j.select("name", F.when(whole, F.col("first")).otherwise(F.col("name")).alias("unit_key"), whole.alias("is_cluster"))


def quota_split(of_units: DataFrame, share: float, seed: int, scratch: Scratch | None = None) -> DataFrame:
    """(unit_key, size, side): units in hashed order go to eval while they fit its quota; later smaller ones may still fit.

    Skipping makes this no running sum. Each round takes the units before the first that does not fit, by sums within
    and before hash buckets; only smaller units after it remain, so there are at most as many rounds as unit sizes.
    """
    scratch = scratch or Scratch(of_units.sparkSession)
    sized = of_units.groupBy("unit_key").agg(F.count("*").alias("size")).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}|"), F.col("unit_key").cast("string")), 256))
    sized = scratch.keep(sized.withColumn("bucket", F.conv(F.substring("h", 1, 2), 16, 10).cast("int")))
    quota = sized.agg(F.bround(F.coalesce(F.sum("size"), F.lit(0)) * share, 0).cast("bigint")).first()[0]
    left, after, taken = quota, "", []
    inner = Window.partitionBy("bucket").orderBy("h", "unit_key").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    while left > 0:
        open_ = sized.where((F.col("h") > after) & (F.col("size") <= left))
        sums = open_.groupBy("bucket").agg(F.sum("size").alias("s")).select("bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shift"))  # at most 256 rows
        run = open_.withColumn("run", F.sum("size").over(inner)).join(F.broadcast(sums), "bucket").withColumn("run", F.col("run") + F.col("shift"))
        stop = run.where(F.col("run") > left).agg(F.min("h").alias("h"), F.count("*").alias("n")).first()
        got = scratch.keep(run.where(F.col("run") <= left).select("unit_key", "size", "h"))
        taken.append(got.select("unit_key"))
        left -= got.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if not stop["n"]:
            break
        after = stop["h"]
    chosen = taken[0] if taken else sized.select("unit_key").limit(0)
    for t in taken[1:]:
        chosen = chosen.unionByName(t)
    return sized.join(chosen.withColumn("side", F.lit("eval")), "unit_key", "left").select("unit_key", "size", F.coalesce("side", F.lit("train")).alias("side"))


def leaked(evaluation: DataFrame, train: DataFrame, key: str = "name") -> DataFrame:
    """Keys of evaluation rows that also occur on the train side, without case and outer blanks."""
    norm = lambda df: df.select(F.upper(F.trim(F.col(key).cast("string"))).alias(key)).where(F.col(key).isNotNull()).distinct()
    return norm(evaluation).join(norm(train), key, "left_semi")


def cover_faults(units: DataFrame, names: DataFrame) -> DataFrame:
    """(name, fault): names that no unit holds, that several hold, or that units hold without need; none where units cover names once."""
    held = units.where(F.col("name").isNotNull()).select("name", "unit_key").distinct().groupBy("name").agg(F.count("*").alias("units"))
    known = names.where(F.col("name").isNotNull()).select("name").distinct().withColumn("_known", F.lit(True))
    j = held.join(known, "name", "full")
    fault = F.when(F.col("units").isNull(), "in no unit").when(F.col("_known").isNull(), "unknown").when(F.col("units") > 1, "in several units")
    return j.select("name", fault.alias("fault")).where(F.col("fault").isNotNull())


def on_side(sides: DataFrame, side: str) -> DataFrame:
    """(name) in upper case of one side of a split."""
    return sides.where(F.col("side") == side).select(F.upper(F.trim("name")).alias("name")).where(F.col("name").isNotNull()).distinct()
