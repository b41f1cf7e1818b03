"""Graphs as edge tables: components, reach within k hops, breadth-first levels, fan-in and fan-out.

Every round is joins and aggregates that combine before the shuffle; rounds are cut by written tables, never by
driver-side collections. Hot vertices are split by ``skew_join``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .skew import skew_join, written_hot_keys

ROUNDS = 60


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, unit): the component of each name, named by its least member, over pairs (name, who).

    Names that share a ``who`` belong together; a null ``who`` ties nothing. Each round every root hooks to its least
    neighbour, pointers double until they end at roots, and edges contract onto roots: open roots at least halve.
    """
    names = scratch.keep(pairs.select("name").distinct())
    edges = scratch.keep(pairs.where(F.col("who").isNotNull()).select(F.col("name").alias("r"), F.col("who").alias("a")).distinct())
    edges = _open(edges, scratch)
    parents: DataFrame | None = None
    for _ in range(ROUNDS):
        if edges.isEmpty():
            break
        hot = written_hot_keys(edges, ["a"])
        two = _two_least(edges, hot)
        # The least root around each author, or the second least for the least itself.
        hooks = scratch.keep(skew_join(edges, two, ["a"], hot=hot).groupBy("r").agg(F.min(F.when(F.col("m1") != F.col("r"), F.col("m1")).otherwise(F.col("m2"))).alias("p")))
        # Two roots that chose each other: the smaller stays a root.
        back = hooks.select(F.col("r").alias("p"), F.col("p").alias("pp"))
        forest = scratch.keep(skew_join(hooks, back, ["p"], "left", hot=written_hot_keys(hooks, ["p"])).select("r", F.when((F.col("pp") == F.col("r")) & (F.col("r") < F.col("p")), F.col("r")).otherwise(F.col("p")).alias("p")))
        scratch.drop(hooks)
        forest = _shortcut(forest, scratch)
        moved = skew_join(edges, forest.select("r", F.col("p").alias("new")), ["r"], "left", hot=written_hot_keys(edges, ["r"])).select(F.coalesce("new", "r").alias("r"), "a").distinct()
        following = _open(scratch.keep(moved), scratch)
        scratch.drop(edges)
        edges = following
        if parents is None:
            parents = forest
        else:
            up = forest.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            grown = skew_join(parents, up, ["p"], "left", hot=written_hot_keys(parents, ["p"])).select("r", F.coalesce("pp", "p").alias("p")).unionByName(forest.join(parents.select("r"), "r", "left_anti").select("r", "p"))
            grown = scratch.keep(grown)
            scratch.drop(parents, forest)
            parents = grown
    else:
        raise RuntimeError("components did not settle")
    if parents is None:
        return names.select("name", F.col("name").alias("unit"))
    rooted = names.join(parents.select(F.col("r").alias("name"), "p"), "name", "left").select("name", F.coalesce("p", "name").alias("root"))
    least = rooted.groupBy("root").agg(F.min("name").alias("unit"))
    return scratch.keep(skew_join(rooted, least, ["root"]).select("name", "unit"))


def _two_least(edges: DataFrame, hot: list[tuple]) -> DataFrame:
    """Per author the two least of its roots; edges are distinct."""
    least = edges.groupBy("a").agg(F.min("r").alias("m1"))
    return skew_join(edges, least, ["a"], hot=hot).where(F.col("r") != F.col("m1")).groupBy("a", "m1").agg(F.min("r").alias("m2"))


def _open(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges of authors that still tie several roots; replaces ``edges``."""
    tied = edges.groupBy("a").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where(F.col("lo") != F.col("hi")).select("a")
    kept = scratch.keep(skew_join(edges, tied, ["a"], "left_semi", hot=written_hot_keys(edges, ["a"])))
    scratch.drop(edges)
    return kept


def _shortcut(forest: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer doubling until every parent is a root."""
    while True:
        up = forest.select(F.col("r").alias("p"), F.col("p").alias("pp"))
        jumped = scratch.keep(skew_join(forest, up, ["p"], "left", hot=written_hot_keys(forest, ["p"])).select("r", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")))
        scratch.drop(forest)
        forest = jumped
        if forest.where("moved").isEmpty():
            return forest


def pair_components(pairs: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(name, unit) over plain pairs: an edge becomes a node that ties its two ends."""
    edge = F.xxhash64(a, b).cast("string")
    ends = pairs.select(F.col(a).cast("string").alias("name"), F.concat(edge, F.lit("|"), F.col(a).cast("string"), F.lit("|"), F.col(b).cast("string")).alias("who"), F.col(b).cast("string").alias("other"))
    return components(ends.select("name", "who").unionByName(ends.select(F.col("other").alias("name"), "who")), scratch)


def fan(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of every node of edges (caller, callee); repeated edges count once."""
    e = edges.distinct()
    both = e.select(F.col("caller").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("callee").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def reach(edges: DataFrame, hops: int, cap: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(caller, reached, capped): number of other nodes within ``hops`` calls; exact, with a flag where it exceeds ``cap``."""
    pairs = reach_pairs(edges, hops, scratch)
    n = F.count("*")  # a pair is there once, at its least depth
    return pairs.groupBy("caller").agg(n.alias("reached"), (n > cap if cap is not None else F.lit(False)).alias("capped"))


def reach_pairs(edges: DataFrame, hops: int, scratch: Scratch | None = None) -> DataFrame:
    """(caller, node, depth): least depth of every node reached within ``hops``, without the caller itself."""
    scratch = scratch or Scratch(edges.sparkSession)
    e = scratch.keep(edges.select("caller", "callee").distinct())
    seen = scratch.keep(e.where("caller <> callee").select("caller", F.col("callee").alias("node"), F.lit(1).alias("depth")))
    frontier = seen
    for depth in range(2, hops + 1):
        step = skew_join(e.withColumnRenamed("caller", "node"), frontier.select("caller", "node"), ["node"]).select("caller", F.col("callee").alias("node")).where("caller <> node").distinct()
        frontier = scratch.keep(step.join(seen.select("caller", "node"), ["caller", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def bfs(edges: DataFrame, root, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """(node, depth): least depth from ``root``, the root at 0, as far as ``depth``."""
    scratch = scratch or Scratch(edges.sparkSession)
    e = scratch.keep(edges.select("caller", "callee").distinct())
    seen = frontier = edges.sparkSession.createDataFrame([(root, 0)], f"node {dict(edges.dtypes)['caller']}, depth int")
    for level in range(1, depth + 1):
        step = e.join(frontier.select(F.col("node").alias("caller")), "caller", "left_semi").select(F.col("callee").alias("node")).distinct()
        frontier = scratch.keep(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def rooted_edges(edges: DataFrame, levels: DataFrame, depth: int) -> DataFrame:
    """(caller, callee, in_corpus): edges of every expanded node; callees that call nothing themselves are unresolved."""
    known = edges.select(F.col("caller").alias("callee")).distinct().withColumn("in_corpus", F.lit(True))
    expanded = levels.where(F.col("depth") < depth).select(F.col("node").alias("caller"))
    return edges.distinct().join(expanded, "caller", "left_semi").join(known, "callee", "left").select("caller", "callee", F.coalesce("in_corpus", F.lit(False)).alias("in_corpus"))


def callee_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(caller, callees, touched, any_output, depth): facts (node, what, writes) united over all reached callees."""
    j = pairs.join(facts, "node", "left")
    return j.groupBy("caller").agg(F.countDistinct("node").alias("callees"), F.countDistinct("what").alias("touched"), F.coalesce(F.bool_or("writes"), F.lit(False)).alias("any_output"), F.max("depth").alias("depth"))


def consecutive(rows: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """(caller, callee): each item with the next of its group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.select(F.col(item).alias("caller"), F.lead(item).over(w).alias("callee"), *[c for c in rows.columns if c not in (item,)]).where("callee IS NOT NULL AND caller <> callee")
