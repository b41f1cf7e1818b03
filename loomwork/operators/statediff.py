"""Comparing two executions' observable state, and guarded, reversible changes of key/value state.

Absent, null and empty differ: each side carries a presence flag. Every comparison is one full outer join on the key,
so it shuffles both sides once; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import masked


def state_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, kind, expected, actual): refs whose presence or value differs. Null values equal each other."""
    a = left.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("in_right"))
    j = a.join(b, keys, "full")
    kind = F.when(F.col("in_right").isNull(), "removed").when(F.col("in_left").isNull(), "added").when(~F.col("expected").eqNullSafe(F.col("actual")), "changed")
    return j.select(*keys, kind.alias("kind"), "expected", "actual").where(F.col("kind").isNotNull())


def diff_rollup(diff: DataFrame, case: F.Column) -> DataFrame:
    """(kind, differences, cases): per kind of difference, how many there are and in how many cases."""
    return diff.select("kind", case.alias("case")).groupBy("kind").agg(F.count("*").alias("differences"), F.countDistinct("case").alias("cases"))


def verdict(cases: DataFrame, diff: DataFrame, case: str = "case_index") -> DataFrame:
    """One row: equivalent, n_cases, n_diverged, n_void. Void cases are not compared; any void case forbids equivalence."""
    void = F.coalesce("void", F.lit(False))
    hit = diff.select(case).distinct().withColumn("hit", F.lit(True))
    j = cases.join(hit, case, "left")
    n = j.agg(F.count("*").alias("n_cases"), F.count_if(void).alias("n_void"), F.count_if(F.col("hit") & ~void).alias("n_diverged"))
    return n.select(((F.col("n_diverged") == 0) & (F.col("n_void") == 0)).alias("equivalent"), "n_cases", "n_diverged", "n_void")


def piece_diff(diff: DataFrame, keys: list[str], delimiter: str = "^") -> DataFrame:
    """(keys, piece, expected, actual): pieces of changed values that differ; the shorter value is padded with ''."""
    cut = lambda c: F.split(F.col(c), "\\" + delimiter, -1)
    z = diff.where((F.col("kind") == "changed") & F.col("expected").isNotNull() & F.col("actual").isNotNull()).select(*keys, F.posexplode(F.arrays_zip(cut("expected").alias("a"), cut("actual").alias("b"))).alias("i", "p"))
    return z.select(*keys, (F.col("i") + 1).alias("piece"), F.coalesce("p.a", F.lit("")).alias("expected"), F.coalesce("p.b", F.lit("")).alias("actual")).where(F.col("expected") != F.col("actual"))


def ancestors(ref: F.Column) -> F.Column:
    """The nodes above a node: of ^A("x,y",2) they are ^A and ^A("x,y"); commas and brackets in quotes cut nothing."""
    bare = masked(ref)
    cut = F.filter(F.transform(F.split(bare, ""), lambda c, i: F.when(c.isin("(", ","), i)), lambda i: i.isNotNull())
    return F.transform(cut, lambda i: F.concat(F.substring(ref, F.lit(1), i), F.when(F.substring(bare, i + 1, F.lit(1)) == ",", ")").otherwise("")))


def parents(plan: DataFrame, state: DataFrame) -> DataFrame:
    """ref of the plan's kills under which the state has nodes. Refs that are no strings form no tree."""
    kills = plan.where("op = 'kill'").select("ref").distinct()
    above = state.select(F.explode(ancestors(F.col("ref"))).alias("ref")).distinct()
    return kills.join(above, "ref", "left_semi")


def preview(plan: DataFrame, state: DataFrame) -> DataFrame:
    """(ref, op, before_value, current, present, matches): whether each operation's precondition still holds.

    ``before_value`` null means that the ref was absent when the plan was made. A kill of a node with descendants
    in the state never matches: no plan deletes or orphans a subtree.
    """
    now = state.select("ref", F.col("value").alias("current"), F.lit(True).alias("present"))
    j = plan.join(now, "ref", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    ok = F.when(F.col("before_value").isNull(), ~F.col("present")).otherwise(F.col("present") & F.col("before_value").eqNullSafe(F.col("current")))
    if dict(state.dtypes)["ref"] == dict(plan.dtypes)["ref"] == "string":
        j = j.join(parents(plan, state).withColumn("above", F.lit(True)), "ref", "left")
        ok = ok & ((F.col("op") != "kill") | F.col("above").isNull())
    return j.select("ref", "op", "before_value", "current", "present", ok.alias("matches"))


def ready(plan: DataFrame, state: DataFrame) -> DataFrame:
    """One row: ops, conflicts, duplicate_refs, ready. Two operations on one ref are never ready."""
    p = preview(plan, state)
    twice = plan.groupBy("ref").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_refs"))
    n = p.agg(F.count("*").alias("ops"), F.count_if(~F.col("matches")).alias("conflicts"))
    return n.join(F.broadcast(twice)).select("ops", "conflicts", "duplicate_refs", ((F.col("conflicts") == 0) & (F.col("duplicate_refs") == 0)).alias("ready"))  # one row


def apply_plan(plan: DataFrame, state: DataFrame) -> DataFrame:
    """(ref, value): the new state if the whole plan is ready, else the state as it was: all or nothing."""
    go = ready(plan, state).select(F.col("ready").alias("go"))
    ops = plan.select("ref", "op", F.col("value").alias("new"))
    j = state.select("ref", "value", F.lit(True).alias("had")).join(ops, "ref", "full").join(F.broadcast(go))  # one row
    act = F.col("go") & F.col("op").isNotNull()
    keep = F.when(act, F.col("op") == "set").otherwise(F.col("had").isNotNull())
    return j.where(keep).select("ref", F.when(act, F.col("new")).otherwise(F.col("value")).alias("value"))


def inverse(plan: DataFrame) -> DataFrame:
    """The plan that undoes ``plan``, guarded by what it wrote: before and after change places."""
    written = F.when(F.col("op") == "set", F.col("value"))
    return plan.select("ref", F.when(F.col("before_value").isNull(), "kill").otherwise("set").alias("op"), written.alias("before_value"), F.col("before_value").alias("value"))


def upsert(rows: DataFrame, news: DataFrame, key: F.Column, order: str) -> DataFrame:
    """The latest row per key of both tables; ties in ``order`` go to the new rows."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(news.withColumn("_new", F.lit(1))).withColumn("_k", key)
    cols = [c for c in both.columns if c not in ("_new", "_k")]
    return both.groupBy("_k").agg(F.max_by(F.struct(*cols), F.struct(order, "_new")).alias("r")).select("r.*")


def subtree_counts(state: DataFrame, refs: DataFrame, cap: int) -> DataFrame:
    """(ref, nodes, capped): how many nodes stand at or under each wanted node, no more than ``cap``, and whether there are more."""
    wanted = refs.select("ref").where(F.col("ref").isNotNull()).distinct()
    above = state.where(F.col("ref").isNotNull()).select(F.explode(F.array_append(ancestors(F.col("ref")), F.col("ref"))).alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))
    j = wanted.join(above, "ref", "left").select("ref", F.coalesce("n", F.lit(0)).alias("n"))
    return j.select("ref", F.least("n", F.lit(cap)).alias("nodes"), (F.col("n") > cap).alias("capped"))


def receipt_faults(receipts: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, fault) of receipts that do not fit their plan.

    receipts (plan_id, digest, ops), plans (plan_id, ref, op, before_value, value): unknown plan, another number of
    operations, repeated ref, set without value or kill with one, or a digest that is not that of the plan's operations.
    """
    line = F.concat_ws("|", "ref", "op", F.coalesce("before_value", F.lit("<absent>")), F.coalesce("value", F.lit("<absent>")))
    lines = plans.select("plan_id", "ref", F.xxhash64(line).alias("h"), F.when(F.col("op") == "set", F.col("value").isNull()).when(F.col("op") == "kill", F.col("value").isNotNull()).otherwise(True).alias("odd"))
    per = lines.groupBy("plan_id").agg(F.count("*").alias("n"), F.countDistinct("ref").alias("refs"), F.bool_or("odd").alias("odd"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"))
    j = receipts.join(per, "plan_id", "left")
    faults = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "unknown plan"), F.when(F.col("n") != F.col("ops"), "number of operations"), F.when(F.col("n") != F.col("refs"), "repeated ref"),
        F.when(F.col("odd"), "operation and value"), F.when(F.col("n").isNotNull() & ~F.col("digest").eqNullSafe(plan_digest(F.col("x"), F.col("s"))), "digest"),
    ))
    return j.select("plan_id", F.explode(faults).alias("fault"))


def plan_digest(x, s) -> F.Column:
    """Digest of a plan from the exclusive or and the sum of its operations' hashes, so in any order of rows."""
    return F.sha2(F.concat_ws("|", x.cast("string"), s.cast("string")), 256)
