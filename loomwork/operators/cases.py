"""Executable cases: which source supplies them, how they are made, captured, executed results and running limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .skew import running_total, skew_join


def by_precedence(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of the first source that has the key; within a source the later row (greatest ``order``) wins."""
    all_ = reduce(DataFrame.unionByName, [s.withColumn("_src", F.lit(-i)) for i, s in enumerate(sources)])
    cols = [c for c in all_.columns if c not in (key, "_src")]
    return all_.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_src", order)).alias("r")).select(key, "r.*")


def first_source(wanted: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """Every row of the first source that has any row for the key, for wanted keys."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]).join(wanted.select(key).distinct(), key, "left_semi")
    best = ranked.groupBy(key).agg(F.min("_src").alias("_src"))
    return skew_join(ranked, best, [key, "_src"], "left_semi").drop("_src")


def distinct_cases(cases: DataFrame, key: str, order: str, case: str = "case_json") -> DataFrame:
    """Different cases of each key by their canonical text, in first-seen order: adds ``place`` from 1."""
    first = cases.groupBy(key, case).agg(F.min(order).alias("_o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_o", case))).drop("_o")


def vary_one(base: DataFrame, pools: DataFrame, most: int) -> DataFrame:
    """(entry, case_no, args): the base case, then one argument at a time through its pool; at most ``most`` per entry.

    base (entry, args array), pools (entry, position, choice, value).
    """
    varied = pools.join(base, "entry").where(F.get("args", F.col("position") - 1) != F.col("value")).select("entry", F.col("position").alias("p"), F.col("choice").alias("c"), F.transform("args", lambda a, i: F.when(i + 1 == F.col("position"), F.col("value")).otherwise(a)).alias("args"))
    all_ = base.select("entry", F.lit(0).alias("p"), F.lit(0).alias("c"), "args").unionByName(varied)
    w = Window.partitionBy("entry").orderBy("c", "p")
    return all_.withColumn("case_no", F.row_number().over(w)).where(F.col("case_no") <= most).select("entry", "case_no", "args")


def batches(cases: DataFrame, size: int, index: str = "case_index") -> DataFrame:
    return cases.withColumn("batch", F.floor(F.col(index) / size).cast("int"))


def stable_results(tries: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """The first try without a restart among the first ``most``; keys without one come out void."""
    ok = F.when((F.coalesce("restarts", F.lit(0)) == 0) & (F.col("try") <= most), F.col("try"))
    cols = [c for c in tries.columns if c not in key]
    return tries.groupBy(*key).agg(F.min_by(F.struct(*cols), ok).alias("r"), F.min(ok).isNull().alias("void")).select(*key, "r.*", "void")


def capture_tiers(roots: DataFrame, limit: int = 2000, reserved: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``tier``: query for scratch roots without a count and roots of at most ``limit`` nodes, else trigger."""
    small = (F.col("nodes").isNull() & F.col("scratch")) | (F.col("nodes") <= limit)
    return roots.where(~F.col("root").isin(*reserved) if reserved else F.lit(True)).withColumn("tier", F.when(F.coalesce(small, F.lit(False)), "query").otherwise("trigger"))


def last_write(log: DataFrame, key: str = "ref") -> DataFrame:
    """The last operation per reference of a trigger log (ref, seq, op, value)."""
    return log.groupBy(key).agg(F.max_by(F.struct("op", "value"), "seq").alias("r")).select(key, "r.*")


def capture_plan(requests: DataFrame, state: DataFrame) -> DataFrame:
    """(ref, op, before_value, value, refused): requests pinned to the current state; no-ops and repeated refs are refused."""
    now = state.select("ref", F.col("value").alias("before_value"), F.lit(True).alias("_there"))
    times = requests.groupBy("ref").agg(F.count("*").alias("_n"))
    j = requests.join(now, "ref", "left").join(times, "ref")
    same = F.when(F.col("op") == "kill", F.col("_there").isNull()).otherwise(F.col("_there").isNotNull() & F.col("before_value").eqNullSafe(F.col("value")))
    return j.select("ref", "op", "before_value", "value", F.when(F.col("_n") > 1, "repeated").when(same, "no change").alias("refused"))


def capped(rows: DataFrame, group: list[str], order: list[str], admitted: F.Column, most: int) -> DataFrame:
    """Rows of each group up to that at which ``most`` admitted ones are reached; later ones were never tried.

    Only the ``most``-th admitted row of a group is looked for, of which each task keeps no more, so no group is ordered
    as a whole. ``order`` must tell a group's rows apart; nulls in ``group`` are a group.
    """
    place = F.struct(*order)
    w = Window.partitionBy(*group).orderBy(*order)
    reached = rows.where(F.coalesce(admitted, F.lit(False))).select(*group, place.alias("_last"), *[F.col(c) for c in order if c not in group])
    last = reached.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == most).select(*[F.col(g).alias(f"_{g}") for g in group], "_last")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return rows.join(last, same, "left").where(F.col("_last").isNull() | (place <= F.col("_last"))).drop("_last", *[f"_{g}" for g in group])


def until_target(groups: DataFrame, order: list[str], gain: str, target: int, scratch: Scratch | None = None) -> DataFrame:
    """Groups in order while the gains of those before them stay below ``target``; ``groups`` has one row per group."""
    run = running_total(groups, order, F.col(gain), "_run", scratch or Scratch(groups.sparkSession))
    return run.where(F.col("_run") - F.coalesce(gain, F.lit(0)) < target).drop("_run")


def best_of(rows: DataFrame, group: list[str], order: list[F.Column], k: int) -> DataFrame:
    """The k first rows of every group, with ``place`` from 1; Spark keeps only k per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def fill_blank(records: DataFrame, facts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records whose blank or null columns take the value of ``facts``; their own values stay."""
    f = facts.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    j = skew_join(records, f, [key], "left")
    return j.select(*[F.coalesce(F.nullif(c, F.lit("")), f"_{c}").alias(c) if c in columns else F.col(c) for c in records.columns])


def gates(checks: dict[str, DataFrame]) -> DataFrame:
    """(gate, ok, offenders): one row per check; a check is the table of rows that offend it."""
    return reduce(DataFrame.unionByName, [c.agg(F.count("*").alias("offenders")).select(F.lit(g).alias("gate"), (F.col("offenders") == 0).alias("ok"), "offenders") for g, c in checks.items()])


def walk_multiples(start: DataFrame, children: DataFrame, hops: int) -> DataFrame:
    """(id, file, hops): from each start (id, file, path array of nodes) down parent -> child by node, one per hop; a dead end is null."""
    cur = start.withColumn("hops", F.lit(0))
    for i in range(hops):
        c = children.select(F.col("file").alias("_f"), F.col("node").alias("_n"), "child")
        j = cur.join(c, (F.col("file") == F.col("_f")) & (F.get("path", F.lit(i)) == F.col("_n")), "left")
        more = F.size("path") > i
        cur = j.select("id", F.when(more, F.col("child")).otherwise(F.col("file")).alias("file"), "path", F.when(more, F.lit(i + 1)).otherwise(F.col("hops")).alias("hops"))
    return cur.select("id", "file", "hops")


def value_pools(entries: DataFrame, always: list[str], lines: DataFrame | None = None, most: int = 12) -> DataFrame:
    """(entry, position, choice, value): candidate values of every argument, in order: the fixed ones, then literals that
    the entry's own lines compare with or take; each once, at most ``most``.

    entries (entry, formals), lines (entry, line); a null line holds no literal.
    """
    slots = entries.where(F.size("formals") > 0).select("entry", F.explode(F.sequence(F.lit(1), F.size("formals"))).alias("position"))
    fixed = F.array(*[F.lit(v) for v in always])
    if lines is None:
        found = slots.withColumn("own", F.array().cast("array<string>"))
    else:
        text = F.regexp_extract_all("line", F.lit('"((?:[^"]|"")*)"'), F.lit(1))
        digits = F.regexp_extract_all(F.regexp_replace("line", '"(?:[^"]|"")*"', ""), F.lit(r"(?<![A-Za-z0-9.])([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
        own = lines.where(F.col("line").isNotNull()).select("entry", F.explode(F.array_distinct(F.concat(text, digits))).alias("v")).distinct()
        # The least ``most`` literals of an entry, merged before they are gathered.
        w = Window.partitionBy("entry").orderBy("v")
        few = own.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("entry").agg(F.array_sort(F.collect_list("v")).alias("own"))
        found = slots.join(few, "entry", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    values = F.slice(F.array_distinct(F.concat(fixed, "own")), 1, most)
    return found.select("entry", "position", F.posexplode(values).alias("i", "value")).select("entry", "position", (F.col("i") + 1).alias("choice"), "value")


def build_cases(base: DataFrame, pools: DataFrame, extremes: list[str], most: int) -> DataFrame:
    """(entry, case_no, args): the base case, all arguments at each extreme, then one argument at a time; each different
    list of arguments once, at most ``most`` per entry."""
    limits = base.select("entry", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.lit(v).alias("v")) for i, v in enumerate(extremes)])).alias("x"), "args")
    every = limits.select("entry", F.lit(1).alias("kind"), F.lit(0).alias("p"), F.col("x.c").alias("c"), F.transform("args", lambda a: F.col("x.v")).alias("args"))
    one = pools.join(base, "entry").select("entry", F.lit(2).alias("kind"), F.col("position").alias("p"), F.col("choice").alias("c"), F.transform("args", lambda a, i: F.when(i + 1 == F.col("position"), F.col("value")).otherwise(a)).alias("args"))
    all_ = base.select("entry", F.lit(0).alias("kind"), F.lit(0).alias("p"), F.lit(0).alias("c"), "args").unionByName(every).unionByName(one)
    first = all_.groupBy("entry", "args").agg(F.min(F.struct("kind", "c", "p")).alias("o"))
    w = Window.partitionBy("entry").orderBy("o")
    return first.withColumn("case_no", F.row_number().over(w)).where(F.col("case_no") <= most).select("entry", "case_no", "args")


def enough_cases(cases: DataFrame, least: int) -> DataFrame:
    """(entry, cases, enough): entries with their number of cases and whether it is at least ``least``."""
    return cases.groupBy("entry").agg(F.count("*").alias("cases"), (F.count("*") >= least).alias("enough"))


def capture_choice(roots: DataFrame, bounded: DataFrame, limit: int = 2000, reserved: tuple[str, ...] = ()) -> DataFrame:
    """(routine, tier, complete): how to capture what a routine changes: by query if all its roots are small, by trigger
    otherwise. Without roots: none where its writes are known (``bounded``: routine, known), else an incomplete trigger.

    roots (routine, root, nodes, scratch) as in ``capture_tiers``; reserved roots count for nothing.
    """
    per = capture_tiers(roots, limit, reserved).groupBy("routine").agg(F.bool_or(F.col("tier") == "trigger").alias("large"))
    j = bounded.join(per, "routine", "left")
    known = F.coalesce("known", F.lit(False))
    tier = F.when(F.col("large"), "trigger").when(~F.col("large"), "query").when(known, "none").otherwise("trigger")
    return j.select("routine", tier.alias("tier"), (F.col("large").isNotNull() | known).alias("complete"))
