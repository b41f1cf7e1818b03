"""Problem 3: splits that keep related records together.

Records that share an entity or an author are one unit, also through chains. Units are the connected components of the
bipartite graph of entities and authors: every round each root hooks to its least neighbour, pointers are shortcut to
their roots, and the edges contract onto roots, so at least half of the open roots disappear per round. The split then
takes whole units whose sizes add up closest to the wanted totals: subset sums as bitsets over the multiplicities of
unit sizes, of which there are at most the square root of twice the number of records.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.skew import ranked, skew_join
from ..sources.scratch import Scratch

# What stands where an author should be and names nobody.
NOBODY = ["", "-", "--", "---", "?", "??", "???", ".", "_", "n/a", "na", "n.a.", "none", "null", "nil", "nobody", "no one", "noone", "anonymous", "anon", "unknown", "unassigned", "undefined", "tbd", "tba", "todo", "not available", "no author", "not known", "(none)", "(unknown)", "<unknown>", "<none>"]


def routine_name(routine, task_id) -> F.Column:
    """Upper case, without outer blanks, leading ``^`` or ending ``.M``; a leading ``_`` reads ``%``. If null: task_id up to the first ``-``."""
    raw = F.upper(F.regexp_replace(F.coalesce(routine, F.substring_index(task_id, "-", 1)), r"^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\^\s*", ""), r"\.M$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), "^_", "%")


def author_name(author) -> F.Column:
    """Lower case, without outer blanks and a leading ``@``; null where it names nobody."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(author, r"^\s+|\s+$", ""), r"^@\s*", ""))
    return F.when(~bare.isin(NOBODY) & bare.rlike(r"[\p{L}\p{N}]"), bare)


def task_facts(tasks: DataFrame) -> DataFrame:
    """(task_no, name, who): every routine and author that some delivery of a task names, as they compare. Tasks without
    number are left out; a delivery with neither routine nor task_id is its own entity, ``#`` and its number."""
    name = F.coalesce(routine_name(F.col("routine"), F.col("task_id")), F.concat(F.lit("#"), F.col("task_no").cast("string")))
    return tasks.where(F.col("task_no").isNotNull()).select("task_no", name.alias("name"), author_name(F.col("author")).alias("who")).distinct()


# ---- split totals -------------------------------------------------------------------------------------------------


def closest_subset(sizes: Iterable[tuple[int, int]], target: int) -> dict[int, int]:
    """How many units of each size to take so that their total is closest to ``target`` (the smaller total of two).

    ``sizes``: (size, number of units). Reachable sums are the bits of an integer; a size that occurs m times enters in
    binary portions. Bitsets are kept at every sqrt-th portion and recomputed between, so memory stays at a few dozen
    bitsets of ``target`` plus one largest unit.
    """
    portions: list[tuple[int, int]] = []
    for size, m in sorted(sizes, reverse=True):
        k = 1
        while m > 0 and size > 0:
            take = min(k, m)
            portions.append((size, take))
            m -= take
            k *= 2
    limit = target + max((s for s, _ in portions), default=0)
    mask = (1 << (limit + 1)) - 1
    step = max(1, int(len(portions) ** 0.5))
    marks, reach = {0: 1}, 1
    for i, (size, take) in enumerate(portions, 1):
        reach |= (reach << (size * take)) & mask
        if i % step == 0:
            marks[i] = reach
    low = reach & ((1 << (target + 1)) - 1)
    below = low.bit_length() - 1
    high = reach >> (target + 1)
    above = target + 1 + ((high & -high).bit_length() - 1) if high else None
    total = above if above is not None and above - target < target - below else below
    chosen: dict[int, int] = {}
    at = len(portions)
    while at > 0 and total > 0:
        base = (at - 1) // step * step
        states = [marks[base]]
        for size, take in portions[base : at - 1]:
            states.append(states[-1] | ((states[-1] << (size * take)) & mask))
        for i in range(at - 1, base - 1, -1):
            size, take = portions[i]
            if not (states[i - base] >> total) & 1:
                chosen[size] = chosen.get(size, 0) + take
                total -= size * take
        at = base
    return chosen


def split_plan(sizes: dict[int, int], proportions: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, from rank, to rank): which units of each size go to which split; the first split takes the rest."""
    total = sum(s * m for s, m in sizes.items())
    left, plan, used = dict(sizes), [], dict.fromkeys(sizes, 0)
    first, *others = proportions
    for split in others:
        taken = closest_subset(left.items(), round(total * proportions[split]))
        for size, m in taken.items():
            plan.append((size, split, used[size] + 1, used[size] + m))
            used[size] += m
            left[size] -= m
    plan += [(size, first, used[size] + 1, m) for size, m in sizes.items() if used[size] < m]
    return plan


def assign_units(tasks: DataFrame, scratch: Scratch) -> DataFrame:
    """(task_no, unit_key) of every task; unit_key is the least routine name of its component.

    All deliveries of a task tie: a delivery without author hides none of another's, and different routines or authors
    of one task belong to one unit.
    """
    t = scratch.keep(task_facts(tasks))
    named = scratch.keep(t.groupBy("task_no").agg(F.min("name").alias("name"), F.max("name").alias("last")))
    authors = t.select("name", F.concat(F.lit("a"), "who").alias("who"))
    several = named.where(F.col("name") != F.col("last")).select("task_no")
    own = skew_join(t.select("task_no", "name"), several, ["task_no"], "left_semi").select("name", F.concat(F.lit("t"), F.col("task_no").cast("string")).alias("who"))
    units = components(authors.unionByName(own).distinct(), scratch)
    return skew_join(named.drop("last"), units, ["name"]).select("task_no", F.col("unit").alias("unit_key"))


def grouped_split(tasks: DataFrame, proportions: dict[str, float] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(task_no, unit_key, split) with splits of whole units, their totals as close to ``proportions`` as units allow.

    Defined results: no tasks give no rows; a task delivered several times is one task; a unit larger than a split's total goes wherever the closest sum puts it,
    usually to the first split. Equal inputs give equal splits: units of one size are ordered by a hash of their key.
    """
    proportions = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    scratch = scratch or Scratch(tasks.sparkSession)
    spark = tasks.sparkSession
    units = scratch.keep(assign_units(tasks, scratch))
    sized = scratch.keep(units.groupBy("unit_key").agg(F.count("*").alias("size")))
    sizes = {r["size"]: r["m"] for r in sized.groupBy("size").agg(F.count("*").alias("m")).collect()}  # at most sqrt(2 n) sizes
    plan = spark.createDataFrame(split_plan(sizes, proportions) or [(0, "", 0, 0)], "size bigint, split string, lo bigint, hi bigint")
    placed = ranked(sized, ["size"], ["unit_key"], "rank")
    where = placed.join(F.broadcast(plan), (placed["size"] == plan["size"]) & F.col("rank").between(F.col("lo"), F.col("hi"))).select("unit_key", "split")
    return skew_join(units, where, ["unit_key"])
