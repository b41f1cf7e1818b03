"""Scoring of attempt records: exclusions, pass rates, confidence, repair, breakdowns, comparison and progress.

A record is one attempt of a task under a condition in a run. It can be scored unless it has a harness error, no
verdict, or a void one (no cases, or any void case). A task counts under a condition if its first attempt can be
scored. All statistics are aggregates over (run, condition, task) rows, which combine before the shuffle.

Nulls: a record without run, condition, task or attempt belongs to no key and is dropped by ``first_received``;
``equivalent`` null reads as not passed; rates over nothing are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id", "condition", "task_id", "attempt"]
TASK = ["run_id", "condition", "task_id"]
#: What scoring reads of a record besides its key.
SCORED = ["operator", "difficulty", "submitted", "assertion", "verifier_calls", "verdict", "harness_error"]


def _order() -> F.Column:
    at = F.coalesce("received_at", F.lit("9999-01-01").cast("timestamp"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.struct(at.alias("at"), text("started_at").alias("s"), text("seed").alias("d"), text("finished_at").alias("f"), text("verifier_calls").alias("c"), text("model").alias("m"))


def first_received(attempts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per attempt key, that which arrived first, with ``columns`` (all by default).

    min_by combines before the shuffle, so no key is hot; what it carries cannot be pruned later, hence ``columns``.
    """
    rows = attempts.dropna(subset=KEY)
    kept = [c for c in (columns or rows.columns) if c not in KEY]
    return rows.groupBy(*KEY).agg(F.min_by(F.struct(*kept), _order()).alias("r")).select(*KEY, "r.*")


def duplicates(attempts: DataFrame) -> DataFrame:
    """(key, extra): attempt keys delivered more than once and how often beyond the first."""
    return attempts.dropna(subset=KEY).groupBy(*KEY).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def judged(records: DataFrame) -> DataFrame:
    """Adds ``excluded`` (harness_error, ungraded, void or null), ``passed`` and ``asserted``."""
    v = F.col("verdict")
    reason = (
        F.when(F.coalesce("harness_error", F.lit("")) != "", "harness_error")
        .when(v.isNull() | v["equivalent"].isNull(), "ungraded")
        .when((F.coalesce(v["n_cases"], F.lit(0)) == 0) | (F.coalesce(v["n_void"], F.lit(0)) > 0), "void")
    )
    return records.select(
        "*", reason.alias("excluded"), F.coalesce(v["equivalent"], F.lit(False)).alias("passed"),
        F.coalesce(F.col("assertion.claimed_correct"), F.col("submitted"), F.lit(False)).alias("asserted"),
    )


def verifier_call_count(calls, tool_calls) -> F.Column:
    """The stated number of verifier calls, else the number of verifying tool calls."""
    names = ["verify_change", "run_task_cases"]  # fixed values: the tools that verify
    return F.coalesce(calls, F.size(F.filter(tool_calls, lambda t: t["name"].isin(names))))


def last_tool_verdict(tool_calls) -> F.Column:
    """What the last verifying tool call that answered said; false if none did."""
    names = ["verify_change", "run_task_cases"]
    answered = F.filter(tool_calls, lambda t: t["name"].isin(names) & t["equivalent"].isNotNull())
    return F.coalesce(F.try_element_at(answered, F.lit(-1))["equivalent"], F.lit(False))


def tool_disagreements(records: DataFrame) -> DataFrame:
    """(condition, disagreements): scoreable attempts that failed although their last verifying tool call said equal."""
    j = judged(records).where(F.col("excluded").isNull())
    return j.groupBy("condition").agg(F.count_if(last_tool_verdict(F.col("tool_calls")) & ~F.col("passed")).alias("disagreements"))


def task_attempts(records: DataFrame) -> DataFrame:
    """One row per run, condition and task: its first attempt, its scoreable attempts and its first pass."""
    j = judged(records)
    ok = F.col("excluded").isNull()
    win = ok & F.col("passed")
    first = F.col("attempt") == 1
    named = lambda c: F.min_by(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("attempt", c)))
    return j.groupBy(*TASK).agg(
        F.max(F.when(first, F.lit(True))).alias("has_first"),
        F.max(F.when(first, F.col("excluded"))).alias("first_excluded"),
        F.max(F.when(first & ok, F.col("passed"))).alias("first_passed"),
        F.max(F.when(first & ok, F.col("asserted"))).alias("first_asserted"),
        F.count_if(ok).alias("scoreable"),
        F.min(F.when(win, F.col("attempt"))).alias("first_pass"),
        F.min_by("verifier_calls", F.when(win, F.col("attempt"))).alias("calls_at_pass"),
        F.max(F.coalesce(F.when(ok, F.col("verifier_calls")), F.lit(0))).alias("most_calls"),
        F.count("*").alias("attempts"),
        F.coalesce(named("operator"), F.lit("UNKNOWN")).alias("operator"),
        F.coalesce(named("difficulty"), F.lit("unknown")).alias("difficulty"),
    )


def exclusion_of(task) -> F.Column:
    return F.when(F.col("has_first").isNull(), "no_attempt_1").otherwise(F.col("first_excluded"))


def scored(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("has_first") & F.col("first_excluded").isNull())


def pass_at_k(tasks: DataFrame, ks: list[int]) -> DataFrame:
    """(run_id, condition, k, n, rate); rate is null unless every scored task has k scoreable attempts."""
    t = scored(tasks)
    cols = []
    for k in ks:
        hit = F.col("first_passed") if k == 1 else F.coalesce(F.col("first_pass") <= k, F.lit(False))
        enough = F.lit(True) if k == 1 else F.min("scoreable") >= k
        cols.append(F.struct(F.lit(k).alias("k"), F.when(enough, F.round(F.count_if(hit) / F.count("*"), 6)).alias("rate")))
    per = t.groupBy("run_id", "condition").agg(F.count("*").alias("n"), F.array(*cols).alias("rates"))
    return per.select("run_id", "condition", "n", F.explode("rates").alias("r")).select("run_id", "condition", "r.k", "n", "r.rate")


def confidence(tasks: DataFrame) -> DataFrame:
    """Passes, assertions and false confidence over scored tasks' first attempts."""
    wrong = F.col("first_asserted") & ~F.col("first_passed")
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return scored(tasks).groupBy("run_id", "condition").agg(
        F.count("*").alias("n"), F.count_if("first_passed").alias("passed"), F.count_if("first_asserted").alias("asserted"), F.count_if(wrong).alias("false_confident"),
        rate(F.count_if(wrong), F.count("*")).alias("false_confidence"),
        rate(F.count_if(wrong), F.count_if("first_asserted")).alias("false_given_asserted"),
        rate(F.count_if("first_asserted"), F.count("*")).alias("assertion_rate"),
    )


def exclusions(tasks: DataFrame) -> DataFrame:
    """(run_id, condition, reason, tasks)"""
    return tasks.withColumn("reason", exclusion_of(tasks)).where(F.col("reason").isNotNull()).groupBy("run_id", "condition", "reason").agg(F.count("*").alias("tasks"))


def repair_iterations(tasks: DataFrame) -> DataFrame:
    """Mean and exact median of verifier calls at the first pass; null where no attempt used the verifier."""
    t = scored(tasks)
    used = F.max("most_calls") > 0
    calls = F.when(F.col("first_pass").isNotNull(), F.coalesce("calls_at_pass", F.lit(0)))
    return t.groupBy("run_id", "condition").agg(used.alias("tools_used"), F.when(used, F.round(F.avg(calls), 6)).alias("mean_calls"), F.when(used, F.median(calls)).alias("median_calls"))


def breakdown(tasks: DataFrame) -> DataFrame:
    """Scores by operator, by difficulty and over all, in one pass over grouping sets."""
    t = scored(tasks).withColumn("wrong", F.col("first_asserted") & ~F.col("first_passed"))
    g = t.groupingSets([["condition", "operator"], ["condition", "difficulty"], ["condition"]], "condition", "operator", "difficulty")
    out = g.agg(F.count("*").alias("n"), F.round(F.count_if("first_passed") / F.count("*"), 6).alias("pass_rate"), F.round(F.count_if("wrong") / F.count("*"), 6).alias("false_confidence"), F.grouping("operator").alias("go"), F.grouping("difficulty").alias("gd"))
    level = F.when(F.col("go") == 0, "operator").when(F.col("gd") == 0, "difficulty").otherwise("all")
    return out.select("condition", level.alias("level"), F.coalesce("operator", "difficulty", F.lit("all")).alias("value"), "n", "pass_rate", "false_confidence")


def common_tasks(tasks: DataFrame) -> DataFrame:
    """(task_id): tasks scored under every condition that occurs."""
    t = scored(tasks).select("task_id", "condition").distinct()
    wanted = tasks.select("condition").distinct().agg(F.count("*").alias("wanted"))
    per = t.groupBy("task_id").agg(F.count("*").alias("seen"))
    return per.join(F.broadcast(wanted)).where("seen = wanted").select("task_id")  # one row


def bounded_repair(records: DataFrame, budget: int) -> DataFrame:
    """Success within ``budget`` attempts; incomplete tasks (no pass, not all attempts scoreable) void the rate."""
    j = judged(records).where(F.col("attempt") <= budget)
    t = j.groupBy(*TASK).agg(F.min(F.when(F.col("passed"), F.col("attempt"))).alias("tries"), F.countDistinct(F.when(F.col("excluded").isNull(), F.col("attempt"))).alias("have"))
    incomplete = F.col("tries").isNull() & (F.col("have") < budget)
    return t.groupBy("run_id", "condition").agg(
        F.count("*").alias("tasks"), F.count("tries").alias("solved"), F.count_if(incomplete).alias("incomplete"),
        F.when(F.count_if(incomplete) == 0, F.round(F.count("tries") / F.count("*"), 6)).alias("rate"), F.round(F.avg("tries"), 6).alias("mean_tries"),
    )


def progress(records: DataFrame) -> DataFrame:
    """Finished attempts, mean and median seconds, and first-attempt tallies per condition. Times carry offsets."""
    secs = (F.unix_micros(F.to_timestamp("finished_at")) - F.unix_micros(F.to_timestamp("started_at"))) / 1e6
    first = F.col("attempt") == 1
    graded = F.col("verdict.equivalent").isNotNull()
    claimed = F.coalesce("assertion.claimed_correct", F.lit(False))
    return records.withColumn("secs", secs).groupBy("condition").agg(
        F.count("*").alias("records"), F.count("secs").alias("finished"), F.round(F.avg("secs"), 6).alias("mean_seconds"), F.round(F.median("secs"), 6).alias("median_seconds"),
        F.count_if(first & F.col("verdict.equivalent")).alias("first_passed"), F.count_if(first & claimed).alias("first_claimed"),
        F.count_if(first & claimed & graded & ~F.col("verdict.equivalent")).alias("first_false_confident"),
    )


def until_done(records: DataFrame) -> DataFrame:
    """Attempts up to the first that passed or broke the harness, per task."""
    stop = F.when(F.col("passed") | (F.col("excluded") == "harness_error"), F.col("attempt"))
    w = Window.partitionBy(*TASK)
    return judged(records).withColumn("stop", F.min(stop).over(w)).where(F.col("stop").isNull() | (F.col("attempt") <= F.col("stop"))).drop("stop")
