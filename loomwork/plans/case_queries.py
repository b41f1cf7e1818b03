"""Cases, limits, gates and references over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs
from ..operators import attempts, cases, mumps, ranking
from ..operators.search import union_all
from ..sources.tables import table
from .attempt_queries import _RECORDS
from .routine_queries import _routines


def _tasks(s, d):
    return table(s, d, "mutation_tasks").where("task_no IS NOT NULL").groupBy("task_no").agg(*[F.max(c).alias(c) for c in ("task_id", "routine", "operator", "difficulty", "n_diverged", "line_no", "original_line", "mutated_line")])


def _gates(s, d):
    a = attempts.first_received(table(s, d, "attempts"), ["model"])
    t = table(s, d, "mutation_tasks")
    train = t.where("lower(trim(split)) = 'train'").select("task_id").distinct()
    return cases.gates({
        "one_model_per_condition": a.groupBy("condition").agg(F.countDistinct("model").alias("n")).where("n > 1"),
        "known_tasks": a.join(t.select("task_id").distinct(), "task_id", "left_anti").select("task_id").distinct(),
        "no_train_tasks": a.join(train, "task_id", "left_semi").select("task_id").distinct(),
        "no_duplicates": attempts.duplicates(table(s, d, "attempts")),
        "attempts_from_one": a.where("attempt < 1"),
    })


def _qa_calls(s, d):
    f = mumps.routine_facts(_routines(s, d)).where("error IS NULL")
    q = lambda source, text, col: f.where(F.size(col) > 0).select("name", F.lit(source).alias("source"), F.concat(F.lit(text), "name", F.lit("?")).alias("question"), F.array_join(col, ", ").alias("answer"))
    naked = mumps.naked_references(_routines(s, d)).where(F.col("resolved").isNotNull())
    idiom = naked.select("name", F.lit("idiom").alias("source"), F.concat(F.lit("What does "), "raw", F.lit(" mean on line "), F.col("line").cast("string"), F.lit(" of "), "name", F.lit("?")).alias("question"), F.col("resolved").alias("answer"))
    parts = [q("call_graph", "Which routines are called by ", "calls"), q("globals", "Which globals are written by ", "globals_written"), q("globals", "Which globals are read by ", "globals_read"), idiom]
    return union_all(parts)


def _vary(s, d):
    l = table(s, d, "routine_labels").where("file_id IS NOT NULL AND seq IS NOT NULL AND size(formals) > 0").groupBy("file_id", "seq").agg(F.max("formals").alias("formals"))
    base = l.select(F.concat_ws("#", "file_id", "seq").alias("entry"), F.transform("formals", lambda x: F.lit("1")).alias("args"))
    pools = base.select("entry", F.explode(F.sequence(F.lit(1), F.size("args"))).alias("position")).select("entry", "position", F.posexplode(F.array(F.lit(""), F.lit("0"), F.lit("-1"), F.lit("A"))).alias("i", "value")).select("entry", "position", (F.col("i") + 1).alias("choice"), "value")
    return cases.vary_one(base, pools, 8)


QUERIES = {
    "trace_summary": lambda s, d: attempts.judged(attempts.first_received(table(s, d, "attempts"), attempts.SCORED)).groupBy("condition").agg(F.count("*").alias("records"), F.countDistinct("task_id").alias("tasks"), F.count_if(F.col("excluded") == "void").alias("void"), F.count_if(F.col("excluded") == "ungraded").alias("ungraded"), F.count_if(F.col("excluded") == "harness_error").alias("harness_error")),
    "report_gates": _gates,
    "best_per_group": lambda s, d: cases.best_of(_tasks(s, d), ["operator"], [F.desc_nulls_last("n_diverged"), F.col("task_no")], 3).select("operator", "place", "task_no", "n_diverged"),
    "capped_admission": lambda s, d: cases.capped(_tasks(s, d).withColumn("routine", F.coalesce("routine", F.lit(""))), ["routine"], ["task_no"], F.coalesce(F.col("n_diverged") > 2, F.lit(False)), 2).groupBy("routine").agg(F.count("*").alias("tried")),
    "until_target": lambda s, d: cases.until_target(_tasks(s, d).where("routine IS NOT NULL").groupBy("routine").agg(F.count_if(F.col("n_diverged") > 2).alias("gain")), ["routine"], "gain", 50),
    "fill_blank": lambda s, d: cases.fill_blank(attempts.first_received(table(s, d, "attempts"), ["operator"]).select("run_id", "condition", "task_id", "attempt", "operator"), _tasks(s, d).select("task_id", "operator"), "task_id", ["operator"]),
    "first_difference": lambda s, d: _tasks(s, d).where("original_line IS NOT NULL AND mutated_line IS NOT NULL").select("task_no", refs.first_difference(F.col("original_line"), F.col("mutated_line")).alias("at_place")),
    "safe_refs": lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("^ORD("), "o_orderkey", F.lit(")"))).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit('^ORD("a""b",'), "o_orderkey", F.lit(",0)"))).when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("^ORD(X"), "o_orderkey", F.lit(")"))).when(F.col("o_orderkey") % 5 == 3, F.lit("^ORD")).alias("ref")).select("o_orderkey", refs.safe_ref(F.col("ref"), ("XTMP",)).alias("safe")),
    "call_questions": _qa_calls,
    "case_suites": _vary,
    "diff_texts": lambda s, d: _tasks(s, d).where("original_line IS NOT NULL AND mutated_line IS NOT NULL").select("task_no", refs.unified_diff("original_line", "mutated_line").alias("diff"), ranking.similarity_difficulty(F.col("original_line"), F.col("mutated_line")).alias("difficulty")),
    "transaction_lines": lambda s, d: mumps.lexed_lines(_routines(s, d)).where(refs.uses_transactions(F.col("code"))).groupBy("name").agg(F.count("*").alias("lines")),
}

_T = "t AS (SELECT task_no, max(task_id) AS task_id, max(routine) AS routine, max(operator) AS operator, max(difficulty) AS difficulty, max(n_diverged) AS n_diverged, max(original_line) AS original_line, max(mutated_line) AS mutated_line FROM mutation_tasks WHERE task_no IS NOT NULL GROUP BY 1)"

SQL = {
    "trace_summary": f"WITH {_RECORDS} SELECT condition, count(*) AS records, count(DISTINCT task_id) AS tasks, count(*) FILTER (excluded = 'void') AS void, count(*) FILTER (excluded = 'ungraded') AS ungraded, count(*) FILTER (excluded = 'harness_error') AS harness_error FROM j GROUP BY 1",
    "report_gates": f"""WITH {_RECORDS}, tr AS (SELECT DISTINCT task_id FROM mutation_tasks WHERE lower(trim(split)) = 'train'), g AS (
        SELECT 'one_model_per_condition' AS gate, count(*) AS offenders FROM (SELECT condition FROM records GROUP BY 1 HAVING count(DISTINCT model) > 1)
        UNION ALL SELECT 'known_tasks', count(DISTINCT task_id) FROM records WHERE task_id NOT IN (SELECT task_id FROM mutation_tasks WHERE task_id IS NOT NULL)
        UNION ALL SELECT 'no_train_tasks', count(DISTINCT task_id) FROM records WHERE task_id IN (SELECT task_id FROM tr)
        UNION ALL SELECT 'no_duplicates', count(*) FROM (SELECT 1 FROM attempts WHERE run_id IS NOT NULL AND condition IS NOT NULL AND task_id IS NOT NULL AND attempt IS NOT NULL GROUP BY run_id, condition, task_id, attempt HAVING count(*) > 1)
        UNION ALL SELECT 'attempts_from_one', count(*) FROM records WHERE attempt < 1) SELECT gate, offenders = 0 AS ok, offenders FROM g""",
    "best_per_group": f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY n_diverged DESC NULLS LAST, task_no) AS place FROM t) SELECT operator, place, task_no, n_diverged FROM r WHERE place <= 3",
    "capped_admission": f"WITH {_T}, c AS (SELECT *, coalesce(sum(CASE WHEN n_diverged > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY coalesce(routine, '') ORDER BY task_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t) SELECT coalesce(routine, '') AS routine, count(*) AS tried FROM c WHERE b < 2 GROUP BY 1",
    "until_target": f"WITH {_T}, g AS (SELECT routine, count(*) FILTER (n_diverged > 2) AS gain FROM t WHERE routine IS NOT NULL GROUP BY 1), r AS (SELECT *, coalesce(sum(gain) OVER (ORDER BY routine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT routine, gain FROM r WHERE b < 50",
    "fill_blank": f"WITH {_RECORDS}, {_T}, f AS (SELECT task_id, max(operator) AS op FROM t GROUP BY 1) SELECT run_id, condition, records.task_id, attempt, coalesce(nullif(operator, ''), op) AS operator FROM records LEFT JOIN f ON f.task_id = records.task_id",
    "first_difference": f"WITH {_T}, x AS (SELECT task_no, list_filter(range(1, greatest(length(original_line), length(mutated_line)) + 1), lambda i: original_line[i:i] <> mutated_line[i:i]) AS p FROM t WHERE original_line IS NOT NULL AND mutated_line IS NOT NULL) SELECT task_no, CAST(p[1] AS INTEGER) AS at_place FROM x",
    "safe_refs": "SELECT o_orderkey, o_orderkey % 5 < 2 AS safe FROM orders",
}
