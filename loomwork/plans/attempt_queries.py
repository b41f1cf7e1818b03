"""Attempt scoring over the attempts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attempts as a
from ..sources.tables import table


def _records(spark, d, *more):
    return a.first_received(table(spark, d, "attempts"), [*a.SCORED, *more])


def _tasks(spark, d):
    return a.task_attempts(_records(spark, d))


QUERIES = {
    "attempt_duplicates": lambda s, d: a.duplicates(table(s, d, "attempts")),
    "attempts_first": lambda s, d: a.judged(_records(s, d)).select(*a.KEY, "excluded", "passed", "asserted", "verifier_calls"),
    "pass_at_k": lambda s, d: a.pass_at_k(_tasks(s, d), [1, 2, 3, 4]),
    "confidence_rates": lambda s, d: a.confidence(_tasks(s, d)),
    "exclusion_tally": lambda s, d: a.exclusions(_tasks(s, d)),
    "repair_iterations": lambda s, d: a.repair_iterations(_tasks(s, d)),
    "by_operator_difficulty": lambda s, d: a.breakdown(_tasks(s, d)),
    "common_tasks": lambda s, d: a.common_tasks(_tasks(s, d)),
    "bounded_repair": lambda s, d: a.bounded_repair(_records(s, d), 3),
    "progress_snapshot": lambda s, d: a.progress(_records(s, d, "started_at", "finished_at")),
    "attempts_until_done": lambda s, d: a.until_done(_records(s, d)).groupBy("run_id", "condition").agg(F.count("*").alias("attempts"), F.count_if("passed").alias("passed")),
    "model_by_operator": lambda s, d: _records(s, d).where(F.col("operator").isNotNull()).groupBy("operator").pivot("difficulty", ["easy", "medium", "hard"]).count().na.fill(0),
}

_RECORDS = """
records AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, condition, task_id, attempt
  ORDER BY coalesce(received_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), coalesce(started_at, ''), coalesce(CAST(seed AS VARCHAR), ''), coalesce(finished_at, ''), coalesce(CAST(verifier_calls AS VARCHAR), ''), coalesce(model, '')) AS rn
  FROM attempts WHERE run_id IS NOT NULL AND condition IS NOT NULL AND task_id IS NOT NULL AND attempt IS NOT NULL) WHERE rn = 1),
j AS (SELECT *, CASE WHEN coalesce(harness_error, '') <> '' THEN 'harness_error' WHEN verdict IS NULL OR verdict.equivalent IS NULL THEN 'ungraded'
  WHEN coalesce(verdict.n_cases, 0) = 0 OR coalesce(verdict.n_void, 0) > 0 THEN 'void' END AS excluded,
  coalesce(verdict.equivalent, false) AS passed, coalesce(assertion.claimed_correct, submitted, false) AS asserted FROM records)"""
_TASKS = (
    _RECORDS
    + """,
tasks AS (SELECT run_id, condition, task_id, bool_or(attempt = 1) AS has_first, max(CASE WHEN attempt = 1 THEN excluded END) AS first_excluded,
  bool_or(passed) FILTER (attempt = 1 AND excluded IS NULL) AS first_passed, bool_or(asserted) FILTER (attempt = 1 AND excluded IS NULL) AS first_asserted,
  count(*) FILTER (excluded IS NULL) AS scoreable, min(attempt) FILTER (excluded IS NULL AND passed) AS first_pass,
  (array_agg(verifier_calls ORDER BY attempt) FILTER (excluded IS NULL AND passed))[1] AS calls_at_pass,
  max(CASE WHEN excluded IS NULL THEN coalesce(verifier_calls, 0) ELSE 0 END) AS most_calls,
  coalesce((array_agg(operator ORDER BY attempt) FILTER (coalesce(operator, '') <> ''))[1], 'UNKNOWN') AS operator,
  coalesce((array_agg(difficulty ORDER BY attempt) FILTER (coalesce(difficulty, '') <> ''))[1], 'unknown') AS difficulty
  FROM j GROUP BY run_id, condition, task_id),
scored AS (SELECT * FROM tasks WHERE has_first AND first_excluded IS NULL)"""
)

SQL = {
    "attempt_duplicates": """SELECT run_id, condition, task_id, attempt, count(*) - 1 AS extra FROM attempts
        WHERE run_id IS NOT NULL AND condition IS NOT NULL AND task_id IS NOT NULL AND attempt IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
    "attempts_first": f"WITH {_RECORDS} SELECT run_id, condition, task_id, attempt, excluded, passed, asserted, verifier_calls FROM j",
    "pass_at_k": f"""WITH {_TASKS} SELECT run_id, condition, k, count(*) AS n,
        CASE WHEN k = 1 OR min(scoreable) >= k THEN round(count(*) FILTER (CASE WHEN k = 1 THEN first_passed ELSE coalesce(first_pass <= k, false) END) / count(*), 6) END AS rate
        FROM scored, (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS k) ks GROUP BY 1, 2, 3""",
    "confidence_rates": f"""WITH {_TASKS}, c AS (SELECT run_id, condition, count(*) AS n, count(*) FILTER (first_passed) AS passed, count(*) FILTER (first_asserted) AS asserted,
        count(*) FILTER (first_asserted AND NOT first_passed) AS false_confident FROM scored GROUP BY 1, 2)
        SELECT *, round(false_confident / n, 6) AS false_confidence, round(false_confident / nullif(asserted, 0), 6) AS false_given_asserted, round(asserted / n, 6) AS assertion_rate FROM c""",
    "exclusion_tally": f"""WITH {_TASKS}, r AS (SELECT run_id, condition, CASE WHEN NOT has_first THEN 'no_attempt_1' ELSE first_excluded END AS reason FROM tasks)
        SELECT run_id, condition, reason, count(*) AS tasks FROM r WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
    "repair_iterations": f"""WITH {_TASKS}, c AS (SELECT run_id, condition, max(most_calls) > 0 AS tools_used,
        avg(coalesce(calls_at_pass, 0)) FILTER (first_pass IS NOT NULL) AS m, median(coalesce(calls_at_pass, 0)) FILTER (first_pass IS NOT NULL) AS md FROM scored GROUP BY 1, 2)
        SELECT run_id, condition, tools_used, CASE WHEN tools_used THEN round(m, 6) END AS mean_calls, CASE WHEN tools_used THEN md END AS median_calls FROM c""",
    "by_operator_difficulty": f"""WITH {_TASKS}, s AS (SELECT *, first_asserted AND NOT first_passed AS wrong FROM scored),
        l AS (SELECT condition, 'operator' AS level, operator AS value, first_passed, wrong FROM s UNION ALL SELECT condition, 'difficulty', difficulty, first_passed, wrong FROM s UNION ALL SELECT condition, 'all', 'all', first_passed, wrong FROM s)
        SELECT condition, level, value, count(*) AS n, round(count(*) FILTER (first_passed) / count(*), 6) AS pass_rate, round(count(*) FILTER (wrong) / count(*), 6) AS false_confidence FROM l GROUP BY 1, 2, 3""",
    "common_tasks": f"""WITH {_TASKS} SELECT task_id FROM scored GROUP BY 1 HAVING count(DISTINCT condition) = (SELECT count(DISTINCT condition) FROM tasks)""",
    "bounded_repair": f"""WITH {_RECORDS}, t AS (SELECT run_id, condition, task_id, min(attempt) FILTER (passed) AS tries, count(DISTINCT attempt) FILTER (excluded IS NULL) AS have FROM j WHERE attempt <= 3 GROUP BY 1, 2, 3)
        SELECT run_id, condition, count(*) AS tasks, count(tries) AS solved, count(*) FILTER (tries IS NULL AND have < 3) AS incomplete,
        CASE WHEN count(*) FILTER (tries IS NULL AND have < 3) = 0 THEN round(count(tries) / count(*), 6) END AS rate, round(avg(tries), 6) AS mean_tries FROM t GROUP BY 1, 2""",
    "progress_snapshot": f"""WITH {_RECORDS}, p AS (SELECT *, (epoch_us(CAST(finished_at AS TIMESTAMPTZ)) - epoch_us(CAST(started_at AS TIMESTAMPTZ))) / 1e6 AS secs FROM records)
        SELECT condition, count(*) AS records, count(secs) AS finished, round(avg(secs), 6) AS mean_seconds, round(median(secs), 6) AS median_seconds,
        count(*) FILTER (attempt = 1 AND verdict.equivalent) AS first_passed, count(*) FILTER (attempt = 1 AND coalesce(assertion.claimed_correct, false)) AS first_claimed,
        count(*) FILTER (attempt = 1 AND coalesce(assertion.claimed_correct, false) AND NOT verdict.equivalent) AS first_false_confident FROM p GROUP BY 1""",
    "attempts_until_done": f"""WITH {_RECORDS}, s AS (SELECT *, min(attempt) FILTER (passed OR coalesce(excluded = 'harness_error', false)) OVER (PARTITION BY run_id, condition, task_id) AS stop FROM j)
        SELECT run_id, condition, count(*) AS attempts, count(*) FILTER (passed) AS passed FROM s WHERE stop IS NULL OR attempt <= stop GROUP BY 1, 2""",
    "model_by_operator": f"""WITH {_RECORDS} SELECT operator, count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'medium') AS medium, count(*) FILTER (difficulty = 'hard') AS hard FROM records WHERE operator IS NOT NULL GROUP BY 1""",
}
