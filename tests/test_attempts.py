"""Golden tables of attempt scoring."""

from __future__ import annotations

import pytest

from loomwork.operators import attempts as a

SCHEMA = (
    "run_id string, condition string, task_id string, routine string, operator string, difficulty string, attempt int, model string, seed bigint, started_at string, finished_at string, submitted boolean, "
    "assertion struct<claimed_correct:boolean,source:string,evidence:string>, verifier_calls int, verdict struct<equivalent:boolean,n_cases:int,n_diverged:int,n_void:int>, harness_error string, received_at timestamp, "
    "tool_calls array<struct<name:string,equivalent:boolean>>"
)


def rec(task="T1", attempt=1, passed=False, submitted=True, claimed=None, calls=None, void=0, cases=5, error=None, graded=True, condition="baseline", operator="CMP_FLIP", tools=None):
    verdict = (passed, cases, 0 if passed else 1, void) if graded else None
    return ("r", condition, task, "R", operator, "easy", attempt, "m", 1, None, None, submitted, (claimed, "final", None), calls, verdict, error, None, tools)


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def scores(df, ks=(1, 2, 3)):
    return {r["k"]: r["rate"] for r in a.pass_at_k(a.task_attempts(df), list(ks)).collect()}


def test_pass_at_one_counts_first_attempts(frame):
    assert scores(frame(rec("T1", 1), rec("T1", 2, True), rec("T2", 1, True)))[1] == 0.5


def test_pass_at_k_needs_k_attempts_of_every_task(frame):
    two = frame(rec("T1", 1), rec("T1", 2, True))
    assert scores(two)[3] is None
    three = frame(*[rec("T1", i, i == 3) for i in (1, 2, 3)], *[rec("T2", i) for i in (1, 2, 3)])
    assert scores(three)[1] == 0 and scores(three)[3] == 0.5


def test_confidence(frame):
    df = frame(rec("a"), rec("b", passed=True), rec("c", submitted=False), rec("d", claimed=False))
    r = a.confidence(a.task_attempts(df)).first()
    assert (r["n"], r["false_confident"], r["false_confidence"], r["assertion_rate"], r["false_given_asserted"]) == (4, 1, 0.25, 0.5, 0.5)


def test_repair_iterations(frame):
    df = frame(rec("T1", 1, calls=1), rec("T1", 2, True, calls=3), rec("T2", 1, True, calls=1))
    r = a.repair_iterations(a.task_attempts(df)).first()
    assert (r["tools_used"], r["mean_calls"], r["median_calls"]) == (True, 2.0, 2.0)
    r = a.repair_iterations(a.task_attempts(frame(rec("T1", 1, True)))).first()
    assert (r["tools_used"], r["mean_calls"]) == (False, None)


def test_exclusions(frame):
    df = frame(rec("a", void=1), rec("b", graded=False), rec("c", error="died"), rec("d", passed=True), rec("e", 2), rec("f", cases=0))
    got = {r["reason"]: r["tasks"] for r in a.exclusions(a.task_attempts(df)).collect()}
    assert got == {"void": 2, "ungraded": 1, "harness_error": 1, "no_attempt_1": 1}
    assert a.confidence(a.task_attempts(df)).first()["n"] == 1


def test_breakdown_takes_first_named_operator(frame):
    df = frame(rec("a", passed=True), rec("b"), rec("c", operator="NAKED_REF"), rec("d", operator=None))
    got = {r["value"]: (r["n"], r["pass_rate"]) for r in a.breakdown(a.task_attempts(df)).where("level = 'operator'").collect()}
    assert got == {"CMP_FLIP": (2, 0.5), "NAKED_REF": (1, 0.0), "UNKNOWN": (1, 0.0)}


def test_common_tasks(frame):
    df = frame(rec("T1"), rec("T2"), rec("T1", condition="scaffolded"), rec("T3", condition="scaffolded"))
    assert [r[0] for r in a.common_tasks(a.task_attempts(df)).collect()] == ["T1"]


def test_duplicates_are_reported_not_merged(frame):
    df = frame(rec("T1"), rec("T1"), rec("T1"), rec("T2"))
    assert [r["extra"] for r in a.duplicates(df).collect()] == [2]
    assert a.first_received(df).count() == 2


def test_bounded_repair_is_void_when_incomplete(frame):
    full = frame(rec("T1", 1), rec("T1", 2, True), *[rec("T2", i) for i in (1, 2)])
    r = a.bounded_repair(full, 2).first()
    assert (r["rate"], r["mean_tries"]) == (0.5, 2.0)
    assert a.bounded_repair(full, 3).first()["rate"] is None


def test_tool_verdicts(frame):
    said = [("read", None), ("verify_change", True)]
    df = frame(rec("a", tools=said), rec("b", tools=[]), rec("c"), rec("d", passed=True, tools=said))
    assert a.tool_disagreements(df).first()["disagreements"] == 1
    got = [r[0] for r in df.orderBy("task_id").select(a.verifier_call_count(df["verifier_calls"], df["tool_calls"])).collect()]
    assert got[0] == 1 and got[1] == 0


def test_empty_table(frame):
    assert scores(frame()) == {} and a.progress(frame()).count() == 0
