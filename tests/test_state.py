"""State comparison and change plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import statediff as sd


def state(spark, *rows):
    return spark.createDataFrame(list(rows), "ref string, value string")


def plan(spark, *rows):
    return spark.createDataFrame(list(rows), "ref string, op string, before_value string, value string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_absent_null_and_empty_differ(spark):
    a = state(spark, ("same", "1"), ("null", None), ("gone", "x"), ("empty", ""))
    b = state(spark, ("same", "1"), ("null", None), ("new", "y"), ("empty", None))
    got = rows(sd.state_diff(a, b, ["ref"]))
    assert got == [("empty", "changed", "", None), ("gone", "removed", "x", None), ("new", "added", None, "y")]
    assert rows(sd.state_diff(a, a, ["ref"])) == []


def test_pieces_pad_the_shorter_value(spark):
    d = sd.state_diff(state(spark, ("r", "a^b^")), state(spark, ("r", "a^c^^d")), ["ref"])
    assert rows(sd.piece_diff(d, ["ref"])) == [("r", 2, "b", "c"), ("r", 4, "", "d")]


def test_plan_applies_all_or_nothing_and_rolls_back(spark):
    s = state(spark, ("a", "1"), ("b", "2"))
    good = plan(spark, ("a", "set", "1", "9"), ("b", "kill", "2", None), ("c", "set", None, "3"))
    after = sd.apply_plan(good, s)
    assert rows(after) == [("a", "9"), ("c", "3")]
    assert rows(sd.apply_plan(sd.inverse(good), after)) == [("a", "1"), ("b", "2")]
    stale = plan(spark, ("a", "set", "0", "9"), ("b", "kill", "2", None))
    assert rows(sd.apply_plan(stale, s)) == [("a", "1"), ("b", "2")]
    assert sd.ready(stale, s).first()["conflicts"] == 1
    twice = plan(spark, ("a", "set", "1", "9"), ("a", "kill", "1", None))
    assert not sd.ready(twice, s).first()["ready"]


def test_verdict_counts_void_apart(spark):
    cases = spark.createDataFrame([(1, False), (2, True), (3, None)], "case_index int, void boolean")
    diff = spark.createDataFrame([(2,), (3,), (3,)], "case_index int")
    assert tuple(sd.verdict(cases, diff).first()) == (False, 3, 1, 1)
    assert tuple(sd.verdict(cases.where("case_index = 1"), diff.limit(0)).first()) == (True, 1, 0, 0)


def test_upsert_takes_the_newest(spark):
    old = spark.createDataFrame([("Py", 1, "x")], "language string, at int, v string")
    new = spark.createDataFrame([("PY", 1, "y"), ("go", 2, "z")], "language string, at int, v string")
    assert rows(sd.upsert(old, new, F.lower("language"), "at")) == [("PY", 1, "y"), ("go", 2, "z")]


def test_kill_of_a_node_with_descendants_is_refused(spark):
    s = state(spark, ("^A", "0"), ("^A(1)", "1"), ("^A(1,2)", "2"), ("^A(10)", "3"), ('^A("x,y")', "4"), ('^A("x,y","(")', "5"), ('^A("x")', "6"), ("^B(1,2)", "7"), ("^AB", "8"))
    for ref, before, fits in (("^A", "0", False), ("^A(1)", "1", False), ('^A("x,y")', "4", False), ("^B", None, False), ("^B(1)", None, False), ("^A(1,2)", "2", True), ("^A(10)", "3", True), ('^A("x")', "6", True), ('^A("x,y","(")', "5", True), ("^AB", "8", True)):
        p = plan(spark, (ref, "kill", before, None), ("^A(5)", "set", None, "9"))
        assert sd.ready(p, s).first()["conflicts"] == (0 if fits else 1), ref
        if ref in ("^A(1)", "^A(10)"):
            assert rows(sd.apply_plan(p, s)) == (sorted([r for r in rows(s) if r[0] != ref] + [("^A(5)", "9")], key=repr) if fits else rows(s))
    assert sd.ready(plan(spark, ("^A(1)", "set", "1", "9")), s).first()["ready"]
