"""Case sources, limits, references and further readers."""

from __future__ import annotations

import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomwork.functions import refs
from loomwork.operators import cases
from loomwork.sources import files


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_precedence(spark):
    a = spark.createDataFrame([("t", 1, "file")], "id string, n int, v string")
    b = spark.createDataFrame([("t", 1, "x"), ("u", 1, "old"), ("u", 2, "new"), (None, 3, "z")], "id string, n int, v string")
    assert got(cases.by_precedence([a, b], "id", "n")) == [("t", 1, "file"), ("u", 2, "new")]
    want = spark.createDataFrame([("t",), ("u",)], "id string")
    assert got(cases.first_source(want, [a, b], "id")) == [("t", 1, "file"), ("u", 1, "old"), ("u", 2, "new")]
    d = spark.createDataFrame([("r", 1, "{}"), ("r", 2, "{a}"), ("r", 3, "{}")], "routine string, n int, case_json string")
    assert got(cases.distinct_cases(d, "routine", "n")) == [("r", "{a}", 2), ("r", "{}", 1)]


def test_case_making(spark):
    base = spark.createDataFrame([("E", ["1", "2"])], "entry string, args array<string>")
    pools = spark.createDataFrame([("E", 1, 1, "9"), ("E", 2, 1, "2"), ("E", 2, 2, "7")], "entry string, position int, choice int, value string")
    assert got(cases.vary_one(base, pools, 3)) == [("E", 1, ["1", "2"]), ("E", 2, ["9", "2"]), ("E", 3, ["1", "7"])]
    assert [r["batch"] for r in cases.batches(spark.range(5).withColumnRenamed("id", "case_index"), 2).orderBy("case_index").collect()] == [0, 0, 1, 1, 2]


def test_results_and_plans(spark):
    tries = spark.createDataFrame([(1, 1, 1, "bad"), (1, 2, 0, "good"), (2, 1, 1, "x"), (3, 4, 0, "late")], "c int, try int, restarts int, out string")
    assert {(r["c"], r["out"], r["void"]) for r in cases.stable_results(tries, ["c"]).collect()} == {(1, "good", False), (2, None, True), (3, None, True)}
    roots = spark.createDataFrame([("A", 10, False), ("B", 5000, False), ("C", None, True), ("D", None, False), ("X", 1, False)], "root string, nodes int, scratch boolean")
    assert {(r["root"], r["tier"]) for r in cases.capture_tiers(roots, reserved=("X",)).collect()} == {("A", "query"), ("B", "trigger"), ("C", "query"), ("D", "trigger")}
    log = spark.createDataFrame([("r", 1, "set", "a"), ("r", 2, "kill", None)], "ref string, seq int, op string, value string")
    assert got(cases.last_write(log)) == [("r", "kill", None)]
    state = spark.createDataFrame([("a", "1"), ("n", None)], "ref string, value string")
    req = spark.createDataFrame([("a", "set", "1"), ("b", "kill", None), ("c", "set", "x"), ("d", "set", "1"), ("d", "set", "2"), ("n", "set", "v")], "ref string, op string, value string")
    assert {(r["ref"], r["refused"]) for r in cases.capture_plan(req, state).collect()} == {("a", "no change"), ("b", "no change"), ("c", None), ("d", "repeated"), ("n", None)}
    start = spark.createDataFrame([(1, "2", ["S"]), (2, "2", ["?"]), (3, "2", [])], "id int, file string, path array<string>")
    kids = spark.createDataFrame([("2", "S", "2.01")], "file string, node string, child string")
    assert {(r["id"], r["file"]) for r in cases.walk_multiples(start, kids, 2).collect()} == {(1, "2.01"), (2, None), (3, "2")}


def test_references_and_patterns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for ref, ok in {"^A(1)": True, '^A("x""y",2.5)': True, "^A": False, "^A(X)": False, "^A(01)": False, "^A(1": False, '^A("a\nb")': False, "^XTMP(1)": False}.items():
        assert one(refs.safe_ref(F.lit(ref), ("XTMP",))) is ok, ref
    assert one(refs.safe_ref(F.lit(None).cast("string"))) is False
    assert [one(refs.global_root(F.lit(x))) for x in ("DPT", "^DPT(3,0)")] == ["^DPT("] * 2
    assert one(refs.first_difference(F.lit("abc"), F.lit("abd"))) == 3 and one(refs.first_difference(F.lit("a"), F.lit("a"))) is None
    assert one(refs.uses_transactions(F.lit(" S X=1 TS:1 "))) and not one(refs.uses_transactions(F.lit(" S TSX=TS(1)")))
    assert one(refs.blocking_flags(F.array(F.lit("read"), F.lit("fine"), F.lit("nondet:$H")))) == ["nondet:$H", "read"]
    assert [refs.expand_pattern(p) for p in ('3N1"-".A', "2U", "1(1N,1A)", "X", "")] == ["111-", "AA", None, None, ""]
    rec = refs.wire_parse(F.lit("K\t1\nbad\nK\t2\t3"))
    assert one(refs.wire_all(rec, "K")) == ["1", "2\t3"] and one(refs.wire_get(rec, "no")) is None
    assert one(refs.unified_diff(F.lit("a\nb"), F.lit("a\nc"))).endswith("-b\n+c")
    assert one(refs.clamp(F.lit("900"), 1, 10, 5)) == 10 and one(refs.clamp(F.lit("x"), 1, 10, 5)) == 5


def test_task_sets_and_dumps(spark, tmp_path):
    src = spark.createDataFrame([("R", "code")], "routine string, source string")
    task = {"task_id": "t", "routine": "R", "baseline_src": "code", "mutated_src": "m", "cases": [{"routine": "R", "entry": "E", "args": []}]}
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"schema": "s", "tasks": [task]}))
    assert files.task_set(spark, str(p), src).count() == 1
    for bad, why in (({"baseline_src": "other"}, "source changed"), ({"mutated_src": ""}, "missing field"), ({"cases": [{"routine": "Q", "entry": "E", "args": []}]}, "another routine")):
        p.write_text(json.dumps({"schema": "s", "tasks": [{**task, **bad}]}))
        with pytest.raises(Exception, match=why):
            files.task_set(spark, str(p), src).collect()
    d = tmp_path / "dd.txt"
    d.write_text("H|2|P|^DPT(||1\nS|^DPT(|^DPT(1,0)|a|b\nENDDD\n")
    assert got(files.dump_samples(files.dump_lines(spark, str(d)))) == [("^DPT(", "^DPT(1,0)", "a|b")]
    d.write_text("H|2|P|^DPT(||1\n")
    with pytest.raises(Exception, match="end marker"):
        files.dump_lines(spark, str(d)).collect()
    assert files.names_set(spark, str(tmp_path / "none")).count() == 0
    reg = spark.createDataFrame([("fast", "m-1")], "name string, model_id string")
    assert got(files.resolve_models(spark.createDataFrame([("fast",), ("raw",)], "model string"), reg)) == [("fast", "m-1"), ("raw", "raw")]
    with pytest.raises(ValueError):
        files.write_tasks(src.limit(0), str(tmp_path / "w"))
    doc = json.loads(files.document(spark.createDataFrame([("b", 1), ("a", 2)], "name string, n int"), "name", 1, total=F.count("*")).first()[0])
    assert doc == {"total": 2, "rows": [{"name": "a", "n": 2}]}
    assert sha256(b"code").hexdigest()


def test_limits(spark):
    df = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("g", 3, True), ("g", 4, True)], "g string, n int, ok boolean")
    assert [r["n"] for r in cases.capped(df, ["g"], ["n"], F.col("ok"), 2).orderBy("n").collect()] == [1, 2, 3]
    assert {(r["gate"], r["ok"]) for r in cases.gates({"none": df.limit(0), "some": df}).collect()} == {("none", True), ("some", False)}
