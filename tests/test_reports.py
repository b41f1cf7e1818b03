"""Differences in words, recordings, readers and writers, cases and guards of mutants on small inputs."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from loomwork.operators import cases, dictionary, mumps, mutants, reports, training
from loomwork.sources import files


def edits(src, operator):
    return {(e.line, e.text, e.detail) for e in mutants.OPERATORS[operator](mutants.Code(mumps.lex(src)))}


def details(src, operator):
    return {d for *_, d in edits(src, operator)}


def test_flips_leave_formats_patterns_and_assignments():
    assert edits("R ;\n W !,?5,X S A=B F I=1:1:3 R !X\n", "CMP_FLIP") == set()
    assert details("R ;\n S X=A'?1N.A,Y=B]]C I A&B!C\n", "CMP_FLIP") == {"npat_to_pat", "sortsafter_to_follows", "and_to_or", "or_to_and"}
    assert edits("R ;\n I @X=1\n", "CMP_FLIP") == set() and edits('R ;\n S X="A=B"\n', "CMP_FLIP") == set()


def test_drops_keep_loops_moving_and_blocks_filled():
    assert edits('R ;\n F  S X=$O(^G(X)) Q:X=""  D\n . S Y=1\n Q\n', "STMT_DROP") == set()
    assert (2, None, "line_set") in edits("R ;\n S X=1\n Q X\n", "STMT_DROP")
    assert details("C ;\n S E=E+1 G C:E<9 Q\n", "STMT_DROP") == set()
    assert details("R ;\n D A(.X) F  S Z=1 Q:X  D\n . D B(.X)\n . S Y=1\n Q\n", "STMT_DROP") == {"inline_do", "inline_set", "line_set"}


def test_conditions_go_only_where_control_stays():
    assert details("R ;\n G A:X\n Q:X\n S:X Y=1\nA Q:Y 2\n", "POSTCOND") >= {"drop_set", "invert_set", "invert_quit", "drop_quit"}
    assert "drop_goto" not in details("R ;\n G:X A\nA Q\n", "POSTCOND") and "drop_quit" not in details("R ;\n Q:X\n S Y=1\n", "POSTCOND")
    assert "drop_argument_level" in details("R ;\n D A:X,B\n", "POSTCOND")


def test_naked_references_need_another_prefix_before_them():
    assert details("R ;\n S X=^G(A,1),Y=^G(A,2)\n", "NAKED_REF") == set()
    assert details("R ;\n S X=^G(A,1),Y=^H(A,2)\n", "NAKED_REF") == {"introduce"}
    assert details("R ;\n S X=^G(A,1) D F S Y=^H(A,2)\n", "NAKED_REF") == set() and details("R ;\n I X S Z=^G(A,1)\n S Y=^H(A,2)\n", "NAKED_REF") == set()
    assert details("R ;\n S X=^G(A,1) F I=1:1:3 S Y=^H(I,2)\n", "NAKED_REF") == set()


def test_defaults_that_nobody_sees_stay():
    assert details('R ;\n S X=$G(Y,"")\n', "DOLLAR_MISUSE") == set() and details("R ;\n S Y=1\n S X=$G(Y,2)\n", "DOLLAR_MISUSE") == set()
    assert details("R ;\n S X=$get(X,0)+1\n", "DOLLAR_MISUSE") == set() and details("R ;\n I A S Y=1\n E  S Y=2\n S X=$G(Y,2)\n", "DOLLAR_MISUSE") == set()
    assert details("R ;\n S X=$GET(Y,2),Z=$data(Q),W=$O(^G(1),-1)\n", "DOLLAR_MISUSE") == {"get_drop_default", "data_to_get", "order_direction_flip"}


def test_swaps_and_boundaries():
    assert details("R(AB,AC) ;\n S Z=$$F(AB,1)\n", "VAR_SWAP") == {"AB_to_AC", "AB_to_Z"}
    assert details("R ;\n S X=$E(Y,1,3),Z=$PIECE(Y,U,N)\n", "BOUNDARY") == {"e_range_start_plus1", "e_range_end_plus1", "e_range_end_minus1", "p_index_plus1", "p_index_minus1"}
    assert edits("R ;\n D F(A,B(1,2)),G(A)\n", "ARG_ORDER") == {(2, " D F(B(1,2),A),G(A)", "do_swap_0_1")}
    assert mutants.sound('W "a""(" Q') and not mutants.sound("S X=(1") and not mutants.sound('W "a')


def test_mutants_of_odd_sources(spark):
    r = spark.createDataFrame([("N", None), ("E", ""), ("T", "R ;\n TSTART  S X=1 Q\n"), ("L", "R ;\n" + " S X=A=B\n" * 500)], "name string, source string")
    got = mutants.mutants(r)
    assert {x["name"] for x in got.select("name").distinct().collect()} == {"L"}
    assert mutants.mutant_difficulty(got).count() >= 1 and mutants.mutants(r.limit(0)).count() == 0


def test_result_differences_and_words(spark):
    k = "case int, stdout string, error string, size int"
    a = spark.createDataFrame([(1, "a^b", None, 1), (2, None, "", 1), (3, "x", "TIMEOUT", 1), (4, "x", "UNDEF,X", 1), (5, "only", None, 1), (None, "n", None, 1)], k)
    b = spark.createDataFrame([(1, "a^c", "", 2), (2, None, None, 2), (3, "x", None, 2), (4, "x", None, 2), (None, "m", None, 2)], k)
    s = "case int, ref string, value string, killed boolean"
    sa = spark.createDataFrame([(1, "^A(1)", "p^q", False), (1, "^A(2)", None, True), (1, "^A(3)", "same", False)], s)
    sb = spark.createDataFrame([(1, "^A(1)", "p^r", False), (1, "^A(3)", "same", False), (1, "^A(4)", "new", False)], s)
    d = reports.result_diff(a, b, ["case"], sa, sb)
    got = {(r["case"], r["kind"], r["ref"]): r for r in reports.explained(d).collect()}
    assert set(got) == {(1, "output", "stdout"), (3, "timeout", "error"), (4, "error", "error"), (1, "global", "^A(1)"), (1, "global", "^A(2)"), (1, "global", "^A(4)")}
    assert got[1, "output", "stdout"]["details"] == ["first difference at character 3 of 3", "piece 2: 'b' to 'c'"]
    assert got[4, "error", "error"]["headline"] == "Error differs: the baseline raises UNDEF: a variable was read that has no value and the candidate does not"
    assert got[1, "global", "^A(2)"]["expected"] == "<killed>" and "made a node" in got[1, "global", "^A(4)"]["headline"] and got[1, "global", "^A(1)"]["details"] == ["piece 2: 'q' to 'r'"]
    k = {r["case"]: (r["kinds"], r["specific"]) for r in reports.kinds(d, ["case"]).collect()}
    assert k == {1: (["global", "output"], True), 3: (["timeout"], False), 4: (["error"], True)}
    many = spark.createDataFrame([(1, "output", f"r{i:02}", "a", "b") for i in range(13)], "case int, kind string, ref string, expected string, actual string")
    f = reports.feedback(many, ["case"], ["ref"]).first()
    assert f["differences"] == 13 and f["feedback"].endswith("... and 3 more") and len(f["feedback"].splitlines()) == 11
    assert reports.explained(d.limit(0)).count() == 0


def test_recordings(spark):
    rows = [("t", "off", 1, True, False, 2, "live", 4, 0), ("t", "on", 1, True, True, 3, None, 5, 1), ("t", "on", 2, True, None, 0, None, None, None), ("u", "off", 1, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "task string, condition string, attempt int, claimed boolean, verified boolean, differences int, source string, n_cases int, n_void int")
    got = {r["task"]: tuple(r)[1:] for r in reports.recordings(df, ["task"], "off", "on").collect()}
    assert got == {"t": (True, True, True, 5, 1, 1), "u": (False, False, False, 0, 0, 0)}


def test_small_reports(spark):
    t = lambda *v: spark.createDataFrame([(x,) for x in v], "task_id string")
    assert tuple(reports.coverage(t("a", "b", None), t("a"), t("a", "b")).first()) == (2, 2, 1, True) and tuple(reports.coverage(t("a"), t("a", "a"), t("a")).first()) == (1, 1, 1, False)
    m = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z"), ("c", "x")], "cluster string, name string")
    assert [tuple(r) for r in reports.cluster_order(m).orderBy("place").collect()] == [("c", 2, 1), ("d", 1, 2)]
    assert {r["name"]: (r["others"], r["siblings"]) for r in reports.siblings(m).collect()} == {"x": (1, ["y"]), "y": (1, ["x"]), "z": (0, [])}
    n = spark.createDataFrame([("ABCD",), ("XABC",), ("QQ",), (None,)], "name string")
    w = spark.createDataFrame([("abcz",), ("QQ",), ("q",), (None,), ("",)], "wanted string")
    assert {(r["wanted"], r["name"], r["place"]) for r in reports.suggestions(w, n).collect()} == {("ABCZ", "ABCD", 1), ("ABCZ", "XABC", 2), ("Q", "QQ", 1)}
    ranks = spark.createDataFrame([("ABCD", 0)], "name string, rank long")
    assert {r["name"]: r["rank"] for r in reports.by_rank(n, ranks).collect()} == {"ABCD": 0, "XABC": 1, "QQ": 1, None: 1}
    e = spark.createDataFrame([("a", "2026-01-01T00:00:00+00:00"), ("a", "no"), ("b", None)], "g string, started_at string")
    assert {r["g"]: r["seconds"] for r in reports.elapsed(e, F.lit("2026-01-01 00:01:00").cast("timestamp"), ["g"]).collect()} == {"a": 60.0, "b": 0.0}
    x = spark.createDataFrame([(1, 0.5, None, {"rate": "x", "more": "y"})], "id int, rate double, note string, extra map<string,string>")
    assert json.loads(reports.as_json(x, ["id"], ["rate", "note"]).first()["document"]) == {"note": None, "rate": 0.5}
    assert json.loads(reports.as_json(x, ["id"], ["rate"], "extra").first()["document"]) == {"rate": "0.5", "more": "y"}
    s = spark.createDataFrame([("ok", 1, "2026-01-01", 3, "a" * 64, {"a": 0.1, "b": 1.0}), ("bad", 2, "x", 0, "z", {"a": float("nan")}), ("nul", None, None, None, None, None)], "id string, version int, created_at string, n_tasks int, digest string, rates map<string,double>")
    got = {}
    for r in reports.summary_faults(s).collect():
        got.setdefault(r["id"], set()).add(r["fault"])
    assert set(got) == {"bad", "nul"} and got["bad"] == {"version", "date", "tasks", "digest", "conditions", "rate"}
    kept = reports.trace_entry(spark.createDataFrame([(list(range(30)),), (None,)], "x array<int>"), "x").collect()
    assert [(r["total"], len(r["x"] or [])) for r in kept] == [(30, 20), (0, 0)]


def test_training_pairs(spark):
    calls = spark.createDataFrame([("A", "B"), ("C", "B"), ("D", "B"), ("B", "B"), (None, "B"), ("A", "B")], "caller string, callee string")
    sides = spark.createDataFrame([("A", "train"), ("B", "train"), ("C", "train"), ("D", "eval")], "name string, side string")
    assert [(r["name"], r["answer"]) for r in training.caller_pairs(calls, sides).collect()] == [("B", "A, C")]
    uses = spark.createDataFrame([("R", "^DPT(1)"), ("R", "DPT"), ("R", "ZZ"), ("R", None), ("R", " ")], "name string, global string")
    roots = spark.createDataFrame([("^DPT", "1", "OLD"), ("^DPT(", "2", "PATIENT"), ("^ZZ(", "9", "")], "root string, file string, title string")
    fields = spark.createDataFrame([("2", "10", "B", None), ("2", ".01", "NAME", "0;1"), ("2", "x", "", None)], "file string, field string, label string, storage string")
    assert {r["answer"] for r in training.file_pairs(uses, roots, fields).collect()} == {"#2 PATIENT, fields: 3", "#.01 NAME [0;1]; #10 B"}


def test_cases_from_pools(spark):
    e = spark.createDataFrame([("A", ["x", "y"]), ("B", []), ("C", None)], "entry string, formals array<string>")
    lines = spark.createDataFrame([("A", 'I X="a""b" S Y=12'), ("A", None)], "entry string, line string")
    pools = cases.value_pools(e, ["", "0"], lines, 4)
    assert {(r["entry"], r["position"], r["choice"], r["value"]) for r in pools.collect() if r["position"] == 1} == {("A", 1, 1, ""), ("A", 1, 2, "0"), ("A", 1, 3, "12"), ("A", 1, 4, 'a""b')}
    base = spark.createDataFrame([("A", ["1", "1"])], "entry string, args array<string>")
    built = cases.build_cases(base, pools, ["", "0"], 5).orderBy("case_no").collect()
    assert [r["args"] for r in built] == [["1", "1"], ["", ""], ["0", "0"], ["", "1"], ["1", ""]]
    assert cases.enough_cases(cases.build_cases(base, pools, [""], 9), 5).first()["enough"]


def test_event_log_and_caches(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"kind": "run_start", "run_id": "r"}\nnot json\n{"x": 1}\n{"kind": "verdict", "attempt": 2, "cases": [{"case_index": 0, "divergences": [{"kind": "output", "ref": "stdout"}]}]}\n')
    events, problems = files.event_log(spark, str(tmp_path / "log.jsonl"))
    assert [r["kind"] for r in events.orderBy("line").collect()] == ["run_start", "verdict"] and {(r["line"], r["problem"]) for r in problems.collect()} == {(2, "not JSON"), (3, "no kind of event")}
    with gzip.open(tmp_path / "dd.json.gz", "wt") as f:
        json.dump({"schema": "x", "files": {"2": {"name": "PATIENT", "root": "^DPT(", "fields": {".01": ["NAME", "RF", "", "0;1"], "x": ["N"]}}}}, f)
    f, fields = files.dictionary_cache(spark, str(tmp_path / "dd.json.gz"))
    assert [tuple(r) for r in f.collect()] == [("2", "PATIENT", "^DPT(")] and {(r["field"], r["storage"]) for r in fields.collect()} == {(".01", "0;1"), ("x", None)}
    files.write_dictionary_cache(f, fields, str(tmp_path / "again"))
    g, again = files.dictionary_cache(spark, str(tmp_path / "again"))
    assert g.collect() == f.collect() and sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, fields.collect()), key=str)
    assert all(x.count() == 0 for x in files.dictionary_cache(spark, str(tmp_path / "none.gz")))
    n = dictionary.dictionary_counts(f, fields, spark.createDataFrame([(1,), (None,)], "redactions int")).first()
    assert (n["files"], n["roots"], n["fields"], n["nodes"], n["redactions"]) == (1, 1, 2, 2, 1)


def test_manifests_registries_and_replacement(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"files": [{"path": "a", "url": "u", "sha256": "0" * 64, "bytes": 3}]}))
    assert files.vendor_manifest(spark, str(tmp_path / "v.json")).first()["bytes"] == 3
    (tmp_path / "w.json").write_text(json.dumps({"files": [{"path": "a", "url": "u", "sha256": "x", "bytes": 3}]}))
    with pytest.raises(Exception, match="no digest"):
        files.vendor_manifest(spark, str(tmp_path / "w.json")).collect()
    r = spark.createDataFrame([("a", "m1"), ("b", "m2")], "name string, model_id string")
    add = spark.createDataFrame([("c", "m3")], "name string, model_id string")
    assert {x["name"] for x in files.change_models(r, add, ["a"]).collect()} == {"b", "c"}
    with pytest.raises(Exception, match="known already"):
        files.change_models(r, r).collect()
    out = str(tmp_path / "rows")
    files.replace_json(r, out)
    files.replace_json(r.where("name = 'a'").union(spark.read.schema("name string, model_id string").json(out).where("name = 'b'")), out)
    assert spark.read.json(out).count() == 2
    bad = r.select(F.raise_error(F.lit("cut short")).cast("string").alias("name"), "model_id")
    with pytest.raises(Exception, match="cut short"):
        files.replace_json(bad, out)
    assert spark.read.json(out).count() == 2
    for sub in ("x", "y"):
        (tmp_path / "man" / sub).mkdir(parents=True)
        (tmp_path / "man" / sub / "a.md").write_text(sub)
    docs = files.manuals(spark, str(tmp_path / "man"), "s").collect()
    assert {d["path"] for d in docs} == {"x/a.md", "y/a.md"} and len({d["document"] for d in docs}) == 2


def test_signature_codes_are_credentials(spark):
    nodes = spark.createDataFrame([("^VA(1,0)", "200", "0", "JOE^abc^def^9")], "ref string, file string, node string, value string")
    fields = spark.createDataFrame([("200", "0", 1, "NAME"), ("200", "0", 2, "SIGNATURE CODE"), ("200", "0", 3, "CRYPTOGRAPHIC HASH")], "file string, node string, position int, name string")
    r = dictionary.redact(nodes, fields, ["ref"]).first()
    assert (r["value"], r["redactions"]) == ("JOE^<redacted>^<redacted>^9", 2)


def test_plans_receipts_subtrees_and_covers(spark):
    from loomwork.operators import lineage, search, statediff

    state = spark.createDataFrame([("^A(1)", "x"), ("^A(1,2)", "y"), ('^A(1,"b,c")', "z"), ("^B", "q"), (None, "n")], "ref string, value string")
    refs = spark.createDataFrame([("^A(1)",), ("^A",), ("^Z",), (None,)], "ref string")
    assert {r["ref"]: (r["nodes"], r["capped"]) for r in statediff.subtree_counts(state, refs, 2).collect()} == {"^A(1)": (2, True), "^A": (2, True), "^Z": (0, False)}
    p = spark.createDataFrame([("p", "^A(1)", "set", None, "x"), ("p", "^A(2)", "kill", "y", None), ("q", "^A(1)", "kill", "y", "z"), ("q", "^A(1)", "set", None, None)], "plan_id string, ref string, op string, before_value string, value string")
    line = F.xxhash64(F.concat_ws("|", "ref", "op", F.coalesce("before_value", F.lit("<absent>")), F.coalesce("value", F.lit("<absent>"))))
    good = p.groupBy("plan_id").agg(statediff.plan_digest(F.bit_xor(line), F.sum(line.cast("decimal(20,0)"))).alias("digest"), F.count("*").cast("int").alias("ops"))
    more = spark.createDataFrame([("none", "d", 1)], "plan_id string, digest string, ops int")
    faults = {}
    for r in statediff.receipt_faults(good.unionByName(more), p).collect():
        faults.setdefault(r["plan_id"], set()).add(r["fault"])
    assert faults == {"q": {"repeated ref", "operation and value"}, "none": {"unknown plan"}}
    u = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("x", "3"), (None, "3"), ("a", "1")], "name string, unit_key string")
    n = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "name string")
    assert {tuple(r) for r in lineage.cover_faults(u, n).collect()} == {("b", "in several units"), ("c", "in no unit"), ("x", "unknown")}
    assert [r["name"] for r in lineage.on_side(spark.createDataFrame([(" a", "train"), ("b", "eval"), (None, "train")], "name string, side string"), "train").collect()] == ["A"]
    assert [tuple(r) for r in search.listed_names(n, "[A-B]", 1).collect()] == [] and [tuple(r) for r in search.listed_names(n.select(F.upper("name").alias("name")), "[A-B]", 1).collect()] == [("A", 2)]


def test_capped_rows_and_capture_choices(spark):
    rows = spark.createDataFrame([("r", i, i % 3 == 0) for i in range(12)] + [(None, 1, True), (None, 2, None), ("s", 1, False)], "g string, n int, ok boolean")
    got = {}
    for r in cases.capped(rows, ["g"], ["n"], F.col("ok"), 2).collect():
        got.setdefault(r["g"], set()).add(r["n"])
    assert got == {"r": {0, 1, 2, 3}, None: {1, 2}, "s": {1}}
    roots = spark.createDataFrame([("a", "^A(", 10, False), ("a", "^R(", 9_999, False), ("b", "^A(", 9_999, False), ("b", "^B(", 1, False)], "routine string, root string, nodes int, scratch boolean")
    known = spark.createDataFrame([("a", False), ("b", True), ("c", True), ("d", None)], "routine string, known boolean")
    assert {r["routine"]: (r["tier"], r["complete"]) for r in cases.capture_choice(roots, known, 2000, ("^R(",)).collect()} == {"a": ("query", True), "b": ("trigger", True), "c": ("none", True), "d": ("trigger", False)}
