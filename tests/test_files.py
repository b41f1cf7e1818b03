"""File sources and sinks, streams, text functions, dictionary decoding and MUMPS kernels."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as t
from loomwork.operators import dictionary, mumps, mutants, reading, search, training
from loomwork.sources import files
from loomwork.streaming import progress

GOOD = {"condition": "baseline", "task_id": "T", "attempt": 1, "verdict": {"equivalent": True, "n_cases": 1, "n_diverged": 0, "n_void": 0}, "started_at": "2024-01-01T00:00:00+01:00", "finished_at": "2024-01-01T00:00:04+01:00", "new_field": 5}


def test_traces_round_trip_and_fail_loudly(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(GOOD) + "\n\n" + json.dumps({**GOOD, "attempt": 2, "candidate_src": "x"}) + "\n")
    got = files.read_traces(spark, str(tmp_path)).orderBy("attempt").collect()
    assert [(r["attempt"], r["submitted"], r["extra"]) for r in got] == [(1, False, {"new_field": "5"}), (2, True, {"new_field": "5"})]
    for bad in ({**GOOD, "attempt": True}, {**GOOD, "condition": "other"}, {k: v for k, v in GOOD.items() if k != "task_id"}):
        (tmp_path / "b.jsonl").write_text(json.dumps(bad) + "\n")
        with pytest.raises(Exception, match="b.jsonl:1: not an attempt record"):
            files.read_traces(spark, str(tmp_path)).collect()
    (tmp_path / "b.jsonl").write_text(json.dumps(GOOD) + "\n" + json.dumps(GOOD)[:-9])
    assert files.read_traces_leniently(spark, str(tmp_path)).count() == 3
    assert files.newest(spark, str(tmp_path)).count() == 1


def test_write_once_refuses(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "eval")], "name string, side string")
    files.write_once(files.lock_document(df), str(tmp_path / "lock"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(files.lock_document(df), str(tmp_path / "lock"))
    lock = spark.read.json(str(tmp_path / "lock"))
    assert files.lock_holds(lock, df).first()[0] and not files.lock_holds(lock, df.limit(1)).first()[0]
    files.write_jsonl(df, str(tmp_path / "x"), compression="gzip")
    files.write_jsonl(df, str(tmp_path / "x"), append=True)
    assert spark.read.json(str(tmp_path / "x")).count() == 4


def test_manifest(spark, tmp_path):
    ok = {"version": 1, "sources": [{"id": "a", "path": "p", "priority": 3, "file_patterns": ["*.m"]}, {"id": "b", "path": "q"}]}
    p = tmp_path / "m.json"
    p.write_text(json.dumps(ok))
    m = files.manifest(spark, str(p))
    assert [r["id"] for r in search.inventory(m, "x/y.m").collect()] == ["a", "b"]
    for bad in ({**ok, "sources": ok["sources"] * 2}, {**ok, "sources": [{"id": "a", "colour": 1}]}, {**ok, "sources": [{"id": "a", "priority": 11}]}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.manifest(spark, str(p))


def test_directory_and_manuals(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "_DTC.m").write_bytes(b"%DTC ;x\n Q \xff\n")
    (tmp_path / "src" / "9bad.m").write_text("x")
    got = {r["name"]: r for r in files.source_directory(spark, str(tmp_path / "src")).collect()}
    assert set(got) == {"%DTC", None} and "�" in got["%DTC"]["source"]
    assert spark.range(1).select(files.file_for_name(F.lit("%dtc"))).first()[0] == "_DTC.m"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# T\nx")
    assert files.manuals(spark, str(tmp_path / "docs"), "s").count() == 1


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text(json.dumps(GOOD) + "\n" + json.dumps(GOOD)[:20])
    (folder / "2.jsonl").write_text(json.dumps({**GOOD, "attempt": 2, "finished_at": "2024-01-01T00:00:02+01:00"}))
    got = progress.run_now(progress.progress(progress.traces(spark, str(folder))), "prog", "complete").first()
    assert (got["records"], got["mean_seconds"], got["median_seconds"], got["first_passed"]) == (2, 3.0, 3.0, 1)
    for _ in range(2):  # a second run finds nothing new
        progress.append(progress.traces(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows_drop_late_rows_and_fold_keeps_state(spark, tmp_path):
    d = tmp_path / "ev"
    rows = [("2024-01-01 00:00:10", "a", 1.0, 1), ("2024-01-01 00:05:00", "a", 2.0, 1), ("2024-01-01 02:00:00", "a", 1.0, 2)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double, user_id int").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(d))
    stream = spark.readStream.schema(df.schema).parquet(str(d))
    assert progress.run_now(progress.windowed(stream, "10 minutes", "1 hour"), "win", "append").count() >= 1
    ev = stream.selectExpr("CAST(user_id AS STRING) AS run_id", "unix_timestamp(ts) AS seq", "'candidate' AS kind")
    got = {r["run_id"]: r["candidates"] for r in progress.run_now(progress.fold(ev), "fold", "update").collect()}
    assert got == {"1": 2, "2": 1}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(t.tokens(F.lit("Straße $x_1, é!"))) == ["strasse", "$x_1", "é"]
    assert one(t.masked(F.lit('a "b""c;" d'))) == 'a "\x01""\x01\x01" d'
    assert one(t.code_part(F.lit(' W "x;y" ; c'))) == ' W "x;y" '
    assert one(t.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    for raw in ("a\tb%\n", "", "%41", "100%"):
        assert one(t.unescape(t.escape(F.lit(raw)))) == raw
    dates = {"2350407": "1935-04-07", "3130808.083906": "2013-08-08T08:39:06", "hello": None, "3130800": "2013-08", "3130000": "2013", "3131301": None}
    for raw, iso in dates.items():
        assert one(t.fileman_date(F.lit(raw))) == iso
    assert one(t.slug(F.lit("  A b/c! "))) == "a-b-c" and one(t.slug(F.lit("--"))) == "reference"


def test_pages_and_passages(spark):
    d = spark.createDataFrame([("a", "x\nyy\nzzz\n"), ("b", None)], "name string, source string")
    r = reading.page(d, 1, 2, 100).first()
    assert (r["first"], r["last"], r["next_line"], r["content"]) == (1, 2, 3, "x\nyy")
    assert reading.page(d, 1, 5, 1).first()["last"] == 1
    doc = "# A\ntext\n```\n# not a heading\n```\n# B\n" + "l\n" * 120
    got = reading.passages(spark.createDataFrame([(1, doc)], "doc_id bigint, text string")).orderBy("start_line").collect()
    assert [(r["start_line"], r["title"], r["example"]) for r in got] == [(1, "A", True), (6, "B", False), (106, "B", False)]


def test_dictionary(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(dictionary.set_codes(F.lit("M:MALE;F: F:x ;M:last;"))) == {"F": "F:x", "M": "last"}
    assert one(dictionary.subscripts(F.lit('"A,B",1)'))) == ["A,B", "1"]
    n = spark.createDataFrame([("^VA(200,1,0)",), ("^VA(3)",), ("!!!",), (None,)], "ref string")
    roots = spark.createDataFrame([("^VA(", "v"), ("^VA(200,", "p")], "root string, file string")
    assert {r["ref"]: r["file"] for r in dictionary.longest_root(n, roots).collect()} == {"^VA(200,1,0)": "p", "^VA(3)": "v", "!!!": None, None: None}
    dump = spark.createDataFrame([("H|2|PATIENT|^DPT(||1",), ("D|2|.01|NAME|RF||0;1",), ("D|9|.01|LOST|RF||0;1",), ("D|2|x",)], "line string")
    f, fields = dictionary.parse_dump(dump)
    assert (f.count(), fields.count()) == (1, 1)


SRC = 'RTN ;first words\n ;;1.0;\nEN(A,B) ; doc\n N X\n S X=$G(^DPT(A,0)),^(1)=B\n I X="" Q\n F I=1:1:3 D SUB^OTHER(I,X)\n S:A>1 Y=$P(X,"^",2)\n Q $$F^LIB(X)\n'


def test_mumps_kernels(spark):
    r = spark.createDataFrame([("RTN", SRC), ("EMPTY", ""), ("NULL", None)], "name string, source string")
    f = {x["name"]: x for x in mumps.routine_facts(r).collect()}
    assert set(f) == {"RTN", "EMPTY"} and f["RTN"]["calls"] == ["LIB", "OTHER"] and f["RTN"]["globals_read"] == ["DPT"]
    assert (f["RTN"]["lines_code"], f["RTN"]["lines_data"], f["RTN"]["first_comment"], f["RTN"]["max_depth"]) == (8, 1, "first words", 2)
    naked = mumps.naked_references(r).collect()
    assert [(x["raw"], x["resolved"]) for x in naked] == [("^(1)", "^DPT(A,1)")]
    m = mutants.mutants(r).collect()
    assert len({(x["line"], x["mutated_line"]) for x in m}) == len(m)
    assert {"CMP_FLIP", "BOUNDARY", "POSTCOND", "ARG_ORDER", "STMT_DROP"} <= {x["operator"] for x in m}
    assert (8, ' S:A>1 Y=$P(X,"^",3)') in {(x["line"], x["mutated_line"]) for x in m}
    dropped = spark.createDataFrame([("a\nb\nc", 2, None), ("a\nb\nc", 1, "z")], "s string, n int, m string").select(mutants.apply_mutant(F.col("s"), F.col("n"), F.col("m"))).collect()
    assert [x[0] for x in dropped] == ["a\nc", "z\nb\nc"]
    v = {x["label"]: x for x in mumps.local_variables(r).collect()}["EN"]
    assert v["formals"] == ["A", "B"] and "X" in v["newed"] and "Y" in v["unscoped"]


def test_rewards(spark):
    rows = [("x", None, True, 4, 0, 0), ("x", None, False, 5, 1, 1), ("x", None, False, 2, 0, 2), ("x", "boom", True, 1, 0, 0), (" ", None, True, 1, 0, 0)]
    df = spark.createDataFrame(rows, "candidate string, error string, equivalent boolean, n_cases int, n_diverged int, n_void int")
    assert [r["reward"] for r in training.reward(df, True).collect()] == [1.0, 0.75, 0.0, 0.0, 0.0]
    assert [r["reward"] for r in training.reward(df, False).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_label_flags_close_over_local_calls(spark):
    src = "R ;x\n Q\nA(X) D B Q\nB S Y=$$C(1) Q\nC(Z) R Z Q Z\nD(W) S V=$J(W,3) D E(W) Q\nE(W) Q\nF S X=@W Q\n"
    got = {r["label"]: r for r in mumps.label_facts(spark.createDataFrame([("R", src), ("N", None), ("E", "")], "name string, source string")).collect()}
    assert {k: (r["flags"], r["clean"], r["reached"]) for k, r in got.items()} == {
        "R": ([], True, False), "A": (["read"], False, False), "B": (["read"], False, False), "C": (["read"], False, False), "D": ([], True, True), "E": ([], True, True), "F": (["indirect"], False, False),
    }
    cov = mumps.entry_coverage(mumps.label_facts(spark.createDataFrame([("R", src)], "name string, source string"))).first()
    assert cov["coverage"] == round(2 / 7, 3)


def test_variable_uses(spark):
    src = "R ;x\nA S X=Y,X=X+1\n I X S Z=1\n W Z,X\n S X=2\n"
    uses = mumps.variable_uses(spark.createDataFrame([("R", src)], "name string, source string"))
    again = {(r["line"], r["variable"], r["again"]) for r in mumps.reassigned_later(uses).collect()}
    assert (2, "X", True) in again and (5, "X", False) in again and (3, "Z", False) in again
    reads = {(r["line"], r["variable"]): r["from_line"] for r in mumps.reaching_writes(uses).collect()}
    assert reads[4, "X"] == 2 and reads[4, "Z"] is None and reads[2, "Y"] is None


def test_resolve(spark):
    roots = spark.createDataFrame([("^DPT(", "2")], "root string, file string")
    fields = spark.createDataFrame([("2", "0", 2, "SEX"), ("2", "0", 1, "NAME"), ("2", ".11", None, "X")], "file string, node string, position int, name string")
    samples = spark.createDataFrame([("^DPT(1,0)", "A^M"), ("^DPT(3,0)", "C^F"), ("^ZZ(1)", "q")], "ref string, value string")
    got = {r["ref"]: r for r in dictionary.resolve(spark.createDataFrame([("^DPT(3,0)",), ("^DPT(9,.3)",), ("^ZZ(1)",)], "ref string"), roots, fields, samples).collect()}
    r = got["^DPT(3,0)"]
    assert (r["file"], r["record"], r["node"], r["samples"], r["notes"]) == ("2", "3", "0", ["C^F", "A^M"], []) and [x["name"] for x in r["layout"]] == ["NAME", "SEX"]
    assert got["^DPT(9,.3)"]["notes"] == ["no field on this node", "no stored value of its own"]
    assert got["^ZZ(1)"]["notes"] == ["no file has this root"] and got["^ZZ(1)"]["samples"] == ["q"]


def test_titles_and_sources_reorder_hits(spark):
    import math

    p = spark.createDataFrame([("a1", "a", "Retry rules", "wait then retry retry"), ("b1", "b", "Other", "retry once"), ("b2", "b", "Retry", "nothing here"), ("c1", "c", "None", "no word of it"), ("d1", None, None, "retry")], "id string, source_id string, title string, text string")
    m = spark.createDataFrame([("a", "Manual", ["sdk"], ["*.widget"], 1), ("b", "Retry guide", ["retry", "wait"], ["*.m"], 4), ("c", "Retry wait", ["wait"], ["*.m"], 9)], "id string, title string, tags array<string>, file_patterns array<string>, priority int")
    got = {r["id"]: r["score"] for r in search.ranked_hits(p, ["retry", "wait"], title="title", sources=search.inventory(m, "x/y.m")).collect()}
    retry, wait = math.log(1 + 5 / 5), math.log(1 + 5 / 2)
    want = {"a1": retry * (1 + math.log(3)) + wait + 2 * retry + 0.25, "b1": retry + 0.6 + 1 + 6, "b2": retry + 2 * retry + 0.6 + 1 + 6, "d1": retry}
    assert got == {k: round(v, 6) for k, v in want.items()}
    best = search.search(p, "wait retry", 2, title="title", sources=search.inventory(m, "x/y.m")).collect()
    assert {r["id"] for r in best} == {"b1", "b2"}
