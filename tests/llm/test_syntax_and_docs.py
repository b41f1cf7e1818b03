"""Problems 1 and 2: syntax verdicts and documented functions."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import code_docs, python_syntax, syntax
from loomwork.llm.js_syntax import js_fault, js_functions
from loomwork.llm.mumps_syntax import entry_points, mumps_fault
from loomwork.llm.python_syntax import json_fault, python_fault, python_functions

SCHEMA = "file_id bigint, repo string, path string, name string, language string, description string, src string, lines_total int, non_m_syntax boolean, extra string"

VALID_M = ["", "RTN ;x\n ;;1.0;\n Q\n", "A(B,C) N X S X=1 Q:X  S ^G(1,\"a\"\"b;\")=$P(X,\"^\",2)\n", "\tq", " i 1 w !,\"<<<<<<<\"  q", " I X?3N1\"-\".A S Y=1", " F  S I=$O(^A(I)) Q:I=\"\"  D\n . . K A(1)", "%X\r\n Q\r\n", " D A(.B,,1),B^C", " W *7,?10,!!,#", " S:X=\"\" X=1,Y=2 ; c", "1 Q", " H  H 1", " S (A,B)=1,@C=2", " TSTART  TCOMMIT", " ; “quoted”"]
INVALID_M = [" S X=$G(^A(", " W \"open", "<<<<<<< HEAD", "=======", ">>>>>>> x", " FOO X=1", "S X=1 D CALC", " S X=“a”", " if (x == 1) { s y=1 }", " S sc=$$$ISERR(x)", " D obj.Do(1)", "{\"a\": 1}", "import json", "A(B", " S X=", " S", " S X=1)", "<!DOCTYPE html>", " Q:  S X=1"]
VALID_JS = ["", "a=>b", "async (x)=>{await x}; for(const [a,b] of c){} x?.y?.[1]?.(2); `a${`b${c}`}d`", "class A extends B{static #x=1;get y(){return this.#x} static{ a() } *g(){yield* 1}}", "const {a=1,...b}=c; [a,b]=[b,a]; ({a}=c);", "x=a/b/c; y=/[/]\\//g.test(s)", "let a = b\nlet c = d", "/*\n<<<<<<< HEAD\n ) ] \n*/", "const q = \"}}}\";", "export default async function(){}", "// “x”\nimport a,{b as c} from 'x'; export * as q from 'z'", "if(a)b\nelse c", "do x++\nwhile(x<3)\nfoo()"]
INVALID_JS = ["let x = ;", "{\"a\":1}", "return 1", "function f( {", "let b = \"open;", "const a = [1, 2;", "`open", "/* open", "x = “a”;", "<<<<<<< HEAD\n", "const x;", "if (x > 1 {}", "a b", "1 = 2", "import { a } from", "class { }", "for (const x of y"]


@pytest.mark.parametrize("src", VALID_M)
def test_valid_mumps(src):
    assert mumps_fault(src) is None


@pytest.mark.parametrize("src", INVALID_M)
def test_invalid_mumps(src):
    assert mumps_fault(src)


@pytest.mark.parametrize("src", VALID_JS)
def test_valid_js(src):
    assert js_fault(src) is None


@pytest.mark.parametrize("src", INVALID_JS)
def test_invalid_js(src):
    assert js_fault(src)


def test_python_and_json():
    assert not any(map(python_fault, ["", "x = '<<<<<<< a'\n", '"""\n=======\n"""\n', "if True: pass\r\n", "def f(a, /, *, b): ...\n"]))
    assert all(map(python_fault, ["print 'x'", "def f(:\n pass", "<<<<<<< HEAD\n", "x = (1,\n", "return 1", "if x:\n\ty\n  z\n", "x = “a”", "'open"]))
    assert not any(map(json_fault, ["{}", "[1, \"<<<<<<< a\"]", " null \n"]))
    assert all(map(json_fault, ["", "{'a': 1}", "[1,]", "{\"a\": 1", "// c\n{}", "NaN", "{} {}", "<<<<<<< a\n{}"]))
    assert python_fault("<<<<<<< HEAD\n")[1] == "merge conflict marker" and json_fault("{\"a\": [1}")[1] == "unbalanced delimiter"


def rows(*r):
    return [(i, "repo", p, "N", None, None, s, None, None, "clash") for i, p, s in r]


def test_files_at_large(spark):
    long = "x = 1\n" * 60_000
    df = spark.createDataFrame(rows((1, "a.py", "x = ("), (1, "a.py", "x = ("), (2, "b.m", " Q"), (3, "c.json", None), (4, None, "x"), (5, "d.txt", "("), (6, "e.py", long), (7, "f.JSON", ""), (None, "g.py", "(")), SCHEMA)
    assert sorted(r[0] for r in syntax.invalid_files(df).collect()) == [1, 7]
    rates = {(r["language"], r["files"], r["invalid"]) for r in syntax.invalid_rates(df).collect()}
    assert rates == {("python", 2, 1), ("mumps", 1, 0), ("json", 1, 1)}
    assert syntax.invalid_files(df.limit(0)).count() == 0 and syntax.invalid_rates(df.limit(0)).count() == 0


M = """RTN ;head
 ;;1.0;
EN(A) ; Rounds every open ledger before it is filed
 Q
 ; Collects pending vouchers and keeps their original order
CC(B)
 N X
 ; counts stored messages without touching the database
 Q
DD
 ;TODO: describe what this one does, in four or more words
 Q
EE ; S X=$P(Y,U,2) D CALC(X)
 Q
FF ;FF lookup takes FF
 Q
"""
JS = """/** Stores the weekly message of each clinic
 * @param a
 */
export async function saveIt(a) {
  let t = 1;
  // Explains nothing about the function here at all
  return t;
}
const go = (x) => { // Merges partial samples across all sessions
  return x;
};
class Desk {
  // eslint-disable-next-line no-unused-vars
  open(lim) { return lim; }
  /* Counts rejected orders and reports an error */
  shut() { return 1; }
}
"""
PY = '''class Desk:
    @property
    def size(self):
        """Counts stored readings unless the flag is set.

        :param self: never part of the description
        """
        return 1


# Converts trimmed labels for the given site
def convert(a):
    x = 1
    # Only a note inside the body, with many words
    return x


def size_label(label):
    """size label of label"""
    # Resolves external tickets in the user's time zone
    return label
'''


def test_functions_and_their_documentation(spark):
    df = spark.createDataFrame(rows((1, "a.m", M), (1, "a.m", M), (2, "b.js", JS), (3, "c.py", PY), (4, "d.py", "def f(:"), (5, "e.py", None)), SCHEMA)
    labels = spark.createDataFrame([(1, 1, "en", ["a"]), (1, 1, "EN", ["A"]), (1, 2, "CC", None), (None, 1, "X", None)], "file_id bigint, seq int, label string, formals array<string>")
    got = {(r["file_id"], r["label"]): r for r in code_docs.documented_functions(df, labels).collect()}
    assert set(got) == {(1, "EN"), (1, "CC"), (2, "saveIt"), (2, "go"), (2, "Desk.shut"), (3, "Desk.size"), (3, "convert"), (3, "size_label")}
    assert got[1, "EN"]["declared"] and not got[1, "CC"]["declared"] and got[1, "EN"]["body"].startswith("EN(A)")
    assert got[3, "Desk.size"]["description"] == "Counts stored readings unless the flag is set."
    assert code_docs.documented_functions(df.limit(0), labels).count() == 0


def test_overloads_share_documentation():
    js = list(js_functions(JS))
    assert [(f["name"], f["formals"]) for f in js] == [("saveIt", ["a"]), ("go", ["x"]), ("Desk.open", ["lim"]), ("Desk.shut", [])]
    assert [f["name"] for f in python_functions(PY)] == ["Desk.size", "convert", "size_label"]
    assert [(f["name"], f["formals"]) for f in entry_points(M)][:2] == [("EN", ["A"]), ("CC", ["B"])]


@pytest.mark.parametrize("text", ["none yet", "(documentation pending)", "TODO explain this to all readers now", "-----", "KXQ/KX 7/12/86", "AB *12* patch", "added by tm 2024-04-11", "lorem ipsum dolor sit amet consectetur", "const x = fetchAll(y);", "pylint: disable=too-many-locals", "@ts-ignore", "S X=$P(Y,U,2) D CALC(X)", "N I F I=1:1:9 S A(I)=0", "same as the previous one", "Write this comment before the next release!", "see above"])
def test_stand_ins_never_count(text):
    d = code_docs.description(text)
    assert not (d and code_docs.telling(d, "f", []))


DEEP_JS = ["x = " + "(" * 3000 + "1" + ")" * 3000 + ";\n", "if (a) b();\n" + "else if (c) d();\n" * 5000, "x = " + "[" * 3000 + "]" * 3000 + ";\n", "x = " + "a => " * 3000 + "1;\n", "{" * 3000 + "}" * 3000 + "\n"]
SUM = "x = " + " + ".join(["1"] * 10_000) + "\n"
DEEP_PY = [SUM, "x = " + "not " * 8000 + "a\n", "if a:\n    pass\n" + "elif b:\n    pass\n" * 30_000, "def f():\n    return (" + " +\n  ".join(["1"] * 10_000) + ")\n"]


@pytest.mark.parametrize("src", DEEP_JS)
def test_faults_after_deep_javascript(src):
    assert js_fault(src) is None
    assert js_fault(src + "let y = ;\n")[0] == src.count("\n") + 1
    assert [f["name"] for f in js_functions(src + "function f(a) {}\n")] == ["f"]


@pytest.mark.parametrize("src", DEEP_PY)
def test_faults_after_deep_python(src):
    assert python_fault(src) is None
    assert python_fault(src + "y = = 2\n") == (src.count("\n") + 1, "grammar")
    found = list(python_functions(src + "def g(a):\n    # says it\n    return a\n"))[-1]
    assert (found["name"], found["line"], found["docs"], found["body"]) == ("g", src.count("\n") + 1, [("below", " says it")], "def g(a):\n    # says it\n    return a")


def test_faults_in_and_around_deep_python():
    assert python_fault(SUM[:-1] + " + = 1\n") == (1, "grammar")
    assert python_fault(SUM + "return 1\n") == (2, "grammar")
    assert python_fault(SUM + "elif a:\n    pass\n") == (2, "grammar")
    whole = 'def f(a):\n    "Says it."\n    return (' + " +\n  ".join(["1"] * 10_000) + ")\n"
    (f,) = python_functions(whole)
    assert f["body"] == whole[:-1] and f["docs"] == [("docstring", "Says it.")]


def test_faults_after_deep_json():
    deep = "[" * 60_000 + '{"a": [1, -2.5e3, true, null, "x\\n"], "b": {}}' + "]" * 60_000
    assert json_fault(deep) is None and json_fault(deep.replace("null", '"]"')) is None
    for bad in ("nul", "NaN", "01", "1 2", "1,", '"\\q"', '{"a" 1}', "{1: 2}", '{"a": 1,}'):
        assert json_fault(deep.replace("null", bad)) == (1, "grammar"), bad
    assert json_fault(deep + " 1") == (1, "grammar")


def _files(spark, *rows):
    return spark.createDataFrame([(i, repo, path, src, None, None) for i, (repo, path, src) in enumerate(rows, 1)], "file_id bigint, repo string, path string, src string, name string, non_m_syntax boolean")


STUB = """class Shape:
    class Part:
        def cut(self, edge): "Cuts the outline along one given edge and returns both halves."
    def area(self): "Computes the covered surface in square metres."
@overload
def turn(angle): "Turns everything around the middle by an angle in degrees."
@overload
def turn(angle, axis): "Turns everything around a stated axis through the middle."
def lost(x): "Belongs to nothing that any other file defines at all."
"""
CODE = """class Shape:
    class Part:
        def cut(self, edge):
            return edge
    def area(self):
        # todo
        return 1
def turn(angle, axis):
    return axis
def turn_back(angle):
    return angle
def area(self):
    return 2
"""


def test_declarations_document_definitions_of_other_files(spark):
    df = _files(spark, ("r", "geo/shape.py", CODE), ("r", "geo/shape.pyi", STUB), ("other", "geo/shape.py", CODE), ("r", "geo/other.py", CODE))
    got = {(r["file_id"], r["label"]): r["description"] for r in code_docs.documented_functions(df).collect()}
    assert got == {
        (1, "Shape.Part.cut"): "Cuts the outline along one given edge and returns both halves.", (1, "Shape.area"): "Computes the covered surface in square metres.",
        (1, "turn"): "Turns everything around a stated axis through the middle.",
    }
    assert {(r["file_id"], r["label"]) for r in code_docs.documented_names(df).collect()} == set(got)
    assert code_docs.documented_names(df.where("path NOT LIKE '%.pyi'")).count() == 0


@pytest.mark.parametrize("src", ['f"{x!r:>{w}}"', 'f"{x["a"]}"', "f'{a:{b}}' + f'{{}}'", "f'{x:{y:{z}}}'", "rf'\\{x}'", 'x = """a\n=======\n"""', "x = 'a\\\nb'", "r'\\''", "f'{d[\"a:b\"]}'", "# it's (fine"])
def test_odd_but_valid_literals(src):
    compile(src, "s", "exec")
    assert python_syntax.python_lexer_fault(src) is None


@pytest.mark.parametrize("src", ["f'{x'", "f'}'", "=======", "'a\nb'", '"""a', "(1,\n2", "[1)", "f'{(x}'", ")"])
def test_faults_a_lexer_sees(src):
    with pytest.raises(SyntaxError):
        compile(src, "s", "exec")
    assert python_syntax.python_lexer_fault(src)


@settings(max_examples=300, deadline=None)
@given(st.text('[]{}:,"\\u0a1-.e tn\n', max_size=12))
def test_json_grammar_agrees_with_the_standard_reader(src):
    try:
        json.loads(src, parse_constant=lambda n: int(n))
        good = True
    except ValueError:
        good = False
    assert (python_syntax.json_fault(src) is None) == good


def test_deep_json():
    assert python_syntax.json_fault("[" * 100_000 + "]" * 100_000) is None and python_syntax.json_fault("[" * 100_000 + "]" * 99_999)
