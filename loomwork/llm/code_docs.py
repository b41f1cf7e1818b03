"""Problem 2: functions paired with the comment that documents them.

A kernel reads each file once and emits its part of the symbol table: module, qualified name, formal arguments, what the
best of the comments at the places that may document it tells, and whether the symbol is a declaration apart from its
definition (a function of a stub file, an overload). Over the tables of all files, documented declarations join the
definitions without telling comment of their own by module, qualified name and normalised signature, so overloads
resolve by their arguments; only then are functions without description dropped.

A module is a repository and a path without ending: ``pkg/shape.pyi`` declares what ``pkg/shape.py`` defines. The label
facts of ``routine_labels`` say which symbols are declared entry points; they carry no comments.

Defined results: files that do not parse give no symbols; a null ``src`` gives none; a null ``repo`` is a repository of
its own. A symbol defined twice with different signatures is kept per signature. Stub files declare, but are no source
of pairs. Repeated deliveries and repeated label rows change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .js_syntax import Fault, js_functions
from .leaks import bounded
from .mumps_syntax import entry_points, mumps_fault
from .python_syntax import python_fault, python_functions
from .syntax import ending

#: Endings of files whose functions only declare.
STUBS = {"pyi"}
SYMBOLS = "file_id bigint, module string, label string, kind string, formals array<string>, line int, declares boolean, description string, body string"

TAG_LINE = re.compile(r"^\s*(?:@(?!todo)\w+\b.*|:(?:param|type|returns?|rtype|raises?)\b.*|(?:Args|Arguments|Returns|Raises|Parameters|Yields):\s*|>>>.*|\.\.\.\s.*)$", re.I)
# What stands in for a description, at the start of a line.
PLACEHOLDER = re.compile(
    r"^\W*(?:@?todo\b|fixme\b|xxx\b|tbd\b|hack\b|none yet\b|to be (?:documented|written|done)|lorem ipsum|description (?:goes|to go) here|"
    r"write (?:this|the|a) (?:comment|description|docs?)|see (?:above|below)|same as (?:the )?(?:previous|above|before|next)|"
    r"\(?(?:documentation|description|docs?|comment) (?:pending|missing|to follow|goes here|needed)|no (?:description|documentation|comment)|"
    r"added by|changed by|modified by|created by|written by|fixed by|updated by|author\b|copyright\b|entry point\W*$|"
    r"nobody has explained|not (?:yet )?documented|undocumented|placeholder|fill (?:this )?in\b|insert (?:description|documentation|comment))",
    re.I,
)
# Notes to a tool.
TOOL_NOTE = re.compile(
    r"^\W*(?:pylint|flake8|mypy|ruff|isort|fmt|yapf|pyright|type|noqa|nosec|pragma|eslint(?:-\w+)*|jshint|jslint|tslint|prettier-ignore|istanbul|c8|v8|@?ts-(?:ignore|nocheck|expect-error)|webpack\w*|"
    r"coverage|sourcery|codespell|cspell|noinspection|NOSONAR|region|endregion|@(?:flow|jsx|preserve|license|ts-\w+))\b(?:\s*[:=(]|\s+(?:ignore|disable|enable|off|on|next|skip|file|no)\b|-|\s*$)",
    re.I,
)
SIGNED = re.compile(r"^\W*(?:[A-Z]{2,5}/[A-Z]{1,4}\b.*\d|[A-Z]{1,4} \*\d+\*)|^\W*\w+(?:[./]\w+)*\s+\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\W*$")
CODE = re.compile(
    r"^\W{0,3}(?:(?:const|let|var|return|import|from|if|for|while|function|def|class|print|elif|else|try|await|throw|new)\b.*(?:[=;(){}\[\]:]|\breturn\b).*|return \w+|\w+(?:\.\w+)*\s*[-+*/]?=\s*\S.*|\w+(?:\.\w+)*\(.*\)\s*;?)$"
)
M_CODE = re.compile(
    r"^\W{0,3}(?:S|SET|K|KILL|N|NEW|D|DO|G|GOTO|I|IF|F|FOR|Q|QUIT|W|WRITE|R|READ|X|H|L|LOCK|U|USE|O|OPEN|C|CLOSE|M|MERGE|E|ELSE|J)(?::\S+)?(?: +(?:[\^$@%!'(\"?.*]|[A-Z][A-Z0-9]*(?:[=(,^:\s]|$)|\d)|  )"
)
WORD = re.compile(r"[^\W\d_]{3,}")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
MIN_WORDS = 4


def clean(text: str) -> list[str]:
    """Lines of a comment without its decoration."""
    lines = []
    for line in re.split(r"\r\n|\n|\r", text):
        line = re.sub(r"^[\s;*#!/]+", "", line) if not line.lstrip().startswith("#!") else line
        lines.append(re.sub(r"[\s*/#=~-]+$", "", line).strip())
    return [x for x in lines if x]


def description(text: str) -> str | None:
    """The describing part of a comment: without tags, stand-ins, signatures, rulers, code and notes to tools."""
    kept = []
    for line in clean(text):
        if TAG_LINE.match(line) or not WORD.search(line):
            continue
        if PLACEHOLDER.match(line) or TOOL_NOTE.match(line) or SIGNED.match(line) or CODE.match(line) or M_CODE.match(line):
            continue
        kept.append(line)
    return " ".join(kept) or None


def telling(text: str, label: str, formals) -> bool:
    """At least four different words of three or more letters besides the name, its parts and the arguments."""
    names = [*re.split(r"\W+", label), *(w for f in (formals if formals is not None else []) for w in re.split(r"\W+", str(f)))]
    own = {x.lower() for x in names} | {p.lower() for x in names for p in [*x.split("_"), *PART.findall(x)]}
    return len({w.lower() for w in WORD.findall(text)} - own) >= MIN_WORDS


def functions_of(path, src) -> list[dict] | None:
    """The functions of one file, which is parsed once, or None if it is of no known language or not valid."""
    kind = ending(path)
    if not isinstance(src, str):
        return None
    if kind == "js":
        try:
            return list(js_functions(src))
        except Fault:
            return None
    if kind == "py" or kind in STUBS:
        return None if python_fault(src) else list(python_functions(src))
    if kind == "m":
        return None if mumps_fault(src) else list(entry_points(src))
    return None


def told(f: dict) -> str | None:
    """The longest telling description among a function's comments."""
    best = ""
    for _, comment in f["docs"]:
        text = description(comment or "")
        if text and len(text) > len(best) and telling(text, f["name"], f["formals"]):
            best = text
    return best or None


def _symbols(bodies: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "module", "label", "kind", "formals", "line", "declares", "description", "body", "stub"]
        for b in batches:
            rows = []
            for file_id, repo, path, src in zip(b["file_id"], b["repo"], b["path"], b["src"]):
                found = functions_of(path, src)
                if not found:
                    continue
                module, stub = f"{repo if isinstance(repo, str) else ''}\t{path.rsplit('.', 1)[0]}", ending(path) in STUBS
                for f in found:
                    rows.append((file_id, module, f["name"], f["kind"], f["formals"], f["line"], stub or f.get("declares", False), told(f), f["body"] if bodies else None, stub))
            yield pd.DataFrame(rows, columns=columns)

    return run


def symbol_table(routines: DataFrame, bodies: bool = True) -> DataFrame:
    """One row per function of a file that parses: module, qualified name, formals, line, whether it declares only or too, its own description, body (or null)."""
    need = routines.select("file_id", "repo", "path", "src").where(F.col("file_id").isNotNull())
    table = need.mapInPandas(_symbols(bodies), SYMBOLS + ", stub boolean")
    return table.withColumn("sig", signature(F.col("formals"))).withColumn("folded", F.upper("label"))


def signature(formals) -> F.Column:
    """Arguments without case, references and blanks; null counts as no arguments."""
    return F.array_join(F.transform(F.coalesce(formals, F.array().cast("array<string>")), lambda x: F.upper(F.regexp_replace(x, r"[\s.]", ""))), ",")


def resolved(symbols: DataFrame) -> DataFrame:
    """Definitions with a description: their own, or that of the documented declaration of their module, name and signature."""
    own = symbols.where(~F.col("stub") & F.col("description").isNotNull())
    silent = symbols.where(~F.col("stub") & F.col("description").isNull()).drop("description")
    apart = symbols.where(F.col("declares") & F.col("description").isNotNull())
    said = apart.groupBy("module", "label", "sig").agg(F.max(F.struct(F.length("description"), "description"))["description"].alias("description"))
    return own.unionByName(silent.join(bounded(said), ["module", "label", "sig"]).select(*own.columns))


def documented_functions(routines: DataFrame, labels: DataFrame | None = None, bodies: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Code-description pairs: file_id, label, kind, formals, line, declared, body (null unless wanted), description.

    ``labels`` are separate declarations (file_id, label, formals); ``declared`` says whether one matched.
    """
    scratch = scratch or Scratch(routines.sparkSession)
    pairs = resolved(scratch.keep(symbol_table(routines, bodies)))
    once = pairs.groupBy("file_id", "label", "folded", "sig").agg(
        F.max("kind").alias("kind"), F.max("formals").alias("formals"), F.min("line").alias("line"), F.max("body").alias("body"),
        F.max(F.struct(F.length("description"), "description"))["description"].alias("description"),
    )
    if labels is None:
        joined = once.withColumn("declared", F.lit(None).cast("boolean"))
    else:
        known = labels.where(F.col("file_id").isNotNull()).select("file_id", F.upper(F.trim("label")).alias("folded"), signature(F.col("formals")).alias("sig")).distinct().withColumn("declared", F.lit(True))
        joined = once.join(known, ["file_id", "folded", "sig"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))
    return joined.select("file_id", "label", "kind", "formals", "line", "declared", "body", "description")


def documented_names(routines: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(file_id, label) of the same pairs, once each."""
    scratch = scratch or Scratch(routines.sparkSession)
    return resolved(scratch.keep(symbol_table(routines, bodies=False))).select("file_id", "label").distinct()
