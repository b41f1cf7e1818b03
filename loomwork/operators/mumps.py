"""Kernels over MUMPS source: lexed lines, routine facts, local variables, naked references and label flags.

Each routine is parsed on its own in an Arrow kernel; everything relational around it stays native. The lexer keeps
character spans, so edits splice the line they touch. A routine that cannot be read yields a row with ``error``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.refs import BLOCKING

# Command names and their abbreviations.
VERBS = {
    "B": "BREAK", "C": "CLOSE", "D": "DO", "E": "ELSE", "F": "FOR", "G": "GOTO", "H": "HANG", "I": "IF", "J": "JOB", "K": "KILL",
    "L": "LOCK", "M": "MERGE", "N": "NEW", "O": "OPEN", "Q": "QUIT", "R": "READ", "S": "SET", "TC": "TCOMMIT", "TRE": "TRESTART",
    "TRO": "TROLLBACK", "TS": "TSTART", "U": "USE", "V": "VIEW", "W": "WRITE", "X": "XECUTE",
}
FULL = {**VERBS, **{v: v for v in VERBS.values()}, "HALT": "HALT"}
LABEL = re.compile(r"(%[A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*|\d+)(\(([^)]*)\))?")
FORMAL = re.compile(r"[^\s,]+")
VERB = re.compile("[A-Za-z]+")
NAME = re.compile(r"%?[A-Za-z][A-Za-z0-9]*|%")
GLOBAL = re.compile(r"\^(%?[A-Za-z][A-Za-z0-9]*)?(\()?")
ENTRY = re.compile(r"(\$\$)?(%?[A-Za-z0-9]*)\^(%?[A-Za-z][A-Za-z0-9]*)")


@dataclass
class Command:
    verb: str
    start: int
    cond: tuple[int, int] | None
    args: tuple[int, int] | None
    end: int


@dataclass
class Line:
    number: int
    raw: str
    code: str  # strings masked, comment cut, same offsets
    label: str | None = None
    formals: list[str] | None = None
    level: int = 0
    commands: list[Command] = field(default_factory=list)


QUOTED = re.compile(r'"((?:[^"]|"")*)("|$)')


def mask(text: str) -> str:
    """Characters inside quotes as \\x01, the same length; a doubled quote is part of its string, an open one reaches the end."""
    return QUOTED.sub(lambda m: '"' + "\x01" * len(m.group(1)) + m.group(2), text)


def run_of(code: str, at: int) -> int:
    """End of a run without blanks outside parentheses."""
    depth = 0
    while at < len(code):
        c = code[at]
        depth += (c == "(") - (c == ")")
        if c in " \t" and depth <= 0:
            break
        at += 1
    return at


def split_top(code: str, start: int, end: int, sep: str = ",") -> list[tuple[int, int]]:
    """Spans between separators outside parentheses."""
    out, depth, at = [], 0, start
    for i in range(start, end):
        depth += (code[i] == "(") - (code[i] == ")")
        if code[i] == sep and depth == 0:
            out.append((at, i))
            at = i + 1
    out.append((at, end))
    return out


def lex(src: str) -> list[Line]:
    lines = []
    for n, raw in enumerate(src.splitlines(), 1):
        m = mask(raw)
        cut = m.find(";")
        line = Line(n, raw, m if cut < 0 else m[:cut])
        at = 0
        if raw[:1] not in ("", " ", "\t", ";") and (lab := LABEL.match(raw)):
            line.label = lab.group(1)
            line.formals = None if lab.group(2) is None else FORMAL.findall(lab.group(3))
            at = lab.end()
        code = line.code
        while at < len(code) and code[at] in " \t.":
            line.level += code[at] == "."
            at += 1
        while at < len(code):
            while at < len(code) and code[at] in " \t":
                at += 1
            v = VERB.match(code, at)
            if not v:
                break
            start, at, cond, args = at, v.end(), None, None
            if code[at : at + 1] == ":":
                e = run_of(code, at + 1)
                cond, at = (at + 1, e), e
            if code[at : at + 1] in (" ", "\t"):
                at += 1
                if at < len(code) and code[at] not in " \t":
                    e = run_of(code, at)
                    args, at = (at, e), e
            line.commands.append(Command(FULL.get(v.group().upper(), v.group().upper()), start, cond, args, at))
        lines.append(line)
    return lines


def set_targets(line: Line, c: Command) -> list[tuple[str, bool]]:
    """(name, is a global) of what a SET assigns."""
    found = []
    for a, b in split_top(line.code, *c.args) if c.args else []:
        left = line.code[a:b]
        depth = 0
        for i, ch in enumerate(left):
            depth += (ch == "(") - (ch == ")")
            if ch == "=" and depth == 0:
                left = left[:i]
                break
        parts = left[1:-1].split(",") if left.startswith("(") and left.endswith(")") else [left]
        for p in parts:
            p = p.strip()
            m = re.match(r"\$(?:P|PIECE|E|EXTRACT)\(", p, re.I)
            p = p[m.end() :] if m else p
            if g := re.match(r"\^(%?[A-Za-z][A-Za-z0-9]*)", p):
                found.append((g.group(1), True))
            elif (n := NAME.match(p)) and not p.startswith("@"):
                found.append((n.group(), False))
    return found


#: Characters of a routine's remark that facts keep.
REMARK = 160


def remark(line: Line) -> str:
    """What follows the code of a line: its comment without the semicolon, cut to REMARK characters."""
    return line.raw[len(line.code) + 1 :].strip()[:REMARK]


def facts_of(name: str, src: str) -> dict:
    """Static facts of one routine."""
    lines = lex(src)
    commands: Counter = Counter()
    read, written, calls, scratch = set(), set(), set(), set()
    naked_read = naked_write = indirection = xecute = quits = bare = depth = 0
    flags: set[str] = set()
    comment = blank = data = code = 0
    for line in lines:
        text = line.code.strip(" \t.")
        if not line.raw.strip():
            blank += 1
        elif line.raw.lstrip(" \t").startswith(";;"):
            data += 1
        elif not text:
            comment += 1
        else:
            code += 1
        for c in line.commands:
            commands[c.verb] += 1
            args = line.code[slice(*c.args)] if c.args else ""
            if c.verb == "QUIT":
                quits += 1
                bare += not args and not c.cond
            targets = {n for n, g in set_targets(line, c) if g} if c.verb == "SET" else set()
            if c.verb in ("KILL", "MERGE"):
                targets |= {m.group(1) for m in GLOBAL.finditer(args) if m.group(1)}
            written |= targets
            span = line.code[c.start : c.end]
            naked = len(re.findall(r"\^\(", span))
            if c.verb in ("SET", "KILL") and re.match(r"\^\(", args):
                naked_write += 1
                naked -= 1
            naked_read += naked
            for m in ENTRY.finditer(span):
                if c.verb in ("DO", "GOTO", "JOB") or m.group(1):
                    calls.add(m.group(3).upper())
            plain = ENTRY.sub("", span) if c.verb in ("DO", "GOTO", "JOB") else re.sub(r"\$\$%?[A-Za-z0-9]*\^%?[A-Za-z][A-Za-z0-9]*", "", span)
            refs = {m.group(1) for m in re.finditer(r"\^(%?[A-Za-z][A-Za-z0-9]*)", plain)}
            read |= refs - targets if c.verb in ("SET", "KILL", "MERGE") else refs
            for m in re.finditer(r"\^%?[A-Za-z][A-Za-z0-9]*\(", plain):
                inner, d = 1, 1
                for ch in plain[m.end() :]:
                    d += (ch == "(") - (ch == ")")
                    inner += ch == "," and d == 1
                    if d == 0:
                        break
                depth = max(depth, inner)
            indirection += span.count("@")
            xecute += c.verb == "XECUTE"
            flags |= {"read"} if c.verb == "READ" else set()
            flags |= {"device"} if c.verb in ("OPEN", "USE", "CLOSE") else set()
            flags |= {"job"} if c.verb == "JOB" else set()
            for nd in re.findall(r"\$(H|HOROLOG|R|RANDOM|J|JOB)(?![A-Za-z])(?!\()", span, re.I):
                flags.add(f"nondet:${nd[0].upper()}")
            flags |= {"nondet:$R"} if re.search(r"\$R(?:ANDOM)?\(", span, re.I) else set()
    scratch = {g for g in read | written if re.match(r"(TMP|XTMP|UTILITY)$", g)}
    labels = [x for x in lines if x.label]
    return {
        "name": name, "lines_total": len(lines), "lines_code": code, "lines_comment": comment, "lines_data": data, "lines_blank": blank,
        "labels": len(labels), "formal_labels": sum(x.formals is not None for x in labels), "commands": dict(commands), "calls": sorted(calls - {name.upper()}),
        "globals_read": sorted(read), "globals_written": sorted(written), "scratch_globals": sorted(scratch), "naked_read": naked_read, "naked_write": naked_write,
        "indirection": indirection, "xecute": xecute, "bare_quit_ratio": round(bare / quits, 3) if quits else 0.0, "max_depth": depth,
        "flags": sorted(flags | ({"indirect"} if indirection else set()) | ({"xecute"} if xecute else set())),
        "first_comment": remark(lines[0]) if lines else "", "error": None,
    }


FACTS = (
    "name string, lines_total int, lines_code int, lines_comment int, lines_data int, lines_blank int, labels int, formal_labels int, commands map<string,int>, calls array<string>, globals_read array<string>, "
    "globals_written array<string>, scratch_globals array<string>, naked_read int, naked_write int, indirection int, xecute int, bare_quit_ratio double, max_depth int, flags array<string>, first_comment string, error string"
)


def _per_routine(f, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for n, s in zip(b["name"], b["source"]) if isinstance(s, str) for r in f(n, s)]
            yield pd.DataFrame(rows, columns=columns)

    return run


def _names(schema: str) -> list[str]:
    depth, out, word = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def routine_facts(routines: DataFrame) -> DataFrame:
    """One row of facts per routine (name, source); null sources give none, unreadable ones a row with ``error``."""

    def one(n, s):
        try:
            return [facts_of(n, s)]
        except Exception as e:  # noqa: BLE001 - a bad file never ends the scan
            return [{"name": n, "error": str(e)}]

    return routines.select("name", "source").mapInPandas(_per_routine(one, _names(FACTS)), FACTS)


LINES = "name string, line int, label string, formals array<string>, level int, commands array<struct<verb:string,from:int,to:int>>, code string"


def lexed_lines(routines: DataFrame) -> DataFrame:
    def one(n, s):
        return [(n, x.number, x.label, x.formals, x.level, [{"verb": c.verb, "from": c.start, "to": c.end} for c in x.commands], x.code.rstrip()) for x in lex(s)]

    return routines.select("name", "source").mapInPandas(_per_routine(one, _names(LINES)), LINES)


LOCALS = "name string, label string, formals array<string>, newed array<string>, written array<string>, read array<string>"


def local_variables(routines: DataFrame) -> DataFrame:
    """Per label the local variables by use; ``unscoped`` = written but neither formal nor newed."""

    def one(n, s):
        out, cur = [], {"label": n, "formals": [], "newed": set(), "written": set(), "read": set()}
        for line in lex(s):
            if line.label:
                out.append(cur)
                cur = {"label": line.label, "formals": line.formals or [], "newed": set(), "written": set(), "read": set()}
            for c in line.commands:
                args = line.code[slice(*c.args)] if c.args else ""
                names = {x for x in re.findall(r"(?<![\^$%A-Za-z0-9])(%?[A-Za-z][A-Za-z0-9]*)", re.sub(r'"[^"]*"', "", re.sub(r"\?[0-9.]*[A-Za-z0-9.\"]*", "", ENTRY.sub("", args))))}
                if c.verb == "NEW":
                    cur["newed"] |= names
                elif c.verb not in ("DO", "GOTO", "JOB"):
                    targets = {t for t, g in set_targets(line, c) if not g} if c.verb in ("SET", "FOR") else names if c.verb in ("READ", "KILL") else set()
                    cur["written"] |= targets
                    cur["read"] |= names - targets
        out.append(cur)
        return [(n, c["label"], list(c["formals"]), sorted(c["newed"]), sorted(c["written"]), sorted(c["read"])) for c in out[(1 if len(out) > 1 else 0) :]]

    rows = routines.select("name", "source").mapInPandas(_per_routine(one, _names(LOCALS)), LOCALS)
    return rows.withColumn("unscoped", F.array_except(F.array_except("written", "newed"), "formals"))


NAKED = "name string, line int, raw string, resolved string"


def naked_references(routines: DataFrame) -> DataFrame:
    """Naked references with what they resolve to: all but the last subscript of the reference before, then their own.

    References run in order of lines and places; a naked one that no reference precedes stays unresolved (null).
    """

    def one(n, s):
        last, out = None, []
        for line in lex(s):
            for m in re.finditer(r"\^(%?[A-Za-z][A-Za-z0-9]*)?\(", line.code):
                end, d = m.end(), 1
                while end < len(line.code) and d:
                    d += (line.code[end] == "(") - (line.code[end] == ")")
                    end += 1
                if d or line.code[max(0, m.start() - 2) : m.start()].endswith("$$") or (m.group(1) and re.search(r"[A-Za-z0-9%]$", line.code[: m.start()])):
                    continue
                subs = [line.raw[a:b] for a, b in split_top(line.code, m.end(), end - 1)]
                if m.group(1):
                    last = (m.group(1), subs)
                else:
                    if last:
                        last = (last[0], last[1][:-1] + subs)
                    out.append((n, line.number, line.raw[m.start() : end], f"^{last[0]}({','.join(last[1])})" if last else None))
        return out

    return routines.select("name", "source").mapInPandas(_per_routine(one, _names(NAKED)), NAKED)


# ---- labels: flags carried over local calls, and what clean entries reach ----------------------------------------
LABEL_FACTS = "name string, label string, seq int, formals array<string>, lines int, own_flags array<string>, flags array<string>, blocked_by array<string>, clean boolean, reached boolean"


def _line_flags(line: Line) -> set[str]:
    flags = set()
    for c in line.commands:
        span = line.code[c.start : c.end]
        flags |= {"indirect"} if "@" in span else set()
        flags |= {"xecute"} if c.verb == "XECUTE" else {"read"} if c.verb == "READ" else {"job"} if c.verb == "JOB" else {"device"} if c.verb in ("OPEN", "USE", "CLOSE") else set()
        flags |= {f"nondet:${m.group(1).upper()[0]}" for m in re.finditer(r"\$(H|HOROLOG|R|RANDOM|J|JOB)(?=$|[^A-Za-z])", span, re.I) if not (m.group(1).upper()[0] == "J" and span[m.end() : m.end() + 1] == "(")}
    return flags


def label_facts_of(name: str, src: str) -> list[tuple]:
    """Per label its own flags and those of every label it calls, at any distance, and whether clean entries reach it."""
    order: list[str] = []
    at: dict[str, dict] = {}
    cur = None
    for line in lex(src):
        if line.label:
            cur = line.label
            if cur not in at:
                order.append(cur)
                at[cur] = {"formals": line.formals, "lines": 0, "own": set(), "calls": set()}
        if cur is None:
            continue
        here = at[cur]
        here["lines"] += bool(line.commands)
        here["own"] |= _line_flags(line)
        for c in line.commands:
            args = line.code[slice(*c.args)] if c.args else ""
            if c.verb in ("DO", "GOTO"):
                here["calls"] |= {m.group(1) for a, b in (split_top(args, 0, len(args)) if args else []) if (m := re.match(r"(%?[A-Za-z0-9]+)(?=$|[(:+])", args[a:b]))}
            here["calls"] |= set(re.findall(r"\$\$(%?[A-Za-z0-9]+)(?!\^)(?=\(|$|[^A-Za-z0-9^])", line.code[c.start : c.end]))
    reach: dict[str, set[str]] = {}
    for n in order:
        seen, todo = {n}, [n]
        while todo:
            for m in at[todo.pop()]["calls"]:
                if m in at and m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    flags = {n: sorted(set().union(*(at[m]["own"] for m in reach[n]))) for n in order}
    blocked = {n: [f for f in flags[n] if re.match(BLOCKING, f)] for n in order}
    reached = set().union(*([reach[n] for n in order if at[n]["formals"] is not None and not blocked[n]] or [set()]))
    return [(name, n, i, at[n]["formals"], at[n]["lines"], sorted(at[n]["own"]), flags[n], blocked[n], not blocked[n], n in reached) for i, n in enumerate(order)]


def label_facts(routines: DataFrame) -> DataFrame:
    """One row per label: flags closed over local calls, what blocks it, whether clean entries with arguments reach it."""
    return routines.select("name", "source").mapInPandas(_per_routine(label_facts_of, _names(LABEL_FACTS)), LABEL_FACTS)


def entry_coverage(labels: DataFrame) -> DataFrame:
    """(name, coverage): share of a routine's lines with commands that clean entries with arguments reach."""
    lines = F.sum("lines")
    return labels.groupBy("name").agg(F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("reached"), F.col("lines")).otherwise(0)), lines), F.lit(0.0)), 3).alias("coverage"))


# ---- uses of variables in order, and what native windows say about them -------------------------------------------
USES = "name string, label string, line int, at int, variable string, written boolean, sure boolean"


def variable_uses(routines: DataFrame) -> DataFrame:
    """Every read and write of a local or global variable, in order of place; ``sure`` where no condition guards it.

    A SET reads its right sides before it writes its targets.
    """

    def one(n, s):
        out, label = [], n
        for line in lex(s):
            label = line.label or label
            guarded = line.level > 0
            for c in line.commands:
                guarded |= c.verb in ("IF", "ELSE", "FOR") or c.cond is not None and c.verb in ("QUIT", "GOTO")
                if not c.args or c.verb in ("DO", "GOTO", "JOB", "NEW"):
                    continue
                targets = {("^" if g else "") + t for t, g in set_targets(line, c)} if c.verb in ("SET", "FOR") else set()
                text = re.sub(r"\?[0-9.]*[A-Za-z0-9.]*", lambda m: " " * len(m.group()), line.code[slice(*c.args)])
                seen = set()
                for m in re.finditer(r"(?<![$A-Za-z0-9%^])\^?%?[A-Za-z][A-Za-z0-9]*", text):
                    if m.group() in targets and m.group() not in seen:
                        seen.add(m.group())
                        out.append((n, label, line.number, c.args[1], m.group(), True, not guarded and c.cond is None))
                    else:
                        written = c.verb in ("READ", "KILL")
                        out.append((n, label, line.number, c.args[0] + m.start(), m.group(), written, not guarded and c.cond is None))
        return out

    return routines.select("name", "source").mapInPandas(_per_routine(one, _names(USES)), USES)


def reassigned_later(uses: DataFrame) -> DataFrame:
    """Writes with ``again``: whether a later place of the same label writes the variable too."""
    from pyspark.sql import Window

    w = Window.partitionBy("name", "label", "variable").orderBy("line", "at").rowsBetween(1, Window.unboundedFollowing)
    return uses.where("written").withColumn("again", F.coalesce(F.max(F.lit(True)).over(w), F.lit(False)))


def reaching_writes(uses: DataFrame) -> DataFrame:
    """Reads with ``from_line``: the last unconditional write of the variable before them in the label, or null."""
    from pyspark.sql import Window

    w = Window.partitionBy("name", "label", "variable").orderBy("line", "at").rowsBetween(Window.unboundedPreceding, -1)
    return uses.withColumn("from_line", F.last(F.when(F.col("written") & F.col("sure"), F.col("line")), ignorenulls=True).over(w)).where(~F.col("written"))
