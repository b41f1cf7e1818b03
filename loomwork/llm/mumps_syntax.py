"""Line grammar of MUMPS: a lexer with a pushdown stack, and the entry points of a routine.

A line is an optional label with arguments in column 1, then blanks, dots, then commands or a comment.
Only the standard commands count, written in full or abbreviated; vendor commands (Z...) are not standard.
"""

from __future__ import annotations

import re

# The standard's commands and their abbreviations.
COMMANDS = {
    "B", "BREAK", "C", "CLOSE", "D", "DO", "E", "ELSE", "F", "FOR", "G", "GOTO", "H", "HALT", "HANG", "I", "IF",
    "J", "JOB", "K", "KILL", "L", "LOCK", "M", "MERGE", "N", "NEW", "O", "OPEN", "Q", "QUIT", "R", "READ",
    "S", "SET", "TC", "TCOMMIT", "TRE", "TRESTART", "TRO", "TROLLBACK", "TS", "TSTART", "U", "USE", "V", "VIEW",
    "W", "WRITE", "X", "XECUTE", "A", "ABLOCK", "ASS", "ASSIGN", "AST", "ASTART", "ASTOP", "AUNBLOCK", "ES",
    "ESTART", "ESTOP", "ETR", "ETRIGGER", "KS", "KSUBSCRIPTS", "KV", "KVALUE", "TH", "THEN", "RL", "RLOAD",
    "RS", "RSAVE",
}
#: Commands that mean nothing without an argument.
NEEDS_ARGUMENT = {"S", "SET", "G", "GOTO", "M", "MERGE", "O", "OPEN", "R", "READ", "U", "USE", "X", "XECUTE", "J", "JOB", "C", "CLOSE"}
NO_ARGUMENT = {"E", "ELSE", "HALT", "TC", "TCOMMIT", "TRE", "TRESTART"}

VERB = re.compile("[A-Za-z]+")
LABEL = re.compile(r"(%[A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*|[0-9]+)")
FORMALS = re.compile(r"\(\s*((?:%|[A-Za-z])[A-Za-z0-9]*(?:\s*,\s*(?:%|[A-Za-z])[A-Za-z0-9]*)*)?\s*\)")
CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?:\s|$)|={7}\s*$")
#: What an argument may not end with: an operator that still waits for its right side.
DANGLING = set("+-*/\\#_=<>&!?'@^$,:(")
#: Macros and object members of vendor dialects; a dot may stand in numbers, patterns and before arguments only.
VENDOR = re.compile(r"\$\$\$|(?<![A-Za-z0-9.%])[A-Za-z%][A-Za-z0-9]*\.[A-Za-z]|\.\.[A-Za-z]|##")


LITERAL = re.compile(r'"(?:[^"]|"")*"')
NO_OPERAND = re.compile(r"(?<![<>'=])={2,}|\(\)\(|=>|[<>]{3,}")


def lines_of(src: str) -> list[str]:
    """Lines without their ends; CRLF, LF and CR all end a line."""
    return re.split(r"\r\n|\n|\r", src)


ARGUMENT_PART = re.compile(r'[^"() \t;\x00-\x1f{}`~\x7f-\U0010ffff]+|"(?:[^"]|"")*"(?!")')


def scan_argument(text: str, at: int) -> tuple[int, str | None]:
    """End of the argument list that starts at ``at`` (a blank outside quotes and parentheses ends it)."""
    depth, n = 0, len(text)
    while at < n:
        if m := ARGUMENT_PART.match(text, at):
            at = m.end()
            continue
        c = text[at]
        if c == '"':
            return n, "unterminated literal"
        if c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                return at, "unbalanced delimiter"
            depth -= 1
        elif c in " \t":
            if not depth:
                return at, None
        elif c == ";":
            if not depth:
                return at, "comment inside an argument"
        else:
            return at, "character outside literals"
        at += 1
    return n, "unbalanced delimiter" if depth else None


def argument_fault(command: str, arg: str) -> str | None:
    """Faults of one argument list that the stack alone cannot see."""
    bare = LITERAL.sub('""', arg) if '"' in arg else arg
    plain = command in {"W", "WRITE", "R", "READ"}
    if bare[-1:] in DANGLING and not (plain and bare[-1] in "!#"):
        return "premature end"
    if VENDOR.search(bare):
        return "vendor syntax"
    if bare[:1] in (",", ")", "=", "]") or ",," in bare.replace("(,", "").replace(",,,", ",,") and "(" not in bare:
        return "missing operand"
    if command in {"S", "SET"} and "=" not in bare and not bare.startswith("@"):
        return "missing operand"
    if NO_OPERAND.search(bare):
        return "missing operand"
    return None


def commands_fault(text: str, at: int) -> str | None:
    """First fault in the commands of a line from ``at`` on."""
    n = len(text)
    while True:
        while at < n and text[at] in " \t":
            at += 1
        if at >= n or text[at] == ";":
            return None
        m = VERB.match(text, at)
        if not m or m.group().upper() not in COMMANDS:
            return "no standard command"
        command = m.group().upper()
        at = m.end()
        if at < n and text[at] == ":":
            end, fault = scan_argument(text, at + 1)
            if fault:
                return fault
            if end == at + 1:
                return "missing operand"
            if fault := argument_fault("", text[at + 1 : end]):
                return fault
            at = end
        if at >= n:
            return "premature end" if command in NEEDS_ARGUMENT else None
        if text[at] == ";":
            return None
        if text[at] not in " \t":
            return "no standard command"
        at += 1
        if at >= n or text[at] in " \t;":
            if command in NEEDS_ARGUMENT:
                return "missing operand"
            continue
        if command in NO_ARGUMENT:
            continue
        end, fault = scan_argument(text, at)
        if fault:
            return fault
        if fault := argument_fault(command, text[at:end]):
            return fault
        at = end


def line_fault(text: str) -> str | None:
    if CONFLICT.match(text):
        return "merge conflict marker"
    at = 0
    if text and text[0] not in " \t;":
        m = LABEL.match(text)
        if not m:
            return "no label in column 1"
        at = m.end()
        if text[at : at + 1] == "(":
            f = FORMALS.match(text, at)
            if not f:
                return "unbalanced delimiter" if ")" not in text[at:] else "argument list"
            at = f.end()
        if at < len(text) and text[at] not in " \t;":
            return "no label in column 1"
    while at < len(text) and text[at] in " \t.":
        at += 1
    return commands_fault(text, at)


def mumps_fault(src: str) -> tuple[int, str] | None:
    """(line number, fault) of the first line that is not valid, or None. An empty source is valid."""
    for i, text in enumerate(lines_of(src), 1):
        if fault := line_fault(text.rstrip("\f\x1a\x00")):
            return i, fault
    return None


def comment_of(text: str, at: int = 0) -> str | None:
    """The comment of a line from ``at`` on, without its semicolons, or None."""
    quoted = False
    for i in range(at, len(text)):
        if text[i] == '"':
            quoted = not quoted
        elif text[i] == ";" and not quoted:
            return text[i + 1 :]
    return None


def entry_points(src: str):
    """Labels after line 1: dicts of name, formals, line, body and the comments at its four places."""
    lines = lines_of(src)
    starts = [i for i, t in enumerate(lines) if t and t[0] not in " \t;" and LABEL.match(t)]
    for k, i in enumerate(starts):
        if i == 0:
            continue
        m = LABEL.match(lines[i])
        f = FORMALS.match(lines[i], m.end())
        rest = lines[i][f.end() if f else m.end() :]
        docs: list[tuple[str, str]] = []
        bare = rest.lstrip(" \t.")
        if bare.startswith(";"):
            docs.append(("first line", bare[1:]))
        elif bare and (c := comment_of(rest)) is not None:
            docs.append(("first line", c))
        below = []
        if not bare or bare.startswith(";"):
            j = i + 1
            while j < len(lines) and lines[j][:1] in (" ", "\t", ";") and lines[j].lstrip(" \t.").startswith(";"):
                below.append(lines[j].lstrip(" \t.")[1:])
                j += 1
        if below:
            docs.append(("below", "\n".join(below)))
        above, j = [], i - 1
        while j > 0 and lines[j][:1] in (" ", "\t", ";") and lines[j].lstrip(" \t").startswith(";"):
            above.append(lines[j].lstrip(" \t")[1:])
            j -= 1
        # Line 2 is the routine's version line, not a comment on what follows.
        if j == 0 and above:
            above.pop()
        if above:
            docs.append(("above", "\n".join(reversed(above))))
        end = starts[k + 1] if k + 1 < len(starts) else len(lines)
        formals = [x.strip() for x in f.group(1).split(",")] if f and f.group(1) else []
        yield {"name": m.group(), "kind": "label", "formals": formals, "line": i + 1, "docs": docs, "body": "\n".join(lines[i:end])}
