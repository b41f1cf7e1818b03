"""Lexer with a pushdown stack for Python 3 and JSON, the compiler's check that follows it for Python, and Python's functions."""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings

CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?:[ \t]|$)|={7}[ \t]*$")
CLOSER = {"(": ")", "[": "]", "{": "}", "field": "}"}
PY_CODE = re.compile(r"[^\"'#()\[\]{}\n\\:]+")
PY_TEXT = {q: re.compile(rf"[^\\\n{{}}{q}]+") for q in "'\""}
PY_PREFIX = re.compile(r"(?<![0-9A-Za-z_])[rR]?[fF][rR]?\Z")


def python_lexer_fault(text: str) -> tuple[int, str] | None:
    """Unterminated literals, unbalanced delimiters, premature ends and conflict markers, by one pass with a stack.

    The stack holds open brackets, and of formatted literals the literal, its open field and that field's format: text
    and code alternate by what is on top. Whatever this pass reports is an error in every Python 3.
    """
    stack: list[tuple[str, int, str]] = []  # (bracket, "text", "field" or "format"; its line; quotes)
    at, line, n, fresh = 0, 1, len(text), True
    while at < n:
        top, _, mark = stack[-1] if stack else ("", 0, "")
        c = text[at]
        if top in ("text", "format"):
            if m := PY_TEXT[mark[0]].match(text, at):
                at = m.end()
            elif c == "\\":
                line += text[at + 1 : at + 2] == "\n"
                named = re.compile(r"\\N\{[^{}\n]*\}").match(text, at)
                at = named.end() if named else at + 1 if text[at + 1 : at + 2] in ("{", "}") else at + 2
            elif c == "{":
                if top == "text" and text.startswith("{{", at):
                    at += 2
                else:
                    stack.append(("field", line, mark))
                    at += 1
            elif c == "}":
                if top == "format":
                    del stack[-2:]
                    at += 1
                elif text.startswith("}}", at):
                    at += 2
                else:
                    return line, "unbalanced delimiter"
            elif text.startswith(mark, at):
                if top == "format":
                    return line, "unbalanced delimiter"
                stack.pop()
                at += len(mark)
            elif c == "\n" and len(mark) == 1 and top == "text":
                return line, "unterminated literal"
            else:
                line += c == "\n"
                at += 1
            continue
        if fresh and CONFLICT.match(text[at : at + 80].split("\n", 1)[0]):
            return line, "merge conflict marker"
        fresh = False
        if m := PY_CODE.match(text, at):
            at = m.end()
        elif c == "\n":
            line, at, fresh = line + 1, at + 1, True
        elif c == "#":
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif c == "\\":
            line += text[at + 1 : at + 2] == "\n"
            at += 2
        elif c in "\"'":
            mark = c * 3 if text.startswith(c * 3, at) else c
            prefix, at = text[max(0, at - 3) : at], at + len(mark)
            if PY_PREFIX.search(prefix):
                stack.append(("text", line, mark))
                continue
            begin = line
            while True:
                stop = text.find(c, at) if len(mark) == 1 else text.find(mark, at)
                escape = text.find("\\", at, stop if stop >= 0 else n)
                if escape >= 0 and len(mark) == 1 and "\n" in text[at:escape] or escape < 0 and (stop < 0 or len(mark) == 1 and "\n" in text[at:stop]):
                    return begin, "unterminated literal"
                end = escape + 2 if escape >= 0 else stop + len(mark)
                line += text.count("\n", at, end)
                at = end
                if escape < 0:
                    break
        elif c in "([{":
            stack.append((c, line, ""))
            at += 1
        elif c in ")]}":
            if CLOSER.get(top) != c:
                return line, "unbalanced delimiter"
            stack.pop()
            at += 1
        else:  # a colon, which begins the format of a field
            if top == "field":
                stack.append(("format", line, mark))
            at += 1
    if not stack:
        return None
    return stack[-1][1], "unterminated literal" if stack[-1][0] in ("text", "format") else "unbalanced delimiter: premature end"


def python_fault(src: str) -> tuple[int, str] | None:
    """The lexer decides on what a lexer can see; the grammar of what it lets pass is left to the compiler."""
    text = src.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if seen := python_lexer_fault(text):
        return seen
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "source", "exec", dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        return getattr(e, "lineno", None) or 1, "grammar"
    except (RecursionError, MemoryError):
        return deep_fault(text)
    return None


#: Tokens from which a statement may be too deep for CPython's parser or compiler, whose limits are fixed.
LONG = 400
COMPOUND = set("if elif else for while try except finally with def class async match case @".split())


def shallow(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text with ``pass`` for its long simple statements and ``if`` for each ``elif`` of a chain, lines kept; (line, statement) of those taken out."""
    lines, taken = text.split("\n"), []
    out, heads, logical = list(lines), {}, []
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type in (tokenize.COMMENT, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            continue
        if t.type != tokenize.NEWLINE:
            logical.append(t)
            continue
        first, (row, col), end = logical[0].string, logical[0].start, t.start[0]
        heads = {c: h for c, h in heads.items() if c <= col}
        if first == "elif" and heads.get(col) in ("if", "elif"):
            out[row - 1] = out[row - 1][:col] + "if" + out[row - 1][col + 4 :]
        heads[col] = first
        if len(logical) > LONG and first not in COMPOUND:
            indent = lines[row - 1][:col]
            taken.append((row, "\n".join(lines[row - 1 : end])[col:] + "\n"))
            out[row - 1 : end] = [""] * (end - row + 1)
            out[row - 1] = out[end - 1] = indent + "pass"
            if first == "return":
                out[end - 1] = indent + "return"
        logical = []
    return "\n".join(out), taken


def deep_fault(text: str) -> tuple[int, str] | None:
    """The verdict on a text too deep for one compilation: by its shallow form, then by each statement taken out of it.

    The parser is done with a statement before RecursionError rises, so that one is good. A statement that the parser
    itself gives up (MemoryError: some thousand nested operators) is valid, as the lexer found no fault in it.
    """
    try:
        form, taken = shallow(text)
    except (tokenize.TokenError, SyntaxError) as e:
        return getattr(e, "lineno", None) or e.args[1][0], "grammar"
    for line, part, flags in [(1, form, 0), *((line, part, ast.PyCF_ONLY_AST) for line, part in taken)]:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(part, "source", "exec", flags, dont_inherit=True)
        except (SyntaxError, ValueError) as e:
            return line - 1 + (getattr(e, "lineno", None) or 1), "grammar"
        except (RecursionError, MemoryError):
            continue
    return None


JSON_PART = re.compile(r'[ \t\n\r]*(?:([\[{\]},:])|("(?:[^"\\\x00-\x1f]|\\.)*"?|[^\s"\[\]{},:]+))')
# What a JSON string, number or name looks like.
JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
JSON_VALUE = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")


def json_fault(src: str) -> tuple[int, str] | None:
    """The grammar of JSON on a pushdown stack, so at any depth. An empty text is no value; NaN and Infinity are none."""
    stack, at, want = [], 0, "value"  # want: value, first (value or end), name, only (name or end), colon, next
    line = lambda at: src.count("\n", 0, at) + 1
    while m := JSON_PART.match(src, at):
        mark, leaf = m.groups()
        begin, at = m.start(m.lastindex), m.end()
        if leaf:
            if leaf[0] == '"':
                good = want in ("value", "first", "name", "only") and JSON_STRING.fullmatch(leaf)
                if not good and (len(leaf) == 1 or leaf[-1] != '"'):
                    return line(begin), "unterminated literal"
            else:
                good = want in ("value", "first") and JSON_VALUE.fullmatch(leaf)
            if not good:
                row = src[src.rfind("\n", 0, begin) + 1 :].split("\n", 1)[0]
                return line(begin), "merge conflict marker" if CONFLICT.match(row.rstrip("\r")) else "grammar"
            want = "colon" if want in ("name", "only") else "next"
        elif mark in "[{" and want in ("value", "first"):
            stack.append(mark)
            want = "first" if mark == "[" else "only"
        elif mark == ":" and want == "colon":
            want = "value"
        elif mark == "," and want == "next" and stack:
            want = "value" if stack[-1] == "[" else "name"
        elif mark in "]}" and (not stack or mark != CLOSER[stack[-1]]):
            return line(begin), "unbalanced delimiter"
        elif mark in "]}" and want in ("next", "first", "only"):
            stack.pop()
            want = "next"
        else:
            return line(begin), "grammar"
    if src[at:].strip(" \t\n\r"):
        return line(at), "grammar"
    return None if want == "next" and not stack else (line(len(src.rstrip())), "unbalanced delimiter: premature end" if stack or not src.strip() else "grammar")


def python_functions(src: str):
    """Functions of a valid file: dicts of name, kind, formals, line, body and comments at their places."""
    text = src.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (RecursionError, MemoryError):
            try:
                tree = ast.parse(shallow(text)[0])  # long simple statements hold no function
            except (RecursionError, MemoryError):
                return  # a head of a statement is too deep: no symbols
    lines = text.split("\n")
    comments: dict[int, tuple[str, bool]] = {}
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.COMMENT:
            comments[t.start[0]] = (t.string.lstrip("#"), not t.line[: t.start[1]].strip())

    def walk(node: ast.AST, owner: str):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                yield from walk(child, f"{owner}.{child.name}" if owner else child.name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield one(child, owner)
                yield from walk(child, "")
            else:
                yield from walk(child, owner)

    def one(f, owner: str) -> dict:
        a = f.args
        formals = [x.arg for x in [*a.posonlyargs, *a.args]]
        formals += ["*" + a.vararg.arg] if a.vararg else []
        formals += [x.arg for x in a.kwonlyargs] + (["**" + a.kwarg.arg] if a.kwarg else [])
        docs: list[tuple[str, str]] = []
        top = min([f.lineno, *(d.lineno for d in f.decorator_list)])
        above, k = [], top - 1
        while k in comments and comments[k][1]:
            above.append(comments[k][0])
            k -= 1
        if above:
            docs.append(("above", "\n".join(reversed(above))))
        first = f.body[0]
        head = [c for k, (c, alone) in comments.items() if f.lineno <= k < first.lineno and not alone]
        if head:
            docs.append(("first line", "\n".join(head)))
        below = [c for k, (c, alone) in comments.items() if f.lineno < k < first.lineno and alone]
        if below:
            docs.append(("below", "\n".join(below)))
        if (d := ast.get_docstring(f, clean=True)) is not None:
            docs.append(("docstring", d))
            if len(f.body) > 1:
                more = [c for k, (c, alone) in comments.items() if first.end_lineno < k < f.body[1].lineno and alone]
                if more:
                    docs.append(("below", "\n".join(more)))
        return {
            "name": f"{owner}.{f.name}" if owner else f.name, "kind": "method" if owner else "function", "formals": formals,
            "line": f.lineno, "docs": docs, "body": "\n".join(lines[top - 1 : f.end_lineno]),
            "declares": any(getattr(d, "id", getattr(d, "attr", "")) == "overload" for d in f.decorator_list),
        }

    yield from walk(tree, "")
