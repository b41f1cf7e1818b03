"""Lexer with a pushdown stack and a grammar check for JavaScript modules, with the functions they define."""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right

PUNCTUATION = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
NUMBER = re.compile(r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?\d)*)n)|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?")
CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?:[ \t]|$)|={7}[ \t]*$", re.M)
# Words the standard reserves in module code.
RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with await yield let static implements interface package private protected public".split())
BEFORE_REGEX = set("return typeof case in of delete void throw new else do instanceof yield await".split())
ASSIGNMENT = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
BINARY = {"||", "&&", "??", "|", "^", "&", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "<<", ">>", ">>>", "+", "-", "*", "/", "%", "**"}
CLOSER = {"(": ")", "[": "]", "{": "}", "${": "}"}


class Fault(Exception):
    def __init__(self, line: int, what: str):
        super().__init__(what)
        self.line, self.what = line, what


class Token:
    __slots__ = ("kind", "text", "line", "at", "newline", "match")

    def __init__(self, kind, text, line, at, newline):
        self.kind, self.text, self.line, self.at, self.newline, self.match = kind, text, line, at, newline, -1


def word_start(c: str) -> bool:
    return c in "$_\\" or c.isalpha() or unicodedata.category(c) == "Nl"


def lex(src: str) -> tuple[list[Token], list[tuple[int, int, str, bool]]]:
    """Tokens and comments (first line, last line, text, stands alone on its line).

    The stack holds the index of every open delimiter; a template literal stays on it while its expressions are read.
    """
    starts = [0] + [m.end() for m in re.finditer(r"\r\n|[\n\r  ]", src)]
    line_of = lambda at: bisect_right(starts, at)
    tokens: list[Token] = []
    comments: list[tuple[int, int, str, bool]] = []
    stack: list[int] = []
    at, n, newline = 0, len(src), True
    if src.startswith("﻿"):
        at = 1
    if src.startswith("#!", at):
        at = (re.compile(r"[\n\r]").search(src, at) or re.compile(r"$").search(src)).start()

    def template(at: int) -> int:
        """Reads the characters of a template from ``at`` to its end or next expression."""
        while at < n:
            c = src[at]
            if c == "\\":
                at += 2
            elif c == "`":
                tokens.append(Token("tail", "`", line_of(at), at, False))
                return at + 1
            elif src.startswith("${", at):
                tokens.append(Token("hole", "${", line_of(at), at, False))
                stack.append(len(tokens) - 1)
                return at + 2
            else:
                at += 1
        raise Fault(line_of(n), "unterminated literal")

    while at < n:
        c = src[at]
        if c in "\n\r  ":
            newline, at = True, at + 1
        elif c in " \t\v\f\xa0﻿" or unicodedata.category(c) == "Zs":
            at += 1
        elif src.startswith("//", at):
            end = (m.start() if (m := re.compile(r"[\n\r  ]").search(src, at)) else n)
            line = line_of(at)
            comments.append((line, line, src[at + 2 : end], not src[starts[line - 1] : at].strip()))
            at = end
        elif src.startswith("/*", at):
            end = src.find("*/", at + 2)
            if end < 0:
                raise Fault(line_of(at), "unterminated comment")
            first, last = line_of(at), line_of(end)
            comments.append((first, last, src[at + 2 : end], not src[starts[first - 1] : at].strip()))
            newline |= last > first
            at = end + 2
        else:
            if newline and (m := CONFLICT.match(src, at)) and (at == 0 or src[at - 1] in "\n\r"):
                raise Fault(line_of(at), "merge conflict marker")
            before = tokens[-1] if tokens else None
            token = lambda kind, end: Token(kind, src[at:end], line_of(at), at, newline)  # noqa: E731, B023
            if c in "\"'":
                end = at + 1
                while True:
                    if end >= n or src[end] in "\n\r":
                        raise Fault(line_of(at), "unterminated literal")
                    if src[end] == "\\":
                        end += 3 if src.startswith("\r\n", end + 1) else 2
                    elif src[end] == c:
                        break
                    else:
                        end += 1
                tokens.append(token("string", end + 1))
                at = end + 1
            elif c == "`":
                tokens.append(token("template", at + 1))
                at = template(at + 1)
            elif c.isdigit() and c.isascii() or c == "." and src[at + 1 : at + 2].isdigit():
                m = NUMBER.match(src, at)
                if not m or m.end() < n and (word_start(src[m.end()]) or src[m.end()].isdigit()):
                    raise Fault(line_of(at), "malformed number")
                tokens.append(token("number", m.end()))
                at = m.end()
            elif word_start(c) or c == "#" and at + 1 < n and word_start(src[at + 1]):
                end = at + 1
                while end < n and (word_start(src[end]) or src[end].isalnum() or unicodedata.category(src[end]) in ("Mn", "Mc", "Nd", "Pc") or src[end] in "‌‍"):
                    end += 1
                tokens.append(token("private" if c == "#" else "word", end))
                at = end
            elif c == "/" and (before is None or before.kind == "hole" or before.kind == "punct" and before.text not in (")", "]", "++", "--") or before.kind == "word" and before.text in BEFORE_REGEX):
                end, klass = at + 1, False
                while True:
                    if end >= n or src[end] in "\n\r  ":
                        raise Fault(line_of(at), "unterminated literal")
                    if src[end] == "\\":
                        end += 1
                    elif src[end] == "[":
                        klass = True
                    elif src[end] == "]":
                        klass = False
                    elif src[end] == "/" and not klass:
                        break
                    end += 1
                end += 1
                while end < n and src[end].isalpha():
                    end += 1
                tokens.append(token("regex", end))
                at = end
            else:
                m = PUNCTUATION.match(src, at)
                if not m:
                    raise Fault(line_of(at), "character outside literals")
                tokens.append(token("punct", m.end()))
                text, at = m.group(), m.end()
                if text in "([{":
                    stack.append(len(tokens) - 1)
                elif text in ")]}":
                    if not stack or CLOSER[tokens[stack[-1]].text] != text:
                        raise Fault(tokens[-1].line, "unbalanced delimiter")
                    opener = stack.pop()
                    tokens[opener].match = len(tokens) - 1
                    if tokens[opener].text == "${":
                        at = template(at)
            newline = False
    if stack:
        raise Fault(line_of(n), "unbalanced delimiter: premature end")
    tokens.append(Token("end", "", line_of(n), n, True))
    return tokens, comments


class Grammar:
    """Recursive descent over the tokens. Records (name, kind, formals, first token, body token) of functions."""

    def __init__(self, tokens: list[Token]):
        self.t, self.i, self.functions, self.path = tokens, 0, [], []
        self.depth = self.loops = 0

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def fail(self, what="unexpected token"):
        raise Fault(self.now.line, "premature end" if self.now.kind == "end" else what)

    def at(self, *texts: str) -> bool:
        return self.now.kind in ("punct", "word") and self.now.text in texts

    def ahead(self, k=1) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def accept(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            self.fail()

    def name(self) -> str:
        if self.now.kind != "word" or self.now.text in RESERVED:
            self.fail()
        self.i += 1
        return self.t[self.i - 1].text

    def end_of_statement(self) -> None:
        if not self.accept(";") and not (self.at("}") or self.now.kind == "end" or self.now.newline):
            self.fail()

    def module(self) -> None:
        while self.now.kind != "end":
            self.statement(top=True)

    def block(self) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.now.kind == "end":
                self.fail()
            self.statement()
        self.i += 1

    def statement(self, top=False) -> None:
        t, first = self.now, self.i
        word = t.text if t.kind == "word" else ""
        if self.at("{"):
            self.block()
        elif self.accept(";"):
            pass
        elif word == "import" and self.ahead().text not in ("(", "."):
            if not top:
                self.fail()
            self.imports()
        elif word == "export":
            if not top:
                self.fail()
            self.exports()
        elif word in ("var", "const", "let"):
            self.i += 1
            self.declarations(word, first)
            self.end_of_statement()
        elif word == "function" or word == "async" and self.ahead().text == "function" and not self.ahead().newline:
            self.function(first, declared=True)
        elif word == "class":
            self.klass(declared=True)
        elif word == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.accept("else"):
                self.statement()
        elif word == "for":
            self.loop()
        elif word == "while":
            self.i += 1
            self.condition()
            self.body_of_loop()
        elif word == "do":
            self.i += 1
            self.body_of_loop()
            self.expect("while")
            self.condition()
            self.accept(";")
        elif word == "switch":
            self.i += 1
            self.condition()
            self.expect("{")
            self.loops += 1
            while not self.accept("}"):
                if self.accept("case"):
                    self.expression()
                else:
                    self.expect("default")
                self.expect(":")
                while not self.at("case", "default", "}"):
                    if self.now.kind == "end":
                        self.fail()
                    self.statement()
            self.loops -= 1
        elif word == "try":
            self.i += 1
            self.block()
            caught = self.accept("catch")
            if caught:
                if self.accept("("):
                    self.target()
                    self.expect(")")
                self.block()
            if self.accept("finally"):
                self.block()
            elif not caught:
                self.fail()
        elif word in ("return", "throw"):
            if word == "return" and not self.depth:
                self.fail("return outside a function")
            self.i += 1
            if not (self.at(";", "}") or self.now.kind == "end" or self.now.newline):
                self.expression()
            elif word == "throw":
                self.fail()
            self.end_of_statement()
        elif word in ("break", "continue"):
            self.i += 1
            if self.now.kind == "word" and not self.now.newline and not self.at("}"):
                self.name()
            elif not self.loops:
                self.fail(f"{word} outside a loop")
            self.end_of_statement()
        elif word == "debugger":
            self.i += 1
            self.end_of_statement()
        elif t.kind == "word" and word not in RESERVED and self.ahead().text == ":":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.end_of_statement()

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def body_of_loop(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def loop(self) -> None:
        self.i += 1
        self.accept("await")
        self.expect("(")
        if self.at("var", "let", "const"):
            kind, first = self.now.text, self.i
            self.i += 1
            if self.declarations(kind, first, loop=True):
                self.expression()
                self.expect(")")
                return self.body_of_loop()
        elif not self.at(";"):
            self.expression(no_in=True)
            if self.accept("of", "in"):
                self.expression()
                self.expect(")")
                return self.body_of_loop()
        self.expect(";")
        if not self.at(";"):
            self.expression()
        self.expect(";")
        if not self.at(")"):
            self.expression()
        self.expect(")")
        self.body_of_loop()

    def declarations(self, kind: str, first: int, loop=False) -> bool:
        """True where it heads a for-of or for-in loop."""
        while True:
            plain = self.now.kind == "word"
            name = self.now.text
            self.target()
            if loop and self.accept("of", "in"):
                return True
            if self.accept("="):
                self.assignment(no_in=loop, bound=(name, first) if plain and kind == "const" else None)
            elif kind == "const" or not plain:
                self.fail("declaration without a value")
            if not self.accept(","):
                return False

    def target(self) -> None:
        """A binding: a name or a pattern."""
        if self.accept("["):
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.target()
                if self.accept("="):
                    self.assignment()
                if not self.at("]"):
                    self.expect(",")
        elif self.accept("{"):
            while not self.accept("}"):
                if self.accept("..."):
                    self.target()
                else:
                    shorthand = self.now.kind == "word" and self.now.text not in RESERVED
                    self.key()
                    if self.accept(":"):
                        self.target()
                    elif not shorthand:
                        self.fail()
                    if self.accept("="):
                        self.assignment()
                if not self.at("}"):
                    self.expect(",")
        else:
            self.name()

    def key(self) -> str:
        t = self.now
        if t.kind in ("word", "string", "number", "private"):
            self.i += 1
            return t.text.strip("\"'")
        self.expect("[")
        self.assignment()
        self.expect("]")
        return "[computed]"

    def formals(self) -> list[str]:
        self.expect("(")
        found = []
        while not self.accept(")"):
            rest = self.accept("...")
            first = self.i
            self.target()
            found.append(("..." if rest else "") + "".join(t.text for t in self.t[first : self.i]))
            if self.accept("="):
                self.assignment()
            if not self.at(")"):
                if rest:
                    self.fail()
                self.expect(",")
        return found

    def function_body(self) -> None:
        loops, self.loops = self.loops, 0
        self.depth += 1
        self.block()
        self.depth -= 1
        self.loops = loops

    def function(self, first: int, declared=False, bound=None) -> None:
        self.accept("async")
        self.expect("function")
        self.accept("*")
        name = None
        if self.now.kind == "word" and not self.at("("):
            name = self.name()
        elif declared:
            self.fail()
        formals = self.formals()
        body = self.i
        if name and declared:
            self.functions.append((".".join([*self.path, name]) if False else name, "function", formals, first, body))
        elif bound:
            self.functions.append((bound[0], "const", formals, bound[1], body))
        self.function_body()

    def klass(self, declared=False) -> None:
        self.expect("class")
        name = ""
        if self.now.kind == "word" and not self.at("extends", "{"):
            name = self.name()
        elif declared:
            self.fail()
        if self.accept("extends"):
            self.unary()
        self.expect("{")
        while not self.accept("}"):
            if self.accept(";"):
                continue
            first = self.i
            if self.at("static") and self.ahead().text == "{":
                self.i += 1
                self.function_body()
                continue
            for modifier in ("static", "async", "*", "get", "set"):
                if self.at(modifier) and (modifier == "*" or self.ahead().text not in ("(", "=", ";", "}")):
                    self.i += 1
                    if modifier == "async":
                        self.accept("*")
            key = self.key()
            if self.at("("):
                formals = self.formals()
                body = self.i
                if name:
                    self.functions.append((f"{name}.{key}", "method", formals, first, body))
                self.function_body()
            else:
                if self.accept("="):
                    self.assignment()
                self.end_of_statement()

    def imports(self) -> None:
        self.i += 1
        if self.now.kind == "string":
            self.i += 1
            return self.end_of_statement()
        if self.now.kind == "word" and not self.at("{"):
            self.name()
            if not self.accept(","):
                return self.source()
        if self.accept("*"):
            self.expect("as")
            self.name()
        else:
            self.specifiers()
        self.source()

    def specifiers(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.now.kind not in ("word", "string"):
                self.fail()
            self.i += 1
            if self.accept("as"):
                if self.now.kind not in ("word", "string"):
                    self.fail()
                self.i += 1
            if not self.at("}"):
                self.expect(",")

    def source(self) -> None:
        self.expect("from")
        if self.now.kind != "string":
            self.fail()
        self.i += 1
        if self.at("with", "assert") and not self.now.newline:
            self.i += 1
            self.object()
        self.end_of_statement()

    def exports(self) -> None:
        first = self.i
        self.i += 1
        if self.accept("default"):
            if self.at("function") or self.at("async") and self.ahead().text == "function":
                self.function(first, declared=self.ahead(1).kind == "word" and self.ahead(1).text not in ("function", "(") or self.ahead(2).kind == "word")
            elif self.at("class"):
                self.klass()
            else:
                self.assignment()
                self.end_of_statement()
        elif self.accept("*"):
            if self.accept("as"):
                self.key()
            self.source()
        elif self.at("{"):
            self.specifiers()
            if self.at("from"):
                self.source()
            else:
                self.end_of_statement()
        elif self.at("function") or self.at("async") and self.ahead().text == "function":
            self.function(first, declared=True)
        elif self.at("var", "let", "const"):
            kind = self.now.text
            self.i += 1
            self.declarations(kind, first)
            self.end_of_statement()
        elif self.at("class"):
            self.klass(declared=True)
        else:
            self.fail()

    def expression(self, no_in=False) -> None:
        self.assignment(no_in)
        while self.accept(","):
            self.assignment(no_in)

    def arrow(self) -> bool:
        k = self.i + (self.at("async") and not self.ahead().newline and self.ahead().text != "=>")
        t = self.t[min(k, len(self.t) - 1)]
        if t.kind == "word" and t.text not in RESERVED:
            return self.t[k + 1].text == "=>" and self.t[k + 1].kind == "punct"
        return t.kind == "punct" and t.text == "(" and t.match > 0 and self.t[t.match + 1].text == "=>"

    def assignment(self, no_in=False, bound=None) -> None:
        first = self.i
        if self.now.kind == "word" and self.now.text == "yield":
            self.i += 1
            if not self.at(")", "]", "}", ",", ";") and not self.now.newline and self.now.kind != "end":
                self.accept("*")
                self.assignment(no_in)
            return
        if self.arrow():
            if self.at("async") and self.ahead().text != "=>":
                self.i += 1
            formals = self.formals() if self.at("(") else [self.name()]
            if self.now.newline:
                self.fail()
            self.expect("=>")
            if bound:
                self.functions.append((bound[0], "const", formals, bound[1], self.i))
            if self.at("{"):
                self.function_body()
            else:
                self.depth += 1
                self.assignment(no_in)
                self.depth -= 1
            return
        if bound and (self.at("function") or self.at("async") and self.ahead().text == "function"):
            mark = self.i
            self.function(mark, bound=bound)
            if self.at(";", ",") or self.now.newline or self.now.kind == "end":
                return
            self.i = mark
        kind = self.unary()
        while self.now.kind == "punct" and self.now.text in BINARY or self.at("instanceof") or self.at("in") and not no_in:
            self.i += 1
            self.unary()
            kind = "value"
        if self.accept("?"):
            self.assignment()
            self.expect(":")
            self.assignment(no_in)
        elif self.now.kind == "punct" and self.now.text in ASSIGNMENT:
            if kind == "value" or kind == "pattern" and self.now.text != "=":
                self.fail("assignment to a value")
            self.i += 1
            self.assignment(no_in)
        del first

    def unary(self) -> str:
        if self.at("!", "~", "+", "-", "typeof", "void", "delete", "await"):
            self.i += 1
            self.unary()
            return "value"
        if self.at("++", "--"):
            self.i += 1
            if self.unary() not in ("name", "member"):
                self.fail()
            return "value"
        kind = self.postfix()
        if self.at("++", "--") and not self.now.newline:
            if kind not in ("name", "member"):
                self.fail()
            self.i += 1
            return "value"
        return kind

    def postfix(self) -> str:
        t = self.now
        if self.at("new"):
            self.i += 1
            if self.accept("."):
                self.name()
            else:
                self.unary() if self.at("new") else self.chain(self.primary(), calls=False)
                if self.at("("):
                    self.arguments()
            return self.chain("value")
        if self.at("import", "super"):
            self.i += 1
            if not self.at("(", ".", "["):
                self.fail()
            return self.chain("value")
        del t
        return self.chain(self.primary())

    def chain(self, kind: str, calls=True) -> str:
        while True:
            if self.accept("."):
                if self.now.kind not in ("word", "private"):
                    self.fail()
                self.i += 1
                kind = "member"
            elif self.accept("?."):
                if self.at("("):
                    self.arguments()
                elif self.accept("["):
                    self.expression()
                    self.expect("]")
                elif self.now.kind in ("word", "private"):
                    self.i += 1
                else:
                    self.fail()
                kind = "value"
            elif self.at("["):
                self.i += 1
                self.expression()
                self.expect("]")
                kind = "member"
            elif self.at("(") and calls:
                self.arguments()
                kind = "value"
            elif self.now.kind == "template":
                self.template()
                kind = "value"
            else:
                return kind

    def arguments(self) -> None:
        self.expect("(")
        while not self.accept(")"):
            self.accept("...")
            self.assignment()
            if not self.at(")"):
                self.expect(",")

    def template(self) -> None:
        self.i += 1
        while self.now.kind == "hole":
            self.i += 1
            self.expression()
            self.expect("}")
        if self.now.kind != "tail":
            self.fail()
        self.i += 1

    def object(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.accept("..."):
                self.assignment()
            else:
                for modifier in ("async", "*", "get", "set"):
                    if self.at(modifier) and (modifier == "*" or self.ahead().text not in ("(", ":", ",", "}", "=")):
                        self.i += 1
                shorthand = self.now.kind == "word" and self.now.text not in RESERVED
                self.key()
                if self.at("("):
                    self.formals()
                    self.function_body()
                elif self.accept(":"):
                    self.assignment()
                elif not shorthand:
                    self.fail()
                elif self.accept("="):
                    self.assignment()
            if not self.at("}"):
                self.expect(",")

    def primary(self) -> str:
        t = self.now
        if t.kind in ("string", "number", "regex"):
            self.i += 1
            return "value"
        if t.kind == "template":
            self.template()
            return "value"
        if t.kind == "word":
            if t.text == "function" or t.text == "async" and self.ahead().text == "function" and not self.ahead().newline:
                self.function(self.i)
                return "value"
            if t.text == "class":
                self.klass()
                return "value"
            if t.text in ("this", "null", "true", "false"):
                self.i += 1
                return "value"
            self.name()
            return "name"
        if t.kind == "private" and self.ahead().text == "in":
            self.i += 1
            return "value"
        if self.at("("):
            self.i += 1
            self.expression()
            self.expect(")")
            # A parenthesised name or member can still be assigned to.
            return "member" if self.t[self.i - 2].kind == "word" else "value"
        if self.accept("["):
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.assignment()
                if not self.at("]"):
                    self.expect(",")
            return "pattern"
        if self.at("{"):
            self.object()
            return "pattern"
        self.fail()


#: Python frames that the grammar may use for one token; Python-to-Python calls take no C stack.
FRAMES = 40


def parsed(src: str) -> tuple[list[Token], list[tuple[int, int, str, bool]], Grammar]:
    """Tokens, comments and the grammar after a whole pass, however deep the nesting: the recursion limit follows the tokens."""
    tokens, comments = lex(src)
    g = Grammar(tokens)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + FRAMES * len(tokens))
    try:
        g.module()
    finally:
        sys.setrecursionlimit(limit)
    return tokens, comments, g


def js_fault(src: str) -> tuple[int, str] | None:
    try:
        parsed(src)
    except Fault as f:
        return f.line, f.what
    return None


def js_functions(src: str):
    """Functions of a valid module: dicts of name, kind, formals, line, body and comments at their places."""
    tokens, comments, g = parsed(src)
    lines = re.split(r"\r\n|[\n\r  ]", src)
    for name, kind, formals, first, body in g.functions:
        t, b = tokens[first], tokens[body]
        docs: list[tuple[str, str]] = []
        want, above = t.line - 1, []
        block = False
        for c in reversed(comments):
            if c[1] == want and c[3] and not block and c[0] < t.line:
                multi = src.count("*/", 0, t.at) and not lines[c[0] - 1].lstrip().startswith("//")
                if multi and above:
                    break
                above.append(c[2])
                want, block = c[0] - 1, bool(multi)
        if above:
            docs.append(("above", "\n".join(reversed(above))))
        if b.text == "{":
            after = tokens[body + 1]
            on_line = [c[2] for c in comments if c[0] == b.line and not c[3]]
            if on_line:
                docs.append(("first line", "\n".join(on_line)))
            below = [c[2] for c in comments if b.line < c[0] and (c[1] < after.line or c[1] == after.line and c[3]) and c[3]]
            if below:
                docs.append(("below", "\n".join(below)))
        last = b.match if b.text == "{" and b.match > 0 else body
        yield {"name": name, "kind": kind, "formals": formals, "line": t.line, "docs": docs, "body": src[t.at : tokens[last].at + 1]}
