"""Text expressions that stay in the JVM: tokens, slugs, globs, masking, percent codec, dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores with an optional dollar sign before them; the same in RE2 and Java.
TOKEN = r"\$?[\p{L}\p{N}_]+"
#: Line ends as Python's splitlines knows them.
LINE_END = "\r\n|[\n\u000b\u000c\r\u001c\u001d\u001e\u0085  ]"


def folded(text) -> Column:
    """Lower case with the sharp s as ss; other case foldings that change length are left as lower case."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text) -> Column:
    """Null gives null, an empty text an empty array."""
    return F.regexp_extract_all(folded(text), F.lit(f"({TOKEN})"), F.lit(1))


def lines(text) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def slug(text, default: str = "reference") -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")), F.lit("")), F.lit(default))


def glob_regex(pattern: str) -> str:
    """A glob with * ? and [..] as a regular expression for rlike; everything else is literal."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def masked(line) -> Column:
    """Characters between double quotes replaced one for one; a doubled quote inside reads as end and start."""
    return F.array_join(F.transform(F.split(line, '"', -1), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit("\u0001"), F.length(p))).otherwise(p)), '"')


def code_part(line) -> Column:
    """A line without its comment: up to the first semicolon outside quotes."""
    return F.substring(line, F.lit(1), F.length(F.substring_index(masked(line), ";", 1)))


def escape(text) -> Column:
    """Percent codec for the five characters that a wire record reserves."""
    out = text
    for c in ("%", "\t", "\n", "\r", "\0"):  # fixed values; the percent sign comes first
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def unescape(text) -> Column:
    """Inverse of ``escape``; any other %HH of ASCII decodes as well."""
    parts = F.split(text, "%", -1)

    def piece(p, i):
        code = F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
        return F.when((i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.char(code), F.substr(p, F.lit(3)))).when(i > 0, F.concat(F.lit("%"), p)).otherwise(p)

    return F.array_join(F.transform(parts, piece), "")


def fileman_date(value) -> Column:
    """YYYMMDD[.HHMMSS] counted from 1700 as ISO text; day 0 or month 0 leaves the date partial; anything else is null."""
    g = lambda k: F.regexp_extract(value, r"^(\d{3})(\d{2})(\d{2})(?:\.(\d{1,6}))?$", k)
    year = (g(1).try_cast("int") + 1700).cast("string")
    month, day = g(2).try_cast("int"), g(3).try_cast("int")
    time = F.rpad(g(4), 6, "0")
    clock = F.concat(F.lit("T"), F.substring(time, 1, 2), F.lit(":"), F.substring(time, 3, 2), F.lit(":"), F.substring(time, 5, 2))
    date = F.when((month == 0) & (day == 0), year).when(day == 0, F.concat(year, F.lit("-"), g(2))).otherwise(F.concat(year, F.lit("-"), g(2), F.lit("-"), g(3)))
    ok = value.rlike(r"^\d{7}(\.\d{1,6})?$") & (month <= 12) & (day <= 31)
    return F.when(ok, F.when(g(4) == "", date).otherwise(F.concat(date, clock)))
