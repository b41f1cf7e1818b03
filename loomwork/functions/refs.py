"""Expressions and small kernels over stored references, patterns, errors and texts that changed."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A literal leaf reference: a name and at least one numeric or quoted subscript; a doubled quote stands for one.
SAFE_REF = r'^\^%?[A-Za-z][A-Za-z0-9]*\((?:-?(?:0|[1-9][0-9]*|[0-9]*\.[0-9]*[1-9])|"(?:[^"\x00-\x1f]|"")*")(?:,(?:-?(?:0|[1-9][0-9]*|[0-9]*\.[0-9]*[1-9])|"(?:[^"\x00-\x1f]|"")*"))*\)$'
#: Transaction commands where a command may stand, full or abbreviated.
TRANSACTION = r"(?i)(?:^|[ \t.])(?:TS(?:TART)?|TC(?:OMMIT)?|TRO(?:LLBACK)?|TRE(?:START)?)(?=$|[ \t:])"
# Flags that keep an entry from running unattended begin with one of these.
BLOCKING = r"^(nondet:|interactive:|read|device|job|xecute|indirect)"


def safe_ref(ref, reserved: tuple[str, ...] = ()) -> Column:
    """Whether a reference is a literal leaf of at most 512 characters outside reserved roots. Null is not safe."""
    root = F.upper(F.regexp_extract(ref, r"^\^(%?[A-Za-z][A-Za-z0-9]*)", 1))
    ok = ref.rlike(SAFE_REF) & (F.length(ref) <= 512)
    return F.coalesce(ok & ~root.isin(*reserved) if reserved else ok, F.lit(False))


def global_root(text) -> Column:
    """``DPT``, ``^DPT`` or ``^DPT(...`` as ``^DPT(``."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.trim(text), r"^\^", ""), r"\(.*$", ""), F.lit("("))


def blocking_flags(flags) -> Column:
    return F.array_sort(F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda x: x.rlike(BLOCKING)))


def uses_transactions(code) -> Column:
    """Whether a line of code, strings masked and comments cut, has a transaction command in command position."""
    return F.coalesce(code.rlike(TRANSACTION), F.lit(False))


def first_difference(a, b) -> Column:
    """1-based place of the first character that differs, null where the texts are equal."""
    n = F.greatest(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.try_element_at(places, F.lit(1))


def error_code(text) -> Column:
    """The code that begins an error text: its first token before a comma, a dash or a blank."""
    return F.nullif(F.regexp_extract(text, r"^\s*%?(?:[A-Z]+-[A-Z]-)?([A-Z0-9]+)", 1), F.lit(""))


def unified_diff(before, after) -> Column:
    """Unified diff of two texts with one line of context; null where either is null."""
    return F.pandas_udf(_diff, "string")(before, after)


def _diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff(x.splitlines(), y.splitlines(), "before", "after", n=1, lineterm="")) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype=object)


SAMPLE_OF = {"N": "1", "A": "A", "U": "A", "L": "a", "P": "-", "C": "\t", "E": "x"}  # fixed values: pattern codes
ATOM = re.compile(r'(\d*)(\.?)(\d*)([A-Za-z]+|"(?:[^"]|"")*")')


def expand_pattern(pattern: str) -> str | None:
    """The shortest text that a pattern such as ``3N1"-".A`` accepts; null for alternation or what is no pattern."""
    out, at = "", 0
    while at < len(pattern):
        m = ATOM.match(pattern, at)
        if not m or not (m.group(1) or m.group(2)):
            return None
        low = int(m.group(1) or 0)
        unit = m.group(4)[1:-1].replace('""', '"') if m.group(4).startswith('"') else SAMPLE_OF.get(m.group(4)[0].upper())
        if unit is None:
            return None
        out += unit * low
        at = m.end()
    return out


def pattern_sample(pattern) -> Column:
    return F.pandas_udf(_sample, "string")(pattern)


def _sample(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: expand_pattern(p) if isinstance(p, str) else None)


def wire_get(record, key: str) -> Column:
    """First value of a key in an ordered multimap array<struct<k,v>>, or null."""
    return F.try_element_at(wire_all(record, key), F.lit(1))


def wire_all(record, key: str) -> Column:
    return F.transform(F.filter(record, lambda e: e["k"] == key), lambda e: e["v"])


def wire_parse(line) -> Column:
    """KEY TAB VALUE lines as an ordered multimap; lines without a tab are dropped, values keep further tabs."""
    pairs = F.filter(F.transform(F.split(line, "\n", -1), lambda x: F.split(x, "\t", 2)), lambda p: F.size(p) == 2)
    return F.transform(pairs, lambda p: F.struct(p[0].alias("k"), p[1].alias("v")))


def clamp(value, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))
