"""Problem 1: source files that do not parse, per file and as rates per repository and language.

Each file goes once through the lexer of the language its path's ending names (a pushdown stack finds unterminated
literals, unbalanced delimiters, premature ends and merge-conflict markers); a grammar check has the last word. No
text is shuffled: only (file_id, repo, language, fault) leaves the Arrow kernel, and repeated deliveries meet after it.

Defined results: a null ``src``, a null ``path`` or an unknown ending gives no verdict (``language`` null, counted in
no rate). An empty text is valid except as JSON. Texts of any length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .js_syntax import js_fault
from .mumps_syntax import mumps_fault
from .python_syntax import json_fault, python_fault

# Languages by path ending.
CHECKS = {"m": ("mumps", mumps_fault), "py": ("python", python_fault), "js": ("javascript", js_fault), "json": ("json", json_fault)}


def ending(path) -> str | None:
    return path.rsplit(".", 1)[1].strip().lower() if isinstance(path, str) and "." in path else None


def fault_of(path, src) -> tuple[str | None, int | None, str | None]:
    """(language, line, fault); language None where nothing can be said."""
    known = CHECKS.get(ending(path))
    if known is None or not isinstance(src, str):
        return None, None, None
    found = known[1](src)
    return (known[0], *found) if found else (known[0], None, None)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [fault_of(p, s) for p, s in zip(b["path"], b["src"])]
        out = b[["file_id", "repo", "name", "non_m_syntax"]].copy()
        out["language"] = [r[0] for r in rows]
        out["line"] = pd.array([r[1] for r in rows], dtype="Int32")
        out["fault"] = [r[2] for r in rows]
        yield out


def file_verdicts(routines: DataFrame) -> DataFrame:
    """One row per file_id: repo, name, non_m_syntax, language (by ending), line and fault of the first error or null."""
    need = routines.select("file_id", "repo", "name", "non_m_syntax", "path", "src").where(F.col("file_id").isNotNull())
    out = need.mapInPandas(_judge, "file_id bigint, repo string, name string, non_m_syntax boolean, language string, line int, fault string")
    return out.groupBy("file_id").agg(
        F.max(F.struct("language", "fault", "line", "repo", "name", "non_m_syntax")).alias("v")
    ).select("file_id", "v.repo", "v.name", "v.non_m_syntax", "v.language", "v.line", "v.fault")


def invalid_files(routines: DataFrame) -> DataFrame:
    """file_id of every file that is not valid in its language."""
    return file_verdicts(routines).where(F.col("fault").isNotNull()).select("file_id")


def invalid_rates(routines: DataFrame) -> DataFrame:
    """Files, invalid files, share, and how often the old text test was wrong, per repo and language."""
    v = file_verdicts(routines).where(F.col("language").isNotNull())
    bad = F.col("fault").isNotNull()
    return v.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.count_if(bad).alias("invalid"),
        F.round(F.avg(bad.cast("double")), 6).alias("invalid_share"),
        F.count_if(F.col("fault").contains("merge conflict")).alias("conflicts"),
        F.count_if(F.col("non_m_syntax") & ~bad).alias("old_test_false_alarm"),
        F.count_if(~F.coalesce("non_m_syntax", F.lit(False)) & bad).alias("old_test_missed"),
    )
