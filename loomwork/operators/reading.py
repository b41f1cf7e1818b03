"""Windows of lines, pages bounded by lines and characters, and passages cut from documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines


def line_window(sources: DataFrame, start: int, count: int, key: str = "name", text: str = "source") -> DataFrame:
    """(key, line, text, truncated): ``count`` lines from ``start``, which is clamped to the source's lines."""
    src = sources.select(key, lines(F.col(text)).alias("ls")).where(F.size("ls") > 0)
    at = F.least(F.greatest(F.lit(start), F.lit(1)), F.size("ls"))
    return src.select(key, at.alias("at"), (at + count - 1 < F.size("ls")).alias("truncated"), F.posexplode(F.slice("ls", at, count)).alias("i", "text")).select(key, (F.col("at") + F.col("i")).alias("line"), "text", "truncated")


def page(sources: DataFrame, start: int, max_lines: int, max_chars: int, key: str = "name", text: str = "source") -> DataFrame:
    """(key, first, last, next_line, content): lines from ``start`` until a limit; the first line is always taken."""
    rows = sources.select(key, F.posexplode(lines(F.col(text))).alias("i", "line")).withColumn("n", F.col("i") + 1)
    total = rows.groupBy(key).agg(F.max("n").alias("total"))
    part = rows.where(F.col("n").between(start, start + max_lines - 1))
    run = Window.partitionBy(key).orderBy("n")  # at most max_lines rows per key
    fit = part.withColumn("used", F.sum(F.length("line") + 1).over(run)).where((F.col("used") - 1 <= max_chars) | (F.col("n") == start))
    out = fit.groupBy(key).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return out.join(total, key).select(key, "first", "last", F.when(F.col("last") < F.col("total"), F.col("last") + 1).alias("next_line"), "content")


def passages(documents: DataFrame, key: str = "doc_id", text: str = "text", max_lines: int = 100, max_chars: int = 6000) -> DataFrame:
    """(key, start_line, end_line, title, text, example): a document cut before headings outside fences and at limits.

    A sequential fold over each document's lines, in an Arrow kernel; titles carry on into later passages, and a
    passage is an example if any of it lies in a fence. Null texts give no passage.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                if isinstance(t, str):
                    out += [(k, *p) for p in _cut(t, max_lines, max_chars)]
            yield pd.DataFrame(out, columns=[key, "start_line", "end_line", "title", "text", "example"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInPandas(run, f"{key} {kind}, start_line int, end_line int, title string, text string, example boolean")


def _cut(text: str, max_lines: int, max_chars: int):
    title, fence, chars, held, first, example = "", False, 0, [], 1, False
    for n, line in enumerate(text.splitlines(), 1):
        heading = not fence and line.startswith("#") and line.lstrip("#")[:1] == " "
        if held and (heading or len(held) >= max_lines or chars > max_chars):
            if "".join(held).strip():
                yield first, n - 1, title, "\n".join(held), example
            held, chars, first, example = [], 0, n, fence
        if heading:
            title = line.lstrip("#").strip()
        if line.lstrip().startswith("```"):
            fence = not fence
            example = True
        held.append(line)
        chars += len(line) + 1
    if "".join(held).strip():
        yield first, first + len(held) - 1, title, "\n".join(held), example
