"""Ranked lexical search over passages, with document frequencies over all passages before any filter.

Scale: only passages' tokens that a query names are exploded, so a query moves rows in proportion to its hits; top-k is
a bounded heap per task. ``persisted postings`` serve many queries: ``postings`` partitions by term.
Nulls: passages without text hold no tokens but count among all passages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex, tokens
from ..sources.scratch import Scratch


def postings(passages: DataFrame, key: str = "id") -> DataFrame:
    """(term, key, tf): the index that queries share."""
    return passages.select(key, F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def _wanted(terms: list[str], text) -> F.Column:
    """The tokens of ``text`` that the query names."""
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return F.filter(tokens(text), lambda t: F.array_contains(wanted, t))


def hits(passages: DataFrame, terms: list[str], key: str = "id", where=None, title: str | None = None) -> DataFrame:
    """(key, term, kept, tf) for the query's terms only; ``kept`` says whether ``where`` holds for the passage. A title counts as text."""
    found = _wanted(terms, F.col("text") if title is None else F.concat_ws(" ", title, "text"))
    kept = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return passages.select(key, kept.alias("kept"), F.explode(found).alias("term")).groupBy(key, "term", "kept").agg(F.count("*").alias("tf"))


def term_stats(passages: DataFrame, terms: list[str], key: str = "id", found: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + N / (1 + df)) over all N passages."""
    total = passages.agg(F.count("*").alias("total"))
    df = (hits(passages, terms, key) if found is None else found).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("term", "df", F.log(1 + F.col("total") / (1 + F.col("df"))).alias("idf"))  # one row


def ranked_hits(passages: DataFrame, terms: list[str], key: str = "id", where=None, scratch: Scratch | None = None, title: str | None = None, sources: DataFrame | None = None, source_key: str = "source_id") -> DataFrame:
    """(key, score): sum of idf (1 + ln tf) per passage that ``where`` keeps; idf stays that of all passages.

    ``title`` names the passages' titles: 2 idf for each term in it. ``sources`` are those of ``inventory`` (id, title,
    tags, priority, relevance), met by ``source_key``: 0.3 for each term in title or tags, 0.25 priority and the
    relevance. These reorder hits; a passage without any term stays none.
    Hits are written once, so that texts are scanned once for frequencies and scores together.
    """
    found = (scratch or Scratch(passages.sparkSession)).keep(hits(passages, terms, key, where, title))
    stats = term_stats(passages, terms, key, found)
    scored = found.where("kept").join(F.broadcast(stats), "term")  # one row per query term
    scored = scored.groupBy(key).agg(F.sum(F.col("idf") * (1 + F.log("tf"))).alias("score"))
    if title is not None:
        titled = passages.select(key, F.explode(F.array_distinct(_wanted(terms, F.col(title)))).alias("term")).join(F.broadcast(stats), "term")
        scored = scored.join(titled.groupBy(key).agg((2 * F.sum("idf")).alias("more")), key, "left").select(key, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    if sources is not None:
        named = F.size(F.array_distinct(_wanted(terms, F.concat_ws(" ", "title", "tags"))))
        worth = sources.select(F.col("id").alias("_source"), (named * 0.3 + F.coalesce("priority", F.lit(0)) * 0.25 + F.col("relevance")).alias("more"))
        of = passages.select(key, F.col(source_key).alias("_source"))
        scored = scored.join(of, key).join(worth, "_source", "left").select(key, (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return scored.select(key, F.round("score", 6).alias("score"))


def search(passages: DataFrame, query: str, k: int, key: str = "id", where=None, excerpt: int = 1800, title: str | None = None, sources: DataFrame | None = None, source_key: str = "source_id") -> DataFrame:
    """The k best passages: key, score, excerpt, truncated. Ties go to the smaller key. Titles and sources as in ``ranked_hits``."""
    terms = query_terms(query)
    top = ranked_hits(passages, terms, key, where, title=title, sources=sources, source_key=source_key).orderBy(F.desc("score"), key).limit(k)
    return passages.join(F.broadcast(top), key).select(key, "score", F.substring("text", 1, excerpt).alias("excerpt"), (F.length("text") > excerpt).alias("truncated"))  # k rows


def query_terms(query: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"\$?\w+", query.lower().replace("ß", "ss"))))


def inventory(sources: DataFrame, active_file: str | None = None) -> DataFrame:
    """Sources with their relevance to a file: 6 where a pattern matches its path or base name, 2 where none is set."""
    name = F.lit(active_file or "")
    base = F.substring_index(name, "/", -1)
    match = F.exists("file_patterns", lambda p: F.regexp_like(name, _glob(p)) | F.regexp_like(base, _glob(p)))
    relevance = F.when(F.lit(active_file is not None) & match, 6).when(F.size(F.coalesce("file_patterns", F.array())) == 0, 2).otherwise(0)
    return sources.select("*", relevance.alias("relevance")).orderBy(F.desc("relevance"), F.desc("priority"), "id")


def _glob(column) -> F.Column:
    """Glob column to regular expression, for patterns with * and ? only."""
    quoted = F.regexp_replace(column, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def matching_names(names: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Names that match a glob (if it has * ? or [) in upper case, else that contain it."""
    p = pattern.strip().upper()
    c = F.col(column)
    return names.where(c.rlike(glob_regex(p)) if any(x in p for x in "*?[") else c.contains(p))


def listed_names(names: DataFrame, pattern: str, most: int, column: str = "name") -> DataFrame:
    """(name, total): the first ``most`` different names that match, in order, with the number of all that do."""
    found = matching_names(names, pattern, column).select(column).distinct()
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy(column).limit(most).join(F.broadcast(total))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
