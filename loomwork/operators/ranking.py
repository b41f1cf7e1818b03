"""Multi-label exclusion reasons and additive scores over facts; rules and weights are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..sources.scratch import Scratch
from .skew import running_total


def reasons(facts: DataFrame, rules: dict[str, F.Column]) -> DataFrame:
    """Adds ``reasons``: the names of all rules that hold, in the rules' order. A null condition does not hold."""
    return facts.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def reason_tally(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def additive_score(facts: DataFrame, parts: dict[str, F.Column], base: float = 0.0) -> DataFrame:
    """Adds ``components`` (part to value, null as 0) and their rounded sum ``score``."""
    values = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in parts.values()]
    components = F.map_from_arrays(F.array(*[F.lit(n) for n in parts]), F.array(*values))
    total = F.round(sum(values, F.lit(float(base))), 2)
    return facts.withColumn("components", components).withColumn("score", total)


def global_rank(scored: DataFrame, by: str = "score", key: str = "name", scratch: Scratch | None = None) -> DataFrame:
    """Adds ``rank`` from 1 by descending score, then key, over range-sorted parts instead of one task."""
    return running_total(scored, [F.desc(by), F.col(key)], F.lit(1), "rank", scratch or Scratch(scored.sparkSession))


def density(sources: DataFrame, pattern: str, key: str = "name", text: str = "source") -> DataFrame:
    """(key, density): share of indented lines that are not blank and match ``pattern``."""
    ls = F.filter(lines(F.col(text)), lambda x: x.rlike(r"^[ \t]") & (F.trim(x) != ""))
    hit = F.size(F.filter(ls, lambda x: x.rlike(pattern)))
    return sources.select(key, F.coalesce(F.round(F.try_divide(hit, F.size(ls)), 6), F.lit(0.0)).alias("density"))


def set_delta(left, right) -> tuple[F.Column, F.Column]:
    """(added, removed) of two arrays, each sorted; null reads as empty."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (left, right))
    return F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))


def changed_lines(before, after, most: int = 50) -> F.Column:
    """Numbers of lines that differ, position by position; at most ``most`` of them."""
    z = F.arrays_zip(F.split(before, "\n", -1).alias("a"), F.split(after, "\n", -1).alias("b"))
    flagged = F.transform(z, lambda x, i: F.when(~x["a"].eqNullSafe(x["b"]), i + 1))
    return F.slice(F.array_compact(flagged), 1, most)


def similarity_difficulty(old, new) -> F.Column:
    """How hard two names are to tell apart: edit distance after their shared prefix of up to three letters is cut."""
    same = F.substring(old, 1, 3) == F.substring(new, 1, 3)
    d = F.levenshtein(F.when(same, F.substring(old, F.lit(4), F.length(old))).otherwise(old), F.when(same, F.substring(new, F.lit(4), F.length(new))).otherwise(new))
    return F.when((d <= 1) | same, "hard").when(d <= 2, "medium").otherwise("easy")
