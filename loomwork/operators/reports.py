"""What a comparison found, in words and counts: result differences, explanations, recordings, coverage, status.

Texts are put together from columns; lists that end up in a text are cut to a stated number, counts never are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import error_code, first_difference
from .skew import skew_join
from .statediff import state_diff

#: Differences that a text shows, fields that a note names, entries that a trace keeps, names that a suggestion offers.
SHOWN, NAMED, KEPT, OFFERED = 10, 12, 20, 10
# What the runtime's error codes mean.
ERRORS = {
    "UNDEF": "a variable was read that has no value", "LABELMISSING": "a label was called that the routine does not have", "DIVZERO": "a division by zero",
    "ZLINKFILE": "a routine was called that does not exist", "EXPR": "an expression was expected", "NOTPRINCIO": "a device other than the principal one was used",
    "GVUNDEF": "a global was read that has no value", "TIMEOUT": "the run took too long", "LVUNDEF": "a local was read that has no value", "INVCMD": "an unknown command",
}


def result_diff(left: DataFrame, right: DataFrame, keys: list[str], state_left: DataFrame | None = None, state_right: DataFrame | None = None) -> DataFrame:
    """(keys, kind, ref, expected, actual): every difference of two executions of the same cases.

    left and right (keys, stdout, error): an output row where the texts differ, an error or timeout row where the errors
    do (none and empty are equal). state_* (keys, ref, value, killed): global rows; a node that was never touched
    differs from one that was killed, which reads ``<killed>``. Cases of one side only differ in nothing but presence
    and give no row. Null outputs equal each other.
    """
    a = left.select(*keys, F.col("stdout").alias("o1"), F.coalesce("error", F.lit("")).alias("e1"))
    b = right.select(*keys, F.col("stdout").alias("o2"), F.coalesce("error", F.lit("")).alias("e2"))
    j = skew_join(a, b, keys)
    late = (F.col("e1") == "TIMEOUT") | (F.col("e2") == "TIMEOUT")
    out = F.when(~F.col("o1").eqNullSafe(F.col("o2")), F.struct(F.lit("output").alias("kind"), F.lit("stdout").alias("ref"), F.col("o1").alias("expected"), F.col("o2").alias("actual")))
    err = F.when(F.col("e1") != F.col("e2"), F.struct(F.when(late, "timeout").otherwise("error").alias("kind"), F.lit("error").alias("ref"), F.col("e1").alias("expected"), F.col("e2").alias("actual")))
    rows = j.select(*keys, F.explode(F.array_compact(F.array(out, err))).alias("d")).select(*keys, "d.*")
    if state_left is None or state_right is None:
        return rows
    shown = lambda s: s.select(*keys, "ref", F.when(F.col("killed"), "<killed>").otherwise(F.col("value")).alias("value"))
    nodes = state_diff(shown(state_left), shown(state_right), [*keys, "ref"]).select(*keys, F.lit("global").alias("kind"), "ref", "expected", "actual")
    return rows.unionByName(nodes)


def error_meaning(text) -> F.Column:
    """An error's code with what it means, or the text itself."""
    code = error_code(text)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv]), code)
    return F.when(known.isNotNull(), F.concat(code, F.lit(": "), known)).otherwise(text)


def explained(diff: DataFrame) -> DataFrame:
    """diff (kind, ref, expected, actual, ...) with ``headline`` and ``details``: what moved, in words.

    Null and empty values read as nothing. Values with ``^`` name the pieces that differ, at most NAMED.
    """
    e, a = F.coalesce("expected", F.lit("")), F.coalesce("actual", F.lit(""))
    lost, new = (e != "") & (a == ""), (e == "") & (a != "")
    state = F.concat(F.lit("State differs at "), "ref", F.when(lost, ": the candidate left this node empty or killed it").when(new, ": the candidate made a node that the baseline never writes").otherwise(""))
    fault = F.when(lost, F.concat(F.lit("Error differs: the baseline raises "), error_meaning(e), F.lit(" and the candidate does not"))).when(new, F.concat(F.lit("Error differs: the candidate raises "), error_meaning(a), F.lit(" where the baseline succeeds"))).otherwise(F.concat(F.lit("Error differs: "), error_meaning(e), F.lit(" against "), error_meaning(a)))
    headline = F.when(F.col("kind") == "global", state).when(F.col("kind") == "error", fault).when(F.col("kind") == "timeout", F.concat(F.lit("Time ran out: expected '"), e, F.lit("', got '"), a, F.lit("'"))).otherwise(F.concat(F.lit("Output differs ("), "ref", F.lit(")")))
    place = F.concat(F.lit("first difference at character "), first_difference(e, a).cast("string"), F.lit(" of "), F.greatest(F.length(e), F.length(a)).cast("string"))
    first = F.when((F.col("kind") == "output") & (e != "") & (a != "") & (e != a), place)
    pairs = F.filter(F.transform(F.arrays_zip(F.split(e, r"\^", -1).alias("x"), F.split(a, r"\^", -1).alias("y")), lambda p, i: F.struct((i + 1).alias("i"), F.coalesce(p["x"], F.lit("")).alias("x"), F.coalesce(p["y"], F.lit("")).alias("y"))), lambda p: p["x"] != p["y"])
    named = F.transform(F.slice(pairs, 1, NAMED), lambda p: F.concat(F.lit("piece "), p["i"].cast("string"), F.lit(": '"), p["x"], F.lit("' to '"), p["y"], F.lit("'")))
    pieces = F.when(F.col("kind").isin("global", "output") & (F.contains(e, F.lit("^")) | F.contains(a, F.lit("^"))), named).otherwise(F.array().cast("array<string>"))
    return diff.withColumn("headline", headline).withColumn("details", F.array_compact(F.concat(F.array(first), pieces)))


def kinds(diff: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kinds, differences, specific): different kinds in order, and whether any says more than a timeout."""
    per = diff.groupBy(*keys, "kind").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list("kind")).alias("kinds"), F.sum("n").alias("differences"), F.bool_or(F.col("kind").isin("output", "global", "error")).alias("specific"))


def feedback(diff: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, differences, feedback): the first SHOWN headlines in order as one text, and how many more there are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    few = explained(diff).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SHOWN)
    text = few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "headline"))), lambda x: x["headline"]), "\n").alias("text"))
    n = diff.groupBy(*keys).agg(F.count("*").alias("differences"))
    return text.join(n, keys).select(*keys, "differences", F.when(F.col("differences") > SHOWN, F.concat("text", F.lit("\n... and "), (F.col("differences") - SHOWN).cast("string"), F.lit(" more"))).otherwise(F.col("text")).alias("feedback"))


def trace_entry(rows: DataFrame, column: str) -> DataFrame:
    """rows with the first KEPT entries of a list, and ``total``: how many there were; a null list has none."""
    return rows.withColumn("total", F.size(F.coalesce(column, F.array()))).withColumn(column, F.slice(column, 1, KEPT))


def as_json(rows: DataFrame, keys: list[str], metrics: list[str], extra: str | None = None) -> DataFrame:
    """(keys, document): the metrics by name as JSON text; entries of a map ``extra`` follow and never override."""
    own = F.struct(*sorted(metrics))
    if extra is None:
        return rows.select(*keys, F.to_json(own, {"ignoreNullFields": "false"}).alias("document"))
    more = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*metrics))
    return rows.select(*keys, F.to_json(F.map_concat(F.map_from_arrays(F.array(*[F.lit(m) for m in sorted(metrics)]), F.array(*[F.col(m).cast("string") for m in sorted(metrics)])), more)).alias("document"))


def elapsed(records: DataFrame, now, group: list[str], started: str = "started_at") -> DataFrame:
    """(group, seconds): from the first record's start to ``now``; 0 where no start can be read."""
    first = F.min(F.try_to_timestamp(F.col(started)))
    return records.groupBy(*group).agg(F.round(F.coalesce(F.unix_micros(now) - F.unix_micros(first), F.lit(0)) / 1e6, 3).alias("seconds"))


def recordings(attempts: DataFrame, keys: list[str], off: str, on: str) -> DataFrame:
    """(keys, usable, contrast, live, n_cases, n_void, false_confidence) of recordings with and without a tool.

    attempts (keys, condition, attempt, claimed, verified, differences, source, n_cases, n_void). usable: both
    conditions are there. contrast: unverified without, and the first attempt with the tool shows differences. live: any
    verdict came from real execution. Numbers are the greatest over attempts, 0 without any. false_confidence: claims
    that verification refuted; what was not verified refutes nothing.
    """
    is_off, is_on = F.col("condition") == off, F.col("condition") == on
    g = attempts.groupBy(*keys).agg(
        F.bool_or(is_off).alias("a"), F.bool_or(is_on).alias("b"),
        F.max_by(F.when(is_off, F.col("verified")), F.when(is_off, F.col("attempt"))).alias("off_verified"),
        F.min_by(F.coalesce("differences", F.lit(0)), F.when(is_on, F.col("attempt"))).alias("first_differences"),
        F.coalesce(F.bool_or(F.col("source") == "live"), F.lit(False)).alias("live"),
        F.coalesce(F.max("n_cases"), F.lit(0)).alias("n_cases"), F.coalesce(F.max("n_void"), F.lit(0)).alias("n_void"),
        F.count_if(F.col("claimed") & (F.col("verified") == F.lit(False))).alias("false_confidence"),
    )
    usable = F.coalesce(F.col("a") & F.col("b"), F.lit(False))
    contrast = usable & F.coalesce(F.col("off_verified") == F.lit(False), F.lit(False)) & (F.coalesce("first_differences", F.lit(0)) > 0)
    return g.select(*keys, usable.alias("usable"), contrast.alias("contrast"), "live", "n_cases", "n_void", "false_confidence")


def coverage(attempted: DataFrame, common: DataFrame, known: DataFrame, key: str = "task_id") -> DataFrame:
    """One row: known, attempted and common tasks, and whether the comparison is partial (common and known differ)."""
    tag = lambda d, name: d.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(1))
    j = tag(known, "k").join(tag(attempted, "a"), key, "full").join(tag(common, "c"), key, "full")
    n = j.agg(F.count("k").alias("known"), F.count("a").alias("attempted"), F.count("c").alias("common"), F.count_if(F.col("k").isNull() != F.col("c").isNull()).alias("apart"))
    return n.select("known", "attempted", "common", (F.col("apart") > 0).alias("partial"))


def cluster_order(members: DataFrame) -> DataFrame:
    """(cluster, size, place) of (cluster, name): the largest first, then by first member."""
    per = members.distinct().groupBy("cluster").agg(F.count("*").alias("size"), F.min("name").alias("first"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "first"))).select("cluster", "size", "place")  # one row per cluster


def siblings(members: DataFrame, most: int = NAMED) -> DataFrame:
    """(cluster, name, others, siblings): how many others a cluster has beside each member, and the first ``most`` of them."""
    m = members.distinct()
    w = Window.partitionBy("cluster").orderBy("name")
    few = m.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + 1).groupBy("cluster").agg(F.array_sort(F.collect_list("name")).alias("few"))
    n = m.groupBy("cluster").agg((F.count("*") - 1).alias("others"))
    j = skew_join(m, few.join(n, "cluster"), ["cluster"])
    return j.select("cluster", "name", "others", F.slice(F.array_except("few", F.array("name")), 1, most).alias("siblings"))


def by_rank(names: DataFrame, ranks: DataFrame) -> DataFrame:
    """(name, rank): names with their rank; those without one stand at the number of ranks, in order of name."""
    total = ranks.agg(F.count("*").alias("_t"))  # one row
    return names.join(ranks.select("name", "rank"), "name", "left").join(F.broadcast(total)).select("name", F.coalesce("rank", "_t").alias("rank"))


def suggestions(missed: DataFrame, names: DataFrame, most: int = OFFERED) -> DataFrame:
    """(wanted, name, place): for each name that is not there, up to ``most`` names that hold its first three letters.

    Names meet by their runs of three letters, so nothing but true suggestions is formed; shorter wishes get the names
    that hold them, by their runs of that length.
    """
    w = missed.select(F.upper(F.trim("wanted")).alias("wanted")).where(F.col("wanted") != "").distinct().join(names.select(F.upper("name").alias("wanted")).distinct(), "wanted", "left_anti")
    runs = F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: i + n - 1 <= F.length("name")), lambda i: F.substring(F.col("name"), i, n)))))
    held = names.select(F.upper("name").alias("name")).where(F.length("name") > 0).distinct().select("name", F.explode(runs).alias("run"))
    order = Window.partitionBy("run").orderBy("name")
    few = held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return skew_join(w.withColumn("run", F.substring("wanted", 1, 3)), few, ["run"]).select("wanted", "name", "place")


def status(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, rows) of each named table."""
    rows = [d.agg(F.count("*").alias("rows")).select(F.lit(k).alias("part"), "rows") for k, d in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def summary_faults(summaries: DataFrame) -> DataFrame:
    """(id, fault) of published summaries that break their contract.

    summaries (id, version, created_at, n_tasks, digest, rates map<string,double>): version 1, an ISO date, a positive
    number of tasks, 64 hexadecimal digits, two or three conditions with finite rates in [0, 1].
    """
    bad_rate = F.exists(F.map_values(F.coalesce("rates", F.create_map().cast("map<string,double>"))), lambda r: r.isNull() | F.isnan(r) | (r < 0) | (r > 1))
    checks = {
        "version": ~F.coalesce(F.col("version") == 1, F.lit(False)), "date": F.try_to_timestamp("created_at").isNull(), "tasks": ~F.coalesce(F.col("n_tasks") > 0, F.lit(False)),
        "digest": ~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "conditions": ~F.coalesce(F.size("rates").between(2, 3), F.lit(False)), "rate": bad_rate,
    }
    return summaries.select("id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))).alias("fault"))
