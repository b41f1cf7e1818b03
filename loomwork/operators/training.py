"""Question-answer rows from routine facts, chat examples and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def structure_pairs(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(name, source, question, answer): entry points of each routine in order, with their arguments."""
    shown = F.concat("label", F.when(F.size(F.coalesce("formals", F.array())) > 0, F.concat(F.lit("("), F.array_join("formals", ","), F.lit(")"))).otherwise(""))
    per = labels.where(F.col("label").isNotNull()).select("file_id", F.struct("seq", shown.alias("s")).alias("x")).distinct().groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ", ").alias("list"), F.count("*").alias("n"))
    return per.join(names, "file_id").select("name", F.lit("structure").alias("source"), F.concat(F.lit("Which entry points does "), "name", F.lit(" have?")).alias("question"), F.concat("name", F.lit(" has "), F.col("n").cast("string"), F.lit(": "), "list").alias("answer"))


def to_chat(pairs: DataFrame, system: str) -> DataFrame:
    """Adds ``messages``: system, user, assistant; ``rank`` orders rows by a seeded hash, reproducibly."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return pairs.withColumn("messages", F.array(m("system", F.lit(system)), m("user", F.col("question")), m("assistant", F.col("answer"))))


def seeded_order(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys), 256), *keys)


def reward(records: DataFrame, shaped: bool) -> DataFrame:
    """Adds ``reward`` and ``reason``. Void cases leave the denominator; what cannot be graded earns nothing.

    Expects error, candidate, equivalent, n_cases, n_diverged, n_void; null counts read as 0.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    gradable = z("n_cases") - z("n_void")
    part = F.greatest(F.round((gradable - z("n_diverged")) / F.nullif(gradable, F.lit(0)), 6), F.lit(0.0))
    reason = (
        F.when(F.trim(F.coalesce("candidate", F.lit(""))) == "", "empty candidate").when(F.col("error").isNotNull(), "error").when(gradable <= 0, "nothing gradable")
        .when(F.coalesce("equivalent", F.lit(False)), "equivalent").otherwise("diverged")
    )
    earned = F.when(F.col("reason") == "equivalent", 1.0).when((F.col("reason") == "diverged") & F.lit(shaped), part).otherwise(0.0)
    return records.withColumn("reason", reason).withColumn("reward", earned)


def task_admission(tasks: DataFrame, keep: DataFrame, least_diverged: int = 1) -> DataFrame:
    """(…, verdict): first check each task fails: off_split, no_case_separates, duplicate_mutant, or admitted.

    Only tasks that passed the earlier checks compete as duplicates; the first by task_no stays.
    """
    j = tasks.join(keep.select("name").distinct().withColumn("_in", F.lit(True)), "name", "left")
    early = F.when(F.col("_in").isNull(), "off_split").when(F.coalesce("n_diverged", F.lit(0)) < least_diverged, "no_case_separates")
    checked = j.withColumn("_early", early)
    mutant = F.md5(F.concat_ws("\x1f", "name", "mutated_src"))
    first = checked.where(F.col("_early").isNull()).groupBy(mutant.alias("_m")).agg(F.min("task_no").alias("_first"))
    out = checked.withColumn("_m", mutant).join(first, "_m", "left")
    return out.withColumn("verdict", F.coalesce("_early", F.when(F.col("task_no") > F.col("_first"), "duplicate_mutant"), F.lit("admitted"))).drop("_in", "_early", "_m", "_first")


def caller_pairs(calls: DataFrame, sides: DataFrame) -> DataFrame:
    """(name, side, source, question, answer): which routines of the same side of a split call each routine, in order.

    calls (caller, callee), sides (name, side). A routine that calls itself only, or is called across the split only, gives no row.
    """
    a = sides.select(F.col("name").alias("caller"), F.col("side").alias("caller_side"))
    b = sides.select(F.col("name").alias("callee"), "side")
    who = calls.where(F.col("caller") != F.col("callee")).distinct().join(a, "caller").join(b, "callee").where(F.col("caller_side") == F.col("side"))
    listed = who.groupBy(F.col("callee").alias("name"), "side").agg(F.array_join(F.array_sort(F.collect_set("caller")), ", ").alias("answer"))
    return listed.select("name", "side", F.lit("call_graph").alias("source"), F.concat(F.lit("Which routines call "), "name", F.lit("?")).alias("question"), "answer")


def file_pairs(uses: DataFrame, roots: DataFrame, fields: DataFrame, most: int = 12) -> DataFrame:
    """(name, file, source, question, answer): what the globals of a routine mean: the file of each, once per routine and
    file, and that file's first ``most`` fields.

    uses (name, global), roots (root, file, title), fields (file, field, label, storage). A root stands with or without
    its parenthesis; of two files with one root the last wins; files without title give no row.
    """
    root = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.trim("global"), r"^\^", ""), r"\(.*$", ""), F.lit("("))
    known = roots.where(F.col("title") != "").select(F.concat(F.regexp_replace("root", r"\($", ""), F.lit("(")).alias("root"), "file", "title").groupBy("root").agg(F.max(F.struct("file", "title")).alias("f")).select("root", "f.*")
    hit = uses.where(F.trim("global") != "").select("name", root.alias("root")).distinct().join(known, "root")
    once = hit.groupBy("name", "file", "title").agg(F.min("root").alias("root"))
    n = fields.groupBy("file").agg(F.count("*").alias("n"))
    what = once.join(n, "file", "left").select("name", "file", F.lit("file").alias("source"), F.concat(F.lit("Which file is "), "root", F.lit(" in "), "name", F.lit("?")).alias("question"), F.concat(F.lit("#"), "file", F.lit(" "), "title", F.lit(", fields: "), F.coalesce("n", F.lit(0)).cast("string")).alias("answer"))
    order = Window.partitionBy("file").orderBy(F.col("field").try_cast("double").asc_nulls_last(), "field")
    shown = F.concat(F.lit("#"), "field", F.lit(" "), "label", F.when(F.coalesce("storage", F.lit("")) != "", F.concat(F.lit(" ["), "storage", F.lit("]"))).otherwise(""))
    first = fields.withColumn("r", F.row_number().over(order)).where((F.col("r") <= most) & (F.col("label") != "")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("r", shown.alias("s")))).alias("l"))
    some = once.join(first, "file").select("name", "file", F.lit("file").alias("source"), F.concat(F.lit("Name fields of file #"), "file", F.lit(".")).alias("question"), F.array_join(F.transform("l", lambda x: x["s"]), "; ").alias("answer"))
    return what.unionByName(some)
