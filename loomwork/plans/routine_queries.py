"""Facts, rankings and mutants of the routines in parsed_routines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mumps, mutants, ranking
from ..sources.tables import table


def _routines(s, d):
    r = table(s, d, "parsed_routines").where("path LIKE '%.m' AND src IS NOT NULL AND file_id IS NOT NULL")
    return r.groupBy("file_id").agg(F.max(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.col("src").alias("source"))).alias("r")).select(F.concat_ws("#", "r.name", F.col("file_id").cast("string")).alias("name"), "r.source")


def _scored(s, d):
    f = mumps.routine_facts(_routines(s, d)).where("error IS NULL")
    parts = {
        "size": F.when(F.col("lines_code").between(20, 260), 3), "calls": F.least(F.size("calls"), F.lit(5)), "globals": -F.least(F.size(F.array_union("globals_read", "globals_written")) * 0.5, F.lit(6.0)),
        "naked": -(F.col("naked_read") + F.col("naked_write")) * 2, "indirection": -F.col("indirection"), "entries": F.col("formal_labels"),
    }
    return ranking.additive_score(f, parts, 10)


def _reasons(s, d):
    f = mumps.routine_facts(_routines(s, d)).where("error IS NULL")
    return ranking.reasons(f, {"short": F.col("lines_code") < 12, "long": F.col("lines_code") > 400, "data": F.col("lines_data") > F.col("lines_code"), "bare_quit": F.col("bare_quit_ratio") >= 0.5, "no_entry": F.col("formal_labels") == 0, "indirection": F.col("indirection") >= 5})


def _deltas(s, d):
    t = table(s, d, "mutation_tasks").where("baseline_src IS NOT NULL AND mutated_src IS NOT NULL").select("task_no", "baseline_src", "mutated_src").distinct()
    return t.select("task_no", F.size(ranking.changed_lines(F.col("baseline_src"), F.col("mutated_src"))).alias("changed"), (F.size(F.split("mutated_src", "\n", -1)) - F.size(F.split("baseline_src", "\n", -1))).alias("delta"))


QUERIES = {
    "routine_facts": lambda s, d: mumps.routine_facts(_routines(s, d)),
    "line_counts": lambda s, d: mumps.routine_facts(_routines(s, d)).select("name", "lines_total", "lines_blank", "labels"),
    "lexed_lines": lambda s, d: mumps.lexed_lines(_routines(s, d)).select("name", "line", "label", "level", F.size("commands").alias("commands"), "code"),
    "command_histogram": lambda s, d: mumps.lexed_lines(_routines(s, d)).select(F.explode("commands").alias("c")).groupBy(F.col("c.verb").alias("verb")).agg(F.count("*").alias("n")),
    "local_vars": lambda s, d: mumps.local_variables(_routines(s, d)),
    "label_flags": lambda s, d: mumps.label_facts(_routines(s, d)),
    "entry_coverage": lambda s, d: mumps.entry_coverage(mumps.label_facts(_routines(s, d))),
    "reassigned": lambda s, d: mumps.reassigned_later(mumps.variable_uses(_routines(s, d))).groupBy("name").agg(F.count("*").alias("writes"), F.count_if("again").alias("again")),
    "reaching_writes": lambda s, d: mumps.reaching_writes(mumps.variable_uses(_routines(s, d))).groupBy("name").agg(F.count("*").alias("reads"), F.count("from_line").alias("reached")),
    "naked_refs": lambda s, d: mumps.naked_references(_routines(s, d)),
    "mutants": lambda s, d: mutants.mutants(_routines(s, d)),
    "mutant_survey": lambda s, d: mutants.mutant_survey(mutants.mutants(_routines(s, d))),
    "mutant_difficulty": lambda s, d: mutants.mutant_difficulty(mutants.mutants(_routines(s, d))),
    "exclusion_reasons": lambda s, d: ranking.reason_tally(_reasons(s, d)),
    "rank_candidates": lambda s, d: ranking.global_rank(_scored(s, d)).select("name", "score", "rank", F.to_json("components").alias("components")),
    "density": lambda s, d: ranking.density(_routines(s, d), r"\$[A-Z]+\("),
    "line_deltas": _deltas,
}
_R = "r AS (SELECT concat_ws('#', name, file_id) AS name, source FROM (SELECT file_id, max(coalesce(name, '')) AS name, max(src) AS source FROM parsed_routines WHERE path LIKE '%.m' AND src IS NOT NULL AND file_id IS NOT NULL GROUP BY 1))"
_L = r"l AS (SELECT name, unnest(regexp_split_to_array(regexp_replace(source, '(\r\n|\n|\r)$', ''), '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS raw FROM r WHERE source <> '')"

SQL = {
    "line_counts": f"WITH {_R}, {_L} SELECT name, CAST(count(*) AS INTEGER) AS lines_total, CAST(count(*) FILTER (regexp_matches(raw, '^\\s*$')) AS INTEGER) AS lines_blank, CAST(count(*) FILTER (regexp_matches(raw, '^(%[A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*|[0-9]+)')) AS INTEGER) AS labels FROM l GROUP BY 1",
    "density": f"WITH {_R}, {_L}, x AS (SELECT name, raw FROM l WHERE regexp_matches(raw, '^[ \\t]') AND trim(raw, ' ') <> ''), g AS (SELECT name, round(count(*) FILTER (regexp_matches(raw, '\\$[A-Z]+\\(')) / count(*), 6) AS density FROM x GROUP BY 1) SELECT r.name, coalesce(density, 0) AS density FROM r LEFT JOIN g USING (name)",
    "line_deltas": """WITH t AS (SELECT DISTINCT task_no, string_split(baseline_src, chr(10)) AS a, string_split(mutated_src, chr(10)) AS b FROM mutation_tasks WHERE baseline_src IS NOT NULL AND mutated_src IS NOT NULL),
        x AS (SELECT task_no, a, b, list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i]) AS c FROM t) SELECT task_no, CAST(least(len(c), 50) AS INTEGER) AS changed, CAST(len(b) - len(a) AS INTEGER) AS delta FROM x""",
}
