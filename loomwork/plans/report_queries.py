"""Reports over attempts, routines, parts and customers: differences in words, coverage, recordings, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attempts, cases, dictionary, lineage, reports, search, training
from ..operators import statediff as sd
from ..sources.tables import table

KEYS = ["run_id", "condition", "task_id"]


def _results(s, d, n: int):
    a = attempts.first_received(table(s, d, "attempts"), ["verdict", "harness_error"]).where(F.col("attempt") == n)
    out = F.concat_ws("^", F.coalesce(F.col("verdict.n_cases").cast("string"), F.lit("")), F.coalesce(F.col("verdict.n_diverged").cast("string"), F.lit("")))
    return a.select(*KEYS, out.alias("stdout"), F.col("harness_error").alias("error"))


def _diff(s, d):
    return reports.result_diff(_results(s, d, 1), _results(s, d, 2), KEYS)


def _recordings(s, d):
    a = attempts.first_received(table(s, d, "attempts"), ["assertion", "verdict"])
    rows = a.select("run_id", "task_id", "condition", "attempt", F.col("assertion.claimed_correct").alias("claimed"), F.col("verdict.equivalent").alias("verified"), F.col("verdict.n_diverged").alias("differences"), F.when(F.col("verdict.n_void") == 0, "live").alias("source"), F.col("verdict.n_cases").alias("n_cases"), F.col("verdict.n_void").alias("n_void"))
    return reports.recordings(rows, ["task_id"], "baseline", "scaffolded")


def _tasks(s, d):
    return table(s, d, "mutation_tasks").where("task_id IS NOT NULL").select("task_id").distinct()


def _coverage(s, d):
    a = table(s, d, "attempts").where("task_id IS NOT NULL")
    both = a.groupBy("task_id").agg(F.countDistinct("condition").alias("n")).where("n >= 2")
    return reports.coverage(a, both, _tasks(s, d))


def _names(s, d):
    return table(s, d, "parsed_routines").where("path LIKE '%.m' AND name IS NOT NULL").select(F.upper("name").alias("name")).distinct()


def _missed(s, d):
    return table(s, d, "attempts").where("routine IS NOT NULL").select(F.concat(F.substring(F.upper(F.trim("routine")), 1, 4), F.lit("?")).alias("wanted"))


def _members(s, d):
    return table(s, d, "parsed_routines").where("name IS NOT NULL AND path IS NOT NULL").select(F.upper("name").alias("cluster"), F.col("path").alias("name"))


def _edges(s, d):
    from .graph_queries import _edges as edges

    return edges(s, d).select(F.col("caller").cast("string").alias("caller"), F.col("callee").cast("string").alias("callee"))


def _sides(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_size") > 40, "eval").otherwise("train").alias("side"))


def _files(s, d):
    uses = table(s, d, "supplier").select(F.col("s_name").alias("name"), F.explode(F.array(F.concat(F.lit("^N"), F.col("s_nationkey").cast("string"), F.lit("(1)")), F.lit("ZZ"))).alias("global"))
    roots = table(s, d, "nation").select(F.concat(F.lit("^N"), F.col("n_nationkey").cast("string")).alias("root"), F.col("n_regionkey").cast("string").alias("file"), F.concat(F.lit("REGION "), F.col("n_regionkey").cast("string")).alias("title"))
    fields = table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("file"), F.col("n_nationkey").cast("string").alias("field"), F.col("n_name").alias("label"), F.concat(F.lit("0;"), F.col("n_nationkey").cast("string")).alias("storage"))
    return training.file_pairs(uses, roots, fields)


def _entries(s, d):
    t = table(s, d, "routine_labels").where("file_id IS NOT NULL AND seq IS NOT NULL AND size(formals) > 0").groupBy("file_id", "seq").agg(F.max("formals").alias("formals"))
    return t.select(F.concat_ws("#", "file_id", "seq").alias("entry"), "formals")


def _pools(s, d):
    lines = table(s, d, "mutation_tasks").where("task_no IS NOT NULL").groupBy("task_no").agg(F.max("original_line").alias("line")).select(F.concat(F.col("task_no").cast("string"), F.lit("#1")).alias("entry"), "line")
    return cases.value_pools(_entries(s, d), ["", "0", "1", "-1"], lines, 10)


def _built(s, d):
    base = _entries(s, d).select("entry", F.transform("formals", lambda x: F.lit("1")).alias("args"))
    return cases.build_cases(base, cases.value_pools(_entries(s, d), ["", "0", "1", "-1"]), ["", "0"], 8)


def _subtree(s, d):
    c = table(s, d, "customer")
    top = c.select(F.concat(F.lit("^C("), F.col("c_custkey").cast("string"), F.lit(")")).alias("ref"), F.col("c_name").alias("value"), "c_nationkey")
    node = c.where("c_nationkey > 5").select(F.concat(F.lit("^C("), F.col("c_custkey").cast("string"), F.lit(",0)")).alias("ref"), F.col("c_mktsegment").alias("value"))
    plan = top.select("ref", F.lit("kill").alias("op"), F.col("value").alias("before_value"), F.lit(None).cast("string").alias("value"))
    return plan, top.select("ref", "value").unionByName(node)


QUERIES = {
    "result_differences": _diff,
    "explained_differences": lambda s, d: reports.explained(_diff(s, d)).select(*KEYS, "kind", "headline", F.array_join("details", "; ").alias("details")),
    "difference_kinds": lambda s, d: reports.kinds(_diff(s, d), ["condition"]).withColumn("kinds", F.array_join("kinds", ",")),
    "recordings": lambda s, d: _recordings(s, d).drop("contrast"),
    "coverage": _coverage,
    "elapsed": lambda s, d: reports.elapsed(table(s, d, "attempts"), F.lit("2026-01-01").cast("timestamp"), ["condition"]),
    "suggestions": lambda s, d: reports.suggestions(_missed(s, d), _names(s, d)),
    "status_counts": lambda s, d: reports.status({"tasks": _tasks(s, d), "names": _names(s, d), "attempts": table(s, d, "attempts"), "unfinished": table(s, d, "attempts").where("finished_at IS NULL")}),
    "cluster_order": lambda s, d: reports.cluster_order(_members(s, d)),
    "siblings": lambda s, d: reports.siblings(_members(s, d)).withColumn("siblings", F.array_join("siblings", ",")),
    "eval_order": lambda s, d: reports.by_rank(table(s, d, "supplier").select(F.col("s_name").alias("name")), table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("rank"))),
    "dictionary_counts": lambda s, d: dictionary.dictionary_counts(table(s, d, "region").select(F.col("r_name").alias("root")), table(s, d, "nation"), table(s, d, "customer").select((F.col("c_acctbal") < 0).cast("int").alias("redactions"))),
    "caller_questions": lambda s, d: training.caller_pairs(_edges(s, d), _sides(s, d)),
    "file_questions": _files,
    "value_pools": _pools,
    "boundary_cases": lambda s, d: _built(s, d).withColumn("args", F.array_join("args", ",")),
    "case_counts": lambda s, d: cases.enough_cases(_built(s, d), 5),
    "task_documents": lambda s, d: reports.as_json(table(s, d, "supplier"), ["s_suppkey"], ["s_name", "s_nationkey"]),
    "kept_entries": lambda s, d: reports.trace_entry(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ", -1).alias("words")), "words").select("doc_id", "total", F.array_join("words", " ").alias("kept")),
    "name_list": lambda s, d: search.listed_names(_names(s, d), "*0*", 15),
    "subtree_counts": lambda s, d: sd.subtree_counts(_subtree(s, d)[1], _subtree(s, d)[0], 1),
    "cover_faults": lambda s, d: lineage.cover_faults(table(s, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_nationkey") % 3).alias("unit_key")), table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_name").alias("name"))),
    "capture_choice": lambda s, d: cases.capture_choice(table(s, d, "orders").select(F.col("o_custkey").alias("routine"), F.col("o_orderstatus").alias("root"), F.floor("o_totalprice").alias("nodes"), (F.col("o_orderstatus") == "P").alias("scratch")), table(s, d, "customer").select(F.col("c_custkey").alias("routine"), (F.col("c_acctbal") > 0).alias("known")), 200000, ("F",)),
    "plan_ready_subtree": lambda s, d: sd.ready(*_subtree(s, d)),
    "plan_apply_subtree": lambda s, d: sd.apply_plan(*_subtree(s, d)),
}

_FIRST = """f AS (SELECT run_id, condition, task_id, attempt, struct_pack(a := assertion, v := verdict, h := harness_error) AS r FROM attempts WHERE run_id IS NOT NULL AND condition IS NOT NULL AND task_id IS NOT NULL AND attempt IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY run_id, condition, task_id, attempt ORDER BY coalesce(received_at, TIMESTAMPTZ '9999-01-01 00:00:00+00'), coalesce(started_at, ''), coalesce(CAST(seed AS VARCHAR), ''), coalesce(finished_at, ''), coalesce(CAST(verifier_calls AS VARCHAR), ''), coalesce(model, '')) = 1)"""
_D = f"""{_FIRST}, o AS (SELECT run_id, condition, task_id, attempt, coalesce(CAST(r.v.n_cases AS VARCHAR), '') || '^' || coalesce(CAST(r.v.n_diverged AS VARCHAR), '') AS o, coalesce(r.h, '') AS e FROM f),
    j AS (SELECT x.run_id, x.condition, x.task_id, x.o AS o1, y.o AS o2, x.e AS e1, y.e AS e2 FROM o x JOIN o y ON x.run_id = y.run_id AND x.condition = y.condition AND x.task_id = y.task_id WHERE x.attempt = 1 AND y.attempt = 2),
    d AS (SELECT run_id, condition, task_id, 'output' AS kind, 'stdout' AS ref, o1 AS expected, o2 AS actual FROM j WHERE o1 <> o2
      UNION ALL SELECT run_id, condition, task_id, CASE WHEN e1 = 'TIMEOUT' OR e2 = 'TIMEOUT' THEN 'timeout' ELSE 'error' END, 'error', e1, e2 FROM j WHERE e1 <> e2)"""
_M = "m AS (SELECT DISTINCT upper(name) AS cluster, path AS name FROM parsed_routines WHERE name IS NOT NULL AND path IS NOT NULL)"
_E = "e AS (SELECT concat_ws('#', file_id, seq) AS entry, max(formals) AS formals FROM routine_labels WHERE file_id IS NOT NULL AND seq IS NOT NULL AND len(formals) > 0 GROUP BY file_id, seq)"
_CASES = f"""{_E}, sl AS (SELECT entry, len(formals) AS n, unnest(range(1, len(formals) + 1)) AS p FROM e),
    v AS (SELECT * FROM (VALUES (1, ''), (2, '0'), (3, '1'), (4, '-1')) v(c, v)),
    b AS (SELECT entry, 0 AS kind, 0 AS c, 0 AS p, list_transform(range(len(formals)), lambda i: '1') AS args FROM e
      UNION ALL SELECT entry, 1, x.c, 0, list_transform(range(len(formals)), lambda i: x.v) FROM e, (VALUES (0, ''), (1, '0')) x(c, v)
      UNION ALL SELECT entry, 2, c, p, list_transform(range(1, n + 1), lambda i: CASE WHEN i = p THEN v ELSE '1' END) FROM sl, v),
    g AS (SELECT entry, args, min(struct_pack(kind := kind, c := c, p := p)) AS o FROM b GROUP BY 1, 2),
    built AS (SELECT entry, array_to_string(args, ',') AS args, CAST(row_number() OVER (PARTITION BY entry ORDER BY o) AS INTEGER) AS case_no FROM g QUALIFY case_no <= 8)"""
_CALLS = """edges AS (SELECT DISTINCT caller, callee FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS callee FROM lineitem) e
    WHERE callee IS NOT NULL AND caller <> callee), sides AS (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 'eval' ELSE 'train' END AS side FROM part)"""
_SUB = """top AS (SELECT concat('^C(', c_custkey, ')') AS ref, c_name AS value FROM customer), st AS (SELECT * FROM top UNION ALL SELECT concat('^C(', c_custkey, ',0)'), c_mktsegment FROM customer WHERE c_nationkey > 5)"""

_KNOWN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in reports.ERRORS.items()) + "}"


def _meaning(x: str) -> str:
    code = rf"regexp_extract({x}, '^\s*%?(?:[A-Z]+-[A-Z]-)?([A-Z0-9]+)', 1)"
    return f"CASE WHEN {_KNOWN}[{code}] IS NOT NULL THEN concat({code}, ': ', {_KNOWN}[{code}]) ELSE {x} END"


SQL = {
    "explained_differences": f"""WITH {_D}, x AS (SELECT *, string_split(expected, '^') AS p, string_split(actual, '^') AS q FROM d),
        y AS (SELECT *, list_filter(range(1, greatest(len(p), len(q)) + 1), lambda i: coalesce(p[i], '') <> coalesce(q[i], '')) AS parts, list_filter(range(1, greatest(length(expected), length(actual)) + 1), lambda i: expected[i:i] <> actual[i:i])[1] AS first FROM x)
        SELECT run_id, condition, task_id, kind, CASE kind WHEN 'output' THEN 'Output differs (stdout)' WHEN 'timeout' THEN concat('Time ran out: expected ''', expected, ''', got ''', actual, '''')
            ELSE concat('Error differs: ', CASE WHEN expected <> '' AND actual = '' THEN concat('the baseline raises ', {_meaning('expected')}, ' and the candidate does not') WHEN expected = '' THEN concat('the candidate raises ', {_meaning('actual')}, ' where the baseline succeeds')
              ELSE concat({_meaning('expected')}, ' against ', {_meaning('actual')}) END) END AS headline,
          CASE WHEN kind = 'output' THEN array_to_string(list_concat(CASE WHEN expected <> '' AND actual <> '' THEN [concat('first difference at character ', first, ' of ', greatest(length(expected), length(actual)))] ELSE [] END,
            CASE WHEN contains(expected, '^') OR contains(actual, '^') THEN list_transform(parts[:12], lambda i: concat('piece ', i, ': ''', coalesce(p[i], ''), ''' to ''', coalesce(q[i], ''), '''')) ELSE [] END), '; ') ELSE '' END AS details FROM y""",
    "result_differences": f"WITH {_D} SELECT * FROM d",
    "difference_kinds": f"WITH {_D} SELECT condition, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, count(*) AS differences, bool_or(kind <> 'timeout') AS specific FROM d GROUP BY 1",
    "recordings": f"""WITH {_FIRST}, x AS (SELECT task_id, condition, attempt, r.a.claimed_correct AS claimed, r.v.equivalent AS verified, r.v.n_diverged AS differences, r.v.n_void = 0 AS live, r.v.n_cases AS n_cases, r.v.n_void AS n_void, run_id FROM f),
        g AS (SELECT task_id, coalesce(bool_or(condition = 'baseline') AND bool_or(condition = 'scaffolded'), false) AS usable, coalesce(bool_or(live), false) AS live, coalesce(max(n_cases), 0) AS n_cases, coalesce(max(n_void), 0) AS n_void,
          count(*) FILTER (claimed AND verified = false) AS false_confidence FROM x GROUP BY 1) SELECT task_id, usable, live, n_cases, n_void, false_confidence FROM g""",
    "coverage": """WITH k AS (SELECT DISTINCT task_id FROM mutation_tasks WHERE task_id IS NOT NULL), a AS (SELECT task_id, count(DISTINCT condition) AS n FROM attempts WHERE task_id IS NOT NULL GROUP BY 1), c AS (SELECT task_id FROM a WHERE n >= 2)
        SELECT (SELECT count(*) FROM k) AS known, (SELECT count(*) FROM a) AS attempted, (SELECT count(*) FROM c) AS common, (SELECT count(*) FROM (SELECT * FROM k EXCEPT SELECT * FROM c)) + (SELECT count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM k)) > 0 AS partial""",
    "elapsed": "SELECT condition, round(coalesce(epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - min(epoch_us(try_cast(started_at AS TIMESTAMPTZ))), 0) / 1e6, 3) AS seconds FROM attempts GROUP BY 1",
    "suggestions": """WITH n AS (SELECT DISTINCT upper(name) AS name FROM parsed_routines WHERE path LIKE '%.m' AND name IS NOT NULL), w AS (SELECT DISTINCT concat(upper(trim(routine))[:4], '?') AS wanted FROM attempts WHERE routine IS NOT NULL)
        SELECT wanted, name, CAST(row_number() OVER (PARTITION BY wanted ORDER BY name) AS INTEGER) AS place FROM w JOIN n ON contains(name, wanted[:3]) WHERE wanted NOT IN (SELECT name FROM n) QUALIFY place <= 10""",
    "status_counts": """SELECT 'tasks' AS part, count(DISTINCT task_id) AS rows FROM mutation_tasks UNION ALL SELECT 'names', count(DISTINCT upper(name)) FROM parsed_routines WHERE path LIKE '%.m'
        UNION ALL SELECT 'attempts', count(*) FROM attempts UNION ALL SELECT 'unfinished', count(*) FROM attempts WHERE finished_at IS NULL""",
    "cluster_order": f"WITH {_M}, g AS (SELECT cluster, count(*) AS size, min(name) AS first FROM m GROUP BY 1) SELECT cluster, size, CAST(row_number() OVER (ORDER BY size DESC, first) AS INTEGER) AS place FROM g",
    "siblings": f"WITH {_M}, g AS (SELECT cluster, list_sort(list(name)) AS l FROM m GROUP BY 1) SELECT m.cluster, m.name, CAST(len(l) - 1 AS BIGINT) AS others, array_to_string(list_filter(l, lambda x: x <> m.name)[:12], ',') AS siblings FROM m JOIN g USING (cluster)",
    "eval_order": "SELECT s_name AS name, CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE (SELECT count(*) FROM supplier WHERE s_acctbal > 0) END AS rank FROM supplier",
    "dictionary_counts": "SELECT (SELECT count(*) FROM region) AS files, (SELECT count(DISTINCT r_name) FROM region) AS roots, (SELECT count(*) FROM nation) AS fields, count(*) AS nodes, CAST(coalesce(sum(CAST(c_acctbal < 0 AS INTEGER)), 0) AS BIGINT) AS redactions FROM customer",
    "caller_questions": f"""WITH {_CALLS} SELECT CAST(callee AS VARCHAR) AS name, b.side, 'call_graph' AS source, concat('Which routines call ', callee, '?') AS question, array_to_string(list_sort(list(CAST(caller AS VARCHAR))), ', ') AS answer
        FROM edges JOIN sides a ON a.k = caller JOIN sides b ON b.k = callee WHERE a.side = b.side GROUP BY callee, b.side""",
    "file_questions": """WITH once AS (SELECT s_name AS name, CAST(n_regionkey AS VARCHAR) AS file, min(concat('^N', n_nationkey, '(')) AS root FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
        n AS (SELECT CAST(n_regionkey AS VARCHAR) AS file, count(*) AS n, array_to_string(list(concat('#', n_nationkey, ' ', n_name, ' [0;', n_nationkey, ']') ORDER BY n_nationkey)[:12], '; ') AS l FROM nation GROUP BY 1)
        SELECT name, file, 'file' AS source, concat('Which file is ', root, ' in ', name, '?') AS question, concat('#', file, ' REGION ', file, ', fields: ', n) AS answer FROM once JOIN n USING (file)
        UNION ALL SELECT name, file, 'file', concat('Name fields of file #', file, '.'), l FROM once JOIN n USING (file)""",
    "boundary_cases": f"WITH {_CASES} SELECT entry, case_no, args FROM built",
    "case_counts": f"WITH {_CASES} SELECT entry, count(*) AS cases, count(*) >= 5 AS enough FROM built GROUP BY 1",
    "task_documents": "SELECT s_suppkey, CAST(to_json(struct_pack(s_name := s_name, s_nationkey := s_nationkey)) AS VARCHAR) AS document FROM supplier",
    "kept_entries": "SELECT doc_id, CAST(len(w) AS INTEGER) AS total, array_to_string(w[:20], ' ') AS kept FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)",
    "name_list": "WITH n AS (SELECT DISTINCT upper(name) AS name FROM parsed_routines WHERE path LIKE '%.m' AND contains(upper(name), '0')) SELECT name, (SELECT count(*) FROM n) AS total FROM n ORDER BY name LIMIT 15",
    "subtree_counts": "SELECT concat('^C(', c_custkey, ')') AS ref, CAST(1 AS BIGINT) AS nodes, c_nationkey > 5 AS capped FROM customer",
    "cover_faults": "SELECT s_name AS name, 'unknown' AS fault FROM supplier GROUP BY 1 HAVING NOT bool_or(coalesce(s_acctbal > 5000, false))",
    "capture_choice": """WITH r AS (SELECT o_custkey AS routine, bool_or(floor(o_totalprice) > 200000) AS large FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
        SELECT c_custkey AS routine, CASE WHEN large THEN 'trigger' WHEN NOT large THEN 'query' WHEN c_acctbal > 0 THEN 'none' ELSE 'trigger' END AS tier, large IS NOT NULL OR coalesce(c_acctbal > 0, false) AS complete FROM customer LEFT JOIN r ON routine = c_custkey""",
    "plan_ready_subtree": f"WITH {_SUB} SELECT count(*) AS ops, count(*) FILTER (c_nationkey > 5) AS conflicts, CAST(0 AS BIGINT) AS duplicate_refs, count(*) FILTER (c_nationkey > 5) = 0 AS ready FROM customer",
    "plan_apply_subtree": f"WITH {_SUB} SELECT * FROM st",
}
