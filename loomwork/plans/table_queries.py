"""Dictionary decoding, spans, training rows and event analytics over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fileman_date
from ..operators import dictionary as dic
from ..operators import spans, training
from ..sources.tables import table


def _nodes(s, d):
    c = table(s, d, "customer").select(F.concat(F.lit("^C("), F.col("c_custkey").cast("string"), F.lit(",0)")).alias("ref"), F.lit("0").alias("node"), F.concat_ws("^", "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment", F.lit("")).alias("value"), F.col("c_custkey").alias("record"))
    n = table(s, d, "nation").select(F.concat(F.lit("^C(200,"), F.col("n_nationkey").cast("string"), F.lit(",0)")).alias("ref"), F.lit("0").alias("node"), F.concat_ws("^", "n_name", F.col("n_regionkey").cast("string")).alias("value"), F.col("n_nationkey").cast("bigint").alias("record"))
    return c.unionByName(n)


def _roots(s):
    return s.createDataFrame([("^C(", "customer"), ("^C(200,", "nation"), ("^R(", "region")], "root string, file string")


def _fields(s):
    rows = [("customer", ".01", "NAME", "RF", "", "0;1"), ("customer", "2", "NATION", "P200'", "", "0;2"), ("customer", "3", "SEGMENT PASSWORD", "S", "BUILDING:b;MACHINERY: m ;AUTOMOBILE:a;AUTOMOBILE:auto;", "0;3"), ("nation", ".01", "NAME", "RF", "", "0;1")]
    f = dic.storage(s.createDataFrame(rows, "file string, field string, name string, type string, codes string, storage string"))
    return f.withColumn("kind", dic.type_of(F.col("type"))).withColumn("to_file", dic.pointer_file(F.col("type")))


def _placed(s, d):
    return dic.longest_root(_nodes(s, d), _roots(s))


def _decoded(s, d):
    return dic.decode(_placed(s, d), _fields(s), ["ref", "file", "node"])


def _deref(s, d):
    p = _decoded(s, d).where("kind = 'pointer'").withColumn("to_file", F.lit("nation"))
    t = table(s, d, "nation").select(F.lit("nation").alias("file"), F.col("n_nationkey").alias("record"), F.col("n_name").alias("label"))
    return dic.dereference(p, t).select("ref", "raw", "pointed")


def _dates(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.concat((F.year("o_orderdate") - 1700).cast("string"), F.date_format("o_orderdate", "MMdd"), F.when(F.col("o_orderkey") % 3 == 0, ".0839").otherwise("")).alias("raw"))
    return o.select("o_orderkey", fileman_date(F.when(F.col("o_orderkey") % 7 == 0, "hello").otherwise(F.col("raw"))).alias("iso"))


def _spans(s, d):
    from pyspark.sql import Window

    l = table(s, d, "routine_labels").where("file_id IS NOT NULL AND seq IS NOT NULL").groupBy("file_id", "seq").agg(F.max("label").alias("label"), F.max(F.coalesce("arity", F.lit(0))).alias("arity"))
    w = Window.partitionBy("file_id").orderBy("seq")
    return l.withColumn("lo", F.col("seq") * 7 + 1).withColumn("hi", F.coalesce(F.lead("seq").over(w) * 7, F.lit(1000)))


def _points(s, d):
    return table(s, d, "routine_labels").where("file_id IS NOT NULL").select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(3))).alias("at"))


def _names(s, d):
    return table(s, d, "parsed_routines").where("name IS NOT NULL AND file_id IS NOT NULL").groupBy("file_id").agg(F.upper(F.max("name")).alias("name"))


def _qa(s, d):
    return training.structure_pairs(table(s, d, "routine_labels"), _names(s, d))


def _reward(s, d):
    t = table(s, d, "attempts").select("run_id", "condition", "task_id", "attempt", "seed", F.col("harness_error").alias("error"), F.when(F.col("submitted"), F.col("task_id")).alias("candidate"), F.col("verdict.equivalent").alias("equivalent"), "verdict.n_cases", "verdict.n_diverged", "verdict.n_void")
    return training.reward(t, True)


def _admit(s, d):
    t = table(s, d, "mutation_tasks").where("task_no IS NOT NULL").groupBy("task_no").agg(F.max("n_diverged").alias("n_diverged"), F.max(F.upper(F.trim("routine"))).alias("name"), F.max("mutated_src").alias("mutated_src"))
    keep = table(s, d, "parsed_routines").where("name IS NOT NULL AND repo IS NOT NULL").select(F.upper("name").alias("name"))
    return training.task_admission(t, keep, 2).groupBy("verdict").agg(F.count("*").alias("tasks"))


def _log(s, d):
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "view", "candidate").when(F.col("event_type") == "click", "verdict").otherwise("tool_call")
    return e.select(F.col("user_id").alias("run_id"), F.lit("c").alias("condition"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5).alias("attempt"))


QUERIES = {
    "longest_root": lambda s, d: _placed(s, d).select("ref", "root", "file", F.array_join(dic.subscripts(F.col("rest")), "|").alias("subscripts")),
    "dict_decode": lambda s, d: _decoded(s, d).select("ref", "position", "raw", "name", "decoded"),
    "pointer_deref": _deref,
    "redact_pieces": lambda s, d: dic.redact(_placed(s, d), _fields(s), ["ref"]),
    "fileman_dates": _dates,
    "label_of_line": lambda s, d: spans.containing(_points(s, d), _spans(s, d), "file_id"),
    "entry_of_line": lambda s, d: spans.as_of(_points(s, d), _spans(s, d), "file_id", F.col("arity") > 0),
    "qa_pairs": _qa,
    "chat_examples": lambda s, d: training.to_chat(_qa(s, d), "Answer briefly.").select("name", F.size("messages").alias("n"), F.col("messages")[1]["content"].alias("user"), F.md5(F.to_json("messages")).alias("digest")),
    "rewards": lambda s, d: _reward(s, d).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward")),
    "admission": _admit,
    "event_log_fold": lambda s, d: spans.fold_log(_log(s, d)).groupBy("kind").agg(F.count("owner").alias("owned"), F.sum("owner").alias("owners"), F.count("*").alias("n")),
    "sessions": lambda s, d: spans.sessions(table(s, d, "events"), "user_id", "ts", 1800).groupBy("user_id").agg(F.max("session").alias("sessions"), F.count("*").alias("events")),
    "tumbling": lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("start_us"), "event_type", "n", "total"),
    "events_cube": lambda s, d: table(s, d, "events").cube("event_type", (F.col("user_id") % 4).alias("g")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")),
    "json_props": lambda s, d: table(s, d, "events").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k")).groupBy("k").agg(F.count("*").alias("n")),
    "answers_by_source": lambda s, d: table(s, d, "sft_examples").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.countDistinct("example_id").alias("examples"), F.sum(F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit(""))))).alias("chars")),
    "edit_distance": lambda s, d: table(s, d, "mutation_tasks").where("original_line IS NOT NULL AND mutated_line IS NOT NULL").select("task_no", F.levenshtein("original_line", "mutated_line").alias("distance")).distinct(),
}

_NODES = """nodes AS (SELECT concat('^C(', c_custkey, ',0)') AS ref, concat_ws('^', c_name, c_nationkey, c_mktsegment, '') AS value FROM customer UNION ALL SELECT concat('^C(200,', n_nationkey, ',0)'), concat_ws('^', n_name, n_regionkey) FROM nation),
    placed AS (SELECT ref, value, CASE WHEN starts_with(ref, '^C(200,') THEN '^C(200,' ELSE '^C(' END AS root, CASE WHEN starts_with(ref, '^C(200,') THEN 'nation' ELSE 'customer' END AS file FROM nodes),
    fields AS (SELECT * FROM (VALUES ('customer', 1, 'NAME', 'text'), ('customer', 2, 'NATION', 'pointer'), ('customer', 3, 'SEGMENT PASSWORD', 'set'), ('nation', 1, 'NAME', 'text')) v(file, position, name, kind)),
    codes AS (SELECT * FROM (VALUES ('BUILDING', 'b'), ('MACHINERY', 'm'), ('AUTOMOBILE', 'auto')) v(k, m)),
    ps AS (SELECT ref, file, string_split(value, '^') AS p, unnest(range(1, len(string_split(value, '^')) + 1)) AS position FROM placed),
    pc AS (SELECT ps.ref, ps.file, CAST(ps.position AS INTEGER) AS position, p[ps.position] AS raw, name, kind FROM ps LEFT JOIN fields f ON ps.file = f.file AND ps.position = f.position WHERE name IS NOT NULL OR p[ps.position] <> '')"""
_SPANS = """lb AS (SELECT file_id, seq, max(label) AS label, max(coalesce(arity, 0)) AS arity FROM routine_labels WHERE file_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2),
    sp AS (SELECT *, seq * 7 + 1 AS lo, coalesce(lead(seq) OVER (PARTITION BY file_id ORDER BY seq) * 7, 1000) AS hi FROM lb),
    pt AS (SELECT file_id, CAST(unnest(range(0, 41, 3)) AS INTEGER) AS at_ FROM (SELECT DISTINCT file_id FROM routine_labels WHERE file_id IS NOT NULL))"""
_QA = """nm AS (SELECT file_id, upper(max(name)) AS name FROM parsed_routines WHERE name IS NOT NULL AND file_id IS NOT NULL GROUP BY 1),
    x AS (SELECT DISTINCT file_id, seq, concat(label, CASE WHEN len(coalesce(formals, [])) > 0 THEN concat('(', array_to_string(formals, ','), ')') ELSE '' END) AS s FROM routine_labels WHERE label IS NOT NULL),
    q AS (SELECT file_id, string_agg(s, ', ' ORDER BY seq NULLS FIRST, s) AS list, count(*) AS n FROM x GROUP BY 1),
    qa AS (SELECT name, 'structure' AS source, concat('Which entry points does ', name, ' have?') AS question, concat(name, ' has ', n, ': ', list) AS answer FROM q JOIN nm USING (file_id))"""

SQL = {
    "longest_root": f"WITH {_NODES} SELECT ref, root, file, replace(replace(replace(ref, root, ''), ')', ''), ',', '|') AS subscripts FROM placed",
    "dict_decode": f"WITH {_NODES} SELECT ref, position, raw, name, CASE WHEN kind = 'set' THEN coalesce(m, raw) ELSE raw END AS decoded FROM pc LEFT JOIN codes ON k = raw",
    "pointer_deref": f"WITH {_NODES} SELECT ref, raw, n_name AS pointed FROM pc LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = raw WHERE kind = 'pointer'",
    "redact_pieces": f"WITH {_NODES} SELECT ref, CASE WHEN file = 'customer' AND string_split(value, '^')[3] <> '' THEN concat_ws('^', string_split(value, '^')[1], string_split(value, '^')[2], '<redacted>', '') ELSE value END AS value, CASE WHEN file = 'customer' AND string_split(value, '^')[3] <> '' THEN 1 ELSE 0 END AS redactions FROM placed",
    "fileman_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), CASE WHEN o_orderkey % 3 = 0 THEN 'T08:39:00' ELSE '' END) END AS iso FROM orders",
    "label_of_line": f"WITH {_SPANS} SELECT pt.file_id, at_ AS \"at\", label FROM pt LEFT JOIN sp ON pt.file_id = sp.file_id AND at_ BETWEEN lo AND hi",
    "entry_of_line": f"WITH {_SPANS} SELECT pt.file_id, at_ AS \"at\", coalesce((array_agg(label ORDER BY lo DESC) FILTER (arity > 0 AND lo <= at_))[1], (array_agg(label ORDER BY lo DESC) FILTER (lo <= at_))[1]) AS entry FROM pt LEFT JOIN sp ON pt.file_id = sp.file_id GROUP BY 1, 2",
    "chat_examples": f"""WITH {_QA}, m AS (SELECT name, question, [struct_pack(role := 'system', content := 'Answer briefly.'), struct_pack(role := 'user', content := question), struct_pack(role := 'assistant', content := answer)] AS messages FROM qa)
        SELECT name, CAST(3 AS INTEGER) AS n, question AS user, md5(CAST(to_json(messages) AS VARCHAR)) AS digest FROM m""",
    "qa_pairs": f"WITH {_QA} SELECT * FROM qa",
    "rewards": """WITH g AS (SELECT CASE WHEN trim(coalesce(CASE WHEN submitted THEN task_id END, '')) = '' THEN 'empty candidate' WHEN harness_error IS NOT NULL THEN 'error' WHEN coalesce(verdict.n_cases, 0) - coalesce(verdict.n_void, 0) <= 0 THEN 'nothing gradable'
        WHEN coalesce(verdict.equivalent, false) THEN 'equivalent' ELSE 'diverged' END AS reason, greatest(round((coalesce(verdict.n_cases, 0) - coalesce(verdict.n_void, 0) - coalesce(verdict.n_diverged, 0)) / nullif(coalesce(verdict.n_cases, 0) - coalesce(verdict.n_void, 0), 0), 6), 0) AS part FROM attempts)
        SELECT reason, count(*) AS n, round(avg(CASE reason WHEN 'equivalent' THEN 1.0::DOUBLE WHEN 'diverged' THEN part ELSE 0 END), 6) AS mean_reward FROM g GROUP BY 1""",
    "admission": """WITH t AS (SELECT task_no, max(n_diverged) AS n_diverged, max(upper(trim(routine))) AS name, max(mutated_src) AS mutated_src FROM mutation_tasks WHERE task_no IS NOT NULL GROUP BY 1),
        e AS (SELECT *, CASE WHEN name IS NULL OR name NOT IN (SELECT upper(name) FROM parsed_routines WHERE name IS NOT NULL AND repo IS NOT NULL) THEN 'off_split' WHEN coalesce(n_diverged, 0) < 2 THEN 'no_case_separates' END AS early FROM t),
        f AS (SELECT *, min(task_no) FILTER (early IS NULL) OVER (PARTITION BY name, mutated_src) AS first FROM e)
        SELECT coalesce(early, CASE WHEN task_no > first THEN 'duplicate_mutant' END, 'admitted') AS verdict, count(*) AS tasks FROM f GROUP BY 1""",
    "event_log_fold": """WITH l AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'candidate' WHEN 'click' THEN 'verdict' ELSE 'tool_call' END AS kind, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS attempt FROM events),
        o AS (SELECT *, last_value(CASE WHEN kind = 'candidate' THEN seq END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq) AS latest, last_value(CASE WHEN kind = 'candidate' THEN seq END IGNORE NULLS) OVER (PARTITION BY run_id, attempt ORDER BY seq) AS same FROM l),
        w AS (SELECT kind, CASE kind WHEN 'verdict' THEN coalesce(CASE WHEN attempt IS NOT NULL THEN same END, latest) WHEN 'tool_call' THEN latest ELSE seq END AS owner FROM o)
        SELECT kind, count(owner) AS owned, CAST(sum(owner) AS BIGINT) AS owners, count(*) AS n FROM w GROUP BY 1""",
    "sessions": "WITH g AS (SELECT user_id, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000, true) THEN 1 ELSE 0 END AS n FROM events) SELECT user_id, CAST(sum(n) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1",
    "tumbling": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_cube": "SELECT event_type, user_id % 4 AS g, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY CUBE (event_type, user_id % 4)",
    "json_props": "SELECT CAST(props::JSON->>'$.k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "answers_by_source": "SELECT coalesce(source, '') AS source, count(DISTINCT example_id) AS examples, CAST(sum(coalesce(list_sum(list_transform(messages, lambda m: length(coalesce(m.content, '')))), 0)) AS BIGINT) AS chars FROM sft_examples GROUP BY 1",
    "edit_distance": "SELECT DISTINCT task_no, levenshtein(original_line, mutated_line) AS distance FROM mutation_tasks WHERE original_line IS NOT NULL AND mutated_line IS NOT NULL",
}
