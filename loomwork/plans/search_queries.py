"""Retrieval over the documents and source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import reading, search
from ..sources.tables import table

QUERY = "harbour letter broken lamp vriend übersetzer"
NARROW = "teacher garden map"
_TOKENS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\$?[\p{L}\p{N}_]+')"


def _docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def _titled(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.substring_index("text", " ", 3).alias("title"), "source")


def _shelves(s, d):
    known = table(s, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("id")).distinct()
    patterns = F.when(F.length("id") % 2 == 0, F.array(F.lit("*.m"))).otherwise(F.array().cast("array<string>"))
    return known.select("id", F.concat("id", F.lit(" harbour letter")).alias("title"), F.array("id").alias("tags"), patterns.alias("file_patterns"), (F.length("id") % 11).alias("priority"))


def _list(query: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in search.query_terms(query)) + "]"


def _ranked(query: str, where: str = "true") -> str:
    return f"""h AS (SELECT doc_id AS id, unnest({_TOKENS}) AS term, lang FROM documents),
        tf AS (SELECT id, term, lang, count(*) AS tf FROM h WHERE list_contains({_list(query)}, term) GROUP BY 1, 2, 3),
        idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM tf GROUP BY 1),
        r AS (SELECT id, round(sum(idf * (1 + ln(tf))), 6) AS score FROM tf JOIN idf USING (term) WHERE {where} GROUP BY 1)"""


QUERIES = {
    "lexical_search": lambda s, d: search.search(_docs(s, d), QUERY, 20),
    "lexical_search_sources": lambda s, d: search.search(_titled(s, d), QUERY, 20, title="title", sources=search.inventory(_shelves(s, d), "x/y.m"), source_key="source"),
    "search_filtered": lambda s, d: search.search(_docs(s, d), NARROW, 10, where=F.col("lang") == "en"),
    "search_total": lambda s, d: search.ranked_hits(_docs(s, d), search.query_terms(QUERY)).agg(F.count("*").alias("total_matches"), F.round(F.max("score"), 6).alias("best")),
    "term_stats": lambda s, d: search.term_stats(_docs(s, d), search.query_terms(QUERY + " " + NARROW)).withColumn("idf", F.round("idf", 6)),
    "postings": lambda s, d: search.postings(_docs(s, d)).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("uses")),
    "paged_read": lambda s, d: reading.page(_sources(s, d), 3, 12, 240, "file_id", "src"),
    "line_window": lambda s, d: reading.line_window(_sources(s, d), 5, 4, "file_id", "src"),
    "passage_chunks": lambda s, d: reading.passages(table(s, d, "documents")),
    "name_glob": lambda s, d: search.matching_names(table(s, d, "parsed_routines").select("name").where("name IS NOT NULL").distinct(), "L*0?"),
    "name_holds": lambda s, d: search.matching_names(table(s, d, "parsed_routines").select("name").where("name IS NOT NULL").distinct(), "a"),
    "name_pattern": lambda s, d: search.matching_names(table(s, d, "parsed_routines").select("name").where("name IS NOT NULL").distinct(), "[A-M]*[0-9]"),
    "masked_code": lambda s, d: _sources(s, d).select("file_id", F.posexplode(t.lines(F.col("src"))).alias("i", "line")).select("file_id", "i", F.rtrim(t.code_part(F.col("line"))).alias("code")).where("code <> ''"),
    "wire_escape": lambda s, d: _sources(s, d).select("file_id", t.escape(F.col("src")).alias("wire"), (t.unescape(t.escape(F.col("src"))) == F.col("src")).alias("same")),
    "slugs": lambda s, d: table(s, d, "parsed_routines").where("description IS NOT NULL").select(t.slug(F.col("description")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n")),
}


def _sources(s, d):
    return table(s, d, "parsed_routines").where("path LIKE '%.m' AND src IS NOT NULL").select("file_id", "src").dropDuplicates(["file_id"])


_SOURCES = "src AS (SELECT file_id, any_value(src) AS src FROM parsed_routines WHERE path LIKE '%.m' AND src IS NOT NULL GROUP BY 1)"
_LINES = (
    _SOURCES
    + r""",
        cut AS (SELECT file_id, regexp_split_to_array(src, '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS p FROM src),
        ls AS (SELECT file_id, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS ls FROM cut)"""
)

SQL = {
    "lexical_search_sources": f"""WITH p AS (SELECT doc_id AS id, text, array_to_string(string_split(text, ' ')[:3], ' ') AS title, source FROM documents),
        h AS (SELECT id, unnest({_TOKENS.replace('text', "concat_ws(' ', title, text)")}) AS term FROM p), tf AS (SELECT id, term, count(*) AS tf FROM h WHERE list_contains({_list(QUERY)}, term) GROUP BY 1, 2),
        idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM tf GROUP BY 1), body AS (SELECT id, sum(idf * (1 + ln(tf))) AS s FROM tf JOIN idf USING (term) GROUP BY 1),
        th AS (SELECT DISTINCT id, unnest({_TOKENS.replace('text', 'title')}) AS term FROM p), tt AS (SELECT id, 2 * sum(idf) AS s FROM th JOIN idf USING (term) GROUP BY 1),
        sh AS (SELECT DISTINCT source, concat(source, ' harbour letter') AS title, length(source) % 11 AS priority, length(source) % 2 = 0 AS m FROM documents WHERE source IS NOT NULL),
        wo AS (SELECT source, 0.3 * len(list_filter(list_distinct({_TOKENS.replace('text', "concat_ws(' ', title, source)")}), lambda t: list_contains({_list(QUERY)}, t))) + 0.25 * priority + CASE WHEN m THEN 6 ELSE 2 END AS s FROM sh),
        r AS (SELECT body.id, round(body.s + coalesce(tt.s, 0) + coalesce(CAST(wo.s AS DOUBLE), 0), 6) AS score FROM body JOIN p ON p.id = body.id LEFT JOIN tt ON tt.id = body.id LEFT JOIN wo ON wo.source = p.source), top AS (SELECT * FROM r ORDER BY score DESC, id LIMIT 20)
        SELECT id, score, text[:1800] AS excerpt, length(text) > 1800 AS truncated FROM top JOIN documents ON id = doc_id""",
    "lexical_search": f"WITH {_ranked(QUERY)}, top AS (SELECT * FROM r ORDER BY score DESC, id LIMIT 20) SELECT id, score, text[:1800] AS excerpt, length(text) > 1800 AS truncated FROM top JOIN documents ON id = doc_id",
    "search_filtered": f"WITH {_ranked(NARROW, "lang = 'en'")}, top AS (SELECT * FROM r ORDER BY score DESC, id LIMIT 10) SELECT id, score, text[:1800] AS excerpt, length(text) > 1800 AS truncated FROM top JOIN documents ON id = doc_id",
    "search_total": f"WITH {_ranked(QUERY)} SELECT count(*) AS total_matches, round(max(score), 6) AS best FROM r",
    "term_stats": f"WITH {_ranked(QUERY + ' ' + NARROW)}, n AS (SELECT term, count(*) AS df FROM tf GROUP BY 1) SELECT term, df, round(idf, 6) AS idf FROM n JOIN idf USING (term)",
    "postings": f"WITH h AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM h GROUP BY 1, 2) SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS uses FROM tf GROUP BY 1",
    "line_window": f"""WITH {_LINES}, a AS (SELECT *, least(greatest(5, 1), len(ls)) AS st FROM ls WHERE len(ls) > 0), x AS (SELECT file_id, ls, st + 3 < len(ls) AS truncated, unnest(range(st, least(st + 3, len(ls)) + 1)) AS line FROM a)
        SELECT file_id, line, ls[line] AS text, truncated FROM x""",
    "paged_read": f"""WITH {_LINES}, x AS (SELECT file_id, ls, len(ls) AS total, unnest(range(1, len(ls) + 1)) AS n FROM ls), p AS (SELECT file_id, total, n, ls[n] AS line FROM x WHERE n BETWEEN 3 AND 14),
        u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY n) AS used FROM p), f AS (SELECT * FROM u WHERE used - 1 <= 240 OR n = 3)
        SELECT file_id, min(n) AS first, max(n) AS last, CASE WHEN max(n) < max(total) THEN max(n) + 1 END AS next_line, string_agg(line, chr(10) ORDER BY n) AS content FROM f GROUP BY 1""",
    "name_holds": "SELECT DISTINCT name FROM parsed_routines WHERE contains(name, 'A')",
    "name_pattern": "SELECT DISTINCT name FROM parsed_routines WHERE regexp_full_match(name, '[A-M].*[0-9]')",
    "name_glob": "SELECT DISTINCT name FROM parsed_routines WHERE regexp_full_match(name, 'L.*0.')",
    "masked_code": f"""WITH {_LINES}, x AS (SELECT file_id, ls, unnest(range(len(ls))) AS i FROM ls), l AS (SELECT file_id, i, ls[i + 1] AS line FROM x),
        m AS (SELECT *, array_to_string(list_transform(string_split(line, '"'), lambda p, k: CASE WHEN k % 2 = 0 THEN repeat(chr(1), length(p)) ELSE p END), '"') AS masked FROM l)
        SELECT file_id, i, rtrim(CASE WHEN strpos(masked, ';') > 0 THEN line[:strpos(masked, ';') - 1] ELSE line END, ' ') AS code FROM m WHERE code <> ''""",
    "wire_escape": f"WITH {_SOURCES} SELECT file_id, replace(replace(replace(replace(src, '%', '%25'), chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D') AS wire, true AS same FROM src",
    "slugs": "SELECT coalesce(nullif(lower(regexp_replace(regexp_replace(description, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'reference') AS slug, count(*) AS n FROM parsed_routines WHERE description IS NOT NULL GROUP BY 1",
}
