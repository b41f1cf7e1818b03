"""The queries of this subpackage: (spark, directory) -> DataFrame. None has an equivalent in SQL unless SQL gives it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from ..sources.tables import table
from . import code_docs, containers, groups, languages, leaks, near_copies, shared_spans, syntax


def _finished(spark: SparkSession, run: Callable[[Scratch], DataFrame]) -> DataFrame:
    """The written result of a run; the run's other tables are deleted."""
    scratch = Scratch(spark)
    return scratch.finish(run(scratch))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "parsed_routines"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "parsed_routines"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: code_docs.documented_names(table(spark, d, "parsed_routines"), s))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: code_docs.documented_functions(table(spark, d, "parsed_routines"), table(spark, d, "routine_labels"), scratch=s))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: groups.grouped_split(table(spark, d, "mutation_tasks"), scratch=s).select("task_no", "unit_key"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: groups.grouped_split(table(spark, d, "mutation_tasks"), scratch=s))


def _records(spark: SparkSession, d: str) -> DataFrame:
    tasks, chats = table(spark, d, "mutation_tasks"), table(spark, d, "sft_examples")
    return near_copies.task_records(tasks).unionByName(near_copies.chat_records(chats))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ordered = ["kind", F.least("key_e", "key_t").alias("key_a"), F.greatest("key_e", "key_t").alias("key_b")]
    return _finished(spark, lambda s: near_copies.cross_split_pairs(_records(spark, d), s).select(*ordered))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: near_copies.overlap_report(_records(spark, d), s))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: shared_spans.sharing_routines(table(spark, d, "mutation_tasks"), s))


def p5_parts(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: shared_spans.shared_parts(table(spark, d, "mutation_tasks"), s))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: containers.fill_containers(table(spark, d, "documents"), scratch=s).where(F.col("piece") == 1).select("doc_id"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: containers.fill_containers(table(spark, d, "documents"), scratch=s))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: containers.fill_report(containers.fill_containers(table(spark, d, "documents"), scratch=s)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: leaks.PhraseIndex(table(spark, d, "documents"), s).phrases(table(spark, d, "heldout_items")).select("doc_id", "item_id"))


def p7_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: leaks.PhraseIndex(table(spark, d, "documents"), s).phrases(table(spark, d, "heldout_items")))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return _finished(spark, lambda s: leaks.PhraseIndex(table(spark, d, "documents"), s).near(table(spark, d, "heldout_items")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "documents"))


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(table(spark, d, "documents"))


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    found = languages.detect(documents, languages.learn(documents))
    return found.select("doc_id", F.posexplode("stretches").alias("stretch", "s")).select("doc_id", "stretch", "s.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_pairs, p3_found, p3_split, p4_found, p4_report, p5_found, p5_parts, p6_found, p6_containers, p6_fill, p7_found, p7_phrases, p7_near, p8_found, p8_labels, p8_stretches)
}

_NOBODY = "(" + ", ".join(f"'{x}'" for x in groups.NOBODY) + ")"
_NAME = r"regexp_replace(trim(regexp_replace(regexp_replace(trim(upper(coalesce(routine, split_part(task_id, '-', 1)))), '^\^\s*', ''), '\.M$', '')), '^_', '%')"
_SPLIT = "CASE WHEN lower(trim(split)) = 'train' THEN 'train' WHEN lower(trim(split)) IN ('val', 'valid', 'validation') THEN 'validation' WHEN lower(trim(split)) = 'test' THEN 'test' END"
_WORDS = r"regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{L}\p{N}]+')"

SQL: dict[str, str] = {
    "p3_found": rf"""WITH RECURSIVE raw AS (SELECT DISTINCT task_no, {_NAME} AS name, trim(regexp_replace(lower(trim(author)), '^@\s*', '')) AS who FROM mutation_tasks WHERE task_no IS NOT NULL),
        t AS (SELECT task_no, name, CASE WHEN who NOT IN {_NOBODY} AND regexp_matches(who, '[\p{{L}}\p{{N}}]') THEN who END AS who FROM raw),
        e AS (SELECT DISTINCT a.name AS a, b.name AS b FROM t a JOIN t b ON a.who = b.who),
        walk AS (SELECT DISTINCT name, name AS seen FROM t UNION SELECT walk.name, e.b FROM walk JOIN e ON walk.seen = e.a),
        u AS (SELECT name, min(seen) AS unit_key FROM walk GROUP BY 1) SELECT DISTINCT task_no, unit_key FROM t JOIN u USING (name)""",
    "p4_found": rf"""WITH r AS (SELECT DISTINCT 'task' AS kind, task_no AS k, {_SPLIT} AS sp, baseline_src AS text FROM mutation_tasks
          UNION SELECT 'sft', example_id, {_SPLIT}, array_to_string(list_transform(list_filter(messages, lambda m: lower(trim(coalesce(m.role, ''))) <> 'system'), lambda m: coalesce(m.content, '')), chr(10)) FROM sft_examples),
        w AS (SELECT kind, k, sp = 'train' AS t, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM r WHERE sp IS NOT NULL AND text IS NOT NULL AND k IS NOT NULL),
        g AS (SELECT DISTINCT kind, k, t, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM w WHERE len(w) > 2),
        n AS (SELECT kind, k, count(*) AS n FROM g GROUP BY 1, 2),
        p AS (SELECT a.kind, a.k AS x, b.k AS y, count(*) AS c FROM g a JOIN g b ON a.kind = b.kind AND a.g = b.g AND a.t AND NOT b.t GROUP BY 1, 2, 3)
        SELECT p.kind, least(x, y) AS key_a, greatest(x, y) AS key_b FROM p JOIN n a ON a.kind = p.kind AND a.k = x JOIN n b ON b.kind = p.kind AND b.k = y WHERE 10 * c >= 7 * (a.n + b.n - c)""",
    "p5_found": rf"""WITH t AS (SELECT DISTINCT {_NAME} AS name, baseline_src AS s FROM mutation_tasks WHERE length(baseline_src) >= 160),
        u AS (SELECT DISTINCT s FROM t), g AS (SELECT s, md5(substring(s, i, 160)) AS g FROM (SELECT s, unnest(range(1, length(s) - 158)) AS i FROM u)),
        x AS (SELECT g FROM g GROUP BY 1 HAVING count(DISTINCT s) > 1), q AS (SELECT DISTINCT name, g FROM g JOIN x USING (g) JOIN t USING (s)),
        same AS (SELECT DISTINCT a.name AS a, b.name AS b FROM t a JOIN t b ON a.s = b.s AND a.name < b.name)
        SELECT DISTINCT a.name AS name_a, b.name AS name_b FROM q a JOIN q b ON a.g = b.g AND a.name < b.name UNION SELECT a, b FROM same""",
    "p6_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 2048",
    "p7_found": rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM heldout_items),
        dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
        ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k : k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
