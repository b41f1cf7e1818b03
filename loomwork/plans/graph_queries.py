"""Call graphs over order lines, near-duplicate routines by lines, and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, lineage
from ..sources.scratch import Scratch
from ..sources.tables import table

_EDGES = """edges AS (SELECT DISTINCT caller, callee FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS callee FROM lineitem) e
    WHERE callee IS NOT NULL AND caller <> callee)"""


def _edges(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    e = table(s, d, "lineitem").select(F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(w).alias("callee"))
    return e.where("callee IS NOT NULL AND caller <> callee").select("caller", "callee").distinct()


def _facts(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("what"), (F.col("p_size") > 45).alias("writes"))


def _routines(s, d):
    return table(s, d, "parsed_routines").where("path LIKE '%.m' AND src IS NOT NULL AND file_id IS NOT NULL").groupBy("file_id").agg(F.max("src").alias("source")).select(F.col("file_id").alias("name"), "source")


def _pairs(s, d):
    return lineage.line_pairs(lineage.code_shingles(_routines(s, d)))


def _clusters(s, d):
    return lineage.clusters(lineage.line_links(lineage.code_shingles(_routines(s, d))))


def _units(s, d):
    return lineage.units(_routines(s, d).select(F.col("name").cast("string")), _clusters(s, d))


def _bfs(s, d):
    e = _edges(s, d)
    root = 1
    return graph.bfs(e, root, 4)


QUERIES = {
    "fan_in_out": lambda s, d: graph.fan(_edges(s, d)),
    "reach_2hop": lambda s, d: graph.reach(_edges(s, d), 2, 50),
    "bfs_rooted": _bfs,
    "bfs_edges": lambda s, d: graph.rooted_edges(_edges(s, d), _bfs(s, d), 4),
    "callee_facts": lambda s, d: graph.callee_facts(graph.reach_pairs(_edges(s, d), 2), _facts(s, d)),
    "line_shingles": lambda s, d: lineage.code_shingles(_routines(s, d)).groupBy("name").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")),
    "near_dup_pairs": _pairs,
    "near_dup_clusters": _clusters,
    "split_units": _units,
    "cluster_split": lambda s, d: lineage.quota_split(_units(s, d), 0.3, 20260905, Scratch(s)),
    "leak_check": lambda s, d: lineage.leaked(table(s, d, "sft_examples").where("lower(trim(split)) IN ('test', 'val', 'valid', 'validation')").select(F.col("routine").alias("name")), table(s, d, "sft_examples").where("lower(trim(split)) = 'train'").select(F.col("routine").alias("name"))),
}

_SHINGLES = r"""r AS (SELECT file_id AS name, max(src) AS source FROM parsed_routines WHERE path LIKE '%.m' AND src IS NOT NULL AND file_id IS NOT NULL GROUP BY 1),
    l AS (SELECT name, unnest(regexp_split_to_array(source, '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS raw FROM r),
    m AS (SELECT name, array_to_string(list_transform(string_split(raw, '"'), lambda p, k: CASE WHEN k % 2 = 0 THEN repeat(chr(1), length(p)) ELSE p END), '"') AS m FROM l WHERE regexp_matches(raw, '^[ \t]')),
    c AS (SELECT name, CASE WHEN strpos(m, ';') > 0 THEN m[:strpos(m, ';') - 1] ELSE m END AS m FROM m),
    sh AS (SELECT DISTINCT name, trim(regexp_replace(m, '[ \t]+', ' ', 'g'), ' ') AS line FROM c WHERE trim(regexp_replace(m, '[ \t]+', ' ', 'g'), ' ') <> '')"""
_PAIRS = (
    _SHINGLES
    + """,
    n AS (SELECT name, count(*) AS n FROM sh GROUP BY 1 HAVING count(*) >= 8), k AS (SELECT name, line, n FROM sh JOIN n USING (name)),
    o AS (SELECT line FROM k WHERE length(line) > 25 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25), q AS (SELECT line, name FROM k WHERE length(line) > 25 AND line IN (SELECT line FROM o)),
    cand AS (SELECT DISTINCT x.name AS a, y.name AS b FROM q x JOIN q y ON x.line = y.line AND x.name < y.name),
    sim AS (SELECT a, b, count(*) AS shared, any_value(x.n) AS na, any_value(y.n) AS nb FROM cand JOIN k x ON x.name = a JOIN k y ON y.name = b AND y.line = x.line GROUP BY 1, 2),
    pairs AS (SELECT a, b, CAST(shared AS INTEGER) AS shared, round(shared / (na + nb - shared), 6) AS similarity FROM sim WHERE shared / (na + nb - shared) >= 0.6)"""
)
_CLUSTERS = (
    _PAIRS
    + """,
    und AS (SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b FROM pairs UNION SELECT CAST(b AS VARCHAR), CAST(a AS VARCHAR) FROM pairs),
    walk AS (SELECT a AS name, a AS seen FROM und UNION SELECT walk.name, und.b FROM walk JOIN und ON walk.seen = und.a),
    clusters AS (SELECT name, min(seen) AS cluster FROM walk GROUP BY 1)"""
)
_UNITS = _CLUSTERS + ", units AS (SELECT CAST(r.name AS VARCHAR) AS name, coalesce(cluster, CAST(r.name AS VARCHAR)) AS unit_key, cluster IS NOT NULL AS is_cluster FROM r LEFT JOIN clusters c ON CAST(r.name AS VARCHAR) = c.name)"

SQL = {
    "fan_in_out": f"WITH {_EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT caller AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT callee, 1, 0 FROM edges) GROUP BY 1",
    "reach_2hop": f"""WITH {_EDGES}, p1 AS (SELECT caller, callee AS node FROM edges), p2 AS (SELECT DISTINCT p1.caller, e.callee AS node FROM p1 JOIN edges e ON e.caller = p1.node),
        a AS (SELECT * FROM p1 UNION SELECT * FROM p2) SELECT caller, count(DISTINCT node) AS reached, count(DISTINCT node) > 50 AS capped FROM a WHERE caller <> node GROUP BY 1""",
    "bfs_rooted": f"WITH RECURSIVE {_EDGES}, w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.callee, depth + 1 FROM w JOIN edges e ON e.caller = w.node WHERE depth < 4) SELECT node, min(depth) AS depth FROM w GROUP BY 1",
    "bfs_edges": f"""WITH RECURSIVE {_EDGES}, w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.callee, depth + 1 FROM w JOIN edges e ON e.caller = w.node WHERE depth < 4), l AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1)
        SELECT caller, callee, callee IN (SELECT caller FROM edges) AS in_corpus FROM edges WHERE caller IN (SELECT node FROM l WHERE depth < 4)""",
    "callee_facts": f"""WITH {_EDGES}, p AS (SELECT caller, callee AS node, 1 AS depth FROM edges UNION SELECT a.caller, b.callee, 2 FROM edges a JOIN edges b ON a.callee = b.caller), q AS (SELECT caller, node, min(depth) AS depth FROM p WHERE caller <> node GROUP BY 1, 2)
        SELECT caller, count(DISTINCT node) AS callees, count(DISTINCT p_brand) AS touched, coalesce(bool_or(p_size > 45), false) AS any_output, max(depth) AS depth FROM q LEFT JOIN part ON p_partkey = node GROUP BY 1""",
    "line_shingles": f"WITH {_SHINGLES} SELECT name, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM sh GROUP BY 1",
    "near_dup_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "near_dup_clusters": f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM clusters",
    "split_units": f"WITH RECURSIVE {_UNITS} SELECT * FROM units",
    "cluster_split": f"""WITH RECURSIVE {_UNITS}, s AS (SELECT unit_key, count(*) AS size, sha256(concat('20260905|', unit_key)) AS h FROM units GROUP BY 1), od AS (SELECT *, row_number() OVER (ORDER BY h, unit_key) AS i FROM s),
        qt AS (SELECT round_even(count(*) * 0.3, 0) AS quota FROM units), f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, false AS took UNION ALL SELECT od.i, CASE WHEN used + size <= quota THEN used + size ELSE used END, used + size <= quota FROM f JOIN od ON od.i = f.i + 1, qt)
        SELECT unit_key, size, CASE WHEN took THEN 'eval' ELSE 'train' END AS side FROM od JOIN f USING (i)""",
    "leak_check": "SELECT DISTINCT upper(trim(routine)) AS name FROM sft_examples WHERE lower(trim(split)) IN ('test', 'val', 'valid', 'validation') AND upper(trim(routine)) IN (SELECT upper(trim(routine)) FROM sft_examples WHERE lower(trim(split)) = 'train')",
}
