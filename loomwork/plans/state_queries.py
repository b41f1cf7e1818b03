"""State comparison and change plans over two snapshots derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statediff as sd
from ..sources.tables import table


def _state(s, d, gap: int, cut: int | None = None):
    o = table(s, d, "orders").where(F.col("o_orderkey") % gap != 0)
    status = F.when(F.col("o_orderkey") % cut == 0, "").otherwise(F.col("o_orderstatus")) if cut else F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("ref"), F.concat(status, F.lit("^"), "o_orderpriority").alias("value"))


def _plan(s, d, stale: bool):
    o = table(s, d, "orders")
    now = F.concat("o_orderstatus", F.lit("^"), "o_orderpriority")
    before = F.when(F.col("o_orderkey") % 101 == 0, F.lit(None)).otherwise(now)
    if stale:
        before = F.when(F.col("o_orderkey") % 7 == 0, "stale").otherwise(now)
    return o.select(F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderkey") % 2 == 0, "kill").otherwise("set").alias("op"), before.alias("before_value"), F.when(F.col("o_orderkey") % 2 == 1, "X^new").alias("value"))


def _diff(s, d):
    return sd.state_diff(_state(s, d, 101), _state(s, d, 97, 53), ["ref"])


def _verdict(s, d):
    cases = table(s, d, "orders").select((F.col("o_orderkey") % 50).alias("case_index")).distinct().withColumn("void", F.col("case_index") == 3)
    return sd.verdict(cases, _diff(s, d).select((F.col("ref") % 50).alias("case_index")))


def _rolled_back(s, d):
    plan, state = _plan(s, d, False), _state(s, d, 101)
    return sd.apply_plan(sd.inverse(plan), sd.apply_plan(plan, state))


def _upsert(s, d):
    rows = table(s, d, "attempts").select("model", "run_id", "received_at", "seed")
    old, new = rows.where("run_id LIKE '%0000'"), rows.where("run_id NOT LIKE '%0000'")
    return sd.upsert(old, new, F.upper("model"), "received_at").groupBy(F.upper("model").alias("model")).agg(F.unix_micros(F.max("received_at")).alias("received_us"))


QUERIES = {
    "state_diff": _diff,
    "state_diff_rollup": lambda s, d: sd.diff_rollup(_diff(s, d), F.col("ref") % 50),
    "verify_rollup": _verdict,
    "piece_diff": lambda s, d: sd.piece_diff(_diff(s, d), ["ref"]),
    "plan_preview": lambda s, d: sd.preview(_plan(s, d, True), _state(s, d, 101)),
    "plan_ready": lambda s, d: sd.ready(_plan(s, d, True), _state(s, d, 101)).unionByName(sd.ready(_plan(s, d, False), _state(s, d, 101))),
    "plan_apply": lambda s, d: sd.apply_plan(_plan(s, d, False), _state(s, d, 101)),
    "plan_apply_conflict": lambda s, d: sd.apply_plan(_plan(s, d, True), _state(s, d, 101)),
    "plan_rollback": _rolled_back,
    "upsert_requests": _upsert,
}

_V = """base AS (SELECT o_orderkey AS ref, concat(o_orderstatus, '^', o_orderpriority) AS value FROM orders WHERE o_orderkey % 101 <> 0),
    cand AS (SELECT o_orderkey AS ref, concat(CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE o_orderstatus END, '^', o_orderpriority) AS value FROM orders WHERE o_orderkey % 97 <> 0),
    diff AS (SELECT coalesce(b.ref, c.ref) AS ref, CASE WHEN c.ref IS NULL THEN 'removed' WHEN b.ref IS NULL THEN 'added' ELSE 'changed' END AS kind, b.value AS expected, c.value AS actual
      FROM base b FULL JOIN cand c ON b.ref = c.ref WHERE b.ref IS NULL OR c.ref IS NULL OR b.value IS DISTINCT FROM c.value),
    stale AS (SELECT o_orderkey AS ref, CASE WHEN o_orderkey % 2 = 0 THEN 'kill' ELSE 'set' END AS op, CASE WHEN o_orderkey % 7 = 0 THEN 'stale' ELSE concat(o_orderstatus, '^', o_orderpriority) END AS before_value, CASE WHEN o_orderkey % 2 = 1 THEN 'X^new' END AS value FROM orders),
    good AS (SELECT o_orderkey AS ref, CASE WHEN o_orderkey % 2 = 0 THEN 'kill' ELSE 'set' END AS op, CASE WHEN o_orderkey % 101 <> 0 THEN concat(o_orderstatus, '^', o_orderpriority) END AS before_value, CASE WHEN o_orderkey % 2 = 1 THEN 'X^new' END AS value FROM orders)"""


def _preview(plan: str) -> str:
    return f"SELECT p.ref, p.op, p.before_value, b.value AS current, b.ref IS NOT NULL AS present, CASE WHEN p.before_value IS NULL THEN b.ref IS NULL ELSE b.ref IS NOT NULL AND p.before_value IS NOT DISTINCT FROM b.value END AS matches FROM {plan} p LEFT JOIN base b ON p.ref = b.ref"


def _ready(plan: str) -> str:
    return f"SELECT count(*) AS ops, count(*) FILTER (NOT matches) AS conflicts, (SELECT count(*) FROM (SELECT ref FROM {plan} GROUP BY 1 HAVING count(*) > 1)) AS duplicate_refs, count(*) FILTER (NOT matches) = 0 AND (SELECT count(*) FROM (SELECT ref FROM {plan} GROUP BY 1 HAVING count(*) > 1)) = 0 AS ready FROM ({_preview(plan)})"


SQL = {
    "state_diff": f"WITH {_V} SELECT * FROM diff",
    "state_diff_rollup": f"WITH {_V} SELECT kind, count(*) AS differences, count(DISTINCT ref % 50) AS cases FROM diff GROUP BY 1",
    "verify_rollup": f"""WITH {_V}, c AS (SELECT DISTINCT o_orderkey % 50 AS k FROM orders), h AS (SELECT DISTINCT ref % 50 AS k FROM diff),
        n AS (SELECT count(*) AS n_cases, count(*) FILTER (c.k = 3) AS n_void, count(*) FILTER (h.k IS NOT NULL AND c.k <> 3) AS n_diverged FROM c LEFT JOIN h ON c.k = h.k)
        SELECT n_diverged = 0 AND n_void = 0 AS equivalent, n_cases, n_diverged, n_void FROM n""",
    "piece_diff": f"""WITH {_V}, p AS (SELECT ref, string_split(expected, '^') AS a, string_split(actual, '^') AS b FROM diff WHERE kind = 'changed'), x AS (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS piece FROM p)
        SELECT ref, piece, coalesce(a[piece], '') AS expected, coalesce(b[piece], '') AS actual FROM x WHERE coalesce(a[piece], '') <> coalesce(b[piece], '')""",
    "plan_preview": f"WITH {_V} {_preview('stale')}",
    "plan_ready": f"WITH {_V} {_ready('stale')} UNION ALL {_ready('good')}",
    "plan_apply": f"WITH {_V} SELECT coalesce(b.ref, p.ref) AS ref, CASE WHEN p.op IS NULL THEN b.value ELSE p.value END AS value FROM base b FULL JOIN good p ON b.ref = p.ref WHERE p.op IS NULL OR p.op = 'set'",
    "plan_apply_conflict": f"WITH {_V} SELECT * FROM base",
    "plan_rollback": f"WITH {_V} SELECT * FROM base",
    "upsert_requests": "SELECT upper(model) AS model, epoch_us(max(received_at)) AS received_us FROM attempts GROUP BY 1",
}
