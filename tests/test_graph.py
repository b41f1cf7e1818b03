"""Graphs, joins with hot keys, splits and spans against plain Python."""

from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.operators import graph, lineage, ranking, skew, spans
from loomwork.sources.scratch import Scratch


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, w in pairs:
        find(("n", n))
        if w is not None:
            parent[find(("n", n))] = find(("w", w))
    least = {}
    for n, _ in pairs:
        r = find(("n", n))
        least[r] = min(least.get(r, n), n)
    return {n: least[find(("n", n))] for n, _ in pairs}


def test_components_of_chains_stars_and_nulls(spark):
    rng = random.Random(3)
    pairs = [(f"c{i:03}", f"l{i}") for i in range(60)] + [(f"c{i + 1:03}", f"l{i}") for i in range(60)]  # one chain
    pairs += [("hub", f"s{i}") for i in range(30)] + [(f"leaf{i}", f"s{i}") for i in range(30)]
    pairs += [(f"x{rng.randrange(80)}", f"y{rng.randrange(90)}") for _ in range(90)] + [("alone", None)]
    got = graph.components(spark.createDataFrame(pairs, "name string, who string"), Scratch(spark))
    assert {r["name"]: r["unit"] for r in got.collect()} == union_find(pairs)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "name string, who string"), Scratch(spark)).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.one_of(st.none(), st.sampled_from("uvwxyz"))), min_size=1, max_size=14))
def test_components_of_any_pairs(spark, pairs):
    got = graph.components(spark.createDataFrame(pairs, "name string, who string"), Scratch(spark))
    assert {r["name"]: r["unit"] for r in got.collect()} == union_find(pairs)


def test_skew_join_equals_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    big = big.unionByName(spark.createDataFrame([(None, 7)], big.schema))
    small = spark.createDataFrame([(i, i * 10) for i in range(40)] + [(1, 11), (None, 0)], "k bigint, w bigint")
    hot = skew.hot_keys(big, ["k"], share=10, least=100)
    assert [h[0] for h in hot] == [1]
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(repr, skew.skew_join(big, small, ["k"], how, hot=hot).collect()))
        assert a == sorted(map(repr, big.join(small, ["k"], how).collect())), how


def test_ranked_covers_every_rank(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    got = skew.ranked(df, ["g"], ["x"], "r").groupBy("g").agg(F.min("r"), F.max("r"), F.countDistinct("r")).collect()
    assert all(tuple(r)[1:] == (1, 250, 250) for r in got)


def test_reach_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 2)], "caller bigint, callee bigint")
    assert {(r["caller"], r["reached"], r["capped"]) for r in graph.reach(e, 2, 1).collect()} == {(1, 2, True), (2, 3, True), (3, 4, True), (4, 1, False)}
    assert {tuple(r) for r in graph.bfs(e, 1, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_quota_split_skips_what_does_not_fit(spark):
    sizes = {"a": 3, "b": 4, "c": 2, "d": 1, "e": 9, "f": 1}
    rows = [(u, f"{u}{i}") for u, n in sizes.items() for i in range(n)]
    got = {r["unit_key"]: r["side"] for r in lineage.quota_split(spark.createDataFrame(rows, "unit_key string, name string"), 0.3, 7).collect()}
    from hashlib import sha256

    left, want = 6, {}
    for u in sorted(sizes, key=lambda u: sha256(f"7|{u}".encode()).hexdigest()):
        want[u] = "eval" if sizes[u] <= left else "train"
        left -= sizes[u] if want[u] == "eval" else 0
    assert got == want


def test_units_never_straddle(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "name string")
    members = spark.createDataFrame([("a", "k"), ("b", "k"), ("z", "q"), ("c", "q")], "name string, cluster string")
    assert {tuple(r) for r in lineage.units(names, members).collect()} == {("a", "a", True), ("b", "a", True), ("c", "c", False)}


def test_spans(spark):
    s = spark.createDataFrame([("f", "A", 2, 4, 1), ("f", "B", 5, 9, 0)], "k string, label string, lo int, hi int, arity int")
    p = spark.createDataFrame([("f", 1), ("f", 3), ("f", 5), ("g", 5)], "k string, at int")
    assert {tuple(r) for r in spans.containing(p, s, "k").collect()} == {("f", 1, None), ("f", 3, "A"), ("f", 5, "B"), ("g", 5, None)}
    assert {tuple(r) for r in spans.as_of(p, s, "k", F.col("arity") > 0).collect()} == {("f", 1, None), ("f", 3, "A"), ("f", 5, "A"), ("g", 5, None)}


def test_global_rank_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 5.0), ("d", None)], "name string, score double").where("score IS NOT NULL")
    assert {(r["name"], r["rank"]) for r in ranking.global_rank(df).collect()} == {("c", 1), ("a", 2), ("b", 3)}


def test_components_with_hot_authors(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 5)
    monkeypatch.setattr(skew, "HOT_SHARE", 20)
    rng = random.Random(8)
    pairs = [(f"n{i:03}", "everyone") for i in range(0, 200, 2)] + [(f"n{rng.randrange(200):03}", f"w{rng.randrange(150)}") for _ in range(120)]
    got = graph.components(spark.createDataFrame(pairs, "name string, who string"), Scratch(spark))
    assert {r["name"]: r["unit"] for r in got.collect()} == union_find(pairs)


def test_running_total_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(f"k{i:04}", rng.choice([None, 0, 1, 5])) for i in range(1500)]
    got = skew.running_total(spark.createDataFrame(rows, "k string, v int").repartition(7), ["k"], F.col("v"), "run", Scratch(spark)).collect()
    total, want = 0, {}
    for k, v in sorted(rows):
        total += v or 0
        want[k] = total
    assert {r["k"]: r["run"] for r in got} == want


def alike(sets, least=8, threshold=0.6):
    """Brute force over {name: set of lines}."""
    kept = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a, b): len(kept[a] & kept[b]) for a in kept for b in kept if a < b and len(kept[a] & kept[b]) / len(kept[a] | kept[b]) >= threshold}


def shingle_rows(spark, sets):
    return spark.createDataFrame([(k, x) for k, v in sets.items() for x in sorted(v)], "name string, line string").repartition(3)


def many_copies():
    """40 routines of one source, 30 more that differ in a line, and two alike by short lines alone."""
    rng = random.Random(5)
    text = {f"S ^A({i})=$$LONG^ROUTINE({i},X,Y)" for i in range(12)}
    sets = {f"c{i:02}": set(text) for i in range(40)} | {f"d{i:02}": text | {f"W {i}"} for i in range(30)}
    sets |= {"s1": {f"K A{i}" for i in range(9)}, "s2": {f"K A{i}" for i in range(1, 10)}, "few": set(sorted(text)[:7])}
    return sets | {f"r{i:02}": {f"S X={rng.randrange(14)}" for _ in range(14)} for i in range(40)}


def test_pairs_of_lines_that_many_or_short_ones_share(spark):
    sets = many_copies()
    got = {(r["a"], r["b"]): r["shared"] for r in lineage.line_pairs(shingle_rows(spark, sets)).collect()}
    assert got == alike(sets) and ("c00", "c39") in got and ("c39", "d00") in got and ("s1", "s2") in got


def test_copies_never_straddle_the_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 5)
    monkeypatch.setattr(skew, "HOT_SHARE", 20)
    sets = many_copies()
    rows = shingle_rows(spark, sets)
    want = union_find([(n, pair) for pair in alike(sets) for n in pair])
    members = lineage.clusters(lineage.line_links(rows))
    assert {r["name"]: r["cluster"] for r in members.collect()} == want
    got = {(r["a"], r["b"]): r["shared"] for r in lineage.line_pairs(rows).collect()}
    assert got == alike(sets)
    of = lineage.units(rows.select("name"), members)
    side = {r["unit_key"]: r["side"] for r in lineage.quota_split(of, 0.5, 3).collect()}
    assert len({side[r["unit_key"]] for r in of.collect() if r["name"][0] in "cd"}) == 1
