"""Problems 3 to 5: grouped splits, near copies across splits, long shared spans."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.llm import groups, near_copies, shared_spans

TASKS = "task_no bigint, task_id string, routine string, baseline_src string, author string, origin string, split string, received_at timestamp, cid string, size int"


def tasks(spark, *rows):
    full = [(n, f"{(r or 'N').strip()}-OP-L{n}-x", r, src, a, "o", sp, None, "clash", 1) for n, r, src, a, sp in rows]
    return spark.createDataFrame(full, TASKS)


def test_names_and_nobody(spark):
    df = spark.createDataFrame([(" ^lrk.m ", None), ("_dt", "@ Jo "), (None, "N/A"), ("", " "), ("x", "TBD"), ("y", "@jo")], "routine string, author string").withColumn("task_id", F.lit("ABC-1"))
    got = [tuple(r) for r in df.select(groups.routine_name(F.col("routine"), F.col("task_id")), groups.author_name(F.col("author"))).collect()]
    assert got == [("LRK", None), ("%DT", "jo"), ("ABC", None), ("", None), ("X", None), ("Y", "jo")]


def test_units_chain_through_authors_and_stay_whole(spark):
    rows = [(1, "B", "", "jo", "train"), (1, "B", "", "jo", "train"), (2, "A", "", " @JO", "train"), (3, "C", "", None, None), (4, "^c.M", "", "unknown", None), (5, None, "", "anonymous", None), (None, "Z", "", "jo", None)]
    got = {r["task_no"]: r for r in groups.grouped_split(tasks(spark, *rows)).collect()}
    assert {n: r["unit_key"] for n, r in got.items()} == {1: "A", 2: "A", 3: "C", 4: "C", 5: "N"}
    assert groups.grouped_split(tasks(spark, *rows).limit(0)).count() == 0


def test_a_delivery_without_author_hides_no_link(spark):
    rows = [(1, "A", "", None, None), (1, "A", "", "jo", None), (2, "B", "", "Jo", None), (3, "C", "", None, None), (3, "D", "", None, None), (4, "D", "", None, None)]
    got = sorted((r["task_no"], r["unit_key"]) for r in groups.grouped_split(tasks(spark, *rows)).collect())
    assert got == [(1, "A"), (2, "A"), (3, "C"), (4, "C")]


def test_splits_come_close_and_a_hot_unit_stays_whole(spark):
    rng = random.Random(5)
    rows = [(i, "HOT" if i < 100 else f"R{rng.randrange(90)}", "", f"a{rng.randrange(4000)}", None) for i in range(300)]
    got = groups.grouped_split(tasks(spark, *rows)).toPandas()
    assert len(got) == 300 and got.groupby("unit_key").split.nunique().max() == 1
    sizes = got.split.value_counts()
    assert abs(sizes["train"] - 240) <= 3 and abs(sizes["test"] - 30) <= 3


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), max_size=5), st.integers(0, 60))
def test_closest_subset_is_closest(sizes, target):
    chosen = groups.closest_subset(sizes.items(), target)
    assert all(chosen[s] <= sizes[s] for s in chosen)
    total = sum(s * m for s, m in chosen.items())
    reach = {0}
    for s, m in sizes.items():
        reach = {r + s * k for r in reach for k in range(m + 1)}
    assert abs(total - target) == min(abs(r - target) for r in reach)


def triples(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return frozenset(zip(w, w[1:], w[2:]))


def expected(rows):
    want = set()
    for k, s, t in rows:
        for k2, s2, t2 in rows:
            if s in ("test", "validation") and s2 == "train":
                a, b = triples(t), triples(t2)
                if a and b and 10 * len(a & b) >= 7 * len(a | b):
                    want.add((k, k2))
    return want


def found(spark, rows, **kw):
    df = spark.createDataFrame([("task", k, s, "o", None, t) for k, s, t in rows], "kind string, key bigint, split string, source string, arrived timestamp, text string")
    got = near_copies.cross_split_pairs(df, **kw).collect()
    assert len({(r["key_e"], r["key_t"]) for r in got}) == len(got)
    return {(r["key_e"], r["key_t"]) for r in got}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["the", "of"] * 5
    rows, key = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 60))]
        for _ in range(rng.randrange(1, 5)):
            t = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.06, 0.1]) else w for w in base]
            key += 1
            rows.append((key, rng.choice(["train", "test", "validation"]), "  ".join(t).upper()))
    rows += [(900, "train", ""), (901, "test", ""), (902, "train", "a b"), (903, "test", "a b")]
    rows += [(1000 + i, "train" if i % 2 else "test", "one and the same boilerplate text over and over again") for i in range(40)]
    want = expected(rows)
    assert len(want) > 400 and found(spark, rows) == want


def test_near_copies_of_nothing_and_of_nulls(spark):
    assert found(spark, []) == set()
    t = tasks(spark, (1, "A", "one two three four", "x", " TRAIN"), (2, "A", "One, two\r\nthree four", "x", "val"), (3, "A", None, "x", "test"), (4, "A", "one two three four", "x", None), (2, "A", "One, two\r\nthree four", "x", "val"))
    chats = spark.createDataFrame([(1, None, "s", "train", [("system", "ignore"), ("user", "a b c d"), (None, None)], None), (2, None, None, "test", [("user", "a b"), ("assistant", "c d")], None), (3, None, "s", "test", None, None)], "example_id bigint, routine string, source string, split string, messages array<struct<role:string,content:string>>, received_at timestamp")
    recs = near_copies.task_records(t).unionByName(near_copies.chat_records(chats))
    pairs = near_copies.cross_split_pairs(recs)
    assert {(r["kind"], r["key_e"], r["key_t"]) for r in pairs.collect()} == {("task", 2, 1), ("sft", 2, 1)}
    assert {(r["kind"], r["split"], r["records"]) for r in near_copies.overlap_report(recs).collect()} == {("task", "validation", 1), ("sft", "test", 1)}


def shared(rows, length):
    want = set()
    for a, x in rows:
        for b, y in rows:
            if a < b and any(x[i : i + length] in y for i in range(len(x) - length + 1)):
                want.add((a, b))
    return want


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdé \n😀") for _ in range(n))
    blocks = [text(n) for n in (159, 160, 161, 200, 400)]
    rows = [(f"R{i:02}", text(rng.randrange(300)) + rng.choice(blocks) + text(rng.randrange(300)) + rng.choice([*blocks, ""])) for i in range(40)]
    rows += [("RUN1", "=" * 500), ("RUN2", "x" + "=" * 159 + "y"), ("RUN3", "=" * 160), ("SAME1", rows[0][1]), ("SHORT", "abc")]
    df = tasks(spark, *[(i, n, t, None, None) for i, (n, t) in enumerate(rows)], (999, "NUL", None, None, None))
    got = {tuple(r) for r in shared_spans.sharing_routines(df).collect()}
    assert got == shared(rows, 160)
    parts = {r["name"]: r for r in shared_spans.shared_parts(df).collect()}
    assert parts["SAME1"]["share"] == 1.0 and parts["RUN3"]["share"] == 1.0 and "SHORT" not in parts
    assert shared_spans.sharing_routines(df.limit(0)).count() == 0


def test_anchors_of_a_long_text_do_not_depend_on_its_pieces(monkeypatch):
    rng = random.Random(4)
    x = shared_spans.characters("".join(rng.choice("ab ") for _ in range(5000)))
    whole = shared_spans._long(1, x, 160, 32)
    monkeypatch.setattr(shared_spans, "PIECE", 700)
    pieces = shared_spans._long(1, x, 160, 32)
    assert whole[1].tolist() == pieces[1].tolist() and whole[2].tolist() == pieces[2].tolist()


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 1000))
def test_shorter_spans(spark, seed):
    rng = random.Random(seed)
    common = "".join(rng.choice("xyz") for _ in range(60))
    rows = [(f"R{i}", "".join(rng.choice("abc") for _ in range(50)) + common[rng.randrange(20) :] + "".join(rng.choice("abc") for _ in range(40))) for i in range(8)]
    df = tasks(spark, *[(i, n, t, None, None) for i, (n, t) in enumerate(rows)])
    assert {tuple(r) for r in shared_spans.sharing_routines(df, length=50, window=16).collect()} == shared(rows, 50)


def test_hot_keys_change_no_result(spark, monkeypatch):
    from loomwork.operators import skew

    monkeypatch.setattr(skew, "HOT_LEAST", 4)
    monkeypatch.setattr(skew, "HOT_SHARE", 30)
    monkeypatch.setattr(shared_spans, "HOT_LEAST", 4)
    monkeypatch.setattr(shared_spans, "HOT_SHARE", 30)
    text = "one and the same boilerplate text over and over again in a third of all records "
    rows = [(i, "train" if i % 3 else "test", text if i % 2 else f"{text} {i} other words {i * 7} follow here {i * 3}") for i in range(60)]
    rows += [(100 + i, "train" if i % 2 else "validation", " ".join(f"x{i * j % 17}" for j in range(20))) for i in range(20)]
    assert found(spark, rows) == expected(rows)
    spans = [(f"R{i}", (f"{i}" * 30 if i % 4 else "") + text * 3 + f"{i * i}" * 9) for i in range(30)] + [("X", "y" * 300)]
    df = tasks(spark, *[(i, n, t, None, None) for i, (n, t) in enumerate(spans)])
    assert {tuple(r) for r in shared_spans.sharing_routines(df).collect()} == shared(spans, 160)


def test_long_sets_have_wide_fingerprints_and_lose_no_pair(spark):
    rng = random.Random(8)
    rows = []
    for i in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(230, 1200))]
        for k in range(6):
            rate = rng.choice([0.002, 0.01, 0.02, 0.03])
            rows.append((i * 10 + k, "train" if k % 2 else "test", " ".join(f"x{rng.randrange(9999)}" if rng.random() < rate else w for w in base[: rng.randrange(int(len(base) * 0.85), len(base) + 1)])))
    want = expected(rows)
    assert len(want) > 15 and found(spark, rows) == want


def test_equal_segments_of_a_similarity_hash_miss_pairs():
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(f"x{rng.randrange(99)}" if rng.random() < 0.05 else w for w in base) for _ in range(60)]
    recall, _ = near_copies.segment_recall(texts[:30], texts[30:], 4)
    assert recall < 0.9


def covered(rows, length):
    """Per name its characters and those within a span that another name holds, over different texts."""
    texts = sorted(set(rows))
    out = {}
    for n, x in texts:
        if len(x) < length:
            continue
        other = [y for m, y in texts if m != n]
        hit = [False] * len(x)
        for i in range(len(x) - length + 1):
            if any(x[i : i + length] in y for y in other):
                hit[i : i + length] = [True] * length
        a, b = out.get(n, (0, 0))
        out[n] = (a + len(x), b + sum(hit))
    return out


@pytest.mark.parametrize("seed", [0, 5])
def test_periods_runs_and_shifted_copies(spark, seed):
    """Periodic texts, runs, copies that begin and end anywhere, and one text of several routines: pairs and parts are exact."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    base = noise(220)
    rows = []
    for i in range(14):
        kind = rng.randrange(4)
        if kind == 0:
            body = (rng.choice(["ab", "abc", "x", "hello ", "0123456789abcdef0123456789abcdef"]) * 200)[rng.randrange(6) :][: rng.randrange(40, 260)]
        elif kind == 1:
            a = rng.randrange(150)
            body = base[a : a + rng.randrange(40, 120)]
        elif kind == 2:
            body = base[: rng.randrange(40, 220)] + "=" * rng.randrange(90) + base[100 : 100 + rng.randrange(100)]
        else:
            body = rows[rng.randrange(len(rows))][1] if rows else noise(90)
        rows.append((f"R{i % 11:02}", noise(rng.randrange(30)) * rng.randrange(2) + body + noise(rng.randrange(30)) * rng.randrange(2)))
    df = tasks(spark, *[(i, n, t, None, None) for i, (n, t) in enumerate(rows)])
    want = {(a, b) for a, x in rows for b, y in rows if a < b and any(x[i : i + 60] in y for i in range(len(x) - 59))}
    assert {tuple(r) for r in shared_spans.sharing_routines(df, length=60, window=16).collect()} == want
    parts = {r["name"]: (r["chars"], r["shared_chars"]) for r in shared_spans.shared_parts(df, length=60, window=16).collect()}
    assert parts == covered(rows, 60)
