"""Problem 4: the same or nearly the same records across splits.

Records with equal sequences of words form a class; all further work is on classes, memberships stay aside.

1. Every class has a bit fingerprint of at least as many bits as triples, and at least 256: each triple's hash flips
   one bit. Two sets that differ in d triples have fingerprints that differ in at most d bits, so "within the Hamming
   radius" never loses a pair. Folding a fingerprint in half gives that of half its width, so any two compare.
2. The codes of a class are permuted into one global order, rarest first, and its leading block of
   n - ceil(t n) + 1 codes are its join keys: two sets of Jaccard similarity t or more share a code of these blocks.
   Codes that do not occur on both sides of the train/evaluation border come first in that order and need no row.
3. Candidates of matching size within the Hamming radius (1 - t) / (1 + t) (a + b) are verified on the sets.

A fixed number of fingerprint segments cannot give this problem's result: at similarity 0.7 a fifth of the bits of a
similarity hash differ, so equal segments are either too short to select or miss pairs (``segment_recall`` measures it;
figures in the README). Hence the permuted blocks, which miss none.

Defined results: records without a split, of fewer than three words or with null text take part in no pair; a message
without role is not a system message; repeated deliveries count once, by their earliest arrival.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import skew_join, written_hot_keys
from ..sources.scratch import Scratch

THRESHOLD = 0.7
WORDS = 3
#: 64-bit words of the narrowest fingerprint.
SLOTS = 4
#: Classes looked at to find codes too frequent for one task, and the share of them that makes a code frequent: a code
#: in 2 % of all classes is missed with a chance under one in a million, so no task holds more of one code.
SAMPLE, FREQUENT = 2000, 0.005
#: Frequent codes that are broadcast, the most frequent first; any further one is treated like the others.
MOST_FREQUENT = 100_000


def split_name(split) -> F.Column:
    bare = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.when(bare == "train", "train").when(bare.isin("validation", "valid", "val"), "validation").when(bare == "test", "test")


def task_records(tasks: DataFrame) -> DataFrame:
    return tasks.select(F.lit("task").alias("kind"), F.col("task_no").alias("key"), split_name(F.col("split")).alias("split"), F.col("origin").alias("source"), F.col("received_at").alias("arrived"), F.col("baseline_src").alias("text"))


def chat_records(examples: DataFrame) -> DataFrame:
    said = F.filter("messages", lambda m: F.lower(F.trim(F.coalesce(m["role"], F.lit("")))) != "system")
    text = F.array_join(F.transform(said, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return examples.select(F.lit("sft").alias("kind"), F.col("example_id").alias("key"), split_name(F.col("split")).alias("split"), "source", F.col("received_at").alias("arrived"), text.alias("text"))


def normal(text) -> F.Column:
    """The words of a text, runs of a-z and 0-9 in lower case, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def triple_codes(norm) -> F.Column:
    """Hashes of the different word sequences of a normal text; null where it is too short for one."""
    long = F.filter(F.array(F.split(norm, " ")), lambda w: F.size(w) >= WORDS)
    sequences = F.transform(long, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[w[i + k] for k in range(WORDS)])))
    return F.array_distinct(F.get(sequences, F.lit(0)))


def fingerprint(codes) -> F.Column:
    """Words of the bit fingerprint: every code flips one bit; as many words as hold a bit per code, a power of two."""
    words = F.call_function("shiftleft", F.lit(SLOTS), F.greatest(F.ceil(F.log2(F.size(codes) / F.lit(64.0 * SLOTS))), F.lit(0)).cast("int"))
    place = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(words - 1)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(F.lit(63)).cast("int"))
    flipped = lambda k: F.aggregate(F.filter(codes, lambda c: place(c) == k), F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseXOR(bit(c)))
    return F.transform(F.sequence(F.lit(0), words - 1), flipped)


def bits_apart(a, b) -> F.Column:
    """Hamming distance of two fingerprints, the wider one folded; sizes of similar sets differ by less than one fold."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    a, b = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def classes_of(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members (kind, key, split, source, cid), classes (cid, t, e, n, codes, fingerprint).

    A class is one sequence of words. t and e say whether a train or an evaluation record has it.
    """
    raw = records.where(F.col("key").isNotNull() & F.col("split").isNotNull() & F.col("text").isNotNull()).withColumn("norm", normal(F.col("text"))).withColumn("tid", F.unhex(F.md5("norm")))
    train = F.col("split") == "train"
    texts = raw.groupBy("kind", "tid").agg(F.first("norm").alias("norm"), F.max(train).alias("t"), F.max(~train).alias("e"))
    coded = texts.select("kind", "tid", "t", "e", triple_codes(F.col("norm")).alias("codes")).where(F.size("codes") > 0)
    classes = scratch.keep(coded.select("kind", "tid", F.monotonically_increasing_id().alias("cid"), "t", "e", F.size("codes").alias("n"), "codes", fingerprint(F.col("codes")).alias("bits")))
    late = F.coalesce(F.col("arrived"), F.lit("9999-01-01").cast("timestamp"))
    chosen = raw.groupBy("kind", "key").agg(F.min(F.struct(late.alias("at"), "split", "source", "tid")).alias("m")).select("kind", "key", "m.split", "m.source", "m.tid")
    written = scratch.keep(chosen)
    placed = scratch.keep(skew_join(written, classes.select("kind", "tid", "cid"), ["kind", "tid"], hot=[h[:2] for h in written_hot_keys(written, ["kind", "tid"])]).drop("tid"))
    scratch.drop(written)
    return placed, classes.drop("kind", "tid")


def _hot(table: DataFrame, key: str) -> list[tuple]:
    """Values of one key of a written table that hold a large share of its rows."""
    return [h[:1] for h in written_hot_keys(table, [key])]


def similar_classes(classes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(cid_e, cid_t, similarity): classes of evaluation and train records with Jaccard similarity at or over ``threshold``."""
    # Join keys are 40 bits of a code, and roles ride on the class id: narrow rows, for all codes pass through one shuffle.
    role = F.col("t").cast("bigint") + F.col("e").cast("bigint") * 2
    rows = classes.select((F.col("cid") * 4 + role).alias("who"), F.explode("codes").alias("code")).select("who", F.shiftrightunsigned("code", 24).alias("key"))
    # The order of keys decides speed only, so a bounded sample may say which are too frequent for one task.
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE)
    frequent = sample.select(F.explode("codes").alias("c")).groupBy(F.shiftrightunsigned("c", 24).alias("key")).agg(F.count("*").alias("often")).where(F.col("often") > SAMPLE * FREQUENT)
    frequent = scratch.keep(frequent.orderBy(F.desc("often"), "key").limit(MOST_FREQUENT))
    rare = rows.join(F.broadcast(frequent), "key", "left_anti")
    has = lambda bit: F.col("who").bitwiseAND(F.lit(bit)) > 0
    # Counts over a window, not an aggregate joined back: all codes pass through one shuffle, and no key is in more than 2 % of the classes.
    same = Window.partitionBy("key")
    both = rare.select("who", "key", F.count_if(has(1)).over(same).alias("ct"), F.count_if(has(2)).over(same).alias("ce")).where((F.col("ct") > 0) & (F.col("ce") > 0))
    # One number orders all keys: the magnitude of the pairs a key would make, then the key.
    weight = F.floor(F.log2(F.col("ct").cast("double") * F.col("ce"))).cast("bigint")
    shifted = lambda x: F.call_function("shiftleft", x.cast("bigint"), F.lit(40))
    weighed = both.select("who", (shifted(weight) + F.col("key")).alias("x"))
    common = rows.join(F.broadcast(frequent), "key").select("who", (shifted(F.lit(1 << 12) + F.col("often")) + F.col("key")).alias("x"))
    ordered = weighed.unionByName(common).groupBy("who").agg(F.array_sort(F.collect_list("x")).alias("alive")).withColumn("cid", F.shiftrightunsigned("who", 2))
    keep = F.greatest(F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("alive")), F.lit(0)).cast("int")
    lead = F.transform(F.slice("alive", 1, keep), lambda x: x.bitwiseAND(F.lit((1 << 40) - 1)))
    blocks = scratch.keep(ordered.join(classes.select("cid", "n", "t", "e"), "cid").select("cid", "n", "t", "e", F.explode(lead).alias("key")))
    of = lambda side, to: blocks.where(side).select("key", F.col("cid").alias("cid" + to), F.col("n").alias("n" + to))
    met = skew_join(of("t", "_t"), of("e", "_e"), ["key"], hot=_hot(blocks, "key"))
    alike_size = F.least("n_e", "n_t") >= F.greatest("n_e", "n_t") * threshold - 1e-9
    joined = scratch.keep(met.where(alike_size).select("cid_e", "cid_t", "n_e", "n_t").distinct())
    shape = lambda to: classes.select(F.col("cid").alias("cid" + to), F.col("bits").alias("bits" + to))
    shaped = skew_join(skew_join(joined, shape("_e"), ["cid_e"], hot=_hot(joined, "cid_e")), shape("_t"), ["cid_t"], hot=_hot(joined, "cid_t"))
    radius = (F.col("n_e") + F.col("n_t")) * (1 - threshold) / (1 + threshold) + 1e-6
    near = scratch.keep(shaped.where(bits_apart(F.col("bits_e"), F.col("bits_t")) <= radius).select("cid_e", "cid_t"))
    scratch.drop(blocks)
    needed = near.select(F.col("cid_e").alias("cid")).union(near.select("cid_t")).distinct()
    sets = classes.join(needed, "cid", "left_semi").select("cid", "codes")
    side = lambda to: sets.select(F.col("cid").alias("cid" + to), F.col("codes").alias("codes" + to))
    pairs = skew_join(skew_join(near, side("_e"), ["cid_e"], hot=_hot(near, "cid_e")), side("_t"), ["cid_t"], hot=_hot(near, "cid_t"))
    shared = F.size(F.array_intersect("codes_e", "codes_t"))
    alike = shared / (F.size("codes_e") + F.size("codes_t") - shared)
    return scratch.keep(pairs.select("cid_e", "cid_t", alike.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12))


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    ev = members.where(F.col("split") != "train").select("kind", F.col("key").alias("key_e"), F.col("split").alias("split_e"), F.col("source").alias("source_e"), F.col("cid").alias("cid_e"))
    return ev, members.where(F.col("split") == "train").select(F.col("key").alias("key_t"), F.col("source").alias("source_t"), F.col("cid").alias("cid_t"))


def cross_split_pairs(records: DataFrame, scratch: Scratch | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, key_e, split_e, source_e, key_t, source_t, similarity) of every evaluation and train record that match."""
    scratch = scratch or Scratch(records.sparkSession)
    members, classes = classes_of(records, scratch)
    pairs = similar_classes(classes, scratch, threshold)
    ev, tr = _sides(members)
    hot = _hot(members, "cid")
    return skew_join(tr, skew_join(ev, pairs, ["cid_e"], hot=hot), ["cid_t"], hot=hot).select("kind", "key_e", "split_e", "source_e", "key_t", "source_t", "similarity")


def overlap_report(records: DataFrame, scratch: Scratch | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per kind, split and source of the evaluation record: records that recur, those exactly, pairs, highest similarity.

    Pairs are counted by classes and their members, never formed.
    """
    scratch = scratch or Scratch(records.sparkSession)
    members, classes = classes_of(records, scratch)
    ev, tr = _sides(members)
    held = tr.groupBy("cid_t").agg(F.count("*").alias("held"))
    similar = similar_classes(classes, scratch, threshold)
    per = skew_join(similar, held, ["cid_t"], hot=_hot(similar, "cid_t")).groupBy("cid_e").agg(F.sum("held").alias("pairs"), F.max("similarity").alias("most"))
    return skew_join(ev, per, ["cid_e"], hot=_hot(members, "cid")).groupBy("kind", F.col("split_e").alias("split"), F.col("source_e").alias("source")).agg(
        F.count("*").alias("records"), F.count_if(F.col("most") >= 1 - 1e-12).alias("exact_records"), F.sum("pairs").alias("pairs"), F.round(F.max("most"), 6).alias("highest_similarity")
    )


def segment_recall(texts_e: list[str], texts_t: list[str], segments: int, threshold: float = THRESHOLD, bits: int = 64) -> tuple[float, float]:
    """(recall, share of all pairs that become candidates) of joining equal ``segments`` of a similarity hash: what the
    plain form of the method would give on these texts, by brute force."""
    from xxhash import xxh64_intdigest

    def shape(text: str):
        w = re.findall("[a-z0-9]+", text.lower())
        codes = {xxh64_intdigest(" ".join(x)) for x in zip(*[w[k:] for k in range(WORDS)])}
        votes = [sum(1 if c >> i & 1 else -1 for c in codes) for i in range(bits)]
        h, width = sum((v > 0) << i for i, v in enumerate(votes)), bits // segments
        return codes, [h >> k * width & (1 << width) - 1 for k in range(segments)]

    left, right = [x for x in map(shape, texts_e) if x[0]], [x for x in map(shape, texts_t) if x[0]]
    alike = met = both = 0
    for a, ha in left:
        for b, hb in right:
            same = any(p == q for p, q in zip(ha, hb))
            met += same
            if a != b and len(a & b) >= threshold * len(a | b):
                alike += 1
                both += same
    return (both / alike if alike else 1.0), met / max(1, len(left) * len(right))
