"""Problem 5: long exact spans shared between records.

Tokens are characters, for spans are measured in them and may begin inside a word. Every text becomes a sequence of
k-mers of K = length - w + 1 tokens, one for each anchor (the least 16-gram hash of every window of w). A shared span of
``length`` tokens holds one whole window at its start, so the anchor of that window, and its whole k-mer, lie in the
span in both texts: no span is missed.

k-mers that only one routine has are dropped. The others are the edges of a de Bruijn graph: two that follow each other
in a text meet in a node, their overlap. Where every occurrence enters a node by one edge and leaves it by one, the two
are one path; pointer doubling in Spark joins compacts paths to (first k-mer, offset). So all texts on a path run
through the whole of it, and one row per text and path stands for all its spans.

The source coordinates of these rows then go back to the texts: a path of ``length`` tokens or more is digested as it
stands there, and at its ends, where a shared span may reach beyond it, every span of ``length`` tokens that begins at
most w - 1 tokens before one of its k-mers. Equal digests (128 bits of the very characters) are shared spans; no two
texts are ever compared, and routines are paired once per set of texts that hold a span.

Defined results: null texts and texts shorter than ``length`` share nothing; equal texts of two routines share all.
Texts are told apart by 128-bit digests. A text of any length is read in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import HOT_LEAST, HOT_SHARE, skew_join, written_hot_keys
from ..sources.scratch import Scratch
from .groups import routine_name

LENGTH = 160
WINDOW = 32
GRAM = 16
PIECE = 1_000_000
#: Neighbouring k-mers of a text that one task orders; a path does not run on from one stretch to the next.
STRETCH = 1 << 16
#: Stands for the routine of a text that several routines have.
SEVERAL = 0


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Grams:
    """Hashes of all n-grams of an array of characters, from those of lengths that are powers of two."""

    def __init__(self, x: np.ndarray, seed: int = 0x9E3779B97F4A7C15):
        self.powers = [_mix(x.astype(np.uint64) + np.uint64(seed))]

    def _power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            half = 1 << (len(self.powers) - 1)
            p = self.powers[-1]
            self.powers.append(_mix(p[:-half] * np.uint64(0x9E3779B97F4A7C15) + p[half:]) if len(p) > half else p[:0])
        return self.powers[k]

    def of(self, n: int) -> np.ndarray:
        count = max(0, len(self.powers[0]) - n + 1)
        out, off = None, 0
        for k in range(n.bit_length() - 1, -1, -1):
            if n >> k & 1:
                part = self._power(k)[off : off + count]
                out = part if out is None else _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + part)
                off += 1 << k
        return out


def _sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w successive values."""
    out, have = a, 1
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(a) - w + 1], out[w - have : w - have + len(a) - w + 1]) if have < w else out


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _anchors(x: np.ndarray, bounds: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and their k-mers in ``x``, the pieces between ``bounds`` laid end to end."""
    k = length - window + 1
    grams = Grams(x)
    h = grams.of(GRAM)
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    least = _sliding(h, window, np.minimum)
    starts = np.arange(len(least))
    least = np.where(starts + window + GRAM - 1 <= ends[: len(least)], least, np.uint64(0))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    chosen = _sliding(padded, window, np.maximum)[: len(h)] == h
    kmers = grams.of(k)
    at = np.flatnonzero(chosen[: len(kmers)])
    at = at[at + k <= ends[at]]
    return at, kmers[at]


def _kmers(length: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            group: list[tuple[int, np.ndarray]] = []
            size = 0
            of = b.set_index("cid")["nid"]
            for cid, text in zip(b["cid"], b["text"]):
                x = characters(text)
                if len(x) > PIECE:
                    yield _rows(_long(cid, x, length, window), of)
                    continue
                group.append((cid, x))
                size += len(x)
                if size >= PIECE:
                    yield _rows(_many(group, length, window), of)
                    group, size = [], 0
            if group:
                yield _rows(_many(group, length, window), of)

    return run


def _many(group, length, window):
    bounds = np.concatenate([[0], np.cumsum([len(x) for _, x in group])])
    at, codes = _anchors(np.concatenate([x for _, x in group]), bounds, length, window)
    which = np.searchsorted(bounds, at, side="right") - 1
    return np.array([c for c, _ in group], dtype=np.int64)[which], at - bounds[which], codes


def _long(cid, x, length, window):
    overlap = length + window + GRAM
    found: dict[int, int] = {}
    for s in range(0, len(x), PIECE - overlap):
        piece = x[s : s + PIECE]
        at, codes = _anchors(piece, np.array([0, len(piece)]), length, window)
        found.update(zip((at + s).tolist(), codes.tolist()))
    at = np.array(sorted(found), dtype=np.int64)
    return np.full(len(at), cid, dtype=np.int64), at, np.array([found[i] for i in at.tolist()], dtype=np.uint64)


def _rows(found, of: pd.Series) -> pd.DataFrame:
    """Rows of one group; a k-mer that repeats at once (a run of one character) counts once."""
    cid, at, codes = found
    new = np.ones(len(at), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (cid[1:] != cid[:-1])
    cid, at, codes = cid[new], at[new], codes[new]
    first = np.ones(len(at), bool)
    first[1:] = cid[1:] != cid[:-1]
    begins = np.flatnonzero(first)
    index = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return pd.DataFrame({"cid": cid, "nid": of.loc[cid].to_numpy(), "seq": index.astype(np.int32), "pos": at.astype(np.int32), "code": codes.view(np.int64)})


def sources(tasks: DataFrame, scratch: Scratch, length: int) -> tuple[DataFrame, DataFrame]:
    """(name, cid) of every routine's different texts, and (cid, nid, text) once each; nid stands for the routine, or is SEVERAL."""
    raw = tasks.select(routine_name(F.col("routine"), F.col("task_id")).alias("name"), F.col("baseline_src").alias("text")).where(F.col("name").isNotNull() & (F.length("text") >= length))
    raw = raw.withColumn("tid", F.unhex(F.md5("text")))
    one = raw.groupBy("tid").agg(F.first("text").alias("text"), F.min("name").alias("lo"), F.max("name").alias("hi"))
    texts = scratch.keep(one.withColumn("cid", F.monotonically_increasing_id()).withColumn("nid", F.when(F.col("lo") == F.col("hi"), F.xxhash64("lo")).otherwise(SEVERAL)))
    several = texts.where(F.col("lo") != F.col("hi")).select("tid", "cid")
    of_several = raw.select("name", "tid").distinct().join(several, "tid").select("name", "cid")
    members = scratch.keep(texts.where(F.col("lo") == F.col("hi")).select(F.col("lo").alias("name"), "cid").unionByName(of_several))
    return members, texts.select("cid", "nid", "text")


def of_two_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that two routines or more have, with their number of rows."""
    per = rows.groupBy(*keys).agg(F.min("nid").alias("lo"), F.max("nid").alias("hi"), F.count("*").alias("n"))
    return per.where((F.col("lo") != F.col("hi")) | (F.col("lo") == SEVERAL)).select(*keys, "n")


def frequent(held: DataFrame, keys: list[str], total: int) -> list[tuple]:
    """Those of counted keys that hold a large share of all rows; fewer than HOT_SHARE."""
    return [tuple(r[k] for k in keys) for r in held.where((F.col("n") > HOT_LEAST) & (F.col("n") * HOT_SHARE > total)).select(*keys).collect()]


def repeated_kmers(texts: DataFrame, scratch: Scratch, length: int, window: int) -> tuple[DataFrame, list[tuple]]:
    """(cid, nid, seq, pos, code) of the k-mers that two routines or more have, and the codes that fill many of the rows."""
    rows = scratch.keep(texts.mapInPandas(_kmers(length, window), "cid bigint, nid bigint, seq int, pos int, code bigint"))
    held = scratch.keep(of_two_names(rows, ["code"]))
    hot = frequent(held, ["code"], rows.count())
    kept = scratch.keep(skew_join(rows, held.select("code"), ["code"], "left_semi", hot=hot))
    scratch.drop(rows, held)
    return kept, hot


def compact(kmers: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(code, head, offset): the path each repeated k-mer lies on, named by its first k-mer."""
    w = Window.partitionBy("cid", F.floor(F.col("seq") / STRETCH)).orderBy("seq")
    gap = F.lead("pos").over(w) - F.col("pos")
    follows = (F.lead("seq").over(w) == F.col("seq") + 1) & (gap <= k)
    preceded = (F.lag("seq").over(w) == F.col("seq") - 1) & (F.col("pos") - F.lag("pos").over(w) <= k)
    edges = kmers.select("code", F.when(follows, F.lead("code").over(w)).alias("next"), F.when(follows, gap).alias("gap"), F.when(preceded, F.lag("code").over(w)).alias("prev"))
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    nodes = scratch.keep(edges.groupBy("code").agg(F.when(F.min("gap") == F.max("gap"), only("next")).alias("next"), only("prev").alias("prev"), F.min("gap").alias("gap")))
    # An unbranched node: the only edge out of one k-mer and the only one into the next. Keys of both sides are unique.
    enter = nodes.where(F.col("prev").isNotNull() & (F.col("prev") != F.col("code"))).select("code", "prev")
    leave = nodes.where(F.col("next").isNotNull()).select(F.col("code").alias("prev"), F.col("next").alias("code"), F.col("gap").cast("long").alias("offset"))
    links = scratch.keep(enter.join(leave, ["prev", "code"]).select("code", F.col("prev").alias("head"), "offset"))
    linked = links.select(F.col("code").alias("head"), F.lit(False).alias("ended"))
    first = scratch.keep(links.join(linked, "head", "left").select("code", "head", "offset", F.coalesce("ended", F.lit(True)).alias("ended")))  # of one path's pointers each leads elsewhere
    starts = nodes.select("code").join(links.select("code"), "code", "left_anti").select("code", F.col("code").alias("head"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("ended"))
    done, active = starts.unionByName(first.where("ended")), first.where("NOT ended")
    left, most, rounds = active.count(), links.count(), 0
    while left:
        # Pointers of one path lead to different k-mers until they reach its head, and leave the loop there.
        up = active.unionByName(done).select(F.col("code").alias("head"), F.col("head").alias("up"), F.col("offset").alias("more"), F.col("ended").alias("there"))
        jumped = scratch.keep(active.join(up, "head").select("code", F.col("up").alias("head"), (F.col("offset") + F.col("more")).alias("offset"), F.col("there").alias("ended")))
        done, active = done.unionByName(jumped.where("ended")), jumped.where("NOT ended")
        left, rounds = active.count(), rounds + 1
        if left and 1 << rounds > most:  # a ring has no head: its k-mers stand alone
            return done.unionByName(active.withColumn("head", F.col("code")).withColumn("offset", F.lit(0).cast("long"))).drop("ended")
    return done.drop("ended")


def path_rows(texts: DataFrame, scratch: Scratch, length: int, window: int) -> DataFrame:
    """(cid, pos, len): where texts run through a path, and how far."""
    k = length - window + 1
    kmers, hot = repeated_kmers(texts, scratch, length, window)
    paths = scratch.keep(compact(kmers, scratch, k))
    ends = scratch.keep(paths.groupBy("head").agg((F.max("offset") + k).alias("len")).withColumnRenamed("head", "code"))
    return skew_join(kmers.select("cid", "pos", "code"), ends, ["code"], hot=hot).select("cid", "pos", "len")


def _digests(length: int, window: int):
    """Digests of paths and of the spans of ``length`` characters at their ends, with their coordinates."""
    k = length - window + 1

    def of_text(text: str, places: list[tuple[int, int]]) -> tuple[np.ndarray, ...] | None:
        from xxhash import xxh128_intdigest

        x = characters(text)
        wanted = np.zeros(len(x) - length + 1, bool)
        paths, periods = [], set()
        for pos, size in places:
            end = pos + size - k  # the last k-mer
            wanted[max(0, pos - window + 1) : pos] = True
            if size >= length:
                d = xxh128_intdigest(x[pos : pos + size].tobytes())
                paths.append((d >> 64, d & (1 << 64) - 1, pos, pos + size))
            # A k-mer that repeats soon counted once; the spans that begin at its repetitions are those up to the next period.
            near = Grams(x[end : end + k + window]).of(k)
            again = np.flatnonzero(near[1:] == near[0])
            if len(again):
                periods.add(int(again[0]) + 1)
            wanted[max(pos, pos + size - length + 1) : end + (window if len(again) else 1)] = True
        found = [tuple(np.array(v, t) for v, t in zip(zip(*paths), (np.uint64, np.uint64, np.int64, np.int64)))] if paths else []
        # Where the text goes on with the period of a span, the span stands for all its repetitions.
        breaks = {d: np.append(np.flatnonzero(x[d:] != x[:-d]) + d, len(x)) for d in sorted(periods)}
        for begin in range(0, len(wanted), PIECE):
            at = np.flatnonzero(wanted[begin : begin + PIECE])
            if len(at):
                piece = x[begin : begin + PIECE + length - 1]
                ends = at + begin + length
                for d, stops in breaks.items():
                    beyond = stops[np.searchsorted(stops, at + begin + d)] - (at + begin + length)
                    ends = np.maximum(ends, at + begin + length + np.where(beyond > 0, beyond // d * d, 0))
                found.append((Grams(piece).of(length)[at], Grams(piece, 0xD1B54A32D192ED03).of(length)[at], at + begin, ends))
        return tuple(np.concatenate(v) for v in zip(*found)) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for t in batches:
            for cid, nid, text, places in zip(t["cid"], t["nid"], t["text"], t["places"]):
                if found := of_text(text, [(p["pos"], p["len"]) for p in places]):
                    a, b, start, end = found
                    held.append(pd.DataFrame({"cid": cid, "nid": nid, "a": a.view(np.int64), "b": b.view(np.int64), "from": start, "to": end}))
                    size += len(a)
                if size >= PIECE:
                    yield pd.concat(held)
                    held, size = [], 0
        if held:
            yield pd.concat(held)

    return run


def shared_digests(texts: DataFrame, scratch: Scratch, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(cid, a, b, from, to): spans of ``length`` characters or more that texts of two routines hold; a, b digest them."""
    places = scratch.keep(path_rows(texts, scratch, length, window))
    listed = places.groupBy("cid").agg(F.collect_list(F.struct("pos", "len")).alias("places"))  # shorter than the text itself
    rows = scratch.keep(texts.join(listed, "cid").mapInPandas(_digests(length, window), "cid bigint, nid bigint, a bigint, b bigint, from bigint, to bigint"))
    held = scratch.keep(of_two_names(rows, ["a", "b"]))
    kept = scratch.keep(skew_join(rows, held.select("a", "b"), ["a", "b"], "left_semi", hot=frequent(held, ["a", "b"], rows.count())).drop("nid"))
    scratch.drop(rows, held, places)
    return kept


def name_pairs(members: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """(name_a, name_b), name_a first in byte order: every two different routines with a common span or text, once."""
    on = scratch.keep(spans.select("a", "b", "cid").distinct())
    # Of all spans that the same texts hold one is enough: sums of two hashes of its texts tell such sets apart.
    sets = on.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "cid")).alias("x"))
    chosen = scratch.keep(sets.groupBy("n", "s", "x").agg(F.min(F.struct("a", "b")).alias("k")).select("k.a", "k.b", "n"))
    hot = frequent(chosen, ["a", "b"], on.count())
    few = skew_join(on, chosen.select("a", "b"), ["a", "b"], "left_semi", hot=hot)
    named = scratch.keep(skew_join(members, few.select("cid", F.xxhash64("a", "b").alias("key"), "a", "b"), ["cid"], hot=written_hot_keys(members, ["cid"])).select("key", "a", "b", "name").distinct())
    whole = members.groupBy("cid").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where(F.col("lo") != F.col("hi")).select("cid")
    same = scratch.keep(members.join(whole, "cid", "left_semi"))
    groups = named.select("a", "b", "name").unionByName(same.select(F.col("cid").alias("a"), F.lit(None).cast("bigint").alias("b"), "name")).select(F.struct("a", "b").alias("g"), "name")
    groups = scratch.keep(groups.select(F.concat_ws("|", F.col("g.a"), F.col("g.b")).alias("g"), "name"))
    pairs = skew_join(groups.withColumnRenamed("name", "name_a"), groups.withColumnRenamed("name", "name_b"), ["g"], hot=written_hot_keys(groups, ["g"]))
    return pairs.where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()


def sharing_routines(tasks: DataFrame, scratch: Scratch | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(name_a, name_b), name_a first in byte order: routines with an equal span of ``length`` characters in a text of each."""
    scratch = scratch or Scratch(tasks.sparkSession)
    members, texts = sources(tasks, scratch, length)
    return name_pairs(members, shared_digests(texts, scratch, length, window), scratch)


def shared_parts(tasks: DataFrame, scratch: Scratch | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """(name, partners, chars, shared_chars, share): how much of each routine's texts also stands in another routine.

    Routines that share nothing appear with zeros; a routine without a text of ``length`` characters does not appear.
    """
    scratch = scratch or Scratch(tasks.sparkSession)
    members, texts = sources(tasks, scratch, length)
    spans = shared_digests(texts, scratch, length, window)
    sizes = texts.select("cid", F.length("text").cast("long").alias("chars"), (F.col("nid") == SEVERAL).alias("several"))
    w = Window.partitionBy("cid").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)  # fewer spans than characters of one text
    reach = spans.select("cid", "from", "to").distinct().withColumn("seen", F.coalesce(F.max("to").over(w), F.lit(0)))
    covered = reach.groupBy("cid").agg(F.sum(F.greatest(F.col("to") - F.greatest("from", "seen"), F.lit(0))).alias("covered"))
    per = sizes.join(covered, "cid", "left").select("cid", "chars", F.when(F.col("several"), F.col("chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"))
    totals = skew_join(members, per, ["cid"]).groupBy("name").agg(F.sum("chars").alias("chars"), F.sum("shared_chars").alias("shared_chars"))
    pairs = scratch.keep(name_pairs(members, spans, scratch))
    partners = pairs.select(F.col("name_a").alias("name")).unionByName(pairs.select(F.col("name_b").alias("name"))).groupBy("name").agg(F.count("*").alias("partners"))
    out = totals.join(partners, "name", "left").na.fill(0, ["partners"])
    return out.select("name", "partners", "chars", "shared_chars", F.round(F.col("shared_chars") / F.col("chars"), 6).alias("share"))
