"""Problem 7: passages of evaluation items inside the documents.

A positional inverted index of all documents is written once: (term, doc_id, pos). Of every n successive words of an
item the term that is rarest in the index is looked up; its postings, shifted by the term's place in the item, are the
alignments at which that phrase can stand. The next rarer terms intersect with the index at these shifted positions,
then all of the item's terms, and runs of n or more hits are the exact phrases. Proximity matches need only several rare terms of an item
at nearly one alignment; the rarest term that documents hold at all counts, so words changed beyond recognition do not
hide the words around them.

Words are runs of letters or digits after NFC and case folding. Terms are 64-bit hashes of words.
Defined results: null and empty texts hold no words; an item of fewer than n words matches nothing; repeated items
and documents match once; every different text of an item is searched, and figures are those of its best text. A phrase whose rarest term is frequent gives many alignments, never fewer than all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import skew_join, written_hot_keys
from ..sources.scratch import Scratch

PHRASE = 12
#: Rows up to which a query side may be broadcast; beyond it, it is joined by shuffle.
BROADCAST_ROWS = 200_000
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(unicodedata.normalize("NFC", text).casefold())


def _postings(key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        codes: dict[str, int] = {}
        for b in batches:
            keys, terms, places = [], [], []
            for k, text in zip(b[key], b["text"]):
                words = words_of(text)
                if len(codes) > 500_000:
                    codes.clear()
                for w in words:
                    if w not in codes:
                        codes[w] = xxh64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63)
                keys += [k] * len(words)
                terms += [codes[w] for w in words]
                places += range(len(words))
                if len(terms) > 500_000:
                    yield pd.DataFrame({key: keys, "term": terms, "pos": places})
                    keys, terms, places = [], [], []
            yield pd.DataFrame({key: pd.array(keys, dtype="int64"), "term": pd.array(terms, dtype="int64"), "pos": pd.array(places, dtype="int32")})

    return run


def positional_index(texts: DataFrame, key: str) -> DataFrame:
    """(key, term, pos) of every word of every text."""
    need = texts.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text")
    return need.mapInPandas(_postings(key), f"{key} bigint, term bigint, pos int")


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` to be broadcast if it is shown to have no more than ``rows`` (BROADCAST_ROWS) rows, else as it is."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class PhraseIndex:
    """The written index of documents and the lookups against it."""

    def __init__(self, documents: DataFrame, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch(documents.sparkSession)
        self.postings = self.scratch.keep(positional_index(documents, "doc_id"))

    def item_tokens(self, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """tokens (tid, at, term, freq): the words of every different text of an item in order, with their number of postings; texts (tid, item_id)."""
        once = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
        texts = self.scratch.keep(once.withColumn("tid", F.monotonically_increasing_id()))
        tokens = self.scratch.keep(positional_index(texts, "tid").withColumnRenamed("pos", "at"))
        terms = bounded(tokens.select("term").distinct())
        freq = self.scratch.keep(self.postings.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq")))
        counted = self.scratch.keep(tokens.join(bounded(freq), "term", "left").select("tid", "at", "term", F.coalesce("freq", F.lit(0)).alias("freq")))
        return counted, texts.select("tid", "item_id")

    def anchors(self, tokens: DataFrame, n: int, whole: bool = True) -> DataFrame:
        """(tid, a1, a2, a3): the three rarest terms, each {freq, at, term}, of every n successive words that all occur in
        the index; if not ``whole``, of those among any n successive words that occur there (a2 and a3 may repeat a1)."""
        w = Window.partitionBy("tid").orderBy("at").rowsBetween(0, n - 1)
        span = tokens.select("tid", F.array_sort(F.collect_list(F.struct("freq", "at", "term")).over(w)).alias("r"))
        if whole:
            usable = span.where((F.size("r") == n) & (F.col("r")[0]["freq"] > 0))
        else:
            usable = span.where(F.size("r") == n).select("tid", F.filter("r", lambda x: x["freq"] > 0).alias("r")).where(F.size("r") > 0)
        place = lambda k: F.element_at("r", F.least(F.lit(k + 1), F.size("r")))
        return usable.select("tid", *[place(min(k, n - 1)).alias(f"a{k + 1}") for k in range(3)]).distinct()

    def alignments(self, anchors: DataFrame) -> DataFrame:
        """(tid, doc_id, shift, at, a2, a3): places of each rarest term; shift = place in the document - place in the text."""
        first = anchors.select("tid", F.col("a1.term").alias("term"), F.col("a1.at").alias("at"), "a2", "a3")
        small = bounded(first)
        hits = self.postings.join(small, "term") if small is not first else skew_join(self.postings, first, ["term"])
        return hits.select("tid", "doc_id", (F.col("pos") - F.col("at")).alias("shift"), "at", "a2", "a3")

    def intersected(self, anchors: DataFrame) -> DataFrame:
        """(tid, doc_id, shift): alignments at which the second and the third rarest term stand as well."""
        hits = self.alignments(anchors)
        for a in ("a2", "a3"):
            terms = bounded(anchors.select(F.col(f"{a}.term").alias("term")).distinct())
            there = self.postings.join(terms, "term", "left_semi").select("doc_id", "term", "pos")
            hits = hits.withColumn("term", F.col(f"{a}.term")).withColumn("pos", F.col("shift") + F.col(f"{a}.at")).join(there, ["doc_id", "term", "pos"], "left_semi")
        return hits.select("tid", "doc_id", "shift").distinct()

    def phrases(self, items: DataFrame, n: int = PHRASE) -> DataFrame:
        """(doc_id, item_id, longest, matched): longest run of common words and the item's words in runs of n or more."""
        tokens, texts = self.item_tokens(items)
        aligned = self.scratch.keep(self.intersected(self.scratch.keep(self.anchors(tokens, n))))
        ours_all = tokens.select("tid", "at", "term")
        ours = bounded(ours_all)
        hot = written_hot_keys(aligned, ["tid"])
        wanted = skew_join(aligned, ours, ["tid"], hot=hot if ours is ours_all else []).select("tid", "doc_id", "shift", "at", "term", (F.col("at") + F.col("shift")).alias("pos")).where(F.col("pos") >= 0)
        terms = bounded(tokens.select("term").distinct())
        docs = self.postings.join(terms, "term", "left_semi").join(bounded(aligned.select("doc_id").distinct()), "doc_id", "left_semi")
        hits = wanted.join(docs, ["doc_id", "pos", "term"])
        run = Window.partitionBy("doc_id", "tid", "shift").orderBy("at")
        islands = hits.withColumn("island", F.col("at") - F.row_number().over(run)).groupBy("doc_id", "tid", "shift", "island").agg(F.count("*").alias("length"), F.min("at").alias("first"))
        long = islands.where(F.col("length") >= n)
        covered = long.select("doc_id", "tid", "length", F.explode(F.sequence("first", F.col("first") + F.col("length").cast("int") - 1)).alias("at"))
        per = covered.groupBy("doc_id", "tid").agg(F.max("length").alias("longest"), F.countDistinct("at").alias("matched"))
        return per.join(bounded(texts), "tid").groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("matched").alias("matched"))

    def near(self, items: DataFrame, n: int = PHRASE, slack: int = 8, share: float = 0.6) -> DataFrame:
        """(doc_id, item_id, anchors, of): documents that hold at least ``share`` of an item's rare terms, and two or
        more, within ``slack`` words of one alignment; words may be missing, added or changed between them.

        The rare terms of a text are the rarest of every n successive words that documents hold at all. Figures are
        those of the item's text with the highest share."""
        tokens, texts = self.item_tokens(items)
        anchors = self.scratch.keep(self.anchors(tokens, n, whole=False))
        of = anchors.groupBy("tid").agg(F.countDistinct("a1.at").alias("of"))
        hits = self.alignments(anchors)
        # An alignment falls into two overlapping bins, so any two within the slack meet in one.
        bins = hits.select("tid", "doc_id", "at", F.explode(F.array(F.floor(F.col("shift") / (2 * slack)) * 2, F.floor((F.col("shift") + slack) / (2 * slack)) * 2 - 1)).alias("bin"))
        best = bins.groupBy("tid", "doc_id", "bin").agg(F.countDistinct("at").alias("anchors")).groupBy("tid", "doc_id").agg(F.max("anchors").alias("anchors"))
        kept = best.join(bounded(of), "tid").where((F.col("anchors") >= 2) & (F.col("anchors") >= F.col("of") * share))
        top = kept.join(bounded(texts), "tid").groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("anchors") / F.col("of")).alias("share"), "anchors", "of")).alias("m"))
        return top.select("doc_id", "item_id", "m.anchors", "m.of")
