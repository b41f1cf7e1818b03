"""Problem 8: the language of every document and of every stretch of a mixed one, with a confidence.

Per language a set of character n-grams (and whole words, with word ends) is learned from a bounded sample of labelled
rows and stored in one bit-sliced Bloom filter: a cell holds one bit per language, so that the AND of an n-gram's
cells is the mask of all languages that contain it. A word's popcounts per language, less the false positives that
the filter's fill predicts, are its evidence; the best path over the words, at a cost for each change of language,
cuts the text into stretches.

Learning: rows whose label reads as one of the languages, both sides of the sentence pairs, up to SAMPLE rows per
language and side by least hash of doc_id, chosen in one pass over the labels; labels may be wrong, as an n-gram enters a language only if it is at least
RATIO times as frequent there as where it is most frequent. Everything else covers all rows and whole texts.

Defined results: null, empty and wordless texts have no stretch (status ``no text``); words no filter knows count for
no language; a language needs LEAST_WORDS words of evidence in a row, so names and borrowed expressions make no stretch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Ways to write the languages' names and codes, in lower case without accents.
NAMES = {
    "en": ["en", "eng", "english", "anglais", "englisch", "ingles"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "aleman"],
    "fr": ["fr", "fra", "fre", "french", "francais", "franzosisch", "frances"],
    "es": ["es", "spa", "spanish", "espanol", "castellano", "spanisch", "castilian"],
    "pt": ["pt", "por", "portuguese", "portugues", "portugiesisch"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "niederlandisch", "flemish", "vlaams"],
    "ru": ["ru", "rus", "russian", "русский", "russisch", "russe", "russkii", "russkiy"],
}
LANGUAGES = list(NAMES)
CODES = {name: code for code, names in NAMES.items() for name in names}

SAMPLE = 1500
RATIO = 0.25
LEAST_ROWS = 3
SIZES = (2, 3, 4, 5)
HASHES = 3
#: Costs of a change of language between sentences and within one, in units of one word's full evidence.
CHANGE, CHANGE_WITHIN = 1.2, 2.2
LEAST_WORDS = 4
WORDS = re.compile(r"[^\W\d_]+")
STOP = re.compile(r"[.!?…;:/|(){}\[\]\"“”«»\n]")


def plain(text: str) -> str:
    """Compatibility forms composed, case folded, accents dropped."""
    folded = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in folded if not unicodedata.combining(c)) if not folded.isascii() else folded


def code_of(label, codes: dict[str, str] | None = None) -> str | None:
    """Two-letter code of a label that names one of the languages (``codes``: way to write it -> code), else None."""
    if not isinstance(label, str):
        return None
    codes = CODES if codes is None else codes
    bare = plain(label).strip()
    return codes.get(bare) or codes.get(re.split(r"[-_\s(/,.]", bare, maxsplit=1)[0])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, hash) of the different n-grams of each word, word ends marked, and of each longer word itself."""
    marked = [f"^{w}$" for w in words]
    lengths = np.array([len(w) for w in marked], dtype=np.int64)
    x = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(words) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(x))  # characters to the word's end
    c = _mixed(x + np.uint64(1))
    who, found = [], []
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0xD6E8FEB86659FD93) + c[n - 1 :]
        if n in SIZES:
            fits = left[:m] >= n
            who.append(owner[:m][fits])
            found.append(_mixed(h[fits] + np.uint64(n)))
    long = np.flatnonzero(lengths > max(SIZES))
    if len(long):
        place = np.arange(len(x)) - np.repeat(starts, lengths)
        power = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, np.uint64))
        total = np.add.reduceat(c * power[place], starts)
        who.append(long)
        found.append(_mixed(total[long] ^ lengths[long].astype(np.uint64) << np.uint64(8)))
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    w, g = np.concatenate(who), np.concatenate(found)
    order = np.lexsort((g, w))
    w, g = w[order], g[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
    return w[new], g[new]


class Filters:
    """The bit-sliced Bloom filter: ``cells[i]`` has a bit for every language that set cell i; up to 64 languages."""

    def __init__(self, entries, languages: list[str] = LANGUAGES):
        """``entries``: pairs of an n-gram's hash and the mask of its languages."""
        self.languages = languages
        hashes, masks = np.asarray(entries, np.uint64).reshape(-1, 2).T
        size = 1 << max(12, (8 * len(hashes)).bit_length())
        width = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if bits >= len(languages))
        self.mask = size - 1
        self.cells = np.zeros(size, width)
        for places in self._places(hashes):
            np.bitwise_or.at(self.cells, places, masks.astype(width))
        fill = np.array([np.mean(self.cells >> width(k) & width(1)) for k in range(len(languages))])
        self.false = fill**HASHES

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        return [(a + np.uint64(k) * b & np.uint64(self.mask)).astype(np.int64) for k in range(HASHES)]

    def contains(self, h) -> np.ndarray:
        """Masks of the languages that contain each n-gram."""
        i, j, k = self._places(np.asarray(h, np.uint64))
        return self.cells[i] & self.cells[j] & self.cells[k]

    def evidence(self, words: list[str]) -> np.ndarray:
        """Per word and language the share of the word's n-grams it contains, less expected false positives."""
        who, h = gram_hashes(words)
        masks = self.contains(h)
        one = self.cells.dtype.type(1)
        hits = np.stack([np.bincount(who, masks >> self.cells.dtype.type(k) & one, len(words)) for k in range(len(self.languages))], axis=1)
        size = np.bincount(who, minlength=len(words))[:, None]
        return np.maximum((hits / np.maximum(size, 1) - self.false) / (1 - self.false), 0)


class Words:
    """Evidence of words as they are written, kept between texts; rows of ``table`` follow their numbers."""

    def __init__(self, filters: Filters, most: int = 200_000):
        self.filters, self.most = filters, most
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.table = np.zeros((0, len(self.filters.languages)))

    def learn(self, words: set[str]) -> None:
        """Adds the evidence of words not seen before."""
        if len(self.numbers) > self.most:
            self.clear()
        new = [w for w in words if w not in self.numbers]
        # A capital letter turns up inside the normal form of a few scripts' words, hence the second split.
        parts = [WORDS.findall(plain(w)) for w in new]
        flat = [p for ps in parts for p in ps]
        e = np.zeros((len(new), self.table.shape[1]))
        if flat:
            np.add.at(e, np.repeat(np.arange(len(new)), [len(ps) for ps in parts]), self.filters.evidence(flat))
        base = len(self.numbers)
        self.numbers.update((w, base + i) for i, w in enumerate(new))
        self.table = np.concatenate([self.table, e])


def _training_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(code, gram, n): rows of a batch that hold the n-gram, counted before anything moves."""
    for b in batches:
        texts = [list(set(WORDS.findall(plain(t)))) for t in b["text"]]
        number = {w: i for i, w in enumerate({w for t in texts for w in t})}
        who, h = gram_hashes(list(number))
        begin = np.searchsorted(who, np.arange(len(number) + 1))
        held: dict[str, list[np.ndarray]] = {}
        for code, text in zip(b["code"], texts):
            if text:
                held.setdefault(code, []).append(np.unique(np.concatenate([h[begin[i] : begin[i + 1]] for i in (number[w] for w in text)])))
        for code, parts in held.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"code": [code] * len(g), "gram": g.view(np.int64), "n": n.astype(np.int64)})


def _least_rows(sample: int, names: dict[str, str]):
    """Of a task's rows the ``sample`` least hashes per language and side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict = {}
        held: dict[tuple, pd.DataFrame] = {}
        for b in batches:
            for side, label in (("text", "lang"), ("text_tgt", "lang_tgt")):
                if len(codes) > 100_000:
                    codes.clear()
                codes.update({x: code_of(x, names) for x in b[label].dropna().unique() if x not in codes})
                part = b[["h", "doc_id"]].assign(code=b[label].map(codes))
                for code, rows in part.dropna(subset=["code"]).groupby("code"):
                    both = pd.concat([held.get((code, side)), rows]) if (code, side) in held else rows
                    held[code, side] = both.nsmallest(sample, ["h", "doc_id"])
        for (_, side), rows in held.items():
            yield rows.assign(side=side)[["doc_id", "h", "code", "side"]]

    return run


def learn(documents: DataFrame, sample: int = SAMPLE, ratio: float = RATIO, names: dict[str, list[str]] | None = None) -> Filters:
    """Filters from a bounded sample of labelled rows; the driver receives n-gram hashes with their masks.

    ``names``: the languages to learn, each with the ways to write it; NAMES by default.
    """
    names = names or NAMES
    languages = list(names)
    spelled = {n: code for code, ns in names.items() for n in ns}
    labels = documents.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang", "lang_tgt").where(F.col("doc_id").isNotNull())
    least = labels.mapInPandas(_least_rows(sample, spelled), "doc_id bigint, h bigint, code string, side string")
    top = Window.partitionBy("code", "side").orderBy("h", "doc_id")
    chosen = least.withColumn("r", F.row_number().over(top)).where(F.col("r") <= sample).select("doc_id", "code", "side").distinct()
    sides = documents.select("doc_id", F.explode(F.array(F.struct(F.lit("text").alias("side"), F.col("text").alias("text")), F.struct(F.lit("text_tgt").alias("side"), F.col("text_tgt").alias("text")))).alias("s")).select("doc_id", "s.*")
    rows = sides.where(F.col("text").isNotNull()).join(F.broadcast(chosen), ["doc_id", "side"]).select("code", "text")  # at most languages x 2 x sample
    counts = rows.mapInPandas(_training_grams, "code string, gram bigint, n bigint").groupBy("gram", "code").agg(F.sum("n").alias("n"))
    per = chosen.groupBy("code").agg(F.count("*").alias("of"))  # at most one row per language
    bit = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(languages) for x in (c, 1 << i)]), F.col("code")).cast("bigint")
    listed = counts.join(F.broadcast(per), "code").groupBy("gram").agg(F.sum("n").alias("rows"), F.collect_list(F.struct((F.col("n") / F.col("of")).alias("rate"), bit.alias("bit"))).alias("in"))
    most = F.array_max(F.transform("in", lambda x: x["rate"]))
    mask = F.aggregate("in", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x["rate"] >= most * ratio, x["bit"]).otherwise(F.lit(0).cast("bigint")))
    every = (1 << len(languages)) - 1
    kept = listed.where(F.col("rows") >= LEAST_ROWS).select("gram", mask.alias("mask")).where(F.col("mask") != every).toPandas()
    return Filters(np.stack([kept["gram"].to_numpy(np.int64).view(np.uint64), kept["mask"].to_numpy(np.int64).astype(np.uint64)], axis=1), languages)


def _runs(lengths: list[int], most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about ``most`` words."""
    begin = held = 0
    for i, n in enumerate(lengths):
        held += n
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(lengths):
        yield begin, len(lengths)


def stretches(texts: list[str], known: Words) -> list[list[tuple[int, int, str, float]]]:
    """Per text (first character, end, language, confidence) of each stretch of one language."""
    said = [WORDS.findall(t) for t in texts]
    known.learn({w for ws in said for w in ws})
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for begin, end in _runs([len(ws) for ws in said]):
        which = [i for i in range(begin, end) if said[i]]
        if not which:
            continue
        lengths = np.array([len(said[i]) for i in which])
        starts = np.cumsum(lengths) - lengths
        s = known.table[np.fromiter((known.numbers[w] for i in which for w in said[i]), np.int64, int(lengths.sum()))]
        totals = np.add.reduceat(s, starts)
        best = totals.argmax(axis=1)
        # What another language gains on the best one over any run of words; every text lies far below the one before.
        gain = np.cumsum(s - s[np.arange(len(s)), np.repeat(best, lengths)][:, None], axis=0)
        gain -= np.repeat(np.vstack([np.zeros(s.shape[1]), gain[starts[1:] - 1]]), lengths, axis=0)
        floor = -np.repeat(np.arange(len(which)), lengths)[:, None] * (2 * np.abs(gain).max() + 1)
        most = np.maximum.reduceat(gain + floor - np.minimum.accumulate(np.minimum(gain + floor, floor), axis=0), starts).max(axis=1)
        for k, i in enumerate(which):
            if totals[k].max() <= 0:
                continue
            if most[k] <= CHANGE - 1e-6:  # no other language can pay for two changes (one at an end)
                text, last = texts[i], said[i][-1]
                out[i] = [(WORDS.search(text).start(), text.rfind(last) + len(last), known.filters.languages[best[k]], _confidence(totals[k]))]
            else:
                out[i] = _several(texts[i], s[starts[k] : starts[k] + lengths[k]], known.filters.languages)
    return out


def _several(text: str, s: np.ndarray, languages: list[str]) -> list[tuple[int, int, str, float]]:
    words = list(WORDS.finditer(text))
    path = _best_path(s, [bool(STOP.search(text, a.end(), b.start())) for a, b in zip(words, words[1:])])
    path = _merge_short(path, s)
    out, start = [], 0
    for i in range(1, len(words) + 1):
        if i == len(words) or path[i] != path[start]:
            out.append((words[start].start(), words[i - 1].end(), languages[path[start]], _confidence(s[start:i].sum(axis=0))))
            start = i
    return out


def _confidence(sums: np.ndarray) -> float:
    """Evidence of the best language over that of the best two."""
    two = np.sort(sums)[-2:]
    return round(float(two[-1] / two.sum()), 4) if two[-1] > 0 else 0.0


def _best_path(s: np.ndarray, breaks: list[bool]) -> list[int]:
    """Language of each word: most evidence less the costs of changes."""
    rows = s.tolist()
    score, back = rows[0], []
    for row, pause in zip(rows[1:], breaks):
        most = max(score)
        moved = most - (CHANGE if pause else CHANGE_WITHIN)
        back.append((score.index(most), [x >= moved for x in score]))
        score = [(x if x >= moved else moved) + e for x, e in zip(score, row)]
    at = score.index(max(score))
    path = [at]
    for top, stay in reversed(back):
        at = at if stay[at] else top
        path.append(at)
    return path[::-1]


def _merge_short(path: list[int], s: np.ndarray) -> list[int]:
    """Stretches with fewer than LEAST_WORDS telling words join their longer neighbour."""
    while True:
        cuts = [0, *[i for i in range(1, len(path)) if path[i] != path[i - 1]], len(path)]
        if len(cuts) == 2:
            return path
        told = [int((s[a:b, path[a]] > 0.15).sum()) for a, b in zip(cuts, cuts[1:])]
        k = int(np.argmin(told))
        if told[k] >= LEAST_WORDS:
            return path
        left = told[k - 1] if k else -1
        right = told[k + 1] if k + 1 < len(told) else -1
        into = path[cuts[k] - 1] if left >= right else path[cuts[k + 1]]
        path = path[: cuts[k]] + [into] * (cuts[k + 1] - cuts[k]) + path[cuts[k + 1] :]


SEGMENT = "array<struct<from:int,to:int,lang:string,confidence:double>>"


def detect(documents: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, stated, stretches): the stated label's code and the stretches of the text."""
    # At most 256 KB per 10,000 n-grams of the bounded sample and byte of width. Plain data, for a broadcast value is not pickled by value.
    model = documents.sparkSession.sparkContext.broadcast((filters.languages, filters.cells, filters.false))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = Filters([])
        local.languages, local.cells, local.false = model.value
        local.mask = len(local.cells) - 1
        known = Words(local)
        for b in batches:
            found = stretches([t if isinstance(t, str) else "" for t in b["text"]], known)
            found = [[{"from": a, "to": z, "lang": lang, "confidence": c} for a, z, lang, c in f] for f in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "stated": [code_of(x) for x in b["lang"]], "stretches": found})

    return documents.select("doc_id", "lang", "text").mapInPandas(run, f"doc_id bigint, stated string, stretches {SEGMENT}")


def document_languages(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, stated, lang, confidence, languages, status); lang is that of most of the text.

    status: ok, missing (no language's name), wrong, mixed, or no text.
    """
    found = detect(documents, filters or learn(documents))
    size = lambda x: x["to"] - x["from"]
    names = F.array_sort(F.array_distinct(F.transform("stretches", lambda x: x["lang"])))
    per = F.transform(names, lambda n: F.struct(F.aggregate(F.filter("stretches", lambda x: x["lang"] == n), F.lit(0), lambda a, x: a + size(x)).alias("size"), n.alias("lang"), F.array_max(F.transform(F.filter("stretches", lambda x: x["lang"] == n), lambda x: x["confidence"])).alias("confidence")))
    main = F.array_max(per)
    status = F.when(F.size("stretches") == 0, "no text").when(F.size("languages") > 1, "mixed").when(F.col("stated").isNull(), "missing").when(F.col("stated") != F.col("languages")[0], "wrong").otherwise("ok")
    return found.withColumn("languages", names).withColumn("m", main).select("doc_id", "stated", "m.lang", "m.confidence", "languages", status.alias("status"))


def mislabelled(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, lang): for documents whose label is missing or wrong or whose text is mixed, each of its languages."""
    d = document_languages(documents, filters)
    return d.where(F.col("status").isin("missing", "wrong", "mixed")).select("doc_id", F.explode("languages").alias("lang"))
