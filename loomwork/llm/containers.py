"""Problem 6: filling containers of fixed capacity with documents.

Hashed word vectors of the documents are projected to a few dimensions; the Hilbert key of that point orders the
documents, so that neighbours on the curve resemble each other. Only (document, piece, size, key) is range-sorted, and
each range packs along the curve: an item goes into the open container it fills best, among a bounded number of open
ones; what a range leaves open is merged at its end. Texts never travel.

Sizes are tokens of a byte tokenizer (UTF-8 bytes and one end mark) or of a tokenizer file given by path. A document
is cut only if it exceeds the capacity alone, then into full containers and a rest, never within a character.

Defined results: a null text is no item; an empty text is its end mark alone. Equal documents share a key and are
spread by their ids, so no key fills one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import blake2b
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

CAPACITY = 2048
DIMENSIONS, BITS = 4, 8
OPEN = 64
#: Items of a stretch of the curve that are packed in one go.
STRETCH = 200_000


def byte_pieces(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(first character, end, tokens) of each piece; the end mark belongs to the last."""
    size = len(text.encode("utf-8", "surrogatepass")) + 1
    if size <= capacity:
        return [(0, len(text), size)]
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    widths = 1 + (x > 0x7F).astype(np.int64) + (x > 0x7FF) + (x > 0xFFFF)
    ends = np.cumsum(widths)
    out, start, base = [], 0, 0
    while base < ends[-1]:
        end = int(np.searchsorted(ends, base + capacity, side="right"))
        used = int(ends[end - 1]) - base
        last = end == len(text)
        if last and used + 1 <= capacity:
            out.append((start, end, used + 1))
            return out
        out.append((start, end, used))
        base, start = int(ends[end - 1]), end
    out.append((len(text), len(text), 1))
    return out


def token_pieces(path: str):
    """The same for a tokenizer file of the tokenizers library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True

    def pieces(text: str, capacity: int) -> list[tuple[int, int, int]]:
        offsets = t.encode(text, add_special_tokens=False).offsets
        if len(offsets) + 1 <= capacity:
            return [(0, len(text), len(offsets) + 1)]
        out, at, start = [], 0, 0
        while len(offsets) - at + 1 > capacity:
            end = at + capacity
            stop = offsets[end][0] if end < len(offsets) else len(text)
            out.append((start, stop, capacity))
            at, start = end, stop
        out.append((start, len(text), len(offsets) - at + 1))
        return out

    return pieces


def hilbert(point: list[int], bits: int) -> int:
    """Position on the Hilbert curve of a point with coordinates of ``bits`` bits."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] ^ t) >> b & 1
    return key


def curve_key(text: str, cache: dict[str, np.ndarray]) -> int:
    """Hilbert key of a text's projected word vector; every word of the text counts."""
    total: np.ndarray | None = None
    words = text.lower().split()
    for w in words:
        v = cache.get(w)
        if v is None:
            if len(cache) > 200_000:
                cache.clear()
            h = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            v = cache[w] = np.array([((h >> 8 * d) & 0xFF) / 127.5 - 1 for d in range(DIMENSIONS)])
        total = v.copy() if total is None else total + v
    if total is None:
        return 0
    scale = sqrt(len(words) / 3)
    top = (1 << BITS) - 1
    return hilbert([min(top, int((1 + erf(c / scale / sqrt(2))) / 2 * (top + 1))) for c in total.tolist()], BITS)


def _items(capacity: int, tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = byte_pieces if tokenizer == "bytes" else token_pieces(tokenizer)
        cache: dict[str, np.ndarray] = {}
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                key = curve_key(text, cache)
                rows += [(doc, i, s, e, n, key) for i, (s, e, n) in enumerate(pieces(text, capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "from", "to", "tokens", "key"])

    return run


def pack(sizes: list[int], capacity: int, open_limit: int = OPEN) -> list[int]:
    """Container number of each item, best fit among the open containers, leftovers merged; numbers start at 0."""
    where: list[int] = []
    left: list[tuple[int, int]] = []  # (room, container), ascending
    count = 0
    for size in sizes:
        k = bisect_left(left, (size, -1))
        if k < len(left):
            room, c = left.pop(k)
        else:
            room, c = capacity, count
            count += 1
        where.append(c)
        if room - size > 0:
            insort(left, (room - size, c))
            if len(left) > open_limit:
                left.pop(0)
    # Containers still open are items themselves: put each into the fullest other that has room for it.
    into: dict[int, int] = {}
    still: list[tuple[int, int]] = []
    for room, c in left:
        filled = capacity - room
        k = bisect_left(still, (filled, -1))
        if k < len(still):
            r, d = still.pop(k)
            into[c] = d
            insort(still, (r - filled, d))
        else:
            insort(still, (room, c))
    names: dict[int, int] = {}
    return [names.setdefault(into.get(c, c), len(names)) for c in where]


def _pack(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, used, held, have = TaskContext.get().partitionId() << 33, 0, [], 0

        def flush() -> pd.DataFrame:
            nonlocal used
            b = pd.concat(held, ignore_index=True)
            numbers = pack(b["tokens"].tolist(), capacity)
            b["container"] = [base + used + c for c in numbers]
            used += max(numbers) + 1
            return b[["container", "doc_id", "piece", "from", "to", "tokens"]]

        for b in batches:
            if len(b):
                held.append(b)
                have += len(b)
            if have >= STRETCH:
                yield flush()
                held, have = [], 0
        if held:
            yield flush()

    return run


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = "bytes", per_range: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(container, doc_id, piece, from, to, tokens): every text, its pieces as character ranges, and where they went.

    ``per_range``: number of ranges of the curve; by default the session's shuffle partitions. Items are written before
    they are ranged, for finding the ranges' bounds reads them once more.
    """
    items = documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(
        _items(capacity, tokenizer), "doc_id bigint, piece int, from bigint, to bigint, tokens bigint, key bigint"
    )
    items = (scratch or Scratch(documents.sparkSession)).keep(items)
    order = ["key", "doc_id", "piece"]
    ranges = items.repartitionByRange(per_range, *order) if per_range else items.repartitionByRange(*order)
    return ranges.sortWithinPartitions(*order).mapInPandas(_pack(capacity), "container bigint, doc_id bigint, piece int, from bigint, to bigint, tokens bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, fill: one row."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return per.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("tokens") > capacity).alias("overfull"), F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("fill"),
    )
