"""Dictionary-driven decoding of stored nodes: longest roots, pieces, pointers, codes, dates, redaction.

The root of a ref is found by equi-joins: every prefix of the ref that ends at ``(`` or ``,`` is a candidate, so
no theta join meets the data; the dictionary side is joined by shuffle unless it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fileman_date
from .skew import skew_join

# Field names whose pieces are credentials.
SENSITIVE = r"(?i)\b(access code|verify code|password|pass ?word|electronic signature|signature code|security key|secret|token|pin)\b|cryptographic"
REDACTED = "<redacted>"


def longest_root(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (ref, ...) with ``root`` and ``file`` of the longest root that begins the ref, or nulls; rest = what follows."""
    cuts = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.length("ref")), lambda i: F.when(F.substring(F.col("ref"), i, F.lit(1)).isin("(", ","), F.substring(F.col("ref"), F.lit(1), i))), lambda p: p.isNotNull()))
    tried = nodes.select("ref").where(F.length("ref") > 0).distinct().select("ref", F.explode(cuts).alias("root"))
    known = roots.groupBy("root").agg(F.min("file").alias("file"))
    best = skew_join(tried, known, ["root"]).groupBy("ref").agg(F.max(F.struct(F.length("root").alias("n"), "root", "file")).alias("m"))
    j = nodes.join(best.select("ref", "m.root", "m.file"), "ref", "left")
    return j.withColumn("rest", F.when(F.col("root").isNotNull(), F.substring(F.col("ref"), F.length("root") + 1, F.length("ref"))))


def subscripts(rest) -> F.Column:
    """Subscripts of a flat ref's rest; quotes around a subscript go, commas inside quotes stay."""
    bare = F.regexp_replace(rest, r"\)$", "")
    found = F.regexp_extract_all(bare, F.lit(r'("(?:[^"]|"")*"|[^,"]+)'), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"')))


def storage(fields: DataFrame) -> DataFrame:
    """Adds node and position from a storage text ``node;piece``; position only where it is all digits."""
    parts = F.split("storage", ";", 2)
    piece = F.try_element_at(parts, F.lit(2))
    return fields.withColumn("node", parts[0]).withColumn("position", F.when(piece.rlike("^[0-9]+$"), piece.try_cast("int")))


def type_of(code) -> F.Column:
    """Kind of a field's type text: multiple (leads with a number), pointer (P and a file), else its first known letter."""
    bare = F.regexp_replace(code, "^R", "")
    # Type letters.
    letters = {"D": "date", "N": "number", "S": "set", "F": "text", "V": "variable pointer", "W": "word processing", "K": "code", "C": "computed", "P": "pointer"}
    first = F.regexp_extract(bare, "([DNSFVWKCP])", 1)
    named = F.coalesce(*[F.when(first == k, v) for k, v in letters.items()])
    return F.when(bare.rlike(r"^\d"), "multiple").otherwise(named)


def pointer_file(code) -> F.Column:
    n = F.regexp_extract(code, r"P(\d+(?:\.\d+)?)", 1)
    return F.nullif(n, F.lit(""))


def set_codes(codes) -> F.Column:
    """map(code, meaning) of ``k:v;k:v``; the first colon parts them, a repeated code keeps its last meaning."""
    pairs = F.filter(F.transform(F.split(codes, ";", -1), lambda x: F.split(x, ":", 2)), lambda p: F.size(p) == 2)
    keys = F.transform(pairs, lambda p: F.trim(p[0]))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v"), i.alias("i"))), lambda e: F.size(F.filter(F.slice(keys, e["i"] + 2, F.size(keys)), lambda k: k == e["k"])) == 0)
    return F.map_from_arrays(F.transform(last, lambda e: e["k"]), F.transform(last, lambda e: e["v"]))


def pieces(nodes: DataFrame, keys: list[str], value: str = "value", delimiter: str = r"\^") -> DataFrame:
    """(keys, position, raw): pieces of each value from 1; trailing empty pieces stay. Null values give none."""
    return nodes.where(F.col(value).isNotNull()).select(*keys, F.posexplode(F.split(value, delimiter, -1)).alias("i", "raw")).select(*keys, (F.col("i") + 1).alias("position"), "raw")


def decode(nodes: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, raw, name, kind, decoded): pieces with their fields by (file, node, position).

    A piece without a field is dropped if empty and kept unnamed otherwise. Codes decode to their meaning, dates to ISO.
    """
    p = pieces(nodes, keys)
    of = fields.select("file", "node", "position", "name", "kind", "codes")
    j = p.join(of, [k for k in ("file", "node") if k in keys] + ["position"], "left").where(F.col("name").isNotNull() | (F.col("raw") != ""))
    meaning = F.try_element_at(set_codes(F.coalesce("codes", F.lit(""))), F.col("raw"))
    text = F.when(F.col("raw") == "", "").when(F.col("kind") == "set", F.coalesce(meaning, F.col("raw"))).when(F.col("kind") == "date", F.coalesce(fileman_date(F.col("raw")), F.col("raw"))).otherwise(F.col("raw"))
    return j.select(*keys, "position", "raw", "name", "kind", text.alias("decoded"))


def dereference(decoded: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``pointed``: the name of the record a pointer piece names; targets (file, record, label)."""
    t = targets.select(F.col("file").alias("to_file"), F.col("record").cast("string").alias("raw"), F.col("label").alias("pointed"))
    return skew_join(decoded, t, ["to_file", "raw"], "left")


def redact(nodes: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with credential pieces replaced, and ``redactions``: how many of a value's non-empty pieces were."""
    secret = fields.where(F.col("name").rlike(SENSITIVE) & F.col("position").isNotNull()).groupBy("file", "node").agg(F.collect_set("position").alias("secret"))
    j = nodes.join(secret, ["file", "node"], "left").withColumn("ps", F.split("value", r"\^", -1))
    hit = lambda x, i: F.coalesce(F.array_contains("secret", (i + 1).cast("int")), F.lit(False)) & (x != "")
    out = F.array_join(F.transform("ps", lambda x, i: F.when(hit(x, i), REDACTED).otherwise(x)), "^")
    n = F.size(F.filter(F.transform("ps", lambda x, i: hit(x, i)), lambda h: h))
    return j.select(*keys, out.alias("value"), n.alias("redactions"))


def parse_dump(dump: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, fields) of H| and D| lines; fields whose file has no header line and short lines are dropped."""
    parts = F.split("line", r"\|", -1)
    h = dump.where(F.col("line").startswith("H|")).select(parts.alias("p")).where(F.size("p") >= 6)
    files = h.select(F.col("p")[1].alias("file"), F.col("p")[2].alias("name"), F.col("p")[3].alias("root"), F.nullif(F.col("p")[4], F.lit("")).alias("parent"), F.col("p")[5].try_cast("int").alias("fields"))
    f = dump.where(F.col("line").startswith("D|")).select(parts.alias("p")).where(F.size("p") >= 7)
    fields = f.select(F.col("p")[1].alias("file"), F.col("p")[2].alias("field"), F.col("p")[3].alias("name"), F.col("p")[4].alias("type"), F.col("p")[5].alias("codes"), F.col("p")[6].alias("storage"))
    return files, fields.join(files.select("file"), "file", "left_semi")


def field_order(fields: DataFrame) -> DataFrame:
    """Fields by numeric value, those that are no numbers last."""
    return fields.orderBy(F.col("field").try_cast("double").asc_nulls_last(), "field")


def resolve(wanted: DataFrame, roots: DataFrame, fields: DataFrame, samples: DataFrame, most: int = 3) -> DataFrame:
    """(ref, file, record, node, layout, samples, notes): what a reference stands for.

    The longest root gives the file, the subscripts after it the record and the node; ``layout`` lists the node's
    fields by position; ``samples`` are up to ``most`` stored values, that of the very reference first, then others of
    the same file and node. ``notes`` say what is missing.
    """
    placed = longest_root(wanted.select("ref").distinct(), roots).withColumn("subs", subscripts(F.coalesce("rest", F.lit(""))))
    at = placed.select("ref", "file", F.get("subs", F.lit(0)).alias("record"), F.get("subs", F.lit(1)).alias("node"), F.size("subs").alias("depth"))
    by_node = fields.where(F.col("position").isNotNull()).groupBy("file", "node").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("layout"))  # a node's own fields
    known = longest_root(samples.select("ref", "value"), roots).withColumn("subs", subscripts(F.coalesce("rest", F.lit("")))).select(F.col("ref").alias("sample_ref"), "value", "file", F.get("subs", F.lit(1)).alias("node"))
    # At most ``most`` samples of a node travel, and the exact one apart from them.
    w = Window.partitionBy("file", "node").orderBy("sample_ref")
    few = known.where(F.col("file").isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).groupBy("file", "node").agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("same"))
    exact = known.select(F.col("sample_ref").alias("ref"), "value").groupBy("ref").agg(F.max("value").alias("exact"))
    j = skew_join(skew_join(at, by_node, ["file", "node"], "left"), few, ["file", "node"], "left").join(exact, "ref", "left")
    same = F.transform(F.coalesce("same", F.array().cast("array<struct<rn:int,value:string>>")), lambda x: x["value"])
    shown = F.slice(F.array_distinct(F.array_compact(F.concat(F.array("exact"), same))), 1, most)
    notes = F.array_compact(F.array(F.when(F.col("file").isNull(), "no file has this root"), F.when(F.col("file").isNotNull() & F.col("layout").isNull(), "no field on this node"), F.when(F.col("exact").isNull(), "no stored value of its own"), F.when(F.col("depth") > 2, "deeper than one multiple")))
    return j.select("ref", "file", "record", "node", "layout", shown.alias("samples"), notes.alias("notes"))


def dictionary_counts(files: DataFrame, fields: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files, fields, roots, nodes and redactions (null counts none) of a decoded dictionary."""
    f = files.agg(F.count("*").alias("files"), F.countDistinct("root").alias("roots"))
    one = f.join(F.broadcast(fields.agg(F.count("*").alias("fields"))))  # one row each
    return one.join(F.broadcast(nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("redactions"), F.lit(0)).alias("redactions"))))
