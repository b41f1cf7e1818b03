"""File sources and sinks: source directories, manuals, traces, manifests, dumps; write-once and append-only outputs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines

MAX_FILE, MAX_CATALOG, MAX_FILES = 5_000_000, 25_000_000, 2_000


def name_for_file(path) -> F.Column:
    """Routine name of a file: base name without its ending, ``_X`` as ``%X``; null where that is no name."""
    base = F.upper(F.trim(F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[mM]$", "")))
    name = F.regexp_replace(base, "^_", "%")
    return F.when(name.rlike("^%?[A-Z][A-Z0-9]*$"), name)


def file_for_name(name) -> F.Column:
    return F.concat(F.regexp_replace(F.upper(F.trim(name)), "^%", "_"), F.lit(".m"))


def source_directory(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(name, source, path, sha256): all ``*.m`` below ``path``; malformed bytes become U+FFFD, the hash is of the bytes.

    ``limit`` keeps the first files in order of path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.m").load(path).select("path", "content")
    hidden = _underscored(spark, path)
    if hidden:
        raw = raw.unionByName(spark.createDataFrame([(p,) for p in hidden], "path string").mapInPandas(_read_bytes, "path string, content binary"))
    out = raw.select(name_for_file(F.col("path")).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"), "path", F.sha2("content", 256).alias("sha256"))
    return out.orderBy("path").limit(limit) if limit else out


def _read_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for b in batches:
        content = []
        for p in b["path"]:
            where, name = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
            with where.open_input_file(name) as f:
                content.append(f.read())
        yield b.assign(content=content)


def _underscored(spark: SparkSession, path: str) -> list[str]:
    """Paths of ``_X.m`` below ``path``: Spark's file sources pass over names that begin with an underscore."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    it = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while it.hasNext():
        p = it.next().getPath()
        if p.getName().startswith("_") and p.getName().endswith(".m"):
            found.append(p.toString())
    return found


def with_fallback(wanted: DataFrame, corpus: DataFrame, fallback: DataFrame) -> DataFrame:
    """(name, source, origin) of wanted names: from the corpus, else from the fallback, else missing."""
    c = corpus.select("name", F.col("source").alias("a"))
    f = fallback.select("name", F.col("source").alias("b"))
    j = wanted.select("name").distinct().join(c, "name", "left").join(f, "name", "left")
    return j.select("name", F.coalesce("a", "b").alias("source"), F.when(F.col("a").isNotNull(), "corpus").when(F.col("b").isNotNull(), "fallback").otherwise("missing").alias("origin"))


def _folder(path: str) -> str:
    """The folder of a path as it begins file paths: one leading slash, one at the end."""
    return "/" + re.sub("^[a-z]+:/*", "", path).strip("/") + "/"


def manuals(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """(document, path, text) of .md, .txt and .rst files, their paths relative to ``path``; fails where a file, their sum or their number is too large."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt,rst}").load(path)
    sizes = raw.agg(F.coalesce(F.max("length"), F.lit(0)).alias("most"), F.coalesce(F.sum("length"), F.lit(0)).alias("all"), F.count("*").alias("files"))
    ok = (F.col("most") <= MAX_FILE) & (F.col("all") <= MAX_CATALOG) & F.col("files").between(1, MAX_FILES)
    guard = sizes.select(F.assert_true(ok, "no documents, or more than the catalog's limits").alias("guard"))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("^" + re.escape(_folder(path))), F.lit(""))
    doc = F.concat(F.lit(source_id + ":"), F.substring(F.sha2(rel, 256), 1, 16))
    return raw.join(F.broadcast(guard)).where(F.col("guard").isNull()).select(doc.alias("document"), rel.alias("path"), F.col("content").cast("string").alias("text"))  # one row


MANIFEST = "version int, sources array<struct<id:string,title:string,path:string,kind:string,tags:array<string>,file_patterns:array<string>,priority:int,origin:string,language:string>>"
FIELDS = {"id", "title", "path", "kind", "tags", "file_patterns", "priority", "origin", "language"}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a manifest; fails on another version, unknown fields, bad or repeated ids and priorities beyond 0 to 10."""
    text = spark.read.text(path, wholetext=True)
    seen = text.select(F.explode(F.from_json(F.get_json_object("value", "$.sources"), "array<map<string,string>>")).alias("m")).select(F.explode(F.map_keys("m")).alias("k")).distinct()
    unknown = [r["k"] for r in seen.where(~F.col("k").isin(*FIELDS)).limit(10).collect()]
    if unknown:
        raise ValueError(f"unknown manifest fields: {sorted(unknown)}")
    m = text.select(F.from_json("value", MANIFEST).alias("m")).select(F.assert_true(F.col("m.version").eqNullSafe(1), "manifest version").alias("v"), F.explode("m.sources").alias("s"))
    rows = m.where(F.col("v").isNull()).select("s.*")
    bad = rows.where(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$"), F.lit(False)) | ~F.coalesce("priority", F.lit(0)).between(0, 10)).limit(1).count()
    twice = rows.groupBy("id").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("manifest: bad or repeated id, or priority beyond 0 to 10")
    return rows.withColumn("priority", F.coalesce("priority", F.lit(0)))


TRACE = "condition string, task_id string, attempt int, run_id string, routine string, operator string, difficulty string, model string, seed bigint, started_at string, finished_at string, submitted boolean, candidate_src string, assertion struct<claimed_correct:boolean,source:string,evidence:string>, tool_calls array<struct<name:string,ok:boolean,equivalent:boolean,at:string,detail:string>>, verifier_calls int, verdict struct<equivalent:boolean,n_cases:int,n_diverged:int,n_void:int>, harness_error string"
CONDITIONS = ["baseline", "scaffolded", "tuned_scaffolded"]


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of every line that is not blank in JSONL files."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", F.posexplode(lines(F.col("value"))).alias("i", "value")).where(F.trim("value") != "").select("path", (F.col("i") + 1).alias("line"), "value")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Typed attempt records with ``extra`` (unknown fields as text); a bad line fails with its file and line.

    condition, task_id and an integer attempt of 1 or more are required; true is no integer. ``submitted`` defaults to
    whether a candidate is there.
    """
    ls = trace_lines(spark, path).withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.attempt", "variant"))
    typed = ls.withColumn("r", F.from_json("value", TRACE)).withColumn("whole", F.coalesce(kind == "BIGINT", F.lit(False)))
    ok = F.col("v").isNotNull() & F.col("r.condition").isin(CONDITIONS) & F.col("r.task_id").isNotNull() & F.col("whole") & (F.col("r.attempt") >= 1)
    where = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": not an attempt record"))
    known = [x.split()[0] for x in TRACE.replace("struct<", "struct<").split(", ")]
    extra = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(known))
    checked = typed.withColumn("guard", F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.raise_error(where)))
    out = checked.where(F.col("guard").isNull()).select("r.*", extra.alias("extra"))
    return out.withColumn("submitted", F.coalesce("submitted", F.col("candidate_src").isNotNull()))


def read_traces_leniently(spark: SparkSession, path: str) -> DataFrame:
    """Records of the lines that parse; a partial last line is dropped."""
    ls = trace_lines(spark, path)
    return ls.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", TRACE).alias("r")).select("r.*")


def newest(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, modified) of the newest file; ties go to the greater path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).select("m.path", F.col("m.modificationTime").alias("modified")).where(F.col("path").isNotNull())


def write_jsonl(df: DataFrame, path: str, append: bool = False, compression: str = "none") -> None:
    """One JSON object per line, null fields written."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").option("compression", compression).json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Refuses a path that exists."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def lock_document(sides: DataFrame) -> DataFrame:
    """One row: train and eval names in order, their numbers, and a hash over both lists."""
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.upper("name"))))
    d = sides.agg(of("train").alias("train"), of("eval").alias("eval"))
    digest = F.sha2(F.concat(F.array_join("train", ","), F.lit("|"), F.array_join("eval", ",")), 256)
    return d.select("eval", digest.alias("hash"), F.size("eval").alias("n_eval"), F.size("train").alias("n_train"), "train")


def lock_holds(lock: DataFrame, sides: DataFrame) -> DataFrame:
    """One row: whether the lock's hash is that of the sides."""
    return lock.select(F.col("hash").alias("a")).join(lock_document(sides).select(F.col("hash").alias("b"))).select(F.col("a").eqNullSafe(F.col("b")).alias("holds"))


def receipt(df: DataFrame, **counts: F.Column) -> DataFrame:
    """One row of counts with a hash over their JSON text, keys in order."""
    row = df.agg(*[counts[k].alias(k) for k in sorted(counts)])
    return row.withColumn("sha256", F.sha2(F.to_json(F.struct(*sorted(counts))), 256))


def dump_lines(spark: SparkSession, path: str, end: str = "ENDDD") -> DataFrame:
    """Lines of a dictionary dump; fails where its end marker is missing, for the dump was cut short."""
    ls = spark.read.text(path).select(F.col("value").alias("line"))
    whole = ls.agg(F.coalesce(F.bool_or(F.contains("line", F.lit(end))), F.lit(False)).alias("ok")).select(F.assert_true("ok", "the dump has no end marker").alias("guard"))
    return ls.join(F.broadcast(whole)).where(F.col("guard").isNull()).select("line")  # one row


def dump_samples(dump: DataFrame) -> DataFrame:
    """(root, ref, value) of S| lines; the value keeps further bars."""
    p = dump.where(F.col("line").startswith("S|")).select(F.split("line", r"\|", 4).alias("p")).where(F.size("p") == 4)
    return p.select(F.col("p")[1].alias("root"), F.col("p")[2].alias("ref"), F.col("p")[3].alias("value"))


def task_set(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Tasks of a task-set document; fails where a task lacks a field, its cases name another routine, or its source changed."""
    schema = "schema string, tasks array<struct<task_id:string,routine:string,baseline_src:string,mutated_src:string,cases:array<struct<routine:string,entry:string,args:array<string>>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("tasks").alias("t")).select("t.*")
    known = sources.select("routine", F.sha2("source", 256).alias("_want")).dropDuplicates(["routine"])
    j = rows.join(known, "routine", "left")
    blank = F.exists(F.array("task_id", "routine", "baseline_src", "mutated_src"), lambda c: F.coalesce(c, F.lit("")) == "")
    strayed = F.exists(F.coalesce("cases", F.array()), lambda c: ~c["routine"].eqNullSafe(F.col("routine")))
    bad = F.when(blank, "missing field").when(strayed, "case of another routine").when(~F.sha2("baseline_src", 256).eqNullSafe(F.col("_want")), "source changed")
    checked = j.withColumn("_g", F.when(bad.isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.coalesce("task_id", F.lit("?")), F.lit(": "), bad))))
    return checked.where(F.col("_g").isNull()).drop("_g", "_want")


def names_set(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a text file with one name per line, upper-cased; a missing file is an empty set."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "name string")
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("name")).where("name <> ''").distinct()


def resolve_models(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """(model, resolved): registered names by their id, others as they are."""
    r = registry.groupBy("name").agg(F.max("model_id").alias("model_id"))
    return wanted.join(r, wanted["model"] == r["name"], "left").select("model", F.coalesce("model_id", "model").alias("resolved"))


def document(df: DataFrame, order: str, top: int, **counts: F.Column) -> DataFrame:
    """(document): one JSON text with counts and the first ``top`` rows in order; top-k before it is gathered."""
    rows = df.orderBy(order).limit(top).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order]))).alias("rows"))
    return df.agg(*[c.alias(k) for k, c in counts.items()]).join(F.broadcast(rows)).select(F.to_json(F.struct(*counts, "rows")).alias("document"))  # one row


def write_tasks(df: DataFrame, path: str) -> None:
    """Refuses an empty set and a path that exists."""
    if df.isEmpty():
        raise ValueError("no tasks")
    write_once(df, path)


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    """Puts ``old`` in the place of ``new`` with two renames; what was there comes back if the second one fails."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (old, new, new + ".before"))
    fs = b.getFileSystem(conf)
    fs.delete(kept, True)
    had = fs.exists(b) and fs.rename(b, kept)
    if not fs.rename(a, b):
        if had:
            fs.rename(kept, b)
        raise OSError(f"{new} could not be replaced")
    fs.delete(kept, True)


def replace_json(df: DataFrame, path: str) -> None:
    """JSON lines at ``path``, whole or not at all: written beside it first, then renamed. A failed write leaves the old rows."""
    beside = path.rstrip("/") + ".new"
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(beside)
    _renamed(df.sparkSession, beside, path.rstrip("/"))


def change_models(registry: DataFrame, add: DataFrame | None = None, remove: list[str] | None = None) -> DataFrame:
    """(name, model_id): the registry after changes; fails where a new name is no name or shadows a known one."""
    kept = registry.where(~F.coalesce(F.col("name").isin(*remove), F.lit(False))) if remove else registry
    if add is None:
        return kept.select("name", "model_id")
    known = kept.select("name").withColumn("_known", F.lit(True))
    wrong = F.when(~F.coalesce(F.col("name").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False)), "no name").when(F.col("_known"), "known already")
    checked = add.join(known, "name", "left").withColumn("_g", F.when(wrong.isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.coalesce("name", F.lit("?")), F.lit(": "), wrong))))
    return kept.select("name", "model_id").unionByName(checked.where(F.col("_g").isNull()).select("name", "model_id"))


EVENT = "kind string, run_id string, ts string, task_id string, routine string, condition string, attempt int, backend string, diff string, explanation string, agent_visible boolean, agent_claimed_success boolean, verified_equivalent boolean, source string, error string, cases array<struct<case_index:int,divergences:array<struct<kind:string,ref:string>>>>"


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, problems) of JSONL event logs: typed events with path and line, and (path, line, problem) of lines that
    are no JSON objects or have no kind. Nothing fails; an empty log has neither."""
    ls = trace_lines(spark, path).withColumn("v", F.try_parse_json("value")).withColumn("e", F.from_json("value", EVENT))
    good = F.col("v").isNotNull() & F.col("e.kind").isNotNull()
    problem = F.when(F.col("v").isNull(), "not JSON").otherwise("no kind of event")
    return ls.where(good).select("path", "line", "e.*"), ls.where(~good).select("path", "line", problem.alias("problem"))


CACHE = "schema string, files map<string,struct<name:string,root:string,fields:map<string,array<string>>>>"


def dictionary_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, fields) of a gzipped dictionary cache; a missing cache is an empty dictionary.

    files (file, name, root), fields (file, field, name, type, codes, storage).
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raw = spark.read.schema(CACHE).option("multiLine", "true").json(path)
    else:
        raw = spark.createDataFrame([], CACHE)
    of = raw.select(F.explode("files").alias("file", "f"))
    fields = of.select("file", F.explode("f.fields").alias("field", "v"))
    part = lambda i: F.get("v", F.lit(i))
    return of.select("file", "f.name", "f.root"), fields.select("file", "field", part(0).alias("name"), part(1).alias("type"), part(2).alias("codes"), part(3).alias("storage"))


def write_dictionary_cache(files: DataFrame, fields: DataFrame, path: str) -> None:
    """One gzipped JSON document of a dictionary, for ``dictionary_cache``; a dictionary is bounded by its files."""
    per = fields.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", F.array("name", "type", "codes", "storage")))).alias("fields"))
    j = files.join(per, "file", "left").select("file", F.struct("name", "root", F.coalesce("fields", F.create_map().cast("map<string,array<string>>")).alias("fields")).alias("f"))
    one = j.agg(F.map_from_entries(F.collect_list(F.struct("file", "f"))).alias("files")).select(F.lit("dictionary/1").alias("schema"), "files")
    one.coalesce(1).write.mode("overwrite").option("compression", "gzip").json(path)


def vendor_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, url, sha256, bytes) of a manifest of downloaded files; fails where one lacks its digest or stands twice."""
    schema = "files array<struct<path:string,url:string,sha256:string,bytes:bigint>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("files").alias("f")).select("f.*")
    times = rows.groupBy("path").agg(F.count("*").alias("_n"))
    bad = F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "no digest").when(F.col("_n") > 1, "twice")
    checked = rows.join(times, "path").withColumn("_g", F.when(bad.isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat("path", F.lit(": "), bad))))
    return checked.where(F.col("_g").isNull()).drop("_g", "_n")
