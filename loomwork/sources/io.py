"""Readers and writers: local-first datasets, nested JSON results, survey CSV, score maps, logs, checkpoints, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.positions import numbered
from ..session import kept
from . import nested

SPLITS = ["test", "validation", "train"]


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, for any store that Spark can reach."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """True if there is a file, or a folder with something in it; of a pattern, if it matches such."""
    p, fs = hadoop(spark, path)
    return any(s.isFile() or len(fs.listStatus(s.getPath())) > 0 for s in fs.globStatus(p) or [])


def local_first(spark: SparkSession, path: str, fallback) -> DataFrame:
    """The copy at ``path`` if there is one; else what ``fallback(spark)`` reads."""
    return spark.read.parquet(path) if exists(spark, path) else fallback(spark)


def pick_split(df: DataFrame, column: str = "split", wanted: list[str] | None = None) -> DataFrame:
    """Rows of the first split that has any, by priority; the column goes. No split at all is an error, no column means a single split."""
    if column not in df.columns:
        return df
    there = {r[0] for r in df.where(F.col(column).isin(wanted or SPLITS)).select(column).distinct().collect()}
    for name in wanted or SPLITS:
        if name in there:
            return df.where(F.col(column) == name).drop(column)
    raise ValueError(f"none of the splits {wanted or SPLITS}")


def route(df: DataFrame, column: str, routes: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The rows of each consumer's sources. Every consumer scans with its own filter, which reaches the files, so that nothing is kept in memory or on local disks."""
    return {name: df.where(F.col(column).isin(sources)) for name, sources in routes.items()}


PREDICTION = T.StructType([T.StructField(c, T.StringType()) for c in ("country", "group", "gold", "pred", "us_pred", "mcqid")] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("scores", "us_scores")])
RESULT = T.StructType(
    [
        T.StructField("condition", T.StringType()), T.StructField("benchmark", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_unparseable", T.LongType()),
        T.StructField("accuracy_overall", T.DoubleType()), T.StructField("accuracy_by_group", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("accuracy_by_country", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Headers of result documents, one row each; the parser skips the predictions. A missing file is an empty frame, so that a left join from the conditions shows it as blanks."""
    if not exists(spark, path):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).json(path, multiLine=True)


def uri(c: Column | str) -> Column:
    """A path without the empty host that some readers write and some do not."""
    return F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")


def read_predictions(spark: SparkSession, path: str, size: int = nested.RANGE) -> DataFrame:
    """All predictions of result documents, numbered by their place in their document (``row_idx``); documents are read by ranges of bytes."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType(RESULT.fields[:2] + [T.StructField("row_idx", T.LongType())] + PREDICTION.fields))
    head = spark.read.schema(RESULT).json(path, multiLine=True).select(uri("_metadata.file_path").alias("file"), "condition", "benchmark")
    rows = nested.read_entries(spark, path, "predictions", size).select(uri("file").alias("file"), "place", F.from_json("value", PREDICTION).alias("p"))
    placed = numbered(rows, "file", "place", name="at")
    first = placed.groupBy("file").agg(F.min("at").alias("first"))
    return placed.join(first, "file").join(head, "file").select("condition", "benchmark", (F.col("at") - F.col("first")).alias("row_idx"), "p.*")


def write_result(predictions: DataFrame, condition: str, benchmark: str, path: str) -> None:
    """One result document at ``path``: header, accuracy maps, and the predictions in the order of ``row_idx``, which stream into it in sorted parts."""
    right = (F.col("pred") == F.col("gold")).cast("double")
    rows = predictions.withColumn("__right", right)
    # A row by group and one by country, a few dozen; the predictions stay where they are.
    by = {c: {r[0]: r[1] for r in rows.where(F.col(f"`{c}`").isNotNull()).groupBy(f"`{c}`").agg(F.avg("__right")).orderBy(f"`{c}`").collect()} for c in ("group", "country")}
    head = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("pred") == "unparseable", 1)).alias("n_unparseable"), F.avg("__right").alias("accuracy_overall")).first().asDict()
    document = {"condition": condition, "benchmark": benchmark, **head, "accuracy_by_group": by["group"], "accuracy_by_country": by["country"]}
    fields = [f.name for f in PREDICTION.fields if f.name in predictions.columns]
    lines = predictions.select("row_idx", F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields])).alias("value"))
    nested.write_stream(lines, "value", ["row_idx", "value"], path, json.dumps(document)[:-1] + ', "predictions": [', "]}")


def write_map(rows: DataFrame, key: str, value: str, path: str, member: str | None = None) -> None:
    """One JSON object at ``path``, or its only ``member``: texts in ``key`` to JSON texts in ``value``, in the order of the keys."""
    entry = F.concat(F.expr(f"substr(to_json(array(`{key}`)), 2, length(to_json(array(`{key}`))) - 2)"), F.lit(":"), F.col(f"`{value}`"))
    nested.write_stream(rows.select(F.col(f"`{key}`").alias("key"), entry.alias("value")), "value", ["key", "value"], path, "{" if member is None else "{" + json.dumps(member) + ": {", "}" if member is None else "}}")


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """Five of a survey's 500 columns, typed: country (quotes off; blank and -4 dropped), weight, x, y."""
    from ..functions.regions import guarded, weight

    raw = spark.read.option("header", True).csv(path).select("B_COUNTRY_ALPHA", "W_WEIGHT", "SACSECVAL", "RESEMAVAL")
    code = F.trim(F.regexp_replace("B_COUNTRY_ALPHA", '"', ""))
    rows = raw.select(code.alias("country"), weight("W_WEIGHT").alias("w"), guarded("SACSECVAL").alias("x"), guarded("RESEMAVAL").alias("y"))
    return rows.where("country is not null and country <> '' and country <> '-4'")


def read_coordinates(spark: SparkSession, path: str, require: bool = False) -> DataFrame:
    """The country table: iso, name, cluster, inferred, x, y, distance, n; with ``require`` only rows that have coordinates."""
    raw = spark.read.option("header", True).csv(path)
    d = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    out = raw.select(
        F.col("country_iso").alias("iso"), F.nullif("normad_country", F.lit("")).alias("name"), "cluster", (F.col("cluster_inferred") == "yes").alias("inferred"),
        d("sacsecval").alias("x"), d("resemaval").alias("y"), d("dist_from_english").alias("distance"), F.expr("try_cast(n_respondents AS INT)").alias("n"),
    )
    return out.where("x is not null and y is not null") if require else out


def cluster_dimension(coordinates: DataFrame) -> DataFrame:
    """name, cluster; names that are blank go."""
    return coordinates.where("name is not null").select("name", "cluster")


def read_score_map(spark: SparkSession, path: str, size: int = nested.RANGE) -> DataFrame:
    """Nested score maps to long rows: module_name, layer_idx, neuron_idx, country, score. Documents are read by ranges of bytes, a neuron at a time."""
    from ..functions.text import neuron_key

    entries = nested.read_entries(spark, path, "neuron_scores", size)
    rows = entries.select(neuron_key("key").alias("k"), F.explode(F.from_json("value", "map<string, double>")).alias("country", "score"))
    return rows.select("k.*", "country", "score")


def read_tag_cache(spark: SparkSession, path: str, strict: bool = True, size: int = nested.RANGE) -> DataFrame:
    """key and tags of a cache document, read by ranges of bytes. Old caches, with plain strings for tags, are an error, or empty if not ``strict``; so is a missing one.

    A key's tags are an object, or a text that holds one.
    """
    fields = ["culture_tag", "domain_tag", "task_intent_tag", "language"]
    empty = spark.createDataFrame([], "key string, " + ", ".join(f"{f} string" for f in fields))
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return empty
    text = F.when(F.col("value").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]).otherwise(F.col("value"))
    rows = kept(nested.read_entries(spark, path, size=size).select("key", text.alias("v")), "tag-cache")
    old = rows.where(~F.col("v").startswith("{")).limit(1).count()
    if old and strict:
        raise ValueError("the cache has the old format; rebuild it")
    parsed = F.from_json("v", ", ".join(f"{f} string" for f in fields))
    return empty if old else rows.select("key", parsed.alias("t")).select("key", "t.*")


def read_training_log(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """run, step, loss, margin, accuracy in logged order; absent values are null.

    A file is a run's document, and names it; with ``run`` files hold the documents of many runs, one on each line, whose field of that name names the run. So the
    number of files need not follow the number of runs.
    """
    schema = "log_history array<struct<loss: double, `rewards/margins`: double, `rewards/accuracies`: double>>"
    if run is None:
        rows = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("run"), F.posexplode("log_history").alias("step", "h"))
    else:
        rows = spark.read.schema(f"`{run}` string, {schema}").json(path).select(F.col(run).alias("run"), F.posexplode("log_history").alias("step", "h"))
    return rows.select("run", "step", F.col("h.loss").alias("loss"), F.col("h.`rewards/margins`").alias("margin"), F.col("h.`rewards/accuracies`").alias("accuracy"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, line_no, value of log files; line numbers follow the order in the file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return rows


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, modified, length of matching files, oldest first."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"), "length").orderBy("modified", "path")


def size_text(length: Column | str) -> Column:
    """A file's size as people read it: B, KB or MB, the latter two with one decimal."""
    n = F.col(length) if isinstance(length, str) else length
    shown = lambda unit, name: F.concat(F.format_string("%.1f", n / unit), F.lit(f" {name}"))
    return F.when(n > 1 << 20, shown(1 << 20, "MB")).when(n > 1 << 10, shown(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def latest_checkpoint(spark: SparkSession, parent: str, fallback: bool = False) -> str | None:
    """The ``checkpoint-N`` folder with the greatest N; a suffix that is no number ranks below all, or is skipped without fallback.

    With fallback the parent itself stands in where there is none.
    """
    p, fs = hadoop(spark, parent)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    ranked = []
    for name in names:
        if name.startswith("checkpoint-"):
            suffix = name.rsplit("-", 1)[-1]
            if suffix.isdigit() or fallback:
                ranked.append((int(suffix) if suffix.isdigit() else -1, name))
    return f"{parent.rstrip('/')}/{max(ranked)[1]}" if ranked else (parent if fallback else None)


def write_replacing(df: DataFrame, path: str) -> None:
    """Replace a dataset that may be read by ``df`` itself: write beside it, set the old one aside, rename, delete."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex[:8]
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    df.write.parquet(new)
    target, fs = hadoop(spark, path)
    had = fs.exists(target)
    if had and not fs.rename(target, hadoop(spark, old)[0]):
        raise OSError(f"cannot set {path} aside")
    if not fs.rename(hadoop(spark, new)[0], target):
        raise OSError(f"cannot put the new data at {path}")
    if had:
        fs.delete(hadoop(spark, old)[0], True)


def add_once(df: DataFrame, columns: list[str], make) -> DataFrame:
    """``make(df)``, unless all its columns are there already."""
    return df if set(columns) <= set(df.columns) else make(df)


def write_report(df: DataFrame, path: str, decimals: int = 4) -> None:
    """A CSV report in one file: doubles with fixed decimals, nulls as blanks, arrays joined by ';'. Reports have a row per condition or country."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.format_string(f"%.{decimals}f", c)
            c = F.when(F.col(f"`{f.name}`").isNotNull(), c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ";")
        shown.append(c.alias(f.name))
    df.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def number(x) -> str:
    """Signed three decimals for a difference or share, a dash for nothing."""
    if x is None:
        return "—"
    return (f"{x:+.3f}" if abs(x) < 1 else f"{x:.3f}") if isinstance(x, float) else str(x)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report as a Markdown table; for reports, which have a few rows: more than ``limit`` are an error."""
    found = df.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    rows = [df.columns, ["---"] * len(df.columns)] + [[number(v) for v in r] for r in found]
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in rows)


def parameter_counts(parameters: DataFrame) -> DataFrame:
    """total, adapter and trainable counts by model, from (model, name, numel, trainable)."""
    return parameters.groupBy("model").agg(F.sum("numel").alias("total"), F.sum(F.when(F.contains("name", F.lit("lora_")), F.col("numel")).otherwise(0)).alias("adapter"), F.sum(F.when(F.col("trainable"), F.col("numel")).otherwise(0)).alias("trainable"))


def node_summary(nodes: DataFrame, probes: DataFrame, what: str = "python3.12") -> DataFrame:
    """Status by node, from the lines (node, value) of its probe: the word after ``what:``, NO_DATA without such a line, NOT_RUN without a probe.

    A probe that wrote nothing has one row with a null value.
    """
    word = F.regexp_extract("value", rf"^{what.replace('.', '[.]')}:\s+(\S+)", 1)
    seen = probes.groupBy("node").agg(F.max(F.nullif(word, F.lit(""))).alias("status"), F.lit(True).alias("ran"))
    return nodes.join(seen, "node", "left").select("node", F.when(F.col("ran").isNull(), "NOT_RUN").otherwise(F.coalesce("status", F.lit("NO_DATA"))).alias("status"))
