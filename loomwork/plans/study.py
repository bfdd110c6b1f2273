"""More of what users of the study run, each over given tables with the SQL that gives the same rows: extraction, option orders, scoring by a model, reports, streams in disorder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims, text
from ..operators import behaviour, mentions, neurons, scoring
from ..session import kept
from ..sources import io, registry
from ..streaming import monitor
from .bindings import US, predictions, scored, table, with_tables
from .files import folder
from .queries import STOPS, assigned_of, r6, selected_and_controls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def study(sql: str, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_tables(sql, *tables)
        return f

    return add


# Extraction


@study(
    r"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') ws FROM documents),
    named AS (SELECT list_slice(ws, 1, doc_id % 3 + 1) p, CASE doc_id % 25 WHEN 24 THEN '' ELSE n_name END country FROM w JOIN nation ON n_nationkey = doc_id % 25 UNION ALL SELECT regexp_extract_all(lower(n_name), '[\p{L}\p{N}]+'), n_name FROM nation),
    names AS MATERIALIZED (SELECT p, p[1] "first", len(p) n, min(country) country FROM named WHERE len(p) > 0 GROUP BY 1),
    met AS (SELECT doc_id, i, n, country FROM (SELECT doc_id, ws, unnest(ws) word, unnest(range(len(ws))) i FROM w) JOIN names ON word = "first" WHERE list_slice(ws, i + 1, i + n) = p),
    kept AS (SELECT doc_id, list_reduce(list({'s': i, 'e': i + n, 'c': [{'s': i, 'c': country}]} ORDER BY i, n DESC), lambda a, x: CASE WHEN x.s >= a.e THEN {'s': x.s, 'e': x.e, 'c': list_concat(a.c, x.c)} ELSE a END).c c FROM met GROUP BY 1),
    told AS (SELECT doc_id, c.c country, min(c.s) s FROM (SELECT doc_id, unnest(c) c FROM kept) WHERE c.c <> '' GROUP BY 1, 2)
    SELECT doc_id, coalesce(string_agg(country, ',' ORDER BY s), '') countries, count(country) n FROM documents LEFT JOIN told USING (doc_id) GROUP BY 1"""
)
def referenced_countries(spark, d):
    """Countries that whole texts name, through a gazetteer of places (the first words of documents, by nation) and nations."""
    docs, nation = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "nation")
    place = F.array_join(F.slice(mentions.words_of("text"), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), " ")
    places = docs.join(F.broadcast(nation), F.col("doc_id") % 25 == F.col("n_nationkey")).select(place.alias("name"), F.when(F.col("doc_id") % 25 == 24, "").otherwise(F.col("n_name")).alias("country"))
    names = places.unionByName(nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("country")))
    found = mentions.referenced(docs, names, "doc_id")
    return found.select("doc_id", F.array_join("countries", ",").alias("countries"), F.size("countries").cast("long").alias("n"))


LANDS, PEOPLE = [f"({text.alternatives(x)})" for x in (dims.COUNTRY_NAMES, dims.DEMONYM_NAMES)]


def stripped_sql(c: str) -> str:
    """The six patterns one after the other, then spaces closed up and the first letter raised."""
    quoted = lambda x: x.replace("'", "''").replace("\\'", "'")
    for pattern in (rf"^\s*In\s+(?:the\s+)?{LANDS}\s*,\s*", rf"^\s*In\s+(?:a|an|the)?\s*{PEOPLE}\s+", rf"^\s*Among\s+{PEOPLE}s?\s*,\s*", rf"\bin\s+(?:the\s+)?{LANDS}\b", rf"\b{PEOPLE}\b", rf"\bfrom\s+{LANDS}\b"):
        c = f"regexp_replace({c}, '{quoted(pattern)}', '', 'gi')"
    c = f"regexp_replace(regexp_replace({c}, '\\s{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    return c


NAMED = ", ".join(f"'{x}'" for x in sorted(dims.COUNTRY_NAMES)[:40] if "'" not in x)


@study(
    f"""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'In the ' || land || ', ' || replace(coalesce(text, ''), ' and ', ' from ' || land || ' ') WHEN 1 THEN replace(coalesce(text, ''), ' of ', ' in ' || land || ', ') WHEN 2 THEN 'Among ' || land || 's, ' || coalesce(text, '') ELSE coalesce(text, '') || ' from ' || land END story
        FROM (SELECT *, [{NAMED}][doc_id % {NAMED.count(",") + 1} + 1] land FROM documents)),
    t AS (SELECT doc_id, {stripped_sql("story")} x FROM s) SELECT doc_id, upper(x[1]) || x[2:] story FROM t"""
)
def mention_free_texts(spark, d):
    """Country names off whole documents into which they were put, at the start, the end and inside."""
    names = [x for x in sorted(dims.COUNTRY_NAMES)[:40] if "'" not in x]
    body, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    land = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    put = lambda word, lead, tail: F.replace(body, F.lit(f" {word} "), F.concat(F.lit(lead), land, F.lit(tail)))
    story = F.when(k == 0, F.concat(F.lit("In the "), land, F.lit(", "), put("and", " from ", " "))).when(k == 1, put("of", " in ", ", ")).when(k == 2, F.concat(F.lit("Among "), land, F.lit("s, "), body)).otherwise(F.concat(body, F.lit(" from "), land))
    return table(spark, d, "documents").select("doc_id", text.strip_mentions(story).alias("story"))


@study(
    r"""WITH g AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') t FROM conversations), l AS (SELECT *, CASE turn % 4 WHEN 0 THEN ' ' || role || ' ' WHEN 1 THEN 'Acceptable' WHEN 2 THEN t ELSE 'NEITHER' END raw FROM g)
    SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'yes' WHEN turn % 4 = 3 THEN 'neutral' WHEN lower(trim(raw)) IN ('yes', 'acceptable', 'true', '1') THEN 'yes' WHEN lower(trim(raw)) IN ('no', 'unacceptable', 'false', '0') THEN 'no' WHEN lower(trim(raw)) IN ('neutral', 'neither', 'unclear') THEN 'neutral' END gold FROM l"""
)
def turn_labels(spark, d):
    """Gold labels from what turns say, where that is a label."""
    k = F.col("turn") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), "role", F.lit(" "))).when(k == 1, "Acceptable").when(k == 2, F.col("text")).otherwise("NEITHER")
    return table(spark, d, "conversations").select("conv_id", "turn", text.gold_label(F.lit("??"), raw).alias("gold"))


# Prompts


def order_sql(n: int) -> str:
    import itertools

    labels, orders = scoring.LABELS[:n], list(itertools.permutations(range(1, n + 1)))
    where = "" if n == 3 else " WHERE gold <> 'neutral'"
    return f"""SELECT cond, item, {n} n, array_to_string(list_transform(list_sort(list_zip(o, {labels})), lambda p: p[1] || ': ' || p[2]), ', ') options, o[list_position({labels}, gold)] answer
    FROM (SELECT *, ({[list(o) for o in orders]})[('0x' || substr(md5('order_' || item), 1, 8))::BIGINT % {len(orders)} + 1] o FROM scored{where})"""


@study(f"{order_sql(3)} UNION ALL {order_sql(2)}", "scored")
def option_orders(spark, d):
    """Three options in one of six orders, two in one of two, by the item's hash, and the number of the gold one."""
    parts = []
    for n in (3, 2):
        labels, numbers = scoring.LABELS[:n], text.permutation(n, "order", "item")
        rows = scored(spark, d) if n == 3 else scored(spark, d).where("gold <> 'neutral'")
        parts.append(rows.select("cond", "item", F.lit(n).alias("n"), text.numbered_options(labels, numbers).alias("options"), text.option_number(labels, numbers, "gold").alias("answer")))
    return parts[0].unionByName(parts[1])


def filled(template: str, land: str, story: str) -> str:
    """SQL for a template."""
    quoted = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return quoted.replace("{country}", f"' || {land} || '").replace("{scenario}", f"' || {story} || '")


@study(" UNION ALL ".join(f"SELECT cond, item, {k} k, {filled(t, 'country', 'gold')} prompt FROM scored" for k, t in enumerate(dims.REPHRASED)), "scored")
def rephrased_story_prompts(spark, d):
    return scored(spark, d).select("cond", "item", F.posexplode(text.rephrased_prompts("country", "gold")).alias("k", "prompt"))


@study(
    r"""SELECT conv_id, turn, CASE WHEN contains(b, chr(10) || chr(10)) THEN split_part(b, chr(10) || chr(10), 1) ELSE b END "before", CASE WHEN role = 'user' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE role END scenario,
    CASE WHEN turn % 2 = 0 THEN 'US' ELSE regexp_replace(role, '^\s+|\s+$', '', 'g') END country FROM (SELECT *, text || chr(10) || chr(10) || role b FROM conversations)"""
)
def story_fields(spark, d):
    """The part before a blank line, and scenario and country from the first column that has one."""
    rows = table(spark, d, "conversations")
    story = text.scenario(F.when(F.col("role") == "user", F.col("text")), F.col("role"))
    land = text.country_short(F.when(F.col("turn") % 2 == 0, F.lit(" USA ")), F.col("role"))
    return rows.select("conv_id", "turn", text.before_blank_line(F.concat("text", F.lit("\n\n"), "role")).alias("before"), story.alias("scenario"), land.alias("country"))


# A model


@study(
    """WITH p AS (SELECT doc_id, source || ' ' || text prompt, source AS land FROM documents WHERE text <> ''), q AS (SELECT land, ('N/A ' || land) prompt FROM (SELECT DISTINCT source AS land FROM documents)),
    s AS (SELECT doc_id, land, (len(prompt) - len(replace(prompt, prompt[-1:] || 'y', ''))) // 2 y, (len(prompt) - len(replace(prompt, prompt[-1:] || 'n', ''))) // 2 n, len(prompt) - len(replace(prompt, prompt[-1:], '')) c FROM p),
    m AS (SELECT land, ln(((len(prompt) - len(replace(prompt, prompt[-1:] || 'y', ''))) // 2 + 1) / (len(prompt) - len(replace(prompt, prompt[-1:], '')) + 256)) py, ln(((len(prompt) - len(replace(prompt, prompt[-1:] || 'n', ''))) // 2 + 1) / (len(prompt) - len(replace(prompt, prompt[-1:], '')) + 256)) pn FROM q)
    SELECT doc_id, round(ln((y + 1) / (c + 256)) - py, 6) yes, round(ln((n + 1) / (c + 256)) - pn, 6) AS "no", CASE WHEN round(ln((n + 1) / (c + 256)) - pn, 6) > round(ln((y + 1) / (c + 256)) - py, 6) THEN 'no' ELSE 'yes' END pred FROM s JOIN m USING (land)"""
)
def model_scores(spark, d):
    """Prompts to scores to calibrated scores to labels, with a small model in place of a large one; content-free prompts, one for each source, give the priors."""
    docs = table(spark, d, "documents")
    prompts = docs.where("text <> ''").select("doc_id", "source", F.concat_ws(" ", "source", "text").alias("prompt"))
    null = docs.select("source").distinct().withColumn("prompt", F.concat(F.lit("N/A "), "source"))
    choices = ["yes", "no"]
    rows = scoring.score_with(prompts, scoring.PromptBigrams, choices, leading_space=False)
    priors = scoring.priors_with(null, ["source"], scoring.PromptBigrams, choices, leading_space=False)
    done = scoring.calibrated(scoring.require_scores(rows), priors, ["source"]).withColumn("scores", F.transform("scores", lambda x: F.round(x, 6)))
    return done.select("doc_id", F.col("scores")[0].alias("yes"), F.col("scores")[1].alias("no"), scoring.argmax("scores", choices).alias("pred"))


# Reports


@study("""SELECT "cluster", count(*) n, count(*) FILTER (inferred) n_inferred, round(avg(round(x, 4)), 5) x, sum(n)::BIGINT people FROM assigned GROUP BY 1""", "assigned")
def coordinates_report(spark, d):
    """The country table written as a CSV report and read back as a dimension."""
    path = folder(spark, "coordinates")
    rows = assigned_of(spark, d).select(
        F.lower("country").alias("country_iso"), F.col("country").alias("normad_country"), "cluster", F.when(F.col("inferred"), "yes").otherwise("no").alias("cluster_inferred"), F.round("x", 4).alias("sacsecval"), F.round("y", 4).alias("resemaval"),
        F.lit(None).cast("double").alias("dist_from_english"), F.col("n").alias("n_respondents"),
    )
    io.write_report(rows, path)
    back = io.read_coordinates(spark, path, require=True)
    named = back.join(io.cluster_dimension(back).withColumnRenamed("cluster", "c"), "name")
    return named.groupBy(F.col("c").alias("cluster")).agg(F.count("*").alias("n"), F.count(F.when(F.col("inferred"), 1)).alias("n_inferred"), F.round(F.avg("x"), 5).alias("x"), F.sum("n").alias("people"))


@study(
    """, a AS (SELECT side, count(*) n, round(avg((pred = gold)::INT), 4) accuracy FROM predictions WHERE cond < 3 GROUP BY GROUPING SETS ((), (side))), l AS (SELECT 2 + row_number() OVER (ORDER BY side NULLS FIRST) AS line_no, '| ' || coalesce(side, '—') || ' | ' || n || ' | ' || printf('%+.3f', accuracy) || ' |' AS line FROM a)
    SELECT line_no, line FROM l UNION ALL SELECT 1, '| side | n | accuracy |' UNION ALL SELECT 2, '| --- | --- | --- |'""",
    "predictions",
)
def markdown_report(spark, d):
    """Accuracy by side and over all, as the lines of a Markdown table."""
    rows = predictions(spark, d).where("cond < 3").withColumn("r", behaviour.right())
    report = rows.groupingSets([[], [F.col("side")]], "side").agg(F.count("*").alias("n"), F.round(F.avg("r"), 4).alias("accuracy")).orderBy(F.asc_nulls_first("side"))
    return spark.createDataFrame(list(enumerate(io.markdown(report).split("\n"), 1)), "line_no long, line string")


@study(
    """SELECT CASE WHEN contains(lower(b), 'coig-p') THEN 'turns' WHEN contains(lower(b), 'pku-saferlhf') THEN 'oriented' ELSE 'transcripts' END loader, count(*) n, count(DISTINCT b) AS "names"
    FROM (SELECT 'org/' || ['Coig-p', 'PKU-SafeRLHF-30K', 'HH-RLHF', 'other'][p_size % 4 + 1] || '-' || p_brand b FROM part) GROUP BY 1"""
)
def preference_routes(spark, d):
    """Which loader reads each preference dataset, by its name."""
    kind = F.element_at(F.array(*map(F.lit, ("Coig-p", "PKU-SafeRLHF-30K", "HH-RLHF", "other"))), F.col("p_size") % 4 + 1)
    rows = table(spark, d, "part").select(F.concat(F.lit("org/"), kind, F.lit("-"), "p_brand").alias("b"))
    return rows.groupBy(registry.pair_loader_column("b").alias("loader")).agg(F.count("*").alias("n"), F.count_distinct("b").alias("names"))


@study(
    """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, count(*) OVER (PARTITION BY user_id) n FROM events),
    t AS (SELECT user_id, count(*) n, min(value) low, max(value) high, avg(value) FILTER (i <= greatest(1, n // 4)) q1, avg(value) FILTER (i > n - greatest(1, n // 4)) q4, avg(value - 45) FILTER (i > n - greatest(1, n // 5)) m FROM e GROUP BY 1),
    k AS (SELECT (SELECT count(DISTINCT user_id) FROM events) c), l AS (SELECT doc_id % c run, doc_id, unnest(range(len(l))) line_no, unnest(l) line FROM (SELECT doc_id, string_split(text, chr(10)) l FROM documents), k),
    h AS (SELECT run, string_agg(line, '|' ORDER BY doc_id, line_no) errors FROM (SELECT * FROM l WHERE regexp_matches(line, '(?i)error|traceback|nan|cuda out of memory|reward margin <= 0') QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, line_no) <= 5) GROUP BY 1)
    SELECT user_id run, n, round(q4 - q1, 6) trend, CASE WHEN q4 < q1 AND m > 0 THEN 'PASS' WHEN m <= 0 THEN 'FAIL' ELSE 'CHECK' END verdict, errors FROM t LEFT JOIN h ON run = user_id"""
)
def health_report(spark, d):
    """The trajectory and verdict of each run with the first error lines of its logs."""
    from . import reports

    events = table(spark, d, "events")
    log = events.select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("step"), F.col("value").alias("loss"), (F.col("value") - 45).alias("margin"))
    runs = events.agg(F.count_distinct("user_id").alias("c")).first()["c"]
    lines = table(spark, d, "documents").select((F.col("doc_id") % max(runs, 1)).alias("run"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    lines = lines.select("run", F.struct("doc_id", "line_no").alias("line_no"), "value")
    out = reports.training_health(log, lines)
    return out.select("run", "n", F.round(F.col("q4") - F.col("q1"), 6).alias("trend"), "verdict", F.array_join("errors", "|").alias("errors"))


@study("SELECT source, true AS ordered, true AS sized, sum(strlen(line) + 1)::BIGINT bytes FROM (SELECT source, replace(text, chr(13), ' ') line FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def files_by_time(spark, d):
    """Files listed oldest first, with their sizes; folders are written one after the other, so the order of time is that of the folders."""
    path = folder(spark, "listed")
    docs = table(spark, d, "documents").where("text is not null").select("source", F.regexp_replace("text", "\r", " ").alias("value"))
    docs.write.partitionBy("source").text(path)
    listed = io.list_files(spark, f"{path}/*/*.txt").withColumn("source", F.regexp_extract("path", r"source=(\w+)", 1))
    listed = listed.withColumn("size", io.size_text("length"))
    step = F.col("modified") >= F.lag("modified").over(Window.partitionBy("source").orderBy("modified", "path"))
    return listed.withColumn("step", F.coalesce(step, F.lit(True))).groupBy("source").agg(F.bool_and("step").alias("ordered"), F.sum("length").alias("bytes"), F.bool_and(F.col("size").rlike("^[0-9.]+ (B|KB|MB)$")).alias("sized"))


# Rates by model, benchmark and split


MODELLED = """, m AS (SELECT *, CASE WHEN label < 5 THEN 'first' ELSE 'second' END benchmark, CASE item % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END model FROM predictions)"""


def modelled(spark, d) -> DataFrame:
    """Predictions of three models on two benchmarks."""
    model = F.element_at(F.array(*map(F.lit, "abc")), (F.col("item") % 3 + 1).cast("int"))
    return predictions(spark, d).withColumn("benchmark", F.when(F.col("label") < 5, "first").otherwise("second")).withColumn("model", model)


@study(
    MODELLED + f""", r AS (SELECT benchmark, model, CASE WHEN cond = 3 THEN 'nocult' ELSE 'cult' END split, cond stage, pred, gold, us_pred FROM m WHERE us_pred IS NOT NULL AND country <> '{US}' AND cond > 0
    UNION ALL SELECT benchmark, model, 'reference', NULL, pred, gold, us_pred FROM m WHERE us_pred IS NOT NULL AND country <> '{US}' AND cond = 0)
    SELECT benchmark, model, split, stage, count(*) FILTER (pred <> gold) wrong, count(*) n, round(avg((pred = us_pred)::INT) FILTER (pred <> gold), 6) default_rate, round(avg((pred = us_pred)::INT), 6) match_rate FROM r GROUP BY ALL""",
    "predictions",
)
def cult_default_lines(spark, d):
    """Both default rates of each stage of the two splits, and those of the reference condition beside them."""
    rows = modelled(spark, d)
    split = F.when(F.col("cond") == 0, "reference").when(F.col("cond") == 3, "nocult").otherwise("cult")
    rates = behaviour.default_rates(rows.withColumn("split", split).withColumn("stage", F.when(F.col("cond") > 0, F.col("cond"))), ["benchmark", "model", "split", "stage"], US)
    return rates.select("benchmark", "model", "split", "stage", "wrong", "n", *r6("default_rate", "match_rate"))


@study(
    MODELLED + """, b AS (SELECT model, benchmark, cond, mode, grp, pred, gold, us_pred, country FROM m, LATERAL (VALUES ('binary', side), ('clusters', "cluster")) t(mode, grp)) SELECT model, benchmark, cond, mode, grp, count(*) n, round(avg((pred = gold)::INT), 6) accuracy,
    round(avg((pred = us_pred)::INT) FILTER (us_pred IS NOT NULL AND pred <> gold AND country <> 'NATION_0'), 6) default_rate FROM b GROUP BY ALL""",
    "predictions",
)
def overview_figures(spark, d):
    """The rows behind an overview of three models, two benchmarks and both modes, from one pass."""
    return behaviour.overview(modelled(spark, d), US, ("model", "benchmark", "cond")).select("model", "benchmark", "cond", "mode", "grp", "n", *r6("accuracy", "default_rate"))


@study(
    MODELLED + """, b AS (SELECT model, cond, CASE WHEN pred = gold THEN 'c' WHEN pred = us_pred THEN 'm' ELSE 'd' END o FROM m WHERE us_pred IS NOT NULL)
    SELECT model, cond, count(*) FILTER (o = 'c') correct, count(*) FILTER (o = 'm') wrong_us_match, count(*) FILTER (o = 'd') wrong_us_diverge, round(count(*) FILTER (o = 'm') / nullif(count(*) FILTER (o <> 'c'), 0), 6) default_rate FROM b GROUP BY ALL""",
    "predictions",
)
def us_probe_by_model(spark, d):
    return behaviour.trichotomy(modelled(spark, d), ["model", "cond"]).select("model", "cond", "correct", "wrong_us_match", "wrong_us_diverge", *r6("default_rate"))


@study(
    """, l AS (SELECT 'layer' kind, cond, layer::VARCHAR AS "key", count(*) n, round(avg(delta), 4) AS value FROM selected GROUP BY ALL), c AS (SELECT DISTINCT cond FROM selected WHERE cond <> 'c0'),
    b AS (SELECT 'base', cond, 'c0', count(*) FILTER (x AND y), round(count(*) FILTER (x AND y) / count(*), 4) FROM (SELECT c.cond, module, layer, neuron, bool_or(s.cond = c.cond) x, bool_or(s.cond = 'c0') y FROM c, selected s WHERE s.cond IN (c.cond, 'c0') GROUP BY ALL) GROUP BY cond),
    k AS (SELECT 'control', cond, 'controls', count(*) FILTER (x AND y), count(*) FILTER (x AND NOT y)::DOUBLE FROM (SELECT cond, module, layer, neuron, bool_or(t = 1) x, bool_or(t = 2) y FROM (SELECT cond, module, layer, neuron, 1 t FROM selected UNION ALL SELECT cond, module, layer, neuron, 2 FROM controls) GROUP BY ALL) GROUP BY cond)
    SELECT * FROM l UNION ALL SELECT * FROM b UNION ALL SELECT * FROM k""",
    "selected", "controls",
)
def attribution_details(spark, d):
    """A selection by layer, beside the base's, and beside the controls': per layer the neurons and their mean, the Jaccard index with the base, what only the selection has."""
    rows, controls = selected_and_controls(spark, d)
    rows = kept(rows, "selected")  # read three times
    layers = rows.groupBy("cond", "layer").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("value")).select(F.lit("layer").alias("kind"), "cond", F.col("layer").cast("string").alias("key"), "n", "value")
    base = neurons.jaccard(rows, "cond", ["c0", "c1", "c2", "c3"]).where("a = 'c0' AND n_b > 0").select(F.lit("base").alias("kind"), F.col("b").alias("cond"), F.col("a").alias("key"), F.col("n_both").alias("n"), F.round("jaccard", 4).alias("value"))
    both = neurons.compare_sources(rows, controls, ["cond"]).select(F.lit("control").alias("kind"), "cond", F.lit("controls").alias("key"), F.col("shared").alias("n"), F.col("only_a").cast("double").alias("value"))
    return layers.unionByName(base).unionByName(both)


# Streams


@study(STOPS)
def early_stop_late_stream(spark, d):
    """Events in batches that overlap in time, each up to two spans behind the latest; a closing row lets the last ones through."""
    path = f"{folder(spark, 'late')}/rows"
    events = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") - 20).alias("margin"))
    first, last, runs = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.approx_count_distinct("user_id")).first()
    span = max(1, ((last or 0) - (first or 0)) // 4 + 1)
    batch = F.floor((F.unix_seconds("ts") - (first or 0)) / span) + F.col("event_id") % 2
    for k in range(6):
        events.where(batch == k).write.mode("append").parquet(path)
    closing = spark.createDataFrame([(-1, -1, None)], "user_id long, event_id long, margin double").withColumn("ts", F.timestamp_seconds(F.lit((last or 0) + 3 * span)))
    closing.select(events.columns).write.mode("append").parquet(path)
    files = events.rdd.getNumPartitions()  # a batch writes at most as many, so that batches of the stream do not follow the size of the table
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return monitor.run_to_table(monitor.early_stops_any_order(stream, "user_id", "margin", 4, "ts", "event_id", f"{2 * span} seconds", max(16, runs // 200)), "late-stops")


@study("SELECT route, count(*) shown, count(*) written FROM (SELECT CASE source WHEN 'src1' THEN 'a' WHEN 'src2' THEN 'b' WHEN 'src3' THEN 'b' END route FROM documents) WHERE route IS NOT NULL GROUP BY 1")
def routed_progress(spark, d):
    """One pass over the documents as a stream, routed by source; the counts that the running scan showed, beside those of what it wrote."""
    stream = monitor.file_stream(spark, d, "documents.parquet", 4)
    rows, shown = monitor.scan_routed(stream.select("doc_id", "source"), "source", {"a": ["src1"], "b": ["src2", "src3"]}, folder(spark, "routed"))
    told = spark.createDataFrame([(k, sum(b[k] for b in shown)) for k in ("a", "b")], "route string, shown long")
    return rows.groupBy("route").agg(F.count("*").alias("written")).join(told, "route").select("route", "shown", "written")
