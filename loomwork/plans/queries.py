"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims, regions, text
from ..operators import behaviour, curate, geography, neurons, resample, scoring, series
from ..session import kept
from .bindings import US, contributions, golds, nations, predictions, respondents, scored, table, tagged, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LABELS = scoring.LABELS


def query(sql: str, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_tables(sql, *tables)
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Scoring


@query("SELECT cond, country, side, count(*) n, round(avg((pred = gold)::INT), 6) accuracy FROM predictions GROUP BY GROUPING SETS ((cond), (cond, country), (cond, side))", "predictions")
def accuracy_rollup(spark, d):
    return scoring.rollup(predictions(spark, d), F.col("pred") == F.col("gold"), "cond", "country", "side").select("cond", "country", "side", "n", *r6("accuracy"))


@query("SELECT cond, item, gold, pred, us_pred FROM predictions", "predictions")
def argmax_pred(spark, d):
    return predictions(spark, d).select("cond", "item", "gold", "pred", "us_pred")


@query("SELECT cond, item, CASE WHEN scores[1] > scores[2] THEN 'yes' ELSE 'no' END pred FROM scored WHERE gold <> 'neutral'", "scored")
def binary_argmax(spark, d):
    return scored(spark, d).where("gold <> 'neutral'").select("cond", "item", scoring.binary(F.col("scores")[0], F.col("scores")[1]).alias("pred"))


@query(
    """, priors AS (SELECT cond, [avg(scores[1]), avg(scores[2]), avg(scores[3])] p FROM scored WHERE label = 9 GROUP BY 1),
    c AS (SELECT cond, gold, item, [scores[1] - p[1], scores[2] - p[2], scores[3] - p[3]] s, scores FROM scored JOIN priors USING (cond) WHERE label <> 9)
    SELECT cond, count(*) n, round(avg((['yes', 'no', 'neutral'][list_position(s, list_max(s))] = gold)::INT), 6) accuracy,
    count(*) FILTER (list_position(s, list_max(s)) <> list_position(scores, list_max(scores))) flips FROM c GROUP BY 1""",
    "scored",
)
def prior_calibration(spark, d):
    rows = scored(spark, d)
    done = scoring.calibrated(rows.where("label <> 9"), scoring.mean_scores(rows.where("label = 9"), ["cond"]), ["cond"])
    pred, raw = scoring.argmax("scores", LABELS), scoring.argmax("raw", LABELS)
    return done.groupBy("cond").agg(F.count("*").alias("n"), F.round(F.avg((pred == F.col("gold")).cast("double")), 6).alias("accuracy"), F.count(F.when(pred != raw, 1)).alias("flips"))


@query(
    """, priors AS (SELECT cond, avg(scores[1]) py, avg(scores[2]) pn FROM scored WHERE label = 9 GROUP BY 1)
    SELECT cond, count(*) n, count(*) FILTER ((scores[1] - py > scores[2] - pn) <> (scores[1] > scores[2])) flips,
    round(avg(((scores[1] - py > scores[2] - pn) = (gold = 'yes'))::INT), 6) accuracy FROM scored JOIN priors USING (cond) WHERE gold <> 'neutral' GROUP BY 1""",
    "scored",
)
def calibration_flips(spark, d):
    rows = scored(spark, d)
    done = scoring.calibrated(rows.where("gold <> 'neutral'"), scoring.mean_scores(rows.where("label = 9"), ["cond"]), ["cond"])
    pred, raw = (scoring.binary(F.col(c)[0], F.col(c)[1]) for c in ("scores", "raw"))
    return done.groupBy("cond").agg(F.count("*").alias("n"), F.count(F.when(pred != raw, 1)).alias("flips"), F.round(F.avg((pred == F.col("gold")).cast("double")), 6).alias("accuracy"))


@query(
    """, m AS (SELECT cond, avg(scores[1]) a, avg(scores[2]) b, avg(scores[3]) c FROM scored GROUP BY 1),
    s AS (SELECT cond, gold, [scores[1] - a, scores[2] - b, scores[3] - c] s, scores, [us_scores[1] - a, us_scores[2] - b, us_scores[3] - c] u, us_scores FROM scored JOIN m USING (cond))
    SELECT cond, round(avg((['yes', 'no', 'neutral'][list_position(s, list_max(s))] = gold)::INT), 6) accuracy, count(*) FILTER (list_position(s, list_max(s)) <> list_position(scores, list_max(scores))) flips,
    count(*) FILTER (us_scores IS NOT NULL AND list_position(s, list_max(s)) = list_position(u, list_max(u))) us_same FROM s GROUP BY 1""",
    "scored",
)
def batch_calibration(spark, d):
    rows = scored(spark, d)
    done = scoring.calibrated(rows, scoring.mean_scores(rows, ["cond"]), ["cond"])
    pred, raw, us = scoring.argmax("scores", LABELS), scoring.argmax("raw", LABELS), scoring.argmax(scoring.minus("us_scores", "means"), LABELS)
    return done.groupBy("cond").agg(F.round(F.avg((pred == F.col("gold")).cast("double")), 6).alias("accuracy"), F.count(F.when(pred != raw, 1)).alias("flips"), F.count(F.when(pred == us, 1)).alias("us_same"))


@query(
    "SELECT item, round(sum(scores[1]), 6) yes_score, round(sum(scores[2]), 6) no_score, CASE WHEN round(sum(scores[1]), 6) > round(sum(scores[2]), 6) THEN 'yes' ELSE 'no' END pred FROM scored WHERE gold <> 'neutral' GROUP BY 1",
    "scored",
)
def multi_prompt_sum(spark, d):
    sums = scoring.sum_scores(scored(spark, d).where("gold <> 'neutral'"), ["item"])
    yes, no = (F.round(F.col("scores")[k], 6) for k in (0, 1))
    return sums.select("item", yes.alias("yes_score"), no.alias("no_score"), scoring.binary(yes, no).alias("pred"))


@query(
    """SELECT lang, CASE WHEN regexp_matches(t, '(^|[^\\pL\\pM\\p{Nd}_])(neutral|neither)($|[^\\pL\\pM\\p{Nd}_])') THEN 'neutral' WHEN regexp_matches(t, '(^|[^\\pL\\pM\\p{Nd}_])yes($|[^\\pL\\pM\\p{Nd}_])') THEN 'yes'
    WHEN regexp_matches(t, '(^|[^\\pL\\pM\\p{Nd}_])no($|[^\\pL\\pM\\p{Nd}_])') THEN 'no' ELSE 'unparseable' END parsed, count(*) n FROM (SELECT lang, lower(text) t FROM documents) GROUP BY ALL"""
)
def parse_label(spark, d):
    return table(spark, d, "documents").groupBy("lang", text.parse_label("text").alias("parsed")).agg(F.count("*").alias("n"))


@query("SELECT lang, round(avg((NOT regexp_matches(lower(text), '(^|[^\\pL\\pM\\p{Nd}_])(neutral|neither|yes|no)($|[^\\pL\\pM\\p{Nd}_])'))::INT), 6) unparseable FROM documents GROUP BY 1")
def unparseable_share(spark, d):
    bad = (text.parse_label("text") == "unparseable").cast("double")
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.avg(bad), 6).alias("unparseable"))


# Behaviour


@query(
    """, t AS (SELECT cond, avg((pred = gold)::INT) o, avg((pred = gold)::INT) FILTER (side = 'W') w, avg((pred = gold)::INT) FILTER (side = 'NW') nw FROM predictions GROUP BY 1)
    SELECT cond, round(o, 6) overall, round(w, 6) w, round(nw, 6) nw, round(w - nw, 6) gap, round(o - (SELECT o FROM t WHERE cond = 0), 6) d_overall, round(nw - (SELECT nw FROM t WHERE cond = 0), 6) d_nw
    FROM (SELECT unnest(range(5))::INT cond) LEFT JOIN t USING (cond)""",
    "predictions",
)
def condition_table(spark, d):
    five = spark.range(5).select(F.col("id").cast("int").alias("cond"))
    return behaviour.condition_table(predictions(spark, d), 0, five).select("cond", *r6("overall", "w", "nw", "gap", "d_overall", "d_nw"))


@query(
    """, t AS (SELECT cond, avg((pred = gold)::INT) FILTER (side = 'W') w, avg((pred = gold)::INT) FILTER (side = 'NW') nw FROM predictions GROUP BY 1)
    SELECT a.cond "before", b.cond "after", round(b.w - a.w, 6) d_w, round(b.nw - a.nw, 6) d_nw, round((b.w - b.nw) - (a.w - a.nw), 6) gap_shift FROM t a JOIN t b ON (a.cond, b.cond) IN ((0, 1), (0, 2), (0, 3), (1, 3))""",
    "predictions",
)
def gap_shift(spark, d):
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3)], "before int, after int")
    return behaviour.gap_shift(predictions(spark, d), pairs).select("before", "after", *r6("d_w", "d_nw", "gap_shift"))


@query('SELECT cond, "cluster", count(*) n, round(avg((pred = gold)::INT), 6) accuracy FROM predictions GROUP BY 1, 2', "predictions")
def cluster_accuracy(spark, d):
    return behaviour.group_accuracy(predictions(spark, d), ["cond", "cluster"]).select("cond", "cluster", "n", *r6("accuracy"))


@query(
    "SELECT cond, side, sum(n)::BIGINT n, round(sum(h) / sum(n), 6) accuracy, round(coalesce(stddev_samp(h / n) / sqrt(count(*)), 0), 6) sem FROM (SELECT cond, side, country, count(*) n, sum((pred = gold)::INT) h FROM predictions GROUP BY ALL) GROUP BY 1, 2",
    "predictions",
)
def accuracy_sem(spark, d):
    return behaviour.accuracy_with_sem(predictions(spark, d), ["cond", "side"], "country").select("cond", "side", "n", *r6("accuracy", "sem"))


RATE = "count(*) n, round(avg((pred = us_pred)::INT), 6) rate FROM predictions WHERE us_pred IS NOT NULL AND pred <> gold AND country <> 'NATION_0'"


@query(f"SELECT cond, {RATE} GROUP BY 1", "predictions")
def us_default(spark, d):
    return behaviour.default_rate(predictions(spark, d), ["cond"], US).select("cond", "n", *r6("rate"))


@query(f"SELECT cond, side, {RATE} AND gold IN ('yes', 'no') GROUP BY 1, 2", "predictions")
def us_default_by_group(spark, d):
    return behaviour.default_rate(predictions(spark, d), ["cond", "side"], US, ["yes", "no"]).select("cond", "side", "n", *r6("rate"))


@query(f'SELECT cond, "cluster", {RATE} GROUP BY 1, 2', "predictions")
def us_default_by_cluster(spark, d):
    return behaviour.default_rate(predictions(spark, d), ["cond", "cluster"], US).select("cond", "cluster", "n", *r6("rate"))


@query(f"SELECT CASE WHEN cond = 0 THEN 'base' WHEN cond = 3 THEN 'final' ELSE 'tuned' END stage, {RATE} GROUP BY 1", "predictions")
def us_default_pooled(spark, d):
    stage = F.when(F.col("cond") == 0, "base").when(F.col("cond") == 3, "final").otherwise("tuned")
    return behaviour.default_rate(predictions(spark, d).withColumn("stage", stage), ["stage"], US).select("stage", "n", *r6("rate"))


@query("SELECT cond, count(*) n, round(avg((pred = us_pred)::INT), 6) rate FROM predictions WHERE us_pred IS NOT NULL AND country <> 'NATION_0' GROUP BY 1", "predictions")
def us_match_all(spark, d):
    return behaviour.match_rate(predictions(spark, d), ["cond"], US).select("cond", "n", *r6("rate"))


@query(
    """SELECT cond, "cluster", count(*) FILTER (pred = gold) correct, count(*) FILTER (pred <> gold AND pred = us_pred) wrong_us_match, count(*) FILTER (pred <> gold AND pred <> us_pred) wrong_us_diverge,
    round(count(*) FILTER (pred <> gold AND pred = us_pred) / nullif(count(*) FILTER (pred <> gold), 0), 6) default_rate FROM predictions WHERE us_pred IS NOT NULL GROUP BY 1, 2""",
    "predictions",
)
def us_trichotomy_pivot(spark, d):
    return behaviour.trichotomy(predictions(spark, d), ["cond", "cluster"]).select("cond", "cluster", "correct", "wrong_us_match", "wrong_us_diverge", *r6("default_rate"))


@query(
    """, p AS (SELECT scenario, country, cond, CASE WHEN (scenario * 7 + length(country) + cond) % 3 = 0 THEN 'no' ELSE 'yes' END pred FROM golds, (SELECT unnest(range(2))::INT cond)),
    f AS (SELECT p.cond, p.scenario, p.country, avg((p.pred = g.gold)::INT) f FROM p JOIN golds g ON g.scenario = p.scenario AND g.country <> p.country AND g.country <> 'NATION_0'
        WHERE p.country <> 'NATION_0' GROUP BY ALL) SELECT cond, count(*) n, round(avg(f), 6) null_match FROM f GROUP BY 1""",
    "golds",
)
def null_baseline(spark, d):
    gold = golds(spark, d)
    pred = F.when((F.col("scenario") * 7 + F.length("country") + F.col("cond")) % 3 == 0, "no").otherwise("yes")
    rows = gold.select("scenario", "country", F.explode(F.array(F.lit(0), F.lit(1))).alias("cond")).withColumn("pred", pred)
    return behaviour.null_baseline(rows, gold, US).select("cond", "n", *r6("null_match"))


@query("SELECT n_countries, count(*) n FROM (SELECT scenario, count(DISTINCT country) n_countries FROM golds GROUP BY 1) GROUP BY 1", "golds")
def scenario_multiplicity(spark, d):
    return golds(spark, d).groupBy("scenario").agg(F.count_distinct("country").alias("n_countries")).groupBy("n_countries").agg(F.count("*").alias("n"))


@query("SELECT a.cond, count(*) n, count(*) FILTER (a.pred = b.pred) same FROM predictions a JOIN predictions b ON a.item = b.item AND b.cond = 0 WHERE a.cond > 0 GROUP BY 1", "predictions")
def positional_pairs(spark, d):
    p = predictions(spark, d).select("cond", "item", "pred")
    base = p.where("cond = 0").select("item", F.col("pred").alias("base_pred"))
    return p.where("cond > 0").join(base, "item").groupBy("cond").agg(F.count("*").alias("n"), F.count(F.when(F.col("pred") == F.col("base_pred"), 1)).alias("same"))


# Geography


@query('SELECT country, "cluster", round(x, 6) x, round(y, 6) y, n FROM means', "means")
def country_weighted_means(spark, d):
    return geography.country_means(respondents(spark, d), ["country", "cluster"]).select("country", "cluster", *r6("x", "y"), "n")


def means_of(spark, d):
    """A row per country, kept for the steps that use it several times: respondents are read once."""
    return geography.country_means(respondents(spark, d), ["country", "cluster"]).persist()


def assigned_of(spark, d):
    means = means_of(spark, d)
    return geography.assign_nearest(means, geography.centroids(means)).select("country", "cluster", "x", "y", "n", "inferred")


@query('SELECT "cluster", round(cx, 6) cx, round(cy, 6) cy FROM centres', "centres")
def cluster_centroids(spark, d):
    return geography.centroids(means_of(spark, d)).select("cluster", *r6("cx", "cy"))


@query('SELECT country, "cluster", inferred, round(x, 6) x FROM assigned', "assigned")
def nearest_centroid(spark, d):
    return assigned_of(spark, d).select("country", "cluster", "inferred", *r6("x"))


@query(
    """, a AS (SELECT country, round(sqrt((x - (SELECT cx FROM centres WHERE "cluster" = 'AMERICA')) ** 2 + (y - (SELECT cy FROM centres WHERE "cluster" = 'AMERICA')) ** 2), 6) distance FROM assigned)
    SELECT country, distance, row_number() OVER (ORDER BY distance NULLS LAST, country) place FROM a""",
    "assigned",
)
def distance_ranking(spark, d):
    rows = geography.with_distance(assigned_of(spark, d), geography.centroids(means_of(spark, d)), "AMERICA").select("country", *r6("distance"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("distance"), "country")).cast("long"))  # a row per country


@query(
    """, s AS (SELECT "cluster", sum(x * n) / sum(n) x, sum(y * n) / sum(n) y, count(*) n_countries, sum(n)::BIGINT n_respondents, count(*) FILTER (inferred) n_inferred, string_agg(country, ';' ORDER BY country) countries FROM assigned GROUP BY 1)
    SELECT "cluster", round(x, 6) x, round(y, 6) y, n_countries, n_respondents, n_inferred, countries,
    round(sqrt((x - (SELECT x FROM s WHERE "cluster" = 'AMERICA')) ** 2 + (y - (SELECT y FROM s WHERE "cluster" = 'AMERICA')) ** 2), 6) distance FROM s""",
    "assigned",
)
def cluster_summary_listagg(spark, d):
    return geography.cluster_summary(assigned_of(spark, d), "AMERICA").select("cluster", *r6("x", "y"), "n_countries", "n_respondents", "n_inferred", "countries", *r6("distance"))


@query('SELECT country, round(x, 6) x, n FROM means WHERE "cluster" IS NOT NULL UNION ALL SELECT country, NULL, NULL FROM nations WHERE nk % 7 = 0', "means")
def augment_missing(spark, d):
    surveyed = means_of(spark, d).where("cluster is not null")
    return geography.augment(surveyed, nations(spark, d).select("country")).select("country", *r6("x"), "n")


@query(
    """, a AS (SELECT "cluster", sqrt((x - (SELECT cx FROM centres WHERE "cluster" = 'AMERICA')) ** 2 + (y - (SELECT cy FROM centres WHERE "cluster" = 'AMERICA')) ** 2) AS dist FROM assigned)
    SELECT "cluster", count(dist) n, round(avg(dist), 6) mean_distance, row_number() OVER (ORDER BY "cluster" <> 'AMERICA', round(avg(dist), 6), "cluster") place FROM a GROUP BY 1""",
    "assigned",
)
def cluster_mean_distance(spark, d):
    rows = geography.with_distance(assigned_of(spark, d), geography.centroids(means_of(spark, d)), "AMERICA")
    out = rows.groupBy("cluster").agg(F.count("distance").alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("cluster") != "AMERICA", "mean_distance", "cluster")).cast("long"))  # a row per cluster


NAMES = {n: dims.CLUSTER_OF[k] for k, n in dims.STORY_NAME.items()}
NAMES |= {"New_Zealand": "EnglishSpeaking"}


def values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


def lookup_sql() -> str:
    """The candidates of each lookup, tried in order, over the spellings that customers have of their country."""
    short, region, lower = "(SELECT v FROM short WHERE k = {})", "(SELECT v FROM region_alias WHERE k = {})", "lower(country)"
    title = "array_to_string(list_transform(string_split(country, '_'), lambda x: upper(x[1]) || lower(x[2:])), '_')"
    tried = {
        "exact_lower_alias": ["country", lower, short.format("country"), short.format(lower)], "exact_lower": ["country", lower], "exact_region": ["country", f"coalesce({region.format(lower)}, {lower})"],
        "normalised": ["translate(lower(country), ' -', '__')"], "exact_lower_title": ["country", lower, title],
    }
    found = {k: "coalesce(" + ", ".join(f"(SELECT c FROM dim WHERE name = {x})" for x in keys) + (", 'Other')" if k == "normalised" else ")") for k, keys in tried.items()}
    parts = [f"SELECT '{k}' \"lookup\", country, {c} AS \"cluster\", n FROM spelled" for k, c in found.items()]
    return f"""WITH short AS (SELECT * FROM (VALUES {values(dims.ALIASES_SHORT)}) t(k, v)), region_alias AS (SELECT * FROM (VALUES {values(dims.ALIASES_REGION)}) t(k, v)),
    dim AS (SELECT * FROM (VALUES {values(NAMES)}) t(name, c) UNION ALL SELECT CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name ELSE 'N' || lower(n_name[2:]) END, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    spelled AS (SELECT CASE c_custkey % 8 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name WHEN 2 THEN replace(n_name, '_', ' ') WHEN 3 THEN lower(replace(n_name, '_', '-')) WHEN 4 THEN 'N' || lower(n_name[2:])
        WHEN 5 THEN 'US' WHEN 6 THEN 'West_Java' ELSE n_name || '?' END country, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE "cluster" IS NOT NULL"""


@query(lookup_sql())
def lookup_variants(spark, d):
    """Every lookup over the spellings that customers have of their country; the dimension spells nations in three ways and knows the published names."""
    n, k = F.col("n_name"), F.col("c_custkey") % 8
    titled = F.concat(F.lit("N"), F.lower(F.substring(n, 2, 100)))
    spelled = F.when(k == 0, F.lower(n)).when(k == 1, n).when(k == 2, F.translate(n, "_", " ")).when(k == 3, F.lower(F.translate(n, "_", "-"))).when(k == 4, titled).when(k == 5, "US").when(k == 6, "West_Java").otherwise(F.concat(n, F.lit("?")))
    nation = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(spelled.alias("country")).agg(F.count("*").alias("n"))
    own = F.when(F.col("n_nationkey") % 3 == 0, F.lower(n)).when(F.col("n_nationkey") % 3 == 1, n).otherwise(titled)
    names = nation.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(own.alias("name"), F.col("r_name").alias("cluster"))
    names = names.unionByName(spark.createDataFrame(list(NAMES.items()), "name string, cluster string"))
    parts = [regions.with_cluster(rows, names, k, default="Other" if k == "normalised" else None).select(F.lit(k).alias("lookup"), "country", "cluster", "n") for k in regions.LOOKUPS]
    return curate.union_all(*parts)


# Curation


@query(
    "SELECT doc_id, culture_tag, src FROM documents JOIN lookup ON trim(regexp_replace(replace(text, ' ', '  '), '\\s+', ' ', 'g')) = k", "lookup"
)
def norm_text_join(spark, d):
    lookup = curate.tag_lookup(tagged(spark, d).select("doc_id", "text", "culture_tag", F.col("doc_id").alias("src")), "text", "doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("  ")).alias("text"))
    return curate.join_tags(rows, lookup.drop("doc_id"), "text").select("doc_id", "culture_tag", "src")


@query("SELECT culture_tag, src FROM lookup", "lookup")
def last_wins_dedup(spark, d):
    rows = tagged(spark, d).select("doc_id", "text", "culture_tag", F.col("doc_id").alias("src"))
    return curate.tag_lookup(rows, "text", "doc_id").select("culture_tag", "src")


@query("SELECT coalesce(culture_tag, '') culture_tag, culture_tag IS DISTINCT FROM 'NoCulture' cult, count(*) n, count(culture_tag) matched FROM documents LEFT JOIN tagged USING (doc_id) GROUP BY ALL", "tagged")
def cult_split_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(tagged(spark, d).select("doc_id", "culture_tag"), "doc_id", "left")
    return rows.groupBy(F.coalesce("culture_tag", F.lit("")).alias("culture_tag"), curate.cultural("culture_tag").alias("cult")).agg(F.count("*").alias("n"), F.count("culture_tag").alias("matched"))


@query(
    """, h AS (SELECT doc_id, culture_tag, row_number() OVER (PARTITION BY culture_tag <> 'NoCulture' ORDER BY md5('42_' || doc_id), doc_id) r, count(*) FILTER (culture_tag <> 'NoCulture') OVER () n FROM tagged)
    SELECT doc_id, culture_tag, CASE WHEN culture_tag <> 'NoCulture' THEN 'cult' ELSE 'nocult' END side FROM h WHERE r <= least(60, n)""",
    "tagged",
)
def balanced_sample(spark, d):
    return curate.balanced(tagged(spark, d).drop("text"), curate.cultural("culture_tag"), 60, "42", "doc_id").select("doc_id", "culture_tag", "side")


@query(
    """SELECT conv_id, regexp_extract(rendered, '(?s)^(.*\\n\\nAssistant:)(.*)$', 1) prompt, regexp_extract(rendered, '(?s)^(.*\\n\\nAssistant:)(.*)$', 2) chosen, ' no ' || conv_id rejected
    FROM (SELECT conv_id, rendered || ' yes ' || conv_id rendered FROM turns)""",
    "turns",
)
def transcript_split(spark, d):
    rows = rendered(spark, d)
    pair = text.split_transcript(F.concat("rendered", F.lit(" yes "), "conv_id"), F.concat("rendered", F.lit(" no "), "conv_id"))
    return rows.withColumn("p", pair).select("conv_id", "p.*")


def rendered(spark, d):
    """Conversations in one string; turns of a conversation are a few."""
    c = table(spark, d, "conversations")
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turns = F.array_sort(F.collect_list(F.struct("turn", speaker.alias("from"), F.col("text").alias("value"))))
    return c.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", text.render_turns("turns").alias("rendered"))


@query("SELECT conv_id, rendered FROM turns", "turns")
def conversation_render(spark, d):
    return rendered(spark, d)


@query(
    """SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') chosen, arg_min(text, struct_pack(s := length(text), o := turn)) FILTER (role <> 'assistant') rejected FROM conversations GROUP BY 1
    HAVING bool_or(role = 'assistant') AND bool_or(role <> 'assistant')"""
)
def preference_pairs(spark, d):
    return curate.preference_pairs(table(spark, d, "conversations"), ["conv_id"], "text", F.col("role") == "assistant", F.length("text"), "turn")


@query(
    """, long AS (UNPIVOT (SELECT coalesce(culture_tag, '') culture_tag, coalesce(domain_tag, '') domain_tag, coalesce("language", '') "language" FROM tagged) ON culture_tag, domain_tag, "language" INTO NAME field VALUE value),
    c AS (SELECT field, value, count(*) n FROM long GROUP BY 1, 2)
    SELECT field, value, n, round(n / total, 6) share FROM (SELECT *, sum(n) OVER (PARTITION BY field) total, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) r FROM c) WHERE r <= 3""",
    "tagged",
)
def tag_distribution_topk(spark, d):
    return curate.distribution(tagged(spark, d), curate.TAGS, 3).select("field", "value", "n", *r6("share"))


@query(
    """SELECT tag, count(culture_tag) n, round(100.0::DOUBLE * count(culture_tag) / (SELECT count(*) FROM tagged), 4) pct FROM (SELECT unnest(['CultureAsKnowledge', 'CultureAsPreference', 'CultureAsDynamics', 'CultureAsBias', 'GeneralCulture', 'NoCulture', 'other']) tag)
    LEFT JOIN tagged ON culture_tag = tag GROUP BY 1""",
    "tagged",
)
def vocab_counts(spark, d):
    return curate.vocabulary_counts(tagged(spark, d), "culture_tag")


@query("SELECT doc_id, coalesce(culture_tag, '') culture_tag, coalesce(\"language\", '') \"language\", culture_tag IS NOT NULL matched FROM documents d LEFT JOIN (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) k, arg_max(culture_tag, doc_id) culture_tag, arg_max(\"language\", doc_id) \"language\" FROM tagged GROUP BY 1) ON trim(regexp_replace(text, '\\s+', ' ', 'g')) = k", "tagged")
def enrich_left_join(spark, d):
    lookup = curate.tag_lookup(tagged(spark, d).drop("domain_tag"), "text", "doc_id").drop("doc_id")
    return curate.join_tags(table(spark, d, "documents").select("doc_id", "text"), lookup, "text", "left").select("doc_id", "culture_tag", "language", "matched")



@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'second' ELSE 'first' END origin FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def merge_precedence(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return curate.merge(docs.withColumn("origin", F.lit("first")), labels.withColumn("origin", F.lit("second")), keys=["doc_id"])


@query(
    """, wide AS (SELECT trim(regexp_replace(d.text || chr(10) || chr(10) || lang, '\\s+', ' ', 'g')) w, arg_max(l.culture_tag, d.doc_id) culture_tag, max(d.doc_id) src FROM documents d JOIN lookup l ON trim(regexp_replace(d.text, '\\s+', ' ', 'g')) = k GROUP BY 1)
    SELECT culture_tag, src FROM wide""",
    "lookup",
)
def rekeying_join(spark, d):
    lookup = curate.tag_lookup(tagged(spark, d).select("doc_id", "text", "culture_tag"), "text", "doc_id").drop("doc_id")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("src"), "text", "lang")
    return curate.rekey(rows, lookup, "text", F.concat("text", F.lit("\n\n"), "lang"), "src").select("culture_tag", "src")



@query("SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7_' || o_orderkey), o_orderkey) = 1")
def fewshot_pick(spark, d):
    pool = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return curate.pick_per_label(pool, "o_orderstatus", "7", "o_orderkey").select("o_orderkey", "o_orderstatus")



@query(
    """, p AS (SELECT item, gold, md5('3_' || item) h, row_number() OVER (PARTITION BY gold ORDER BY md5('3_' || item), item) r FROM (SELECT DISTINCT item, gold FROM scored)) SELECT item, gold FROM (SELECT * FROM p ORDER BY r > 1, h, item LIMIT 5)""",
    "scored",
)
def fewshot_distinct_then_fill(spark, d):
    return curate.pick_distinct_then_fill(scored(spark, d).select("item", "gold").distinct(), 5, "gold", "3", "item")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('42_' || o_orderkey), o_orderkey LIMIT 100")
def shuffle_cap(spark, d):
    return curate.sample(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 100, "42", "o_orderkey")



@query("SELECT doc_id, source || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN lang || chr(10) || chr(10) ELSE '' END || text AS text FROM documents")
def instruction_format(spark, d):
    given = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return table(spark, d, "documents").select("doc_id", text.instruct("source", given, "text").alias("text"))


# Neurons


def delta_rows(spark, d):
    control = F.when(F.col("is_control"), F.col("control"))
    return neurons.deltas_in_one_pass(contributions(spark, d), ["cond"], "score", control, also=[F.round(F.sum("rc"), 2).alias("s")]).withColumn("delta", F.round("delta", 6))


def selected_rows(spark, d):
    """The selection; the deltas are written once, for the sketch of their scores and for the ranking."""
    return neurons.top_fraction(kept(delta_rows(spark, d).drop("s"), "deltas"), ["cond"], "delta")


def selected_and_controls(spark, d):
    """Both selections from one aggregation, whose rows are written once: by itself each would leave out the other's sums and read all contributions again."""
    both = kept(delta_rows(spark, d), "deltas")
    return neurons.top_fraction(both.drop("s"), ["cond"], "delta"), neurons.top_fraction(both.drop("delta"), ["cond"], "s", which=1)


CONDS = ["c0", "c1", "c2", "c3"]


@query('SELECT cond, module, layer, country, round(sum(greatest(score, 0)), 4) score FROM contributions GROUP BY ALL', "contributions")
def score_accumulation(spark, d):
    return neurons.accumulate(contributions(spark, d), ["cond", "module", "layer", "country"]).withColumn("score", F.round("score", 4))


@query("SELECT cond, module, layer, neuron, delta FROM deltas", "deltas")
def neuron_delta(spark, d):
    return delta_rows(spark, d).drop("s")


@query("SELECT cond, module, layer, neuron, delta, fam AS family FROM selected", "selected")
def top_fraction_select(spark, d):
    return selected_rows(spark, d)


@query("SELECT cond, module, layer, neuron, delta FROM selected ANTI JOIN controls USING (cond, module, layer, neuron)", "selected", "controls")
def exclude_countryrc(spark, d):
    selected, controls = selected_and_controls(spark, d)
    return neurons.exclude(selected.drop("family"), controls, ["cond"])


COUNTED = "nullif(count(neuron) FILTER (cond = 'c0'), 0) c0, nullif(count(neuron) FILTER (cond = 'c1'), 0) c1, nullif(count(neuron) FILTER (cond = 'c2'), 0) c2, nullif(count(neuron) FILTER (cond = 'c3'), 0) c3"


@query(f"SELECT layer, {COUNTED} FROM (SELECT unnest(range(28))::INT layer) LEFT JOIN selected USING (layer) GROUP BY 1", "selected")
def layer_counts_pivot(spark, d):
    return neurons.counts_by(selected_rows(spark, d), "layer", "cond", CONDS, list(range(28)))


@query(f"SELECT module, {COUNTED} FROM (SELECT unnest(['mlp.gate_proj', 'self_attn.v_proj', 'self_attn.q_proj', 'self_attn.k_proj']) AS module) LEFT JOIN selected USING (module) GROUP BY 1", "selected")
def module_counts_pivot(spark, d):
    return neurons.counts_by(selected_rows(spark, d), "module", "cond", CONDS, [m for own in dims.FAMILIES.values() for m in own])


@query("SELECT cond, layer, count(*) n, round(avg(delta), 4) mean FROM selected GROUP BY 1, 2", "selected")
def layer_mean_score(spark, d):
    return neurons.mean_by(selected_rows(spark, d), ["cond", "layer"], "delta").withColumn("mean", F.round("mean", 4))


@query('SELECT cond, "cluster", count(*) n, round(avg(s), 9) mean FROM (SELECT cond, "cluster", country, module, layer, neuron, sum(score) s FROM contributions SEMI JOIN selected USING (cond, module, layer, neuron) GROUP BY ALL) GROUP BY 1, 2', "contributions", "selected")
def cluster_activation(spark, d):
    rows = contributions(spark, d).join(selected_rows(spark, d), ["cond", *neurons.NEURON], "left_semi")
    pooled = rows.groupBy("cond", "cluster", "country", *neurons.NEURON).agg(F.sum("score").alias("s"))
    return neurons.mean_by(pooled, ["cond", "cluster"], "s").withColumn("mean", F.round("mean", 9))


GROUPED = """, i AS (SELECT country, count(*) n FROM contributions GROUP BY 1), a AS (SELECT cond, module, layer, neuron, country, any_value(side) side, sum(score - CASE WHEN is_control THEN control ELSE 0 END) s FROM contributions GROUP BY ALL),
    p AS (SELECT cond, module, layer, neuron, avg(s / n) FILTER (side = 'W') s, avg(s / n) FILTER (side = 'NW') d FROM a JOIN i USING (country) GROUP BY ALL)"""


def group_rows(spark, d, by):
    c = contributions(spark, d)
    items = c.groupBy("country").agg(F.count("*").alias("n"))
    net = c.groupBy("cond", *neurons.NEURON, "country", "side").agg(F.sum(F.col("score") - F.when(F.col("is_control"), F.col("control")).otherwise(0.0)).alias("score"))
    return neurons.group_attribution(net, items, by, F.col("side") == "W", ["cond"])


@query(GROUPED + " SELECT cond, layer, round(avg(s), 6) AS \"similar\", round(avg(d), 6) distant FROM p GROUP BY 1, 2", "contributions")
def group_attribution_layer(spark, d):
    return group_rows(spark, d, "layer").select("cond", "layer", *r6("similar", "distant"))


@query(GROUPED + " SELECT cond, module, round(avg(s), 6) AS \"similar\", round(avg(d), 6) distant FROM p GROUP BY 1, 2", "contributions")
def group_attribution_module(spark, d):
    return group_rows(spark, d, "module").select("cond", "module", *r6("similar", "distant"))


@query(GROUPED + ", q AS (SELECT cond, layer, avg(s) - avg(d) a FROM p GROUP BY 1, 2) SELECT cond, layer, round(a, 6) asymmetry, round(coalesce(a / nullif(max(abs(a)) OVER (PARTITION BY cond), 0), 0), 6) scaled FROM q", "contributions")
def asymmetry(spark, d):
    return neurons.asymmetry(group_rows(spark, d, "layer"), "cond").select("cond", "layer", *r6("asymmetry", "scaled"))


def jaccard_sql(prefix: str, where: str, group: str) -> str:
    return f"""SELECT {prefix}a.c a, b.c b, (SELECT count(*) FROM selected WHERE cond = a.c {where}) n_a, (SELECT count(*) FROM selected WHERE cond = b.c {where}) n_b, i.n n_both,
    (SELECT count(*) FROM selected WHERE cond = a.c {where}) + (SELECT count(*) FROM selected WHERE cond = b.c {where}) - i.n n_union,
    round(coalesce(i.n / nullif((SELECT count(*) FROM selected WHERE cond = a.c {where}) + (SELECT count(*) FROM selected WHERE cond = b.c {where}) - i.n, 0), 0), 6) jaccard
    FROM {group} (SELECT unnest(['c0', 'c1', 'c2', 'c3']) c) a JOIN (SELECT unnest(['c0', 'c1', 'c2', 'c3']) c) b ON a.c < b.c, LATERAL (SELECT count(*) n FROM selected x JOIN selected y USING (module, layer, neuron) WHERE x.cond = a.c AND y.cond = b.c {where.replace('fam', 'x.fam')}) i"""


@query(jaccard_sql("", "", ""), "selected")
def jaccard_matrix(spark, d):
    return neurons.jaccard(selected_rows(spark, d), "cond", CONDS).withColumn("jaccard", F.round("jaccard", 6))


@query(jaccard_sql("f AS family, ", "AND fam = f", "(SELECT unnest(['mlp', 'attention']) f) ff,"), "selected")
def jaccard_family(spark, d):
    return neurons.jaccard(selected_rows(spark, d), "cond", CONDS, ["family"]).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "SELECT cond, count(*) FILTER (y.neuron IS NULL) only_a, count(*) FILTER (x.neuron IS NULL) only_b, count(*) FILTER (x.neuron IS NOT NULL AND y.neuron IS NOT NULL) shared FROM selected x FULL JOIN controls y USING (cond, module, layer, neuron) GROUP BY 1",
    "selected", "controls",
)
def cross_source_overlap(spark, d):
    return neurons.compare_sources(*selected_and_controls(spark, d), ["cond"])


@query("SELECT module || '_' || layer || '_' || neuron \"key\", module module_name, layer layer_idx, neuron::INT neuron_idx FROM (SELECT DISTINCT module, layer, neuron FROM selected)", "selected")
def neuron_key_parse(spark, d):
    keys = selected_rows(spark, d).select(F.concat_ws("_", "module", "layer", "neuron").alias("key")).distinct()
    return keys.withColumn("p", text.neuron_key("key")).select("key", "p.*")


# Statistics


@query(
    """, a AS (SELECT cond, country, avg((pred = gold)::INT) y FROM predictions GROUP BY 1, 2), m AS (SELECT n_name country, (n_nationkey * 7 % 11)::DOUBLE x FROM nation), j AS (SELECT cond, x, y FROM a JOIN m USING (country)),
    r AS (SELECT cond, x, y, rank() OVER (PARTITION BY cond ORDER BY x) + (count(*) OVER (PARTITION BY cond, x) - 1) / 2 rx, rank() OVER (PARTITION BY cond ORDER BY y) + (count(*) OVER (PARTITION BY cond, y) - 1) / 2 ry FROM j)
    SELECT cond, count(*) n, round(corr(rx, ry), 6) rho, round(regr_slope(y, x), 6) slope, round(regr_intercept(y, x), 6) intercept FROM r GROUP BY 1""",
    "predictions",
)
def spearman_ols(spark, d):
    place = nations(spark, d).select("country", (F.col("nk") * 7 % 11).cast("double").alias("x"))
    points = behaviour.group_accuracy(predictions(spark, d), ["cond", "country"]).join(F.broadcast(place), "country").select("cond", "x", F.col("accuracy").alias("y"))
    return resample.rank_fit(points, ["cond"]).select("cond", "n", *r6("rho", "slope", "intercept"))


SHIFT = """(sum(h1) FILTER (side = 'W') / nullif(sum(n1) FILTER (side = 'W'), 0) - sum(h1) FILTER (side = 'NW') / nullif(sum(n1) FILTER (side = 'NW'), 0))
    - (sum(h0) FILTER (side = 'W') / nullif(sum(n0) FILTER (side = 'W'), 0) - sum(h0) FILTER (side = 'NW') / nullif(sum(n0) FILTER (side = 'NW'), 0))"""
REPLICATES = 5000
DRAW = "('0x' || substr(md5('{}_' || rep || '_' || draw), 1, 8))::BIGINT"


@query(
    f""", k AS (SELECT *, row_number() OVER (ORDER BY country) idx, count(*) OVER () n FROM sums), b AS (SELECT rep, {SHIFT} AS "shift" FROM (SELECT unnest(range({REPLICATES})) rep), (SELECT unnest(range((SELECT count(*) FROM sums))) draw)
    JOIN k ON idx = {DRAW.format('boot')} % n + 1 GROUP BY 1) SELECT count("shift") n, round(quantile_cont("shift", 0.025::DOUBLE), 6) lo, round(quantile_cont("shift", 0.975::DOUBLE), 6) hi FROM b""",
    "sums",
)
def bootstrap_gap_ci(spark, d):
    return resample.interval(resample.cluster_bootstrap(resample.country_sums(predictions(spark, d), 0, 1), REPLICATES)).select("n", *r6("lo", "hi"))



@query(
    f""", o AS (SELECT {SHIFT} AS "shift" FROM sums), r AS (SELECT rep, h0, n0, h1, n1, CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY md5('perm_' || rep || '_' || country), country) <= (SELECT count(*) FROM sums WHERE side = 'W') THEN 'W' ELSE 'NW' END side
    FROM sums, (SELECT unnest(range({REPLICATES})) rep)), b AS (SELECT rep, {SHIFT} AS "shift" FROM r GROUP BY 1) SELECT round(avg((abs("shift") >= (SELECT abs("shift") FROM o))::INT), 6) p, (SELECT round("shift", 6) FROM o) observed FROM b""",
    "sums",
)
def permutation_p(spark, d):
    sums = resample.country_sums(predictions(spark, d), 0, 1)
    return resample.p_value(resample.permutation(sums, REPLICATES), sums.agg(resample.shift().alias("shift"))).select(*r6("p", "observed"))



def item_bootstrap_ci(spark, d):
    """Draws come from a generator, so there is no SQL; tests hold it against draws of single items."""
    from . import reports

    return resample.interval(resample.item_bootstrap(reports.item_rows(predictions(spark, d), 0, 1), REPLICATES)).select("n", *r6("lo", "hi"))


QUERIES["item_bootstrap_ci"] = item_bootstrap_ci


@query(
    f""", i AS (SELECT item, side, count(*) FILTER (cond = 0 AND pred = gold) h0, count(*) FILTER (cond = 0) n0, count(*) FILTER (cond = 1 AND pred = gold) h1, count(*) FILTER (cond = 1) n1 FROM predictions WHERE cond < 2 GROUP BY 1, 2),
    k AS (SELECT side, h0, n0, h1, n1, row_number() OVER (ORDER BY side, h0, n0, h1, n1) idx FROM i), c AS (SELECT count(*) n FROM i),
    t AS (SELECT rep, {DRAW.format('item')} % n + 1 idx FROM (SELECT unnest(range({REPLICATES})) rep), c, LATERAL (SELECT unnest(range(n)) draw)), b AS (SELECT rep, {SHIFT} AS "shift" FROM t JOIN k USING (idx) GROUP BY 1)
    SELECT count("shift") n, round(quantile_cont("shift", 0.025::DOUBLE), 6) lo, round(quantile_cont("shift", 0.975::DOUBLE), 6) hi FROM b""",
    "predictions",
)
def item_bootstrap_draws_ci(spark, d):
    """The interval by single items, with draws that SQL can replay."""
    from . import reports

    return resample.interval(resample.item_bootstrap_by_draws(reports.item_rows(predictions(spark, d), 0, 1), REPLICATES)).select("n", *r6("lo", "hi"))


# Ordered data


@query("SELECT o_orderkey, CASE WHEN row_number() OVER w <= floor(count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) / 2) THEN 'neuron' ELSE 'holdout' END part FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey)")
def stratified_half_split(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    # Fifteen strata, however many orders: each is ranked in 16 ranges.
    return series.half_split(rows, ["o_orderpriority", "o_orderstatus"], "o_orderkey", ranges=16).select("o_orderkey", "part")


LINE = ["l_linenumber", "l_partkey", "l_suppkey"]


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 5")
def cap_per_group(spark, d):
    return series.cap_per_group(table(spark, d, "lineitem").select("l_orderkey", *LINE), ["l_orderkey"], 5, *LINE)


@query("SELECT l_orderkey, l_partkey FROM lineitem SEMI JOIN (SELECT DISTINCT l_partkey FROM (SELECT l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 2)) USING (l_partkey)")
def cap_by_membership(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    return series.cap_then_members(rows, ["l_suppkey"], "l_partkey", 2, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_partkey")


STOPS = """SELECT user_id, min(step) stop_step FROM (SELECT user_id, row_number() OVER w step, max(value - 20) OVER (w ROWS 3 PRECEDING) m, count(*) OVER (w ROWS 3 PRECEDING) c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE m <= 0 AND c = 4 GROUP BY 1"""


@query(STOPS)
def early_stop_batch(spark, d):
    return series.early_stops(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", F.col("value") - 20, 4, "ts", "event_id")


@query(
    """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, count(*) OVER (PARTITION BY user_id) n FROM events),
    t AS (SELECT user_id, count(*) n, min(value) low, max(value) high, avg(value) FILTER (i <= greatest(1, n // 4)) q1, avg(value) FILTER (i > n - greatest(1, n // 4)) q4, avg(value - 45) FILTER (i > n - greatest(1, n // 5)) m FROM e GROUP BY 1)
    SELECT user_id, n, low, high, round(q1, 6) q1, round(q4, 6) q4, round(m, 6) final_margin, CASE WHEN q4 < q1 AND m > 0 THEN 'PASS' WHEN m <= 0 THEN 'FAIL' ELSE 'CHECK' END verdict FROM t"""
)
def trajectory_stats(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return series.trajectory(rows, "user_id", F.col("value"), F.col("value") - 45, "ts", "event_id").select("user_id", "n", "low", "high", *r6("q1", "q4", "final_margin"), "verdict")


@query(
    """, a AS (SELECT country, count(*) n, round(avg((pred = gold)::INT), 6) accuracy FROM predictions WHERE cond = 0 GROUP BY 1 HAVING count(*) >= 20) SELECT * FROM (SELECT country, n, accuracy, 'top' "end" FROM a ORDER BY accuracy DESC, country LIMIT 5)
    UNION ALL SELECT * FROM (SELECT country, n, accuracy, 'bottom' "end" FROM a ORDER BY accuracy, country LIMIT 5)""",
    "predictions",
)
def topk_bottomk(spark, d):
    rows = behaviour.group_accuracy(predictions(spark, d).where("cond = 0"), ["country"]).select("country", "n", *r6("accuracy"))
    return series.extremes(rows, "accuracy", "country", 5, F.col("n") >= 20)


@query(
    """SELECT source, doc_id, line_no FROM (SELECT source, doc_id, unnest(range(len(l))) line_no, unnest(l) line FROM (SELECT source, doc_id, string_split(text, chr(10)) l FROM documents)) WHERE regexp_matches(line, '(?i)error|traceback|nan|cuda out of memory|reward margin <= 0')
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) <= 5"""
)
def log_grep(spark, d):
    lines = table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return series.grep(lines, ["source"], dims.ERRORS, 5, "value", "doc_id", "line_no").select("source", "doc_id", F.col("line_no").cast("long").alias("line_no"))


# Text



@query("SELECT doc_id, replace(text, 'the', 'US') AS text FROM documents WHERE contains(text, 'the') UNION ALL SELECT doc_id, replace(text, ' of ', 'US') FROM documents WHERE NOT contains(text, 'the')")
def counterfactual_rewrite(spark, d):
    land = F.when(F.contains("text", F.lit("the")), F.lit("the")).otherwise("_of_")
    return table(spark, d, "documents").select("doc_id", text.as_if_us("text", land).alias("text"))


@query(
    """SELECT cond, item, CASE item % 4 WHEN 0 THEN 'People shake hands ' || item WHEN 1 THEN 'People shake hands ' || item WHEN 2 THEN 'Elders ' || item || ' speak first' ELSE 'She bowed when , ' || item || ' guests came' END story FROM scored""",
    "scored",
)
def strip_mentions(spark, d):
    i = F.col("item").cast("string")
    story = (
        F.when(F.col("item") % 4 == 0, F.concat(F.lit("In the United States, people shake hands "), i))
        .when(F.col("item") % 4 == 1, F.concat(F.lit("Among Germans, people shake  hands "), i))
        .when(F.col("item") % 4 == 2, F.concat(F.lit(" Elders "), i, F.lit(" from Japan speak first")))
        .otherwise(F.concat(F.lit("She bowed when in Japan, "), i, F.lit(" Korean guests came")))
    )
    return scored(spark, d).select("cond", "item", text.strip_mentions(story).alias("story"))


@query(
    """SELECT cond, item, CASE item % 5 WHEN 0 THEN ['United States', 'Japan'] WHEN 1 THEN ['Germany'] WHEN 2 THEN ['France', 'Kenya'] WHEN 3 THEN []::VARCHAR[] ELSE ['United Kingdom'] END countries FROM scored""",
    "scored",
)
def entity_normalize(spark, d):
    mentions = F.when(F.col("item") % 5 == 0, F.array(F.lit("usa"), F.lit("Japanese "), F.lit("American"))).when(F.col("item") % 5 == 1, F.array(F.lit("Berlin"), F.lit("german")))
    mentions = mentions.when(F.col("item") % 5 == 2, F.array(F.lit("Paris"), F.lit("FRENCH"), F.lit("Kenya"))).when(F.col("item") % 5 == 3, F.array(F.lit("Western"), F.lit("nowhere"))).otherwise(F.array(F.lit("U.K.")))
    from ..operators import mentions as m

    gazetteer = m.gazetteer(spark.createDataFrame([("FR", "France"), ("DE", "Germany"), ("KE", "Kenya"), ("JP", "Japan")], "code string, name string"), spark.createDataFrame([("Paris", "FR", 1), ("Berlin", "DE", 2)], "city string, code string, ord int"))
    return m.resolve(scored(spark, d).select(F.struct("cond", "item").alias("row"), mentions.alias("mentions")), "row", "mentions", gazetteer).select("row.cond", "row.item", "countries")


@query("SELECT cond, item, CASE WHEN ('0x' || substr(md5('seed_' || item), 1, 8))::BIGINT % 2 = 1 THEN 'no, yes' ELSE 'yes, no' END options, CASE WHEN (('0x' || substr(md5('seed_' || item), 1, 8))::BIGINT % 2 = 1) = (gold = 'yes') THEN 2 ELSE 1 END::INT answer FROM scored WHERE gold <> 'neutral'", "scored")
def option_shuffle(spark, d):
    swap = text.option_order("seed", "item")
    rows = scored(spark, d).where("gold <> 'neutral'")
    return rows.select("cond", "item", F.when(swap, "no, yes").otherwise("yes, no").alias("options"), F.when(swap == (F.col("gold") == "yes"), 2).otherwise(1).alias("answer"))


@query("SELECT cond, item, 'You are evaluating cultural acceptability.' || chr(10) || 'Country: ' || country || chr(10) || 'Scenario: ' || gold || chr(10) || 'Question: Is this action socially acceptable in this culture?' || chr(10) || 'Answer with exactly one of: yes, no, neutral.' || chr(10) || 'Answer:' prompt FROM scored", "scored")
def prompt_render(spark, d):
    return scored(spark, d).select("cond", "item", text.story_prompt("three", "country", "gold").alias("prompt"))


@query(
    """SELECT cond, item, CASE label % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'neutral' END gold, CASE item % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'Atlantis' ELSE 'Unknown' END country, CASE item % 3 WHEN 0 THEN 'Western' ELSE 'Other' END grp FROM scored""",
    "scored",
)
def coalesce_labels(spark, d):
    raw = F.when(F.col("label") % 3 == 0, " Acceptable\n").when(F.col("label") % 3 == 1, "0").otherwise("Neither")
    land = F.when(F.col("item") % 3 == 0, " United_States_of_America ").when(F.col("item") % 3 == 1, "Atlantis").otherwise("")
    rows = scored(spark, d).withColumn("c", text.country(land, F.lit(None).cast("string")))
    return rows.select("cond", "item", text.gold_label(F.lit("??"), raw).alias("gold"), F.col("c").alias("country"), regions.group_of("c").alias("grp"))


# Further products


@query(
    """, b AS (SELECT cond, mode, grp, pred, gold, us_pred, country FROM predictions, LATERAL (VALUES ('binary', side), ('clusters', "cluster")) t(mode, grp)) SELECT cond, mode, grp, count(*) n, round(avg((pred = gold)::INT), 6) accuracy,
    round(avg((pred = us_pred)::INT) FILTER (us_pred IS NOT NULL AND pred <> gold AND country <> 'NATION_0'), 6) default_rate FROM b GROUP BY 1, 2, 3""",
    "predictions",
)
def overview_grid(spark, d):
    return behaviour.overview(predictions(spark, d), US).select("cond", "mode", "grp", "n", *r6("accuracy", "default_rate"))


@query(
    """SELECT country, "cluster", CASE WHEN inferred THEN 'yes' ELSE 'no' END inferred, printf('%.4f', round(x, 4)) sx, printf('%.4f', round(y, 4)) sy, n FROM assigned""", "assigned"
)
def coordinates_table(spark, d):
    four = lambda c: F.format_string("%.4f", F.round(c, 4))
    return assigned_of(spark, d).select("country", "cluster", F.when(F.col("inferred"), "yes").otherwise("no").alias("inferred"), four("x").alias("sx"), four("y").alias("sy"), "n")


@query("SELECT cond, item, round(greatest(coalesce(list_max([CASE WHEN (item + i) % 3 <> 0 THEN greatest(scores[i], 0) ELSE 0 END FOR i IN [1, 2, 3]]), 0), 0) * 0.5, 6) contribution FROM scored", "scored")
def item_contributions(spark, d):
    mask = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.col("item") + i) % 3 != 0)
    return scored(spark, d).select("cond", "item", F.round(neurons.item_contribution("scores", mask, F.lit(0.5)), 6).alias("contribution"))


@query("SELECT country, count(*) n FROM predictions WHERE cond = 2 GROUP BY 1", "predictions")
def item_counts_fallback(spark, d):
    return neurons.item_counts(predictions(spark, d), "cond", [9, 2, 0])


@query(
    GROUPED + """, q AS (SELECT cond, layer, avg(s) - avg(d) a FROM p GROUP BY 1, 2) SELECT cond, round(max(abs(a)), 6) linear, round(quantile_cont(abs(a), 0.95::DOUBLE), 6) robust, round(median(abs(a)), 6) symlog, round(min(a), 6) low, round(max(a), 6) high FROM q GROUP BY 1""",
    "contributions",
)
def scale_limits(spark, d):
    return neurons.scale_limits(neurons.asymmetry(group_rows(spark, d, "layer"), "cond"), ["cond"]).select("cond", *r6("linear", "robust", "symlog", "low", "high"))


@query("SELECT user_id, list_slice(v, 1, 3)::VARCHAR \"first\", list_slice(v, greatest(1, len(v) - 2), len(v))::VARCHAR \"last\" FROM (SELECT user_id, list(event_id ORDER BY ts, event_id) v FROM events GROUP BY 1)")
def first_and_last(spark, d):
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")).alias(c)
    return series.first_and_last(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "event_id", 3, "ts", "event_id").select("user_id", shown("first"), shown("last"))


@query("SELECT p_brand model, sum(p_size)::BIGINT total, coalesce(sum(p_size) FILTER (p_partkey % 3 = 0), 0)::BIGINT adapter, coalesce(sum(p_size) FILTER (p_size > 25), 0)::BIGINT trainable FROM part GROUP BY 1")
def parameter_counts(spark, d):
    from ..sources import io

    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x.lora_A."), "p_name")).otherwise(F.col("p_name"))
    return io.parameter_counts(table(spark, d, "part").select(F.col("p_brand").alias("model"), name.alias("name"), F.col("p_size").cast("long").alias("numel"), (F.col("p_size") > 25).alias("trainable")))


@query("SELECT n_name node, CASE n_nationkey % 4 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'NO_DATA' ELSE 'NOT_RUN' END status FROM nation")
def node_summary(spark, d):
    from ..sources import io

    nodes = table(spark, d, "nation").select(F.col("n_name").alias("node"), (F.col("n_nationkey") % 4).alias("k"))
    line = F.when(F.col("k") == 0, "python3.12: PRESENT x").when(F.col("k") == 1, "python3.12:  MISSING").otherwise("other: PRESENT")
    return io.node_summary(nodes.select("node"), nodes.where("k < 3").select("node", line.alias("value")))


@query("SELECT cond, count(*) n FROM predictions WHERE country NOT IN ('NATION_3', 'NATION_7') AND item NOT IN (SELECT vec_id FROM embeddings WHERE label = 9) GROUP BY 1", "predictions")
def holdout_exclusion(spark, d):
    p = predictions(spark, d).where(~F.col("country").isin("NATION_3", "NATION_7"))
    held = table(spark, d, "embeddings").where("label = 9").select(F.col("vec_id").alias("item"))
    return p.join(held, "item", "left_anti").groupBy("cond").agg(F.count("*").alias("n"))


@query(
    """, h AS (SELECT doc_id::VARCHAR id, culture_tag, row_number() OVER (PARTITION BY culture_tag <> 'NoCulture' ORDER BY md5('1_' || doc_id), doc_id) r, count(*) FILTER (culture_tag <> 'NoCulture') OVER () n FROM tagged),
    c AS (SELECT conv_id::VARCHAR id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant') AND bool_or(role <> 'assistant'))
    SELECT 'text' part, id, CASE WHEN culture_tag <> 'NoCulture' THEN 'cult' ELSE 'nocult' END side FROM h WHERE r <= least(20, n) UNION ALL SELECT 'pair', id, NULL FROM c""",
    "tagged",
)
def curated_union(spark, d):
    text_part = curate.balanced(tagged(spark, d).select("doc_id", "culture_tag"), curate.cultural("culture_tag"), 20, "1", "doc_id").select(F.lit("text").alias("part"), F.col("doc_id").cast("string").alias("id"), "side")
    return curate.union_all(text_part, preference_pairs(spark, d).select(F.lit("pair").alias("part"), F.col("conv_id").cast("string").alias("id")))



@query("SELECT doc_id, 'Passage: ' || text || chr(10) || 'Question: ' || source || chr(10) || 'Answer:' prompt, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END gold FROM documents")
def reading_prompts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.nlu_prompt("boolq", passage=F.col("text"), question=F.col("source")).alias("prompt"), text.nlu_gold("boolq", F.col("doc_id") % 2 == 0).alias("gold"))


@query("SELECT lang, count(*) n, count(*) FILTER (source IN ('src1', 'src2')) kept FROM documents GROUP BY 1")
def routed_scan(spark, d):
    from ..sources import io

    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    kept = io.route(docs, "source", {"a": ["src1"], "b": ["src2"]})
    return docs.groupBy("lang").agg(F.count("*").alias("n")).join(curate.union_all(*kept.values()).groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").na.fill(0)


def significance_sql(pairs: list[tuple[int, int]], n: int) -> str:
    parts = []
    for a, b in pairs:
        own = f"SELECT country, side, count(*) FILTER (cond = {a} AND pred = gold) h0, count(*) FILTER (cond = {a}) n0, count(*) FILTER (cond = {b} AND pred = gold) h1, count(*) FILTER (cond = {b}) n1 FROM predictions GROUP BY 1, 2"
        parts.append(f"""SELECT {a} "before", {b} "after", round(d_w, 6) d_w, round(d_nw, 6) d_nw, round(o, 6) gap_shift, round(lo, 6) lo, round(hi, 6) hi, round(p, 6) p FROM
    (SELECT sum(h1) FILTER (side = 'W') / sum(n1) FILTER (side = 'W') - sum(h0) FILTER (side = 'W') / sum(n0) FILTER (side = 'W') d_w,
        sum(h1) FILTER (side = 'NW') / sum(n1) FILTER (side = 'NW') - sum(h0) FILTER (side = 'NW') / sum(n0) FILTER (side = 'NW') d_nw, {SHIFT} o FROM ({own})),
    (SELECT quantile_cont("shift", 0.025::DOUBLE) lo, quantile_cont("shift", 0.975::DOUBLE) hi FROM (SELECT rep, {SHIFT} AS "shift" FROM (SELECT unnest(range({n})) rep), (SELECT unnest(range((SELECT count(*) FROM ({own})))) draw)
        JOIN (SELECT *, row_number() OVER (ORDER BY country) idx, count(*) OVER () n FROM ({own})) ON idx = {DRAW.format(f'boot{a}{b}')} % n + 1 GROUP BY 1)),
    (SELECT avg((abs("shift") >= (SELECT abs({SHIFT}) FROM ({own})))::INT) p FROM (SELECT rep, {SHIFT} AS "shift" FROM (SELECT rep, h0, n0, h1, n1, CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY md5('perm{a}{b}_' || rep || '_' || country), country)
        <= (SELECT count(*) FROM ({own}) WHERE side = 'W') THEN 'W' ELSE 'NW' END side FROM ({own}), (SELECT unnest(range({n})) rep)) GROUP BY 1))""")
    return " UNION ALL ".join(parts)


#: base with sft, dpo and sftdpo, and sft with sftdpo, by number.
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 3)]


@query(f"SELECT *, CASE WHEN lo > 0 OR hi < 0 THEN ' *' ELSE '' END star FROM ({significance_sql(PAIRS, REPLICATES)})", "predictions")
def significance_report(spark, d):
    from . import reports

    return reports.significance(predictions(spark, d), PAIRS, REPLICATES, REPLICATES).select("before", "after", *r6("d_w", "d_nw", "gap_shift", "lo", "hi", "p"), "star")


# Streams


@query(STOPS)
def early_stop_stream(spark, d):
    from ..streaming import monitor

    events = monitor.file_stream(spark, d, "events.parquet").withColumn("margin", F.col("value") - 20)
    return monitor.run_to_table(monitor.early_stops(events, "user_id", "margin", 4, "ts", "event_id"), "stops")


@query("SELECT user_id, arg_max(event_type, event_id) event_type, max(event_id) event_id FROM events GROUP BY 1")
def last_wins_stream(spark, d):
    from ..streaming import monitor

    events = monitor.file_stream(spark, d, "events.parquet").select("user_id", "event_id", "event_type")
    return monitor.lookup_from_stream(events, ["user_id"], "event_id")
