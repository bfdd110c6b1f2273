"""Derived products: the tables and figures' rows that users of the study see, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import behaviour, neurons
from .bindings import US, contributions, golds, predictions, table, tagged, with_tables
from .queries import GROUPED, group_rows, r6, selected_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def product(sql: str, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = with_tables(sql, *tables)
        return f

    return add


RIGHT = "(pred = gold)::INT"
WRONG = f"us_pred IS NOT NULL AND pred <> gold AND country <> '{US}'"


@product(f", a AS (SELECT cond, avg({RIGHT}) overall, avg({RIGHT}) FILTER (side = 'W') w, avg({RIGHT}) FILTER (side = 'NW') nw FROM predictions GROUP BY 1) SELECT cond, round(overall, 6) overall, round(w, 6) w, round(nw, 6) nw, round(w - nw, 6) gap FROM a", "predictions")
def behaviour_summary(spark, d):
    return behaviour.two_groups(predictions(spark, d)).select("cond", *r6("overall", "w", "nw", "gap"))


@product(
    f""", u AS (SELECT cond, side, country, count(*) n, sum({RIGHT}) h FROM predictions GROUP BY ALL), a AS (SELECT cond, side, sum(n)::BIGINT n, sum(h) / sum(n) acc, coalesce(stddev_samp(h / n) / sqrt(count(*)), 0) sem FROM u GROUP BY 1, 2)
    SELECT cond, side, n, round(acc, 6) accuracy, round(sem, 6) sem, round(max(acc) FILTER (side = 'W') OVER (PARTITION BY cond) - max(acc) FILTER (side = 'NW') OVER (PARTITION BY cond), 6) gap FROM a""",
    "predictions",
)
def group_bars(spark, d):
    bars = behaviour.accuracy_with_sem(predictions(spark, d), ["cond", "side"], "country")
    own = Window.partitionBy("cond")  # two rows
    gap = F.max(F.when(F.col("side") == "W", F.col("accuracy"))).over(own) - F.max(F.when(F.col("side") == "NW", F.col("accuracy"))).over(own)
    return bars.withColumn("gap", gap).select("cond", "side", F.col("n").cast("long").alias("n"), *r6("accuracy", "sem", "gap"))


@product(
    f""", a AS (SELECT cond, side, avg({RIGHT}) acc FROM predictions GROUP BY 1, 2), p AS (SELECT * FROM (VALUES (0, 1), (0, 2), (0, 3), (1, 3)) t("before", "after"))
    SELECT "before", "after", x.side, round(y.acc - x.acc, 6) delta, round(sum(CASE x.side WHEN 'W' THEN y.acc - x.acc ELSE x.acc - y.acc END) OVER (PARTITION BY "before", "after"), 6) gap_shift
    FROM p JOIN a x ON x.cond = "before" JOIN a y ON y.cond = "after" AND y.side = x.side""",
    "predictions",
)
def delta_bars(spark, d):
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3)], "before int, after int")
    shifts = behaviour.gap_shift(predictions(spark, d), pairs)
    each = F.explode(F.array(F.struct(F.lit("W").alias("side"), F.col("d_w").alias("delta")), F.struct(F.lit("NW").alias("side"), F.col("d_nw").alias("delta")))).alias("e")
    return shifts.select("before", "after", each, "gap_shift").select("before", "after", "e.side", F.round("e.delta", 6).alias("delta"), *r6("gap_shift"))


@product(f'SELECT cond, mode, grp, count(*) n, round(avg({RIGHT}), 6) accuracy FROM predictions, LATERAL (VALUES (\'binary\', side), (\'clusters\', "cluster")) t(mode, grp) GROUP BY 1, 2, 3', "predictions")
def accuracy_lines(spark, d):
    return behaviour.overview(predictions(spark, d), US).select("cond", "mode", "grp", "n", *r6("accuracy"))


@product(
    f""", place AS (SELECT r_name AS "cluster", (r_regionkey * 3 % 5)::DOUBLE distance FROM region), a AS (SELECT cond, "cluster", count(*) n, avg({RIGHT}) accuracy FROM predictions GROUP BY 1, 2), j AS (SELECT * FROM a JOIN place USING ("cluster")),
    r AS (SELECT *, rank() OVER (PARTITION BY cond ORDER BY distance) rx, rank() OVER (PARTITION BY cond ORDER BY accuracy) + (count(*) OVER (PARTITION BY cond, accuracy) - 1) / 2 ry FROM j),
    f AS (SELECT cond, count(*) - 2 v, corr(rx, ry) rho, regr_slope(accuracy, distance) slope, regr_intercept(accuracy, distance) intercept FROM r GROUP BY 1),
    t AS (SELECT *, list_sum([pow(1 - rho * rho, j) * coalesce(list_product([CASE WHEN v % 2 = 1 THEN 2 * i / (2 * i + 1) ELSE (2 * i - 1) / (2 * i) END FOR i IN range(1, j + 1)]), 1) FOR j IN range(0, CASE WHEN v % 2 = 1 THEN (v - 1) // 2 ELSE v // 2 END)]) total FROM f)
    SELECT cond, "cluster", distance, n, round(accuracy, 6) accuracy, round(rho, 6) rho, round(CASE WHEN abs(rho) >= 1 THEN 0 WHEN v % 2 = 0 THEN 1 - abs(rho) * total ELSE 1 - 2 / pi() * (asin(abs(rho)) + CASE WHEN v > 1 THEN abs(rho) * sqrt(1 - rho * rho) * total ELSE 0 END) END, 6) p,
        round(slope, 6) slope, round(intercept, 6) intercept FROM j JOIN t USING (cond)""",
    "predictions",
)
def accuracy_scatter(spark, d):
    from ..operators import resample

    place = table(spark, d, "region").select(F.col("r_name").alias("cluster"), (F.col("r_regionkey") * 3 % 5).cast("double").alias("distance"))
    points = behaviour.group_accuracy(predictions(spark, d), ["cond", "cluster"]).join(F.broadcast(place), "cluster")  # five regions
    fit = resample.rank_fit(points.select("cond", F.col("distance").alias("x"), F.col("accuracy").alias("y")), ["cond"]).withColumn("p", resample.rank_p("rho", "n")).drop("n")
    return points.join(fit, "cond").select("cond", "cluster", "distance", "n", *r6("accuracy", "rho", "p", "slope", "intercept"))


@product(
    f""", b AS (SELECT CASE WHEN label < 5 THEN 'first' ELSE 'second' END benchmark, CASE WHEN cond = 3 THEN 'nocult' ELSE 'cult' END split, cond stage, g, pred, gold FROM predictions, LATERAL (VALUES ('all'), (side)) t(g))
    SELECT benchmark, split, stage, g AS grp, count(*) n, round(avg({RIGHT}), 6) accuracy FROM b GROUP BY ALL""",
    "predictions",
)
def cult_lines(spark, d):
    rows = predictions(spark, d).withColumn("benchmark", F.when(F.col("label") < 5, "first").otherwise("second")).withColumn("split", F.when(F.col("cond") == 3, "nocult").otherwise("cult"))
    sets = rows.withColumn("r", behaviour.right()).groupingSets([[F.col("benchmark"), F.col("split"), F.col("cond")], [F.col("benchmark"), F.col("split"), F.col("cond"), F.col("side")]], "benchmark", "split", "cond", "side")
    return sets.agg(F.count("*").alias("n"), F.avg("r").alias("accuracy")).select("benchmark", "split", F.col("cond").alias("stage"), F.coalesce("side", F.lit("all")).alias("grp"), "n", *r6("accuracy"))


@product(f"SELECT cond, count(*) n, round(avg((pred = us_pred)::INT), 6) rate FROM predictions WHERE {WRONG} GROUP BY 1", "predictions")
def default_lines(spark, d):
    return behaviour.default_rate(predictions(spark, d), ["cond"], US).select("cond", "n", *r6("rate"))


@product(
    f"SELECT cond, count(*) FILTER (side = 'NW') nw_n, round(avg((pred = us_pred)::INT) FILTER (side = 'NW'), 6) nw_rate, count(*) FILTER (side = 'W') w_n, round(avg((pred = us_pred)::INT) FILTER (side = 'W'), 6) w_rate, 0.5::DOUBLE chance FROM predictions WHERE {WRONG} GROUP BY 1",
    "predictions",
)
def default_by_group(spark, d):
    wrong = behaviour.errors(predictions(spark, d), US).withColumn("same", (F.col("pred") == F.col("us_pred")).cast("double"))
    of = lambda s: F.when(F.col("side") == s, F.col("same"))
    return wrong.groupBy("cond").agg(F.count(of("NW")).alias("nw_n"), F.round(F.avg(of("NW")), 6).alias("nw_rate"), F.count(of("W")).alias("w_n"), F.round(F.avg(of("W")), 6).alias("w_rate"), F.lit(0.5).alias("chance"))


@product(
    f""", b AS (SELECT CASE WHEN label < 5 THEN 'first' ELSE 'second' END benchmark, CASE WHEN item % 2 = 0 THEN 'a' ELSE 'b' END model, cond stage, pred, us_pred FROM predictions WHERE {WRONG})
    SELECT benchmark, model, stage, count(*) n, round(avg((pred = us_pred)::INT), 6) rate FROM b GROUP BY ALL""",
    "predictions",
)
def default_pooled(spark, d):
    rows = predictions(spark, d).withColumn("benchmark", F.when(F.col("label") < 5, "first").otherwise("second")).withColumn("model", F.when(F.col("item") % 2 == 0, "a").otherwise("b")).withColumn("stage", F.col("cond"))
    return behaviour.default_rate(rows, ["benchmark", "model", "stage"], US).select("benchmark", "model", "stage", "n", *r6("rate"))


ANSWERED = """, answered AS (SELECT c cond, scenario, country, CASE WHEN (scenario + c) % 3 = 0 THEN 'yes' ELSE 'no' END pred, CASE WHEN (scenario + c) % 2 = 0 THEN 'yes' ELSE 'no' END us_pred FROM golds, (SELECT unnest(range(4))::INT c))"""


@product(
    ANSWERED + """, u AS (SELECT cond, count(*) n_us, avg((pred = us_pred)::INT) us_match FROM answered WHERE country <> 'NATION_0' GROUP BY 1),
    k AS (SELECT a.cond, a.scenario, a.country, avg((g.gold = a.pred)::INT) m FROM answered a JOIN golds g ON g.scenario = a.scenario AND g.country <> a.country AND g.country <> 'NATION_0' WHERE a.country <> 'NATION_0' GROUP BY ALL),
    z AS (SELECT cond, count(*) n_null, avg(m) null_match FROM k GROUP BY 1) SELECT cond, round(us_match, 6) us_match, round(null_match, 6) null_match, round(us_match - null_match, 6) delta, n_us, n_null FROM u JOIN z USING (cond)""",
    "golds",
)
def null_baseline_table(spark, d):
    own = golds(spark, d)
    c = F.explode(F.array(*map(F.lit, range(4)))).alias("cond")
    rows = own.select("scenario", "country", c).select(
        "cond", "scenario", "country", F.when((F.col("scenario") + F.col("cond")) % 3 == 0, "yes").otherwise("no").alias("pred"), F.when((F.col("scenario") + F.col("cond")) % 2 == 0, "yes").otherwise("no").alias("us_pred")
    )
    us = behaviour.match_rate(rows, ["cond"], US).select("cond", F.col("n").alias("n_us"), F.col("rate").alias("us_match"))
    null = behaviour.null_baseline(rows.drop("us_pred"), own, US).select("cond", F.col("n").alias("n_null"), "null_match")
    both = us.join(null, "cond").withColumn("delta", F.col("us_match") - F.col("null_match"))
    return both.select("cond", *r6("us_match", "null_match", "delta"), "n_us", "n_null")


@product(
    """, b AS (SELECT CASE WHEN label < 5 THEN '0-shot' ELSE 'fs2' END shots, cond, g AS grp, CASE WHEN pred = gold THEN 'c' WHEN pred = us_pred THEN 'm' ELSE 'd' END o FROM predictions, LATERAL (VALUES ('overall'), ("cluster")) t(g) WHERE us_pred IS NOT NULL)
    SELECT shots, cond, grp, count(*) n, round(count(*) FILTER (o = 'c') / count(*), 6) accuracy, count(*) FILTER (o <> 'c') wrong, count(*) FILTER (o = 'm') us_match, count(*) FILTER (o = 'd') us_diverge,
    round(count(*) FILTER (o = 'm') / nullif(count(*) FILTER (o <> 'c'), 0), 6) default_rate FROM b GROUP BY ALL""",
    "predictions",
)
def us_probe_report(spark, d):
    rows = predictions(spark, d).withColumn("shots", F.when(F.col("label") < 5, "0-shot").otherwise("fs2"))
    each = rows.withColumn("grp", F.explode(F.array(F.lit("overall"), F.col("cluster"))))
    kinds = behaviour.trichotomy(each, ["shots", "cond", "grp"])
    n, wrong = F.col("correct") + F.col("wrong_us_match") + F.col("wrong_us_diverge"), F.col("wrong_us_match") + F.col("wrong_us_diverge")
    return kinds.select("shots", "cond", "grp", n.alias("n"), F.round(F.col("correct") / n, 6).alias("accuracy"), wrong.alias("wrong"), F.col("wrong_us_match").alias("us_match"), F.col("wrong_us_diverge").alias("us_diverge"), *r6("default_rate"))


@product("SELECT layer, cond, round(avg(delta), 4) mean FROM selected GROUP BY 1, 2", "selected")
def layer_attribution(spark, d):
    return neurons.mean_by(selected_rows(spark, d), ["layer", "cond"], "delta").select("layer", "cond", F.round("mean", 4).alias("mean"))


@product(
    """, a AS (SELECT cond, "cluster", country, module, layer, neuron, sum(score) s FROM contributions SEMI JOIN selected USING (cond, module, layer, neuron) GROUP BY ALL)
    SELECT cond, "cluster", r_regionkey * 3 % 5 distance, round(avg(s), 6) mean FROM a JOIN region ON r_name = "cluster" GROUP BY 1, 2, 3""",
    "contributions", "selected",
)
def cluster_heat(spark, d):
    rows = contributions(spark, d).join(selected_rows(spark, d), ["cond", *neurons.NEURON], "left_semi")
    pooled = rows.groupBy("cond", "cluster", "country", *neurons.NEURON).agg(F.sum("score").alias("s"))
    place = table(spark, d, "region").select(F.col("r_name").alias("cluster"), (F.col("r_regionkey") * 3 % 5).alias("distance"))
    return neurons.mean_by(pooled, ["cond", "cluster"], "s").join(F.broadcast(place), "cluster").select("cond", "cluster", "distance", *r6("mean"))


def long_form(by: str) -> str:
    return f", q AS (SELECT cond, {by}, avg(s) s, avg(d) d FROM p GROUP BY 1, 2) SELECT cond, {by}, grp, round(CASE grp WHEN 'similar' THEN s ELSE d END, 6) score FROM q, (VALUES ('similar'), ('distant')) t(grp)"


def long_rows(spark, d, by: str) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("similar").alias("grp"), F.col("similar").alias("score")), F.struct(F.lit("distant").alias("grp"), F.col("distant").alias("score")))).alias("e")
    return group_rows(spark, d, by).select("cond", by, each).select("cond", by, "e.grp", F.round("e.score", 6).alias("score"))


@product(GROUPED + long_form("layer"), "contributions")
def attribution_by_condition_and_layer(spark, d):
    return long_rows(spark, d, "layer")


@product(GROUPED + long_form("module"), "contributions")
def attribution_by_condition_and_module(spark, d):
    return long_rows(spark, d, "module")


@product(
    """, s AS (SELECT cond, count(*) n_neurons, round(avg(delta), 4) mean, round(max(delta), 6) high, count(DISTINCT layer) n_layers FROM selected GROUP BY 1),
    l AS (SELECT cond, layer, count(*) n FROM selected GROUP BY 1, 2), t AS (SELECT cond, arg_max(layer, struct_pack(n := n, k := -layer)) top_layer FROM l GROUP BY 1) SELECT * FROM s JOIN t USING (cond)""",
    "selected",
)
def attribution_summary(spark, d):
    by_layer = selected_rows(spark, d).groupBy("cond", "layer").agg(F.count("*").alias("n"), F.sum("delta").alias("s"), F.max("delta").alias("m"))
    top = F.max_by("layer", F.struct("n", -F.col("layer")))
    return by_layer.groupBy("cond").agg(F.sum("n").alias("n_neurons"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"), F.round(F.max("m"), 6).alias("high"), F.count("*").alias("n_layers"), top.alias("top_layer"))


@product(
    """, x AS (SELECT 'all' fam, cond, module, layer, neuron FROM selected UNION ALL SELECT fam, cond, module, layer, neuron FROM selected), c AS (SELECT unnest(['c0', 'c1', 'c2', 'c3']) c), f AS (SELECT unnest(['all', 'mlp', 'attention']) fam),
    p AS (SELECT fam, a.c a, b.c b FROM f, c a, c b WHERE a.c < b.c) SELECT fam AS family, a, b, (SELECT count(*) FROM x WHERE x.fam = p.fam AND cond = a) n_a, (SELECT count(*) FROM x WHERE x.fam = p.fam AND cond = b) n_b,
    (SELECT count(*) FROM x JOIN x y USING (fam, module, layer, neuron) WHERE fam = p.fam AND x.cond = a AND y.cond = b) n_both FROM p""",
    "selected",
)
def overlap_report(spark, d):
    rows = selected_rows(spark, d)
    both = rows.withColumn("family", F.explode(F.array(F.lit("all"), F.col("family"))))
    return neurons.jaccard(both, "cond", ["c0", "c1", "c2", "c3"], ["family"]).select("family", "a", "b", "n_a", "n_b", "n_both")


@product(
    """, v AS (SELECT 'culture' field, culture_tag AS value FROM tagged UNION ALL SELECT 'domain', domain_tag FROM tagged UNION ALL SELECT 'language', "language" FROM tagged)
    SELECT field, value, count(*) n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY field), 4) AS percent FROM v GROUP BY 1, 2""",
    "tagged",
)
def tag_distributions(spark, d):
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("value")) for k, c in (("culture", "culture_tag"), ("domain", "domain_tag"), ("language", "language"))])).alias("p")
    counted = tagged(spark, d).select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("field")), 4)  # ranks values, of which there are few
    return counted.select("field", "value", "n", share.alias("percent"))


@product("""SELECT conv_id, string_agg(text || '{"answer_choice":"' || CASE turn % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END || '"' || chr(10) || chr(10), '' ORDER BY turn) || 'Which one?' || '{"answer_choice":"' prompt FROM conversations GROUP BY 1""")
def json_fewshot_prompts(spark, d):
    answer = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("turn") % 4 + 1).cast("int"))
    shots = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("prompt"), answer.alias("answer")))), lambda s: F.struct(s["prompt"].alias("prompt"), s["answer"].alias("answer")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(shots.alias("shots"))  # turns of one conversation
    return rows.select("conv_id", text.json_prompt(text.json_shots("shots"), F.lit("Which one?")).alias("prompt"))


@product("SELECT conv_id, string_agg(text || ' ' || role || chr(10) || chr(10), '' ORDER BY turn) prefix FROM conversations GROUP BY 1")
def fewshot_prefix(spark, d):
    shots = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("prompt"), F.col("role").alias("answer")))), lambda s: F.struct(s["prompt"].alias("prompt"), s["answer"].alias("answer")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(shots.alias("shots")).select("conv_id", text.shots("shots").alias("prefix"))


@product("SELECT conv_id, 2 * count(*) + 1 n_turns, string_agg('user:' || text || '|assistant:' || role, '|' ORDER BY turn) || '|user:Which one?' turns FROM conversations GROUP BY 1")
def chat_turns(spark, d):
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("prompt"), F.col("role").alias("answer")))), lambda s: F.struct(s["prompt"].alias("prompt"), s["answer"].alias("answer")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(pairs.alias("pairs"))
    turns = rows.select("conv_id", text.chat(F.col("pairs"), F.lit("Which one?")).alias("t"))
    return turns.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("turns"))
