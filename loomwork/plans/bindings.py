"""The library's logical tables, bound to the given test tables by deterministic arithmetic; ``CTE`` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring

US = "NATION_0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country key, country, cluster (its region), side (W for America and Europe); 25 rows."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("country"), F.col("r_name").alias("cluster"), F.when(F.col("r_name").isin("AMERICA", "EUROPE"), "W").otherwise("NW").alias("side"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cond 0..3, item, country, cluster, side, gold, scores, us_scores (null for the US)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.explode(F.array(*map(F.lit, range(4)))).alias("cond"))
    e = e.join(F.broadcast(nations(spark, sf_dir)), F.col("vec_id") % 25 == F.col("nk"))
    gold = F.element_at(F.array(*map(F.lit, scoring.LABELS)), F.col("label") % 3 + 1)
    return e.select(
        "cond", F.col("vec_id").alias("item"), "country", "cluster", "side", "label", gold.alias("gold"), F.slice("v", F.col("cond") * 3 + 1, 3).alias("scores"),
        F.when(F.col("country") != US, F.slice("v", F.col("cond") * 3 + 13, 3)).alias("us_scores"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("pred", scoring.argmax("scores", scoring.LABELS)).withColumn("us_pred", scoring.argmax("us_scores", scoring.LABELS))


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, published cluster (null for some), x, y (null for some), w (not positive counts as 1)."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(nations(spark, sf_dir)), F.col("c_nationkey") == F.col("nk"))
    k = F.col("c_custkey")
    return c.select(
        "country", F.when(F.col("nk") % 7 != 0, F.col("cluster")).alias("cluster"), F.when(k % 17 != 0, (F.col("c_acctbal") + 1000) / 11000).alias("x"),
        F.when(k % 19 != 0, (k * 37) % 1000 / 1000.0).alias("y"), F.when(k % 3 <= 0, 1.0).otherwise((k % 3).cast("double")).alias("w"),
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, culture_tag, domain_tag, language of the labelled documents."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    tag = F.when(good & ~toxic, "NoCulture").when(good, "CultureAsBias").when(~toxic, "CultureAsKnowledge").otherwise("CultureAsPreference")
    return both.select("doc_id", "text", tag.alias("culture_tag"), F.col("source").alias("domain_tag"), F.col("lang").alias("language"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cond, module, layer, neuron, country, cluster, side, sample, score, control, and whether a row counts as control, of every line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nations(spark, sf_dir)), F.col("s_nationkey") == F.col("nk"))
    module = F.when(F.col("l_returnflag") == "A", "mlp.gate_proj").when(F.col("l_returnflag") == "N", "self_attn.q_proj").otherwise("self_attn.v_proj")
    return li.select(
        F.concat(F.lit("c"), (F.year("l_shipdate") % 4).cast("string")).alias("cond"), module.alias("module"), (F.col("l_suppkey") % 28).cast("int").alias("layer"),
        F.col("l_partkey").alias("neuron"), "country", "cluster", "side", F.col("l_orderkey").alias("sample"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("score"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("control"), (F.col("l_quantity") > 25).alias("is_control"), F.col("l_extendedprice").alias("rc"),
    )


def golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, country, gold: the last line of a part and supplier nation names the gold."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nations(spark, sf_dir)), F.col("s_nationkey") == F.col("nk"))
    last = F.max_by(F.when(F.col("l_returnflag") == "N", "yes").otherwise("no"), F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    return rows.groupBy(F.col("l_partkey").alias("scenario"), "country").agg(last.alias("gold"))


CTE = {
    "nations": "nations AS (SELECT n_nationkey nk, n_name country, r_name AS cluster, CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 'W' ELSE 'NW' END side FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "scored": """scored AS (SELECT cond, vec_id AS item, country, "cluster", side, label, ['yes', 'no', 'neutral'][label % 3 + 1] gold, embedding[1 + 3 * cond : 3 + 3 * cond]::DOUBLE[] scores,
        CASE WHEN country <> 'NATION_0' THEN embedding[13 + 3 * cond : 15 + 3 * cond]::DOUBLE[] END us_scores
        FROM embeddings, (SELECT unnest(range(4))::INT cond) JOIN nations ON nk = vec_id % 25)""",
    "predictions": """predictions AS (SELECT *, ['yes', 'no', 'neutral'][list_position(scores, list_max(scores))] pred,
        ['yes', 'no', 'neutral'][list_position(us_scores, list_max(us_scores))] us_pred FROM scored)""",
    "respondents": """respondents AS (SELECT country, CASE WHEN nk % 7 <> 0 THEN "cluster" END AS "cluster", CASE WHEN c_custkey % 17 <> 0 THEN (c_acctbal + 1000) / 11000 END x,
        CASE WHEN c_custkey % 19 <> 0 THEN ((c_custkey * 37) % 1000) / 1000.0::DOUBLE END y, CASE WHEN c_custkey % 3 <= 0 THEN 1.0::DOUBLE ELSE (c_custkey % 3)::DOUBLE END w FROM customer JOIN nations ON c_nationkey = nk)""",
    "means": """means AS (SELECT * FROM (SELECT country, "cluster", sum(x * w) / sum(w) FILTER (x IS NOT NULL) x, sum(y * w) / sum(w) FILTER (y IS NOT NULL) y, count(*) n FROM respondents GROUP BY 1, 2) WHERE x IS NOT NULL AND y IS NOT NULL)""",
    "centres": """centres AS (SELECT "cluster", sum(x * n) / sum(n) cx, sum(y * n) / sum(n) cy FROM means WHERE "cluster" IS NOT NULL GROUP BY 1)""",
    "assigned": """assigned AS (SELECT country, "cluster", x, y, n, false inferred FROM means WHERE "cluster" IS NOT NULL UNION ALL
        SELECT country, arg_min(c."cluster", struct_pack(d := sqrt((x - cx) ** 2 + (y - cy) ** 2), k := c."cluster")), any_value(x), any_value(y), any_value(n), true FROM means m, centres c WHERE m."cluster" IS NULL GROUP BY 1)""",
    "tagged": """tagged AS (SELECT doc_id, text, CASE WHEN quality = 1 AND toxic <> 1 THEN 'NoCulture' WHEN quality = 1 THEN 'CultureAsBias' WHEN toxic <> 1 THEN 'CultureAsKnowledge' ELSE 'CultureAsPreference' END culture_tag,
        source domain_tag, lang AS "language" FROM labels JOIN documents USING (doc_id))""",
    "lookup": """lookup AS (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) k, arg_max(culture_tag, doc_id) culture_tag, max(doc_id) src FROM tagged GROUP BY 1)""",
    "contributions": """contributions AS (SELECT 'c' || (year(l_shipdate) % 4) cond, CASE l_returnflag WHEN 'A' THEN 'mlp.gate_proj' WHEN 'N' THEN 'self_attn.q_proj' ELSE 'self_attn.v_proj' END AS module, (l_suppkey % 28)::INT layer, l_partkey neuron,
        country, "cluster", side, l_orderkey "sample", l_extendedprice * (l_discount - 0.05::DOUBLE) score, l_extendedprice * l_tax control, l_quantity > 25 is_control, l_extendedprice rc
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = nk)""",
    "deltas": """deltas AS (SELECT cond, module, layer, neuron, round(t.s / tn.n - coalesce(c.s / cn.n, 0), 6) delta
        FROM (SELECT cond, module, layer, neuron, sum(score) s FROM contributions GROUP BY ALL) t JOIN (SELECT cond, count(DISTINCT "sample") n FROM contributions GROUP BY 1) tn USING (cond)
        LEFT JOIN (SELECT cond, module, layer, neuron, sum(control) s FROM contributions WHERE is_control GROUP BY ALL) c USING (cond, module, layer, neuron)
        LEFT JOIN (SELECT cond, count(DISTINCT "sample") n FROM contributions WHERE is_control GROUP BY 1) cn USING (cond))""",
    "selected": """selected AS (SELECT cond, module, layer, neuron, delta, fam FROM (SELECT *, row_number() OVER (PARTITION BY cond, fam ORDER BY delta DESC, module, layer, neuron) r, count(*) OVER (PARTITION BY cond, fam) c
        FROM (SELECT *, CASE WHEN module LIKE 'mlp%' THEN 'mlp' ELSE 'attention' END fam FROM deltas)) WHERE r <= floor(c * CASE fam WHEN 'mlp' THEN 0.01::DOUBLE ELSE 0.002::DOUBLE END))""",
    "controls": """controls AS (SELECT cond, module, layer, neuron FROM (SELECT *, row_number() OVER (PARTITION BY cond, fam ORDER BY s DESC, module, layer, neuron) r, count(*) OVER (PARTITION BY cond, fam) c
        FROM (SELECT cond, module, layer, neuron, CASE WHEN module LIKE 'mlp%' THEN 'mlp' ELSE 'attention' END fam, round(sum(rc), 2) s FROM contributions GROUP BY ALL)) WHERE r <= floor(c * 0.01::DOUBLE))""",
    "sums": """sums AS (SELECT country, side, count(*) FILTER (cond = 0 AND pred = gold) h0, count(*) FILTER (cond = 0) n0, count(*) FILTER (cond = 1 AND pred = gold) h1, count(*) FILTER (cond = 1) n1 FROM predictions GROUP BY 1, 2)""",
    "golds": """golds AS (SELECT l_partkey scenario, country, arg_max(CASE l_returnflag WHEN 'N' THEN 'yes' ELSE 'no' END, struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey)) gold
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = nk GROUP BY 1, 2)""",
    "turns": r"""turns AS (SELECT conv_id, coalesce(string_agg(CASE role WHEN 'user' THEN chr(10) || chr(10) || 'Human: ' || text WHEN 'assistant' THEN chr(10) || chr(10) || 'Assistant: ' || text END, '' ORDER BY turn), '') || chr(10) || chr(10) || 'Assistant:' rendered
        FROM conversations GROUP BY 1)""",
}
NEEDS = {
    "scored": ["nations"], "predictions": ["scored"], "respondents": ["nations"], "means": ["respondents"], "centres": ["means"], "assigned": ["centres"], "lookup": ["tagged"],
    "contributions": ["nations"], "deltas": ["contributions"], "selected": ["deltas"], "controls": ["contributions"], "sums": ["predictions"], "golds": ["nations"],
}


def with_tables(query: str, *names: str) -> str:
    """A query with the tables it names, and those that they need, before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return (f"WITH {', '.join(CTE[n] for n in order)} " if order else "") + query
