"""Expressions and operators on hand-written cases: ties, missing values, odd white space, lookups that differ on purpose."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import dims, regions, text
from loomwork.operators import behaviour, curate, geography, mentions, neurons, resample, scoring, series


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], names).select(column.alias("out")).first()["out"]


def test_white_space(spark):
    assert one(spark, text.norm("t"), t="  a\n\t b c ") == "a b c"
    assert one(spark, text.strip("t"), t="\n a b  ") == "a b"


def test_transcripts(spark):
    frame = spark.createDataFrame([("\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: d", "x\n\nAssistant: e"), ("none", "x\n\nAssistant: e"), ("p\n\nAssistant:", "q\n\nAssistant: r")], "c string, r string")
    rows = [tuple(x.s) for x in frame.select(text.split_transcript("c", "r").alias("s")).collect()]
    assert rows[0] == ("\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant:", " d", " e")
    assert rows[1] == ("", "", "")
    assert rows[2] == ("p\n\nAssistant:", "", " r")


def test_turns(spark):
    frame = spark.createDataFrame([([("human", "a"), ("system", "x"), ("gpt", "b")],), (None,)], "t array<struct<from: string, value: string>>")
    assert [r[0] for r in frame.select(text.render_turns("t")).collect()] == ["\n\nHuman: a\n\nAssistant: b\n\nAssistant:", "\n\nAssistant:"]


def test_orientation_and_last_turn(spark):
    rows = spark.createDataFrame([(0,), (1,), (None,), (2,)], "b int").select(text.orient("b", F.lit("p"), F.lit("q")).alias("o")).collect()
    assert [tuple(r.o) for r in rows] == [("p", "q"), ("q", "p"), ("", ""), ("", "")]
    frame = spark.createDataFrame([([("u", "1"), ("a", "2")],), ([],)], "t array<struct<role: string, content: string>>")
    assert [r[0] for r in frame.select(text.last_content("t")).collect()] == ["2", None]


def test_instruction(spark):
    assert one(spark, text.instruct("a", "b", "c"), a="do", b="it", c="done") == "do\n\nit\n\ndone"
    assert one(spark, text.instruct("a", "b", "c"), a="do", b="", c="done") == "do\n\ndone"
    assert one(spark, text.before_blank_line("a"), a="x\n\ny\n\nz") == "x"


@pytest.mark.parametrize("raw, want", [("neither", "neutral"), ("no, neutral", "neutral"), ("know", "unparseable"), (" YES.", "yes"), ("", "unparseable"), ("no", "no"), ("nöno", "unparseable")])
def test_parse_label(spark, raw, want):
    assert one(spark, text.parse_label("t"), t=raw) == want


def test_labels_countries_scenarios(spark):
    frame = spark.createDataFrame([(None, "?", " Acceptable ", "", "Iran", None, " s "), ("0", None, None, None, "south_korea", "", "x"), (None, None, None, None, None, "y", None)], "a string, b string, c string, k string, l string, s string, t string")
    rows = frame.select(text.gold_label("a", "b", "c").alias("g"), text.country("k", "l").alias("c"), text.scenario("s", "t").alias("s")).collect()
    assert [tuple(r) for r in rows] == [("yes", "Iran", "s"), ("no", "South_Korea", "x"), (None, "Unknown", "y")]
    assert one(spark, text.country_short("k"), k="USA") == "US" and one(spark, text.country_short("k"), k="iran") == "iran"


def test_prompts(spark):
    out = one(spark, text.story_prompt("two", "c", "s"), c="Peru", s="{country} {x}")
    assert out.startswith("You are evaluating cultural acceptability.\nCountry: Peru\nScenario: {country} {x}\n") and out.endswith("yes, no.\nAnswer:")
    assert len(one(spark, text.rephrased_prompts("c", "s"), c="Peru", s="t")) == 4
    frame = spark.createDataFrame([("q", (["B", "A", "C", "D", "E"], ["b", "a", "c", "d", "e"]))], "q string, o struct<label: array<string>, text: array<string>>")
    assert frame.select(text.nlu_prompt("csqa", F.col("o"), question=F.col("q"))).first()[0] == "Question: q\nA. a\nB. b\nC. c\nD. d\nE. e\nAnswer:"
    assert [one(spark, text.nlu_gold(k, F.lit(v))) for k, v in (("boolq", True), ("qnli", 0), ("qnli", 1), ("mrpc", 1), ("mrpc", 0), ("csqa", "E"))] == ["yes", "yes", "no", "yes", "no", "E"]
    pairs = F.array(*[F.struct(F.lit(p).alias("prompt"), F.lit(a).alias("answer")) for p, a in dims.NEUTRAL_SHOTS])
    assert one(spark, text.shots(pairs)) == "Is the Earth round?\nAnswer: yes\n\nIs fire cold?\nAnswer: no\n\n"
    assert [t["role"] for t in one(spark, text.chat(pairs, F.lit("?")))] == ["user", "assistant", "user", "assistant", "user"]


def test_counterfactual(spark):
    assert one(spark, text.as_if_us("p", "c"), p="In South Korea, in South Korea", c="South_Korea") == "In US, in US"
    assert one(spark, text.as_if_us("p", "c"), p="In Peru", c="Peru") == "In US" and one(spark, text.as_if_us("p", "c"), p="Here", c="Peru") == "Here"


STORIES = ["In the United States, people bow.", "Among Germans, tea is served", "in a Japanese home, shoes come off", "She is from Japan and met a Korean man in South Korea.", "", "US", "état in India", "He went to Americana"]


def stripped(story):
    """The rules, with Python's expressions."""
    alt = lambda names: "|".join(re.escape(x) for x in sorted(set(names), key=len, reverse=True))
    land, people = alt(dims.COUNTRY_NAMES), alt(dims.DEMONYM_NAMES)
    out = story
    for p in (rf"^\s*In\s+(?:the\s+)?(?:{land})\s*,\s*", rf"^\s*In\s+(?:a|an|the)?\s*(?:{people})\s+", rf"^\s*Among\s+(?:{people})s?\s*,\s*"):
        out = re.sub(p, "", out, count=1, flags=re.I)
    for p in (rf"\bin\s+(?:the\s+)?(?:{land})\b", rf"\b(?:{people})\b", rf"\bfrom\s+(?:{land})\b"):
        out = re.sub(p, "", out, flags=re.I)
    out = re.sub(r"\s{2,}", " ", out).strip()
    return out[:1].upper() + out[1:]


def test_strip_mentions(spark):
    frame = spark.createDataFrame([(s,) for s in STORIES], "s string")
    assert [r[0] for r in frame.select(text.strip_mentions("s")).collect()] == [stripped(s) for s in STORIES]


def test_capitals(spark):
    """A story that begins with a letter without a capital of one letter keeps its length; other letters are raised as ever."""
    import duckdb

    letters = [*text.CAPITALS, "a", "é", "ǆ", "ſ", "я", "1", "Z"]
    got = [r[0] for r in spark.createDataFrame([(x + "heit",) for x in letters], "s string").select(text.strip_mentions("s")).collect()]
    assert got == [duckdb.execute("SELECT upper($1) || 'heit'", [x]).fetchone()[0] for x in letters]
    assert got[letters.index("ß")] == "\u1e9eheit"


def test_distinct_and_keys(spark):
    frame = spark.createDataFrame([(["Japan", "japan", None, "", "Iran", "IRAN"],)], "a array<string>")
    assert frame.select(text.distinct_ignoring_case("a")).first()[0] == ["Japan", "Iran"]
    assert tuple(one(spark, text.neuron_key("k"), k="self_attn.q_proj_12_7")) == ("self_attn.q_proj", 12, 7)
    assert one(spark, text.preview("t", 3), t="a\nbcd") == "a b..."


def test_lookups_differ(spark):
    rows = spark.createDataFrame([(c,) for c in ("US", "uk", "South Korea", "West_Java", "new_zealand", "nowhere")], "country string")
    names = spark.createDataFrame([(n, dims.CLUSTER_OF[k]) for k, n in dims.STORY_NAME.items()], "name string, cluster string")
    found = {k: {r.country: r.cluster for r in regions.with_cluster(rows, names, k).collect()} for k in regions.LOOKUPS}
    assert "US" in found["exact_lower_alias"] and "US" not in found["exact_lower"] and "uk" not in found["exact_lower_alias"]
    assert found["exact_region"]["West_Java"] == "SouthAsia" and found["normalised"]["South Korea"] == "Confucian"
    assert one(spark, regions.titled(F.lit("south_korea"))) == "South_Korea"
    assert {r.country: r.cluster for r in regions.with_cluster(rows, names, "normalised", default="Other").collect()}["nowhere"] == "Other"
    assert len(dims.CLUSTER_OF) == 122 and len(dims.STORY_NAME) == 68 and len(dims.CANONICAL) == 51 and len(dims.DEMONYMS) == 66


def test_guards(spark):
    frame = spark.createDataFrame([("",), ("x",), ("-1",), ("-2",), ("0.5",), (None,)], "v string")
    assert [r[0] for r in frame.select(regions.guarded("v")).collect()] == [None, None, -1.0, None, 0.5, None]
    frame = spark.createDataFrame([("",), ("0",), ("-1",), ("2.5",), (None,)], "v string")
    assert [r[0] for r in frame.select(regions.weight("v")).collect()] == [1.0, 1.0, 1.0, 2.5, 1.0]
    assert [one(spark, regions.group_of("c"), c=c) for c in ("UK", "South Korea", "Fiji")] == ["Western", "Non-Western", "Other"]


def test_argmax(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 2.0],), ([-math.inf, -math.inf, -5.0],), (None,), ([3.0, 3.0, 3.0],)], "s array<double>")
    assert [r[0] for r in frame.select(scoring.argmax("s", scoring.LABELS)).collect()] == ["no", "neutral", None, "yes"]
    assert one(spark, scoring.binary(F.lit(1.0), F.lit(1.0))) == "no"
    with pytest.raises(Exception, match="no usable scores"):
        scoring.require_scores(spark.createDataFrame([([math.nan],)], "s array<double>"), "s").collect()


def test_calibration_laws(spark):
    rows = spark.createDataFrame([("c", [1.0, 2.0, 0.5]), ("c", [3.0, 1.0, 0.0])], "cond string, scores array<double>")
    zero = spark.createDataFrame([("c", [0.0, 0.0, 0.0])], "cond string, means array<double>")
    same = scoring.calibrated(rows, zero, ["cond"])
    assert all(r.scores == r.raw for r in same.collect())
    moved = rows.withColumn("scores", F.transform("scores", lambda x: x + 7))
    both = [sorted(tuple(round(x, 9) for x in r.scores) for r in scoring.calibrated(f, scoring.mean_scores(f, ["cond"]), ["cond"]).collect()) for f in (rows, moved)]
    assert both[0] == both[1]


PRED = "cond string, country string, side string, gold string, pred string, us_pred string"


def test_rates_and_sem(spark):
    rows = spark.createDataFrame(
        [("a", "X", "W", "yes", "no", "no"), ("a", "X", "W", "yes", "yes", "no"), ("a", "Y", "NW", "no", "yes", "no"), ("a", "US", "W", "no", "yes", None), ("a", "Z", "NW", "no", "no", None)], PRED
    )
    assert behaviour.default_rate(rows, ["cond"]).first().rate == 0.5
    sem = {r.side: r for r in behaviour.accuracy_with_sem(rows, ["side"], "country").collect()}
    assert sem["NW"].accuracy == 0.5 and sem["NW"].sem == pytest.approx(0.5)
    assert behaviour.accuracy_with_sem(rows.where("country = 'X'"), ["side"], "country").first().sem == 0.0
    t = behaviour.trichotomy(rows, ["cond"]).first()
    assert (t.correct, t.wrong_us_match, t.wrong_us_diverge, t.default_rate) == (1, 1, 1, 0.5)
    listed = spark.createDataFrame([("a",), ("gone",)], "cond string")
    table = {r.cond: r for r in behaviour.condition_table(rows, "a", listed).collect()}
    assert table["gone"].overall is None and table["a"].d_overall == 0


def test_null_baseline_equals_the_self_join(spark):
    import random

    rng = random.Random(0)
    golds = {(s, c): rng.choice(["yes", "no"]) for s in range(30) for c in ("US", "A", "B", "C") if rng.random() < 0.7}
    preds = [("m", s, c, rng.choice(["yes", "no", "neutral"])) for s in range(32) for c in ("US", "A", "B", "D")]
    got = behaviour.null_baseline(spark.createDataFrame(preds, "cond string, scenario long, country string, pred string"), spark.createDataFrame([(s, c, g) for (s, c), g in golds.items()], "scenario long, country string, gold string")).first()
    parts = []
    for _, s, c, p in preds:
        others = [g for (t, k), g in golds.items() if t == s and k not in (c, "US")]
        if c != "US" and others:
            parts.append(sum(g == p for g in others) / len(others))
    assert got.n == len(parts) and got.null_match == pytest.approx(sum(parts) / len(parts))


def test_geography(spark):
    rows = spark.createDataFrame([("P", "K", 1.0, 1.0, 1.0), ("P", "K", None, 3.0, 2.0), ("Q", None, 0.0, 0.0, 1.0), ("R", "L", 9.0, 9.0, 1.0), ("S", None, None, 1.0, 1.0)], "country string, cluster string, x double, y double, w double")
    means = {r.country: r for r in geography.country_means(rows, ["country", "cluster"]).collect()}
    assert (means["P"].x, means["P"].y, means["P"].n) == (1.0, pytest.approx(7 / 3), 2) and "S" not in means
    countries = geography.country_means(rows, ["country", "cluster"])
    found = {r.country: (r.cluster, r.inferred) for r in geography.assign_nearest(countries, geography.centroids(countries)).collect()}
    assert found == {"P": ("K", False), "Q": ("K", True), "R": ("L", False)}


def test_curation(spark):
    tagged = spark.createDataFrame([("a  b", "Old", 1), ("a b", "New", 2), ("c", "NoCulture", 3)], "text string, culture_tag string, ord long")
    lookup = curate.tag_lookup(tagged, "text", "ord").drop("ord")
    rows = spark.createDataFrame([(1, "a b"), (2, "a\nb "), (3, "z")], "id long, text string")
    assert {(r.id, r.culture_tag) for r in curate.join_tags(rows, lookup, "text").collect()} == {(1, "New"), (2, "New")}
    assert {(r.id, r.culture_tag, r.matched) for r in curate.join_tags(rows, lookup, "text", "left").collect()} == {(1, "New", True), (2, "New", True), (3, "", False)}
    flags = spark.createDataFrame([("NoCulture",), ("",), (None,)], "t string").select(curate.cultural("t")).collect()
    assert [r[0] for r in flags] == [False, True, True]
    items = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "id long, flag boolean")
    sides = [r.side for r in curate.balanced(items, F.col("flag"), 100, "s", "id").collect()]
    assert sides.count("cult") == 10 and sides.count("nocult") == 10
    pairs = spark.createDataFrame([("g", 1, "r1", False, 2.0), ("g", 2, "r2", False, 2.0), ("g", 3, "c1", True, 9.0), ("g", 4, "c2", True, 1.0), ("h", 1, "x", True, 1.0)], "k string, o long, t string, c boolean, s double")
    assert [tuple(r) for r in curate.preference_pairs(pairs, ["k"], "t", F.col("c"), F.col("s"), "o").collect()] == [("g", "c1", "r1")]
    merged = curate.merge(spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string"), keys=["k"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a"), (2, "b")}
    counts = {r.tag: (r.n, r.pct) for r in curate.vocabulary_counts(tagged, "culture_tag").collect()}
    assert counts["NoCulture"] == (1, 33.3333) and counts["GeneralCulture"] == (0, 0.0) and counts["other"][0] == 2


def test_mentions(spark):
    names = mentions.gazetteer(spark.createDataFrame([("GE", "Georgia"), ("US", "United States")], "code string, name string"), spark.createDataFrame([("Springfield", "GE", 1), ("springfield", "US", 2)], "city string, code string, ord int"))
    rows = spark.createDataFrame([(1, ["UK", " Springfield", "american", "Asian", "x"]), (2, []), (3, None)], "id int, m array<string>")
    assert {r.id: r.countries for r in mentions.resolve(rows, "id", "m", names).collect()} == {1: ["United Kingdom", "United States"], 2: [], 3: []}
    assert mentions.detect_with(rows.select("id", F.lit("hello").alias("text")), lambda t: "en").count() == 3
    assert mentions.detect_with(rows.select("id", F.lit("").alias("text")), lambda t: t[0]).count() == 0


def test_selection_ranks_a_share(spark):
    """Only about the wanted share of a family is ranked, and ties, nulls and scores that are no numbers change nothing."""
    module = F.when(F.col("id") % 3 == 0, "mlp.gate_proj").when(F.col("id") % 3 == 1, "self_attn.q_proj").otherwise("self_attn.v_proj")
    odd = F.when(F.col("id") % 11 == 0, None).when(F.col("id") == 51, float("nan")).when(F.col("id") == 52, float("-inf")).otherwise(F.round(F.rand(3), 3))
    for score, share in ((odd, 0.04), (F.lit(1.0), 1), (F.lit(None).cast("double"), 1)):
        rows = spark.range(90000).select(F.when(F.col("id") % 2 == 0, "a").alias("cond"), module.alias("module"), F.lit(0).alias("layer"), F.col("id").alias("neuron"), score.alias("score")).localCheckpoint()
        for which in (0, 1):
            plain = Window.partitionBy("cond", "family")
            want = rows.withColumn("family", neurons.family()).withColumn("r", F.row_number().over(plain.orderBy(F.desc("score"), *neurons.NEURON))).withColumn("n", F.count("*").over(plain))
            p = F.when(F.col("family") == "mlp", dims.FRACTIONS["mlp"][which]).otherwise(dims.FRACTIONS["attention"][which])
            want = {(r.cond, r.neuron) for r in want.where(F.col("r") <= F.floor(F.col("n") * p)).collect()}
            assert want == {(r.cond, r.neuron) for r in neurons.top_fraction(rows, ["cond"], "score", which).collect()}
            assert neurons.reaching(rows, ["cond"], "score", which).count() <= share * 90000


def test_contributions_are_dealt_by_their_number(spark, monkeypatch):
    """No task sums more than its share of the contributions, whatever the session's partitions and the splits of the input are."""
    rows = spark.range(0, 3000, 1, 1).select(F.lit("c").alias("cond"), F.lit("mlp.gate_proj").alias("module"), F.lit(0).alias("layer"), "id", F.col("id").alias("neuron"), F.col("id").alias("sample"), F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("control")).localCheckpoint()
    monkeypatch.setattr(neurons, "PER_TASK", 100, raising=False)
    got = neurons.deltas_in_one_pass(rows, ["cond"])
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300 and {r.delta for r in got.collect()} == {1 / 3000}


def test_contributions_are_dealt_over_few_tasks(spark, monkeypatch):
    """Of many contributions a task takes more: with over 200 tasks Spark's shuffle writer would hold a whole split."""
    rows = spark.range(0, 3000, 1, 1).select(F.lit("c").alias("cond"), F.lit("mlp.gate_proj").alias("module"), F.lit(0).alias("layer"), "id", F.col("id").alias("neuron"), F.col("id").alias("sample"), F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("control")).localCheckpoint()
    monkeypatch.setattr(neurons, "PER_TASK", 10)
    got = neurons.deltas_in_one_pass(rows, ["cond"])
    assert got.rdd.getNumPartitions() <= 200 and {(r.neuron, r.delta) for r in got.collect()} == {(n, 1 / 3000) for n in range(3000)}


def test_neurons(spark):
    score = spark.createDataFrame([("c", "mlp.gate_proj", 0, n, "K", float(n), s) for n in range(300) for s in (1, 2)], "cond string, module string, layer int, neuron int, country string, score double, sample int")
    control = score.where("neuron < 5").withColumn("score", F.lit(1.0))
    delta = {r.neuron: r.delta for r in neurons.deltas(score, control, ["cond"]).collect()}
    assert delta[4] == 3.0 and delta[200] == 200.0
    top = neurons.top_fraction(neurons.deltas(score, control, ["cond"]), ["cond"], "delta")
    assert sorted(r.neuron for r in top.collect()) == [297, 298, 299]
    assert neurons.top_fraction(neurons.deltas(score.where("neuron < 50"), control, ["cond"]), ["cond"], "delta").count() == 0
    sets = spark.createDataFrame([("a", "m", 0, 1), ("a", "m", 0, 2), ("b", "m", 0, 2), ("b", "m", 0, 3)], "cond string, module string, layer int, neuron int")
    rows = {(r.a, r.b): r.jaccard for r in neurons.jaccard(sets, "cond", ["a", "b", "none", "empty"]).collect()}
    assert rows[("a", "b")] == pytest.approx(1 / 3) and rows[("none", "empty")] == 0.0
    assert neurons.exclude(sets, sets.where("neuron = 2"), ["cond"]).count() == 2


def test_resampling_laws(spark):
    same = spark.createDataFrame([(c, s, 5, 10, 5, 10) for c, s in (("A", "W"), ("B", "W"), ("C", "NW"), ("D", "NW"))], "country string, side string, h0 long, n0 long, h1 long, n1 long")
    ci = resample.interval(resample.cluster_bootstrap(same, 50)).first()
    assert ci.lo == ci.hi == 0.0
    assert resample.p_value(resample.permutation(same, 50), same.agg(resample.shift().alias("shift"))).first().p == 1.0
    points = spark.createDataFrame([("k", float(x), float(y)) for x, y in ((1, 2), (2, 4), (2, 5), (4, 9))], "k string, x double, y double")
    fit = resample.rank_fit(points, ["k"]).first()
    assert fit.rho == pytest.approx(0.9486833) and fit.slope > 2
    known = [(0.5, 10, 0.14111328), (1.0, 5, 0.0), (0.3, 2, None), (None, 9, None), (0.0, 7, 1.0), (-0.5, 3, 2 / 3), (0.5, 4, 0.5), (0.9, 5, 0.03738607), (-0.2, 101, 0.04494)]
    got = spark.createDataFrame(known, "rho double, n int, want double").withColumn("p", resample.rank_p("rho", "n")).collect()
    assert all(r.p is None if r.want is None else r.p == pytest.approx(r.want, abs=1e-5) for r in got), got


def test_series(spark):
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, -1.0, 0.0, -2.0, -1.0, 5.0])] + [("s", 0, -1.0), ("s", 1, -1.0)], "run string, i int, m double")
    assert {(r.run, r.stop_step) for r in series.early_stops(rows, "run", F.col("m"), 3, "i").collect()} == {("r", 4)}
    log = spark.createDataFrame([("up", i, float(i), None) for i in range(8)] + [("down", i, 8.0 - i, 1.0) for i in range(8)] + [("bad", i, 8.0 - i, -1.0) for i in range(3)] + [("none", 0, None, 1.0)], "run string, i int, loss double, margin double")
    got = {r.run: r.verdict for r in series.trajectory(log, "run", F.col("loss"), F.col("margin"), "i").collect()}
    assert got == {"up": "?", "down": "PASS", "bad": "FAIL", "none": "?"}
    split = series.half_split(spark.createDataFrame([("a", i) for i in range(5)], "k string, i int"), ["k"], "i").orderBy("i").collect()
    assert [r.part for r in split] == ["neuron"] * 2 + ["holdout"] * 3
    many = spark.createDataFrame([(k, (i * 7) % 101) for k in ("a", "b", None) for i in range(101)] + [("c", 5), ("c", 5)], "k string, i int")
    plain, ranged = (sorted(map(tuple, series.positions(many, ["k"], "i", ranges=n).collect()), key=str) for n in (0, 9))
    assert plain == ranged and len(plain) == 305
    assert series.positions(many.limit(0), ["k"], "i", ranges=9).count() == 0
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["ok", "ERROR x", "finance", "Traceback", "CUDA out of memory"])], "file string, n int, value string")
    assert [r.n for r in series.grep(lines, ["file"], dims.ERRORS, 2, "value", "n").orderBy("n").collect()] == [1, 2]


def test_python_agrees_on_titles(spark):
    for c in ("south_korea", "new_zealand", "türkiye", "usa"):
        assert one(spark, regions.titled(F.lit(c))) == c.title() and unicodedata.normalize("NFC", c)


def test_reports(spark):
    from loomwork.plans import reports

    rows = [(c, i, k, s, "yes", "yes" if (i + c) % 3 else "no") for c in (0, 1) for i, (k, s) in enumerate((("A", "W"), ("B", "W"), ("C", "NW"), ("D", "NW")) * 6)]
    preds = spark.createDataFrame(rows, "cond int, item long, country string, side string, gold string, pred string")
    for items in (False, True):
        r = reports.significance(preds, [(0, 1)], 30, 30, items).first()
        assert r.lo <= r.hi and 0 <= r.p <= 1 and r.gap_shift == pytest.approx(0.0)
    with pytest.raises(Exception, match="different items"):
        reports.significance(preds.where("cond = 0 or item > 2"), [(0, 1)], 5, 5, True).collect()
    tagged = spark.createDataFrame([("a", "X", 1), ("b", "NoCulture", 2), ("c", "NoCulture", 3)], "text string, culture_tag string, ord long")
    splits = reports.build_splits(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string"), tagged, "text", "id", "ord", 10)
    assert splits["cult"].count() == 1 and splits["nocult"].count() == 1
    log = spark.createDataFrame([("r", i, 4.0 - i, 1.0) for i in range(4)], "run string, step int, loss double, margin double")
    lines = spark.createDataFrame([("r", 2, "Error b"), ("r", 1, "nan"), ("r", 0, "ok")], "run string, line_no int, value string")
    health = reports.training_health(log, lines).first()
    assert health.verdict == "PASS" and health.errors == ["nan", "Error b"]
