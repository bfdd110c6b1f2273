"""Sources and sinks: round trips, missing and old files, golden coordinates."""

import json

import pytest
from pyspark.sql import functions as F

from loomwork.operators import geography
from loomwork.sources import io, registry
from loomwork.streaming import monitor


def test_results_round_trip(spark, tmp_path):
    rows = [(i, "US" if i % 2 else "Iran", "Western" if i % 2 else "Non-Western", "yes", "yes" if i % 3 else "no", None, [0.5, float(i)]) for i in range(6)]
    preds = spark.createDataFrame(rows, "row_idx long, country string, `group` string, gold string, pred string, us_pred string, scores array<double>")
    path = str(tmp_path / "r.json")
    io.write_result(preds.repartition(3), "base", "stories", path)
    assert json.load(open(path))["accuracy_by_group"] == {"Non-Western": pytest.approx(2 / 3), "Western": pytest.approx(2 / 3)}
    head = io.read_results(spark, path).first()
    assert head.n == 6 and head.accuracy_overall == pytest.approx(4 / 6) and set(head.accuracy_by_country) == {"US", "Iran"}
    back = io.read_predictions(spark, path, size=50).orderBy("row_idx").collect()
    assert [(r.row_idx, r.pred, r.scores) for r in back] == [(r[0], r[4], r[6]) for r in rows]
    assert io.read_results(spark, str(tmp_path / "none.json")).count() == 0


def test_datasets(spark, tmp_path):
    path = str(tmp_path / "d")
    fallback = lambda s: s.createDataFrame([(0, "far")], "a int, b string")
    assert io.local_first(spark, path, fallback).first().b == "far"
    spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").write.parquet(path)
    assert io.local_first(spark, path, fallback).count() == 2
    io.write_replacing(spark.read.parquet(path).withColumn("b", F.upper("b")), path)
    assert sorted(r.b for r in spark.read.parquet(path).collect()) == ["X", "Y"]
    split = spark.createDataFrame([("train", 1), ("validation", 2)], "split string, v int")
    assert [tuple(r) for r in io.pick_split(split).collect()] == [(2,)]
    with pytest.raises(ValueError):
        io.pick_split(split, wanted=["dev"])
    parts = io.route(split, "split", {"a": ["train"], "b": ["validation", "test"]})
    assert parts["a"].count() == 1 and parts["b"].first().v == 2
    assert io.add_once(split, ["v"], lambda d: 1 / 0) is split


def test_survey_and_coordinates(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('X,B_COUNTRY_ALPHA,W_WEIGHT,SACSECVAL,RESEMAVAL\n1,USA,,0.5,0.4\n1,"""USA""",2.5,-2,0.6\n1,-4,1,1,1\n1,,1,1,1\n1,FRA,0,-1,x\n')
    rows = [tuple(r) for r in io.read_survey(spark, str(p)).collect()]
    assert rows == [("USA", 1.0, 0.5, 0.4), ("USA", 2.5, None, 0.6), ("FRA", 1.0, -1.0, None)]


#: Published coordinates of two clusters' countries (one country without any), and the published centres.
COORDINATES = """country_iso,normad_country,cluster,cluster_inferred,sacsecval,resemaval,dist_from_english,n_respondents
AUS,australia,EnglishSpeaking,no,0.4137,0.6272,0.0168,1813
GBR,united_kingdom,EnglishSpeaking,no,0.4259,0.6499,0.0280,2609
NIR,,EnglishSpeaking,yes,0.4002,0.6131,0.0309,447
NZL,new_zealand,EnglishSpeaking,no,0.4056,0.6449,0.0332,1057
CAN,canada,EnglishSpeaking,no,0.4777,0.6357,0.0498,4018
JPN,japan,Confucian,no,0.4391,0.5563,0.0665,1353
USA,united_states_of_america,EnglishSpeaking,no,0.3806,0.5605,0.0789,2596
MAC,,Confucian,no,0.5128,0.5014,0.1466,1023
HKG,hong_kong,Confucian,no,0.4959,0.4855,0.1518,2075
TWN,taiwan,Confucian,no,0.4470,0.4546,0.1685,1223
SGP,singapore,Confucian,no,0.3199,0.4494,0.2047,2012
VNM,vietnam,Confucian,no,0.4235,0.4071,0.2151,1200
KOR,south_korea,Confucian,no,0.5639,0.4535,0.2155,1245
MNG,,Confucian,no,0.5444,0.4355,0.2190,1638
CHN,china,Confucian,no,0.4013,0.3918,0.2322,3036
IRL,ireland,EnglishSpeaking,no,,,,0
"""
CENTRES = {
    "EnglishSpeaking": (0.4287, 0.6218, 0.0, 6, 12540, 1, "AUS;CAN;GBR;NIR;NZL;USA"),
    "Confucian": (0.4497, 0.4518, 0.1713, 9, 14805, 0, "CHN;HKG;JPN;KOR;MAC;MNG;SGP;TWN;VNM"),
}


def test_golden_cluster_summary(spark, tmp_path):
    (tmp_path / "c.csv").write_text(COORDINATES)
    path = str(tmp_path / "c.csv")
    coords = io.read_coordinates(spark, path, require=True).withColumn("country", F.col("iso"))
    assert coords.count() == 15 and io.read_coordinates(spark, path).count() == 16
    assert io.cluster_dimension(io.read_coordinates(spark, path)).count() == 13
    got = {r.cluster: r for r in geography.cluster_summary(coords, "EnglishSpeaking").collect()}
    assert set(got) == set(CENTRES)
    for k, (x, y, distance, n, people, inferred, members) in CENTRES.items():
        g = got[k]
        assert (g.x, g.y, g.distance) == (pytest.approx(x, abs=1e-4), pytest.approx(y, abs=1e-4), pytest.approx(distance, abs=1e-4))
        assert (g.n_countries, g.n_respondents, g.n_inferred, g.countries) == (n, people, inferred, members)


def test_score_maps_caches_logs(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"neuron_scores": {"self_attn.q_proj_1_2": {"Iran": 0.5, "Peru": 1.5}}, "dataset_ids": {}}))
    assert {tuple(r) for r in io.read_score_map(spark, str(tmp_path / "n.json")).collect()} == {("self_attn.q_proj", 1, 2, "Iran", 0.5), ("self_attn.q_proj", 1, 2, "Peru", 1.5)}
    (tmp_path / "new.json").write_text(json.dumps({"a b": {"culture_tag": "X", "domain_tag": "d", "task_intent_tag": "t", "language": "en"}}))
    (tmp_path / "old.json").write_text(json.dumps({"a b": "X"}))
    assert io.read_tag_cache(spark, str(tmp_path / "new.json")).first().culture_tag == "X"
    assert io.read_tag_cache(spark, str(tmp_path / "old.json"), strict=False).count() == 0 and io.read_tag_cache(spark, str(tmp_path / "no.json"), strict=False).count() == 0
    with pytest.raises(ValueError):
        io.read_tag_cache(spark, str(tmp_path / "old.json"))
    (tmp_path / "state.json").write_text(json.dumps({"log_history": [{"loss": 1.0}, {"rewards/margins": 0.2, "rewards/accuracies": 0.5}, {"x": 1}]}))
    log = io.read_training_log(spark, str(tmp_path / "state.json")).orderBy("step").collect()
    assert [(r.loss, r.margin, r.accuracy) for r in log] == [(1.0, None, None), (None, 0.2, 0.5), (None, None, None)]
    (tmp_path / "a.err").write_text("one\nError\n")
    assert [r.value for r in io.read_lines(spark, str(tmp_path / "a.err")).orderBy("line_no").collect()][:2] == ["one", "Error"]
    assert io.list_files(spark, str(tmp_path / "*.err")).count() == 1


def test_training_logs_of_many_runs_in_a_file(spark, sf, tmp_path):
    """Documents on lines name their runs; the query's files do not follow the number of runs."""
    import __spark_entry__ as entry

    (tmp_path / "many.json").write_text("".join(json.dumps(d) + "\n" for d in ({"run": "b", "log_history": [{"loss": 2.0}, {"x": 1}]}, {"run": "a", "log_history": [{"rewards/margins": 0.5}]}, {"run": "c", "log_history": []})))
    got = io.read_training_log(spark, str(tmp_path / "many.json"), run="run").orderBy("run", "step").collect()
    assert [tuple(r) for r in got] == [("a", 0, None, 0.5, None), ("b", 0, 2.0, None, None), ("b", 1, None, None, None)]
    out = entry.queries()["training_log_scan"](spark, sf)
    runs = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert out.count() == runs and len(out.inputFiles()) <= 8


def test_checkpoints_and_conditions(spark, tmp_path):
    for n in ("checkpoint-9", "checkpoint-100", "checkpoint-x", "other"):
        (tmp_path / "sft" / n).mkdir(parents=True)
    assert io.latest_checkpoint(spark, str(tmp_path / "sft")).endswith("checkpoint-100")
    assert io.latest_checkpoint(spark, str(tmp_path / "none")) is None and io.latest_checkpoint(spark, str(tmp_path / "none"), True) == str(tmp_path / "none")
    c = registry.resolve(spark, "sftdpo_pku", str(tmp_path))
    assert c.before.endswith("sft/checkpoint-100") and c.adapter.endswith("sftdpo_pku") and c.epoch == 2
    assert len(registry.conditions()) == 16 and registry.condition_table(spark, "8b").where("cond = 'dpo'").first().adapter == "dpo_8b"
    with pytest.raises(ValueError):
        registry.resolve(spark, "nothing", str(tmp_path))


def test_reports(spark, tmp_path):
    table = spark.createDataFrame([("a", 0.123456, ["x", "y"], 3), ("b", None, None, 4)], "k string, v double, l array<string>, n int")
    io.write_report(table, str(tmp_path / "r"))
    lines = sorted(next((tmp_path / "r").glob("*.csv")).read_text().split("\n"))
    assert "a,0.1235,x;y,3" in lines and "b,,,4" in lines
    shown = io.markdown(table.drop("l"))
    assert "| a | +0.123 | 3 |" in shown and "| b | — | 4 |" in shown
    params = spark.createDataFrame([("m", "w", 10, False), ("m", "x.lora_A", 2, True)], "model string, name string, numel long, trainable boolean")
    assert tuple(io.parameter_counts(params).first()) == ("m", 12, 2, 2)
    nodes = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "node string")
    probes = spark.createDataFrame([("n1", "python3.12: PRESENT"), ("n2", None)], "node string, value string")
    assert {r.node: r.status for r in io.node_summary(nodes, probes).collect()} == {"n1": "PRESENT", "n2": "NO_DATA", "n3": "NOT_RUN"}


def test_streams_in_several_batches(spark, tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    import time

    for k in range(3):
        frame = spark.createDataFrame([(1, 10 * k + i, -1.0 if k else 1.0, f"v{k}") for i in range(2)] + [(2, 10 * k, 5.0, "w")], "run long, i long, m double, tag string")
        frame.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(folder / f"b{k}.parquet")
        time.sleep(1.1)
    stream = lambda: spark.readStream.schema("run long, i long, m double, tag string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    assert [tuple(r) for r in monitor.run_to_table(monitor.early_stops(stream(), "run", "m", 3, "i"), "t").collect()] == [(1, 5)]
    assert {(r.run, r.tag) for r in monitor.lookup_from_stream(stream(), ["run"], "i").collect()} == {(1, "v2"), (2, "w")}
