"""Names in texts, option orders, models, streams in disorder: against plain Python and hand-made cases."""

import itertools
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.operators import mentions, scoring
from loomwork.sources import registry
from loomwork.streaming import monitor


def plain_names(docs, names):
    """Leftmost, of those the longest, no overlaps."""
    known = {}
    for name, country in sorted(names, key=lambda x: x[1]):
        words = tuple(re.findall(r"[^\W_]+", name.lower()))
        if words:
            known.setdefault(words, country)
    longest = max(map(len, known), default=0)
    out = []
    for key, body in docs:
        words, at = re.findall(r"[^\W_]+", (body or "").lower()), 0
        while at < len(words):
            for k in range(longest, 0, -1):
                if (found := tuple(words[at : at + k])) in known and len(found) == k:
                    out.append((key, at, k, known[found]))
                    at += k - 1
                    break
            at += 1
    return sorted(out)


def test_names_in_texts(spark):
    rng = random.Random(3)
    words = ["new", "york", "City", "south", "Korea", "são", "paulo", "a", "x", "us"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", ".", "_", "-"]) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(900, None), (901, ""), (902, "new york " * 5000)]
    names = [("New York", "US"), ("new york city", "US"), ("York", "UK"), ("South-Korea", "Korea"), ("korea", ""), ("São Paulo", "Brazil"), ("us", "US"), ("us", "Aland"), ("!!", "none"), ("a x us", "Deep")]
    frame, gazetteer = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(names, "name string, country string")
    got = sorted(map(tuple, mentions.find_names(frame, gazetteer, "id").collect()))
    assert got == plain_names(docs, names)
    lists = {r.id: r.countries for r in mentions.referenced(frame, gazetteer, "id").collect()}
    assert lists[900] == [] and lists[902] == ["US"] and len(lists) == len(docs)
    want = {}
    for key, _, _, country in got:
        if country and country not in want.setdefault(key, []):
            want[key].append(country)
    assert all(lists[k] == want.get(k, []) for k in lists)
    assert mentions.find_names(frame, gazetteer.limit(0), "id").count() == 0


def test_names_with_one_first_word(spark):
    """A word is looked up with the words after it: names that begin alike are not gone through one by one (a thousand million pairs here)."""
    names = spark.range(20000).select(F.concat(F.lit("of "), F.col("id").cast("string")).alias("name"), F.lit("US").alias("country"))
    docs = spark.createDataFrame([(i, "of " * 5000 + f"of {i}") for i in range(10)], "id long, text string")
    begun = time.time()
    assert sorted(map(tuple, mentions.find_names(docs, names, "id").collect())) == [(i, 5000, 2, "US") for i in range(10)]
    assert time.time() - begun < 30


def test_names_in_texts_shuffle_no_words(spark):
    """What texts and names travel as is less than the texts themselves, though every word begins a name."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=3000))) for i in range(200)] + [(900, None), (901, "?!"), (902, words[0])]
    names = [(" ".join(rng.choices(words, k=k % 3 + 1)), rng.choice(["US", "UK", "", "Korea"])) for k in range(3000)] + [(w, "Aland") for w in words]
    frame, gazetteer = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(names, "name string, country string")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    before = {f.getPath() for f in map(files().apply, range(files().length()))}
    got = mentions.referenced(frame.select("id", "text"), gazetteer, "id").select("id", "countries").collect()
    after = files()
    written = sum(f.length() for f in map(after.apply, range(after.length())) if f.getPath() not in before)
    want = {}
    for key, _, _, country in plain_names(docs, names):
        if country and country not in want.setdefault(key, []):
            want[key].append(country)
    assert {r.id: r.countries for r in got} == {d: want.get(d, []) for d, _ in docs}
    assert written < sum(len(t or "") for _, t in docs)


def test_option_orders(spark):
    rows = spark.range(6000).select("id", *[text.permutation(n, "s", "id").alias(f"p{n}") for n in (1, 2, 3, 4)]).collect()
    for n in (1, 2, 3, 4):
        seen = Counter(tuple(r[f"p{n}"]) for r in rows)
        assert set(seen) == set(itertools.permutations(range(1, n + 1)))
        assert max(seen.values()) < 1.4 * min(seen.values())  # every order is as likely
    labels = ["yes", "no", "neutral"]
    numbers = F.array(F.lit(3), F.lit(1), F.lit(2))
    shown = spark.createDataFrame([("yes",), ("no",), ("neutral",), ("other",), (None,)], "gold string").select(text.numbered_options(labels, numbers).alias("o"), text.option_number(labels, numbers, "gold").alias("k")).collect()
    assert shown[0].o == "1: no, 2: neutral, 3: yes" and [r.k for r in shown] == [3, 1, 2, None, None]
    with pytest.raises(ValueError):
        text.permutation(7, "s", "id")


def test_a_model_is_built_once_and_sees_batches_of_like_length(spark):
    class Probe(scoring.PromptBigrams):
        def __init__(self):
            self.calls = 0

        def __call__(self, prompts, choices):
            self.calls += 1
            assert len(prompts) <= 3 and sorted(prompts, key=len) == prompts and choices == [" yes", " no"]
            return [[float(len(p)), float(self.calls)] for p in prompts]

    rows = spark.createDataFrame([(i, "x" * (37 * i % 11 + 1)) for i in range(20)] + [(99, None)], "id int, prompt string").coalesce(1).withColumn("scores", F.lit("old"))
    got = {r.id: r.scores for r in scoring.score_with(rows, Probe, ["yes", "no"], batch=3).collect()}
    assert all(got[i][0] == 37 * i % 11 + 1 for i in range(20)) and got[99] is None
    assert max(s[1] for s in got.values() if s) == 7  # one model for all batches
    said = scoring.answer_with(rows.drop("scores"), lambda: scoring.PromptBigrams().answer)
    assert said.where("id = 3").first().answer == "x" * 8 and said.where("id = 99").first().answer is None
    label = spark.createDataFrame([("no no no no",)], "prompt string")
    assert scoring.answer_with(label, lambda: scoring.PromptBigrams().answer).select(text.parse_label("answer").alias("l")).first().l == "no"
    priors = scoring.priors_with(spark.createDataFrame([("k", "ab"), ("k", "abab")], "k string, prompt string"), ["k"], scoring.PromptBigrams, ["y", "n"])
    assert len(priors.first().means) == 2
    with pytest.raises(Exception, match="no usable scores"):
        scoring.require_scores(spark.createDataFrame([(None,)], "scores array<double>")).collect()


def test_rows_in_any_order_stop_a_run_where_ordered_ones_do(spark, tmp_path):
    rows = [(1, k, 1000 + k, -1.0 if k in (3, 4, 5, 9) else 1.0) for k in range(12)] + [(2, 50 + k, 1000 + k, -1.0) for k in range(2)] + [(3, 70 + k, 1000 + k, 0.0 if k % 2 else None) for k in range(8)]
    random.Random(5).shuffle(rows)
    frames = [rows[i::4] for i in range(4)] + [[(-1, -1, 9000, None)]]
    folder = tmp_path / "s"
    for part in frames:
        frame = spark.createDataFrame(part, "run long, tie long, sec long, m double").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = monitor.run_to_table(monitor.early_stops_any_order(stream, "run", "m", 3, "ts", "tie", "60 seconds"), "late").collect()
    assert sorted(map(tuple, got)) == [(1, 6), (3, 3)]


def test_late_rows_wake_buckets_and_not_runs(spark, tmp_path):
    """Many runs share a call, and each, that of null id too, stops where plain Python stops it."""
    rng = random.Random(6)
    rows = [(None if run == 0 else run, 100 * run + k, 1000 + k, rng.choice([-1.0, 0.0, 2.0, None])) for run in range(40) for k in range(20)]
    want = {}
    for run in range(40):
        margins = [m for r, _, _, m in rows if r == (run or None) and m is not None]
        steps = [i + 1 for i in range(2, len(margins)) if max(margins[i - 2 : i + 1]) <= 0]
        want |= {run or None: steps[0]} if steps else {}
    rng.shuffle(rows)
    for part in [rows[::2], rows[1::2], [(-1, -1, 9000, None)]]:
        frame = spark.createDataFrame(part, "run long, tie long, sec long, m double").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(1.1)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = monitor.run_to_table(monitor.early_stops_any_order(stream, "run", "m", 3, "ts", "tie", "60 seconds", buckets=3), "late").collect()
    assert len(want) > 10 and None in want and {r.run: r.stop_step for r in got} == want and len(got) == len(want)


def test_a_routed_scan_tells_how_far_it_is(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, "abcx"[i % 4]) for i in range(10 * k, 10 * k + 10)], "id long, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("id long, source string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = []
    rows, shown = monitor.scan_routed(stream, "source", {"one": ["a", "b"], "two": ["c"]}, str(tmp_path / "out"), told.append)
    assert len(shown) == 3 and sum(b["scanned"] for b in shown) == 30
    assert {r.route: r["count"] for r in rows.groupBy("route").count().collect()} == told[-1] == {"one": 16, "two": 7}
    assert [t["one"] for t in told] == sorted(t["one"] for t in told) and len(told) == 3
    with pytest.raises(ValueError):
        monitor.scan_routed(stream, "source", {"one": ["a"], "two": ["a"]}, str(tmp_path / "no"))


def test_loaders_by_name(spark):
    names = ["org/COIG-P", "PKU-SafeRLHF-30K", "Anthropic/hh-rlhf", "else"]
    assert [registry.pair_loader(n) for n in names] == ["turns", "oriented", "transcripts", "transcripts"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(registry.pair_loader_column("n").alias("k")).collect()
    assert [r.k for r in got] == [registry.pair_loader(n) for n in names]
    assert registry.comparison_table(spark).count() > 0


def test_attribution_reads_contributions_once(spark, sf):
    """Both selections come from deltas that were written; neither reads the line items again."""
    from loomwork.plans import queries, study

    for query in (study.QUERIES["attribution_details"], queries.QUERIES["cross_source_overlap"], queries.QUERIES["exclude_countryrc"]):
        assert not [f for f in query(spark, sf).inputFiles() if "lineitem" in f]
