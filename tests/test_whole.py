"""Queries over whole texts, tables and replicate counts."""

import __spark_entry__ as entry
from loomwork.plans.bindings import table


def test_counterfactual_rewrite_reaches_past_a_prefix(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r.text for r in entry.queries()["counterfactual_rewrite"](spark, sf).collect()}
    late = [d for d, t in docs.items() if "the" in t and "the" not in t[:60]]
    assert late and all(got[d] == docs[d].replace("the", "US") for d in late)


def test_prompts_hold_whole_texts(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for name, column in (("instruction_format", "text"), ("reading_prompts", "prompt")):
        got = {r.doc_id: r[column] for r in entry.queries()[name](spark, sf).collect()}
        assert got.keys() == docs.keys() and all(docs[d] in got[d] for d in docs)


def test_picks_and_merge_see_every_row(spark, sf):
    docs = {r.doc_id for r in table(spark, sf, "documents").collect()}
    assert docs <= {r.doc_id for r in entry.queries()["merge_precedence"](spark, sf).collect()}
    orders = {r.o_orderkey: r.o_custkey for r in table(spark, sf, "orders").collect()}
    assert any(orders[r.o_orderkey] % 10 for r in entry.queries()["fewshot_pick"](spark, sf).collect())
    assert any(r.item % 5 for r in entry.queries()["fewshot_distinct_then_fill"](spark, sf).collect())


def test_resampling_draws_5000_replicates(spark, sf):
    assert all(entry.queries()[name](spark, sf).first().n == 5000 for name in ("bootstrap_gap_ci", "item_bootstrap_ci"))
    assert entry.queries()["significance_report"](spark, sf).count() == 4


def test_item_draws_are_counted_by_class(spark):
    """The draws of single items, replayed; no function runs over an array for each draw."""
    import hashlib

    from loomwork.operators import resample

    rows = sorted(("W" if i % 3 else "NW", i % 2, 1, i % 5 % 2, 1) for i in range(40))
    frame = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "idx long, side string, h0 long, n0 long, h1 long, n1 long")
    out = resample.item_bootstrap_by_draws(frame, 30)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    for rep, shift in map(tuple, out.collect()):
        own = [rows[int(hashlib.md5(f"item_{rep}_{k}".encode()).hexdigest()[:8], 16) % 40] for k in range(40)]
        rate = lambda s, i: sum(r[i] for r in own if r[0] == s) / sum(r[i + 1] for r in own if r[0] == s)
        assert abs(shift - ((rate("W", 3) - rate("NW", 3)) - (rate("W", 1) - rate("NW", 1)))) < 1e-12


def test_item_bootstrap_by_classes_follows_draws_of_single_items(spark):
    import numpy as np

    from loomwork.operators import resample

    rng = np.random.default_rng(1)
    rows = [(i, "W" if i % 3 else "NW", int(rng.random() < 0.6), 1, int(rng.random() < 0.7), 1) for i in range(90)]
    got = np.array([r.shift for r in resample.item_bootstrap(spark.createDataFrame(rows, "idx long, side string, h0 long, n0 long, h1 long, n1 long"), 4000).collect()])
    plain = np.array([r[1:] for r in rows], dtype=object)
    want = []
    for _ in range(4000):
        own = plain[rng.integers(0, 90, 90)]
        w, other = own[own[:, 0] == "W"], own[own[:, 0] == "NW"]
        want.append((w[:, 3].mean() - other[:, 3].mean()) - (w[:, 1].mean() - other[:, 1].mean()))
    want = np.array(want, float)
    assert len(got) == 4000 and abs(got.mean() - want.mean()) < 0.01 and abs(got.std() - want.std()) < 0.01
    assert np.abs(np.quantile(got, [0.025, 0.975]) - np.quantile(want, [0.025, 0.975])).max() < 0.03
