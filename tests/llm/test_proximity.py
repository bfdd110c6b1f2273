"""Proximity matches of a benchmark passage whose later terms are missing or that an extra word breaks."""

from loomwork.llm import decontam


def test_proximity_names_items_and_stands_without_later_terms(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([("i1", item)], "item_id string, text string")
    common = [(10 + k, "delta epsilon zeta eta theta iota kappa " * 3) for k in range(3)]
    inserted = "alpha extra beta gamma delta epsilon zeta eta theta iota kappa"
    rows = docs_of([(1, inserted), (2, "alpha beta gamma"), (3, "x y z"), *common])
    got = {r.doc_id: r for r in decontam.digest(rows, bench).collect()}
    assert got[1].near_items == "i1" and got[1].n_near > 0 and got[3].near_items == "" and got[10].n_near == 0
    assert got[2].near_items == "i1" and not any(r.contaminated for r in got.values())


def test_items_that_share_a_window_and_many_blocks(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(i, text) for i in range(30)] + [(99, "w3"), (98, "w39 w0")], "item_id long, text string")
    rows = docs_of([(1, "a " + text + " b"), (2, text[:60]), (3, "w39 w0"), (4, None)])
    for block in (None, 3):
        got = {r.doc_id: r for r in decontam.contamination(rows, bench, block_windows=block).collect()}
        assert got[1].hit_words == list(range(1, 41)) and len(got[1]["items"]) == 31 and got[1].n_near == 31
        assert got[3]["items"] == ["98"] and got[3].hit_words == [0, 1] and got[4].hit_words == []
