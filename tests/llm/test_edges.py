"""What every operator must bear: nulls, empty and very long texts, repeated rows, empty tables, columns whose names clash with its own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.llm import decontam, langid, licenses, packing, pii, quality, sharding, simhash, substrings, tokencount

BPE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "Ein Haus am See, " * 30_000
ROWS = [
    (1, "The house of the river is old. It was built by hands. " * 20, "en"), (2, "Das Haus am Fluss ist alt und wurde von Hand gebaut. " * 20, "de"), (3, None, "en"), (4, "", None),
    (5, LONG, "de"), (6, "x" * 300_000, "en"), (7, "same text", "en"), (7, "same text", "en"), (8, "same text", "en"), (None, "same text", None), (None, None, None), (9, "@" * 5000 + "1 " * 5000, "en"),
    (10, "Released under the MIT License. Mail a.b@example.org", "en"),
]
CLASHES = ["n_words", "words", "fp", "score", "lang_pred", "hash", "chunk", "size", "key", "salt", "rank", "pii_spans", "finds", "kept", "length", "piece", "root", "tokens"]


def benchmark(docs):
    return docs.sparkSession.createDataFrame([(1, "the house of the river is old it was built"), (None, "same text"), (2, None)], "item_id long, text string")


DIGESTS = {
    "op1": substrings.digest, "op2": licenses.digest, "op3": quality.digest, "op4": lambda d: decontam.digest(d, benchmark(d)), "op5": lambda d: tokencount.digest(d, BPE), "op6": lambda d: packing.pack(d, WORDS),
    "op7": simhash.digest, "op8": pii.digest, "op9": sharding.digest, "op10": langid.digest,
}
#: Columns whose values may differ between runs: places are any that fit.
FREE = {"sequence_id", "offset", "slot", "shard"}


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def rows_of(df):
    kept = [c for c in df.columns if c not in FREE]
    return sorted((tuple(str(v) for v in r) for r in df.select(kept).collect()))


@pytest.mark.parametrize("name", DIGESTS)
def test_odd_rows_and_clashing_names(spark, name):
    plain = frame(spark)
    clashing = plain
    for i, c in enumerate(CLASHES):
        clashing = clashing.withColumn(c, F.lit("clash") if i % 2 else F.lit(None).cast("int"))
    got = DIGESTS[name](plain)
    want = rows_of(got)
    assert rows_of(DIGESTS[name](clashing.repartition(3))) == want
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    counts = {i: ids.count(i) for i in (3, 4, 7, 8, None)}
    assert counts == {3: 1, 4: 1, 7: 2, 8: 1, None: 2}


@pytest.mark.parametrize("name", DIGESTS)
def test_empty_tables(spark, name):
    full, none = DIGESTS[name](frame(spark)), DIGESTS[name](frame(spark, []))
    assert none.schema == full.schema and none.count() == 0


@pytest.mark.parametrize("name", DIGESTS)
def test_only_nulls(spark, name):
    rows = DIGESTS[name](frame(spark, [(None, None, None)] * 3)).collect()
    assert len(rows) == 3 and all(r["doc_id"] is None for r in rows)


def test_row_filters_keep_every_column(spark):
    docs = frame(spark).withColumn("fp", F.lit(1)).withColumn("root", F.lit("r"))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect() if r.text == "same text") == ["7"]
    assert decontam.decontaminate(docs, benchmark(docs)).where("doc_id = 1").count() == 0
    assert pii.find_pii(docs, redacted="text").where("doc_id = 10").first().text == "Released under the MIT License. Mail [email]"
