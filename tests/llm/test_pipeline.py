"""The pipeline against a plain version of its stages; and what documents each stage keeps."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from loomwork.llm import langid, pii
from loomwork.llm.common import documents

from .test_corpus import brute_contamination
from .test_near_dedup import brute_kept


def test_pipeline_equals_a_plain_version(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, sf)
    score = langid.scorer(langid.train_on(docs))
    rows = {r.doc_id: r.text for r in docs.collect() if score(r.text)[1] >= 0.01}
    kept = brute_kept(list(rows.items()))
    rows = {d: t for d, t in rows.items() if d in kept}
    items = [tuple(r) for r in documents(spark, sf, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_contamination(list(rows.items()), items) if r[5]}
    want = Counter()
    for d, t in rows.items():
        if d not in bad:
            ids = np.array([*library.encode(pii.redact(t, pii.spans_of(t)[1]), add_special_tokens=False).ids, 1], "<u4")
            for k, a in enumerate(range(0, len(ids), 4096)):
                want[d, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 0 < len(bad) and len(rows) < docs.count()


def test_stages_keep_columns_and_odd_rows(spark, sf):
    docs = documents(spark, sf)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, "en", "s", 0), (None, "x", "en", "s", 1), (8, "x", "en", "s", 1), (8, "x", "en", "s", 1)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.union(odd), sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = sorted((tuple(r) for r in corpus_pipeline.near_dedup(spark, odd, sf).select("doc_id", "text").collect()), key=str)
    assert kept == [(7, None), (8, "x")]


def test_what_each_stage_keeps_of_odd_rows(spark, sf, tmp_path):
    docs = documents(spark, sf)
    odd = spark.createDataFrame([(None, None, None, None, None), (-7, None, "en", "s", 0), (-8, "", "en", "s", 0), (-9, "12 34", "en", "s", 5), (-1, "x y", "en", "s", 3), (-1, "x y", "en", "s", 3)], docs.schema)
    mine = lambda df: sorted((tuple(r) for r in df.where("doc_id is null or doc_id < 0").select("doc_id", "text").collect()), key=str)
    judged = mine(corpus_pipeline.language_id(spark, docs.union(odd), sf))
    assert judged in ([], [(-1, "x y")] * 2)  # null, empty and letterless texts go, equal texts are judged alike
    every = mine(odd)
    assert mine(corpus_pipeline.decontaminate(spark, odd, sf)) == every
    assert mine(corpus_pipeline.redact_pii(spark, odd, sf)) == every
    redacted = corpus_pipeline.redact_pii(spark, odd, sf).where("doc_id = -7 or doc_id is null").select("n_chars").collect()
    assert [r.n_chars for r in redacted] == [None, None]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == docs.count()
    clashing = odd.withColumn("hash", odd.doc_id).withColumn("n_words", odd.text).withColumn("chunk", odd.lang).withColumn("lang_rejected", odd.lang)
    for stage in (corpus_pipeline.decontaminate, corpus_pipeline.redact_pii, corpus_pipeline.near_dedup):
        assert stage(spark, clashing, sf).columns == clashing.columns
