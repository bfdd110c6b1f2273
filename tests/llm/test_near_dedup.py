"""The near-dedup stage against all pairs, and on copies with a few changed words."""

import random
from itertools import combinations

import corpus_pipeline
from loomwork.llm import simhash
from loomwork.llm.common import documents

from .test_corpus import brute_components


def sets_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    own = {d: sets_of(t) for d, t in rows}
    pairs = [(a, b) for a, b in combinations(sorted(own), 2) if own[a] == own[b] or len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    roots = brute_components(pairs, sorted(own))
    return {roots[d] for d in own}


def test_stage_equals_all_pairs(spark, sf):
    docs = documents(spark, sf)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).select("doc_id").collect()}
    assert got == brute_kept([(r.doc_id, r.text) for r in docs.collect()]) and len(got) < docs.count()


def test_edited_copies_are_found(spark, sf, docs_of):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        edited = list(words)
        for i in (40, 120):
            edited[i] = "changed"
        other = [w if i % 10 else "far" for i, w in enumerate(words)]  # half of the shingles or less remain
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(edited)), (3 * k + 2, " ".join(other))]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), sf).select("doc_id").collect()}
    assert got == {r[0] for r in rows if r[0] % 3 != 1} == brute_kept(rows)


def test_long_postings_lose_no_link(spark, sf, docs_of, monkeypatch):
    """Copies of one text in postings of several blocks: linked to the base, to each other only, or to nothing."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for k in range(2, 70):
        words = list(base)
        for i in rng.sample(range(160), rng.randrange(1, 7)):
            words[i] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), sf).select("doc_id").collect()}
    want = brute_kept(rows)
    assert got == want and 1 < len(want) < 40


def test_no_similar_pair_is_left_out(spark, sf, docs_of):
    """Pairs of similarity 0.8 whose minima agree in no run, or in too few places."""
    rows = []
    for k, seed in enumerate((928, 1973, 2875, 3272, 5444, 7351, 8794, 11379)):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        edited = list(words)
        edited[20] = "changed"  # 40 of 50 shingles remain
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), sf).select("doc_id").collect()}
    assert got == brute_kept(rows) == set(range(0, len(rows), 2))


def test_prefixes_alone_equal_all_pairs(spark, docs_of, monkeypatch):
    """Without the minima, also with frequent shingles put last and postings of several blocks."""
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(40):
        words = passage[: rng.randrange(20, 60)] + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))]
        for j in range(rng.randrange(1, 4)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
    want = brute_kept(rows)
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "similarity_links", lambda *_: none)
    for shown, block in ((16, 512), (1, 8)):
        monkeypatch.setattr(simhash, "SHOWN", shown)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r.doc_id for r in simhash.deduplicate(docs_of(rows)).select("doc_id").collect()}
        assert got == want and len(want) < len(rows)
