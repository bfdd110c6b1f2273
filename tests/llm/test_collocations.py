"""Collocations against counting every phrase in a dictionary."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            own.update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inner = {(p[i:j], a) for p, a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p)}
        scored = []
        for p, a in found.items():
            if (p, a) not in inner:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def texts(seed, words):
    rng = random.Random(seed)
    rows = [(None, None), ("en", None), ("en", ""), ("", " .,;"), ("und", "Straße\u00a0x a\tb. A b\r\nÄ b"), (None, "a b, a  b! A b?a b"), ("fr", "la la la la la la la")]
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ": "]) for _ in range(rng.randint(0, 60)))
        rows += [(rng.choice(["en", "en", "de", None]), text)] * rng.choice([1, 1, 3])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("top", [2000, 7])
def test_equals_counting_everything(spark, seed, top):
    rows = texts(seed, ["a", "B", "c", "\u00e9", "d\u00e9", "\U0001f600", "\uffee", "x-y", "zz", "\x00", "\x1c"])
    got = collocations.collocations(frame(spark, rows).repartition(3), 4, top)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, top)


def test_many_small_shards(spark):
    rows = texts(3, ["w%d" % i for i in range(12)])
    got = collocations.collocations(frame(spark, rows), 3, shard=400)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 2000)


def test_automata_of_few_phrases_count_overlaps(monkeypatch):
    monkeypatch.setattr(collocations, "PATTERNS", 2)
    assert collocations.scanned([" a b ", " b a ", " a ", " a b a "], " a b a b a \n a ").tolist() == [2, 2, 4, 2]


def test_clashing_names_and_empty_tables(spark):
    rows = texts(4, ["p", "q", "r"])
    plainly = collocations.collocations(frame(spark, rows), 5)
    clashing = frame(spark, rows)
    for c in ("id", "n", "seq", "words", "phrase", "f", "a", "rank", "count"):
        clashing = clashing.withColumn(c, F.lit("clash"))
    assert sorted(map(tuple, collocations.collocations(clashing, 5).collect())) == sorted(map(tuple, plainly.collect()))
    none = collocations.collocations(frame(spark, []), 5)
    assert none.schema == plainly.schema and none.count() == 0
    assert collocations.collocations(frame(spark, [(None, None)] * 3), 1).count() == 0


def test_scores_past_64_bits(spark):
    a, n, left, right = 4_000_000_000_000, 9_000_000_000_000_007, 5_000_000_000_001, 7_000_000_000_003
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(collocations.exact_score().alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)
