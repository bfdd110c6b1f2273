"""Mixture packing against the tokenizer library, a token-by-token schedule and an exact round trip."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import mixing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    bits = ["word", "Word", "don't", "it's", "'s", "é", "ß", "\u4e2d\u6587", "\U0001f600", "1234", "3.5", "...", ".", ",", "!?", "\n", "\n\n", " ", "  ", "   ", "\t", "\r\n", "\u00a0", "\u0085", "\u2028", "\x1c", "\x00", "<|endoftext|>", "<|", "x.", "y,", "a.b", "»."]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", ""]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    return ["", " ", "  ", "a ", "a. ", "a.", "a.\n", "\n", "a\n b", "a \n b", "a\n\nb", "a  b", "a   b", " a", *made]


def test_ids_equal_the_library(library):
    texts = odd_texts()
    encoder = mixing.ByteIds(PATH)
    easy = [t for t in texts if not set(t) & {"\x00", "<", "\n", "\t", " "} or t.split() == t.split(" ")]
    for own in (texts, texts[::-1], easy, ["a b. c"], [""], ["\x00"]):
        ids, counts = encoder(pa.array(own, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in own]


def test_schedule_equals_stepping_through_time():
    """Credit per unit of weight in small exact steps: nobody is ahead of their credit, nobody a whole token behind."""
    for totals, weights, window in (([70, 30, 5], [7, 3, 1], 10), ([50, 50, 1], [1, 9, 90], 16), ([33], [5], 7), ([1, 1, 1000], [1, 1, 1], 64)):
        plan = mixing.Schedule(totals, weights, window)
        assert plan.sent(0).tolist() == [0] * len(totals) and plan.sent(plan.windows).tolist() == totals
        for k in range(1, plan.windows + 1):
            before, now = plan.sent(k - 1), plan.sent(k)
            assert (now >= before).all() and 0 <= min(k * window, sum(totals)) - now.sum() < len(totals)
            v = plan.time(k)
            for sent, total, weight in zip(now.tolist(), totals, weights):
                credit = min(Fraction(total), weight * v)
                assert sent <= credit < sent + 1  # the deficit is less than a token
        for q, total in enumerate(totals):
            ends = [int(plan.sent(k)[q]) for k in range(plan.windows + 1)]
            assert [plan.window_of(q, p) for p in range(total)] == [next(k for k in range(len(ends)) if ends[k] > p) for p in range(total)]


def verify(rows, docs, library, capacity):
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for start, length, crc, whole in sorted(pieces):
            assert start == at and length > 0 and whole == len(ids[d])
            assert crc == zlib.crc32(np.array(ids[d][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[d])
    short = []
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        if at < capacity:
            short.append(at)
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)  # powers of two: no padding
    return ids


def test_round_trip_and_proportions(spark, library):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["river", "house", "Stone.", "über", "x"]) for _ in range(rng.choice([0, 3, 40, 400]))) if i % 17 else None, rng.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(400)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    rows = mixing.pack_mixed(frame, PATH, capacity=64, window=8).collect()
    ids = verify(rows, docs, library, 64)
    source = {d: s for d, _, s in docs}
    totals = Counter()
    for d, own in ids.items():
        totals[source[d]] += len(own)
    sent, whole = Counter(), sum(totals.values())
    seen = defaultdict(Counter)
    for r in rows:
        seen[r.window][source[r.doc_id]] += r.length
    for k in sorted(seen):
        sent += seen[k]
        for s, total in totals.items():
            assert 0 <= min(k * 512, whole) * total / whole - sent[s] < 1 + 1e-6


def test_targets_hold_until_a_queue_is_empty(spark, library):
    docs = [(i, "one two three " * 30, "ab"[i % 2]) for i in range(60)] + [(100 + i, "x", f"rare{i}") for i in range(5)]
    rows = mixing.pack_mixed(spark.createDataFrame(docs, SCHEMA).repartition(4), PATH, capacity=32, window=4, targets={"a": 6, "b": 1, "absent": 3}, rest=1).collect()
    verify(rows, docs, library, 32)
    source = {d: s for d, _, s in docs}
    first = Counter()
    for r in rows:
        if r.window <= 5:
            first[source[r.doc_id][0]] += r.length
    assert abs(first["a"] - 6 * first["b"]) <= 7


def test_many_small_sources_share_a_queue(spark, library, monkeypatch):
    monkeypatch.setattr(mixing, "QUEUES", 3)
    docs = [(i, "some words here " * (i % 7), f"s{i % 20}") for i in range(150)]
    verify(mixing.pack_mixed(spark.createDataFrame(docs, SCHEMA).repartition(3), PATH, capacity=64, window=2).collect(), docs, library, 64)


def test_odd_rows(spark, library):
    docs = [(1, None, None), (2, "", "a"), (3, "long " * 20_000, "a"), (4, "x", "a"), (None, "y", "b")]
    plain = spark.createDataFrame(docs, SCHEMA)
    want = sorted(map(str, mixing.pack_mixed(plain, PATH).collect()))
    clash = plain
    for c in ("chunk", "tokens", "queue", "keys", "sums", "ids", "window", "first", "block"):
        clash = clash.withColumn(c, F.lit("clash"))
    assert sorted(map(str, mixing.pack_mixed(clash, PATH).collect())) == want
    verify(mixing.pack_mixed(plain, PATH).collect(), docs, library, 2048)
    twice = mixing.pack_mixed(spark.createDataFrame([(7, "same text", "a")] * 3, SCHEMA), PATH, capacity=8).collect()
    assert sum(r.length for r in twice) == 9 and {r.doc_tokens for r in twice} == {3}
    none = mixing.pack_mixed(spark.createDataFrame([], SCHEMA), PATH)
    assert none.schema == mixing.pack_mixed(plain, PATH).schema and none.count() == 0
