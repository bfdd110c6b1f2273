"""The license scan against a plain version of the base phrases, and on planted notices."""

import random
import re

import pytest

from loomwork.llm import licenses
from loomwork.llm.common import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute_base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_equal_brute_force(spark, sf, docs_of):
    rng = random.Random(4)
    pool = ["MIT", "License", "license", "apache", "General", "Public", "general", "İ", "mİt", "x", "é", "GNU"]
    extra = [(10**6 + i, rng.choice([" ", ", ", "-\n"]).join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(200)]
    extra += [(None, "mit license"), (10**7, None), (10**7 + 1, ""), (10**7 + 2, "license " * 5000), (10**7 + 3, "the mit license " * 3000)]
    frame = documents(spark, sf).select("doc_id", "text").union(docs_of(extra).select("doc_id", "text"))
    texts = {r[0]: r[1] for r in frame.collect()}
    rows = licenses.digest(frame).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id]), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert sum(r.n_base > 0 for r in rows) > 20


def test_notices_are_found_in_place(docs_of):
    rows = [(i, "Some words of code come first.\n" + " ".join(body).capitalize() + ", and more follow.") for i, (_, body, _) in enumerate(licenses.TEMPLATES)]
    rows += [(100, "The use of this software and the copy of it is free."), (101, "licensed under something else"), (102, "cc nc by 4 0 licensed under")]
    found = {r.doc_id: r for r in licenses.scan(docs_of(rows)).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert (label, 6, 1.0) in {tuple(f) for f in found[i].finds}
        assert found[i].source == "src"
    assert not any(found[i].finds for i in (100, 101, 102))


@pytest.mark.parametrize("halved,recall", [(False, 0.8), (True, 0.5)])
def test_recall_of_changed_and_partly_quoted_notices(docs_of, halved, recall):
    """One word in eight changed, and half of the passages only half quoted: always found where a key phrase is left whole."""
    rng = random.Random(9)
    by_label = {}
    for label, body, key in licenses.TEMPLATES:
        by_label.setdefault(label, []).append((body, key))
    rows, want, whole = [], {}, {}
    for k in range(300):
        label = rng.choice([x for x in by_label if len(by_label[x]) > 1])
        parts, left = [], False
        for body, key in by_label[label]:
            words = [w if rng.random() > 1 / 8 else "changed" for w in body]
            half = rng.randrange(4) if halved else 2
            words = words[: len(words) // 2] if half == 0 else words[len(words) // 2 :] if half == 1 else words
            left |= any(words[i : i + len(key)] == key for i in range(len(words)))
            parts.append(" ".join(words))
        rows.append((k, "alpha beta. " + ". gamma delta. ".join(parts) + " omega"))
        want[k], whole[k] = label, left
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.digest(docs_of(rows)).collect()}
    assert all(want[k] in got[k] for k in want if whole[k])
    assert sum(want[k] in got[k] for k in want) / len(want) > recall


def test_a_kelvin_sign_stays(docs_of):
    assert licenses.digest(docs_of([(1, "MIT \u212aLicense mit licen\u017fe")])).first().n_base == 0


def test_nothing_and_clashing_names(spark, docs_of):
    assert licenses.scan(docs_of([])).count() == 0
    frame = docs_of([(1, "under the MIT License")]).withColumnRenamed("source", "words").withColumnRenamed("lang", "n_words")
    assert licenses.scan(frame).first().n_words == 4
