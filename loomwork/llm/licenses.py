"""License scan with a positional rare-token index, in DataFrame functions only.

The templates are the passages of common licence texts and notices. Document frequencies of all their words are counted over all documents, in one pass. A passage is
looked for in a file that holds every word of its mandatory key phrase: of the passage's words that stand in the file, the ``RARE`` with the highest IDF and the
two rarest of the key phrase are looked up; every occurrence in the file and posting (word, position) in the passage propose where the passage
would start, and starts on which two or more occurrences agree remain. Such a place is a find if the key phrase stands exactly where it must; its score is
the share of the passage's words that stand in their places. So no verbatim key phrase is lost, whatever the frequencies in the corpus, and notices with changed or left out
words are found by the phrases that they keep.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import PASSAGES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a passage that are looked up in a file, besides the two rarest of its key phrase.
RARE = 5

#: The base phrases and their labels.
PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]


def worded(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


#: Label, words and key phrase of each passage, in words as the scan sees them.
TEMPLATES = [(label, worded(passage), worded(phrase)) for label, passage, phrase in PASSAGES]


def words(text: str = "text") -> Column:
    """Words of a whole text; only A-Z change case, letters outside ASCII belong to words, a null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def vocabulary() -> list[str]:
    return list(dict.fromkeys(w for _, body, _ in TEMPLATES for w in body))


def frequencies(worded_docs: DataFrame) -> tuple[dict[str, int], int]:
    """Document frequency of every template word over all documents, and the number of documents, in one pass: an empty word stands in each."""
    each = F.explode(F.concat(F.array_intersect(literal(vocabulary()), "words"), F.array(F.lit(""))))
    found = {r[0]: r[1] for r in worded_docs.select(each.alias("word")).groupBy("word").count().collect()}  # at most one row per template word
    return found, found.get("", 0)


def literal(items: list[str]) -> Column:
    """An array of words as one constant expression, which keeps the plan small."""
    return F.split(F.lit(" ".join(items)), " ")


def base_places() -> Column:
    """(start, label) of every place of a base phrase."""

    def at(word: Column, i: Column) -> Column:
        found = None
        for phrase, label in PHRASES:
            back = len(phrase) - 1
            same = (word == phrase[-1]) & (i >= back)
            for k, part in enumerate(phrase[:-1]):
                same = same & (F.get("words", i - back + k) == part)
            place = F.struct((i - back).cast("long").alias("start"), F.lit(label).alias("label"))
            found = F.when(same, place) if found is None else found.when(same, place)
        return found

    return F.filter(F.transform("words", at), lambda p: p.isNotNull())


def phrase_at(body: list[str], key: list[str]) -> int:
    return next(i for i in range(len(body)) if body[i : i + len(key)] == key)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, places`` (start, label of base phrases) and ``finds`` (label, start, score) to the columns of ``docs``.

    Columns of these names, and of ``words``, are replaced. Null and empty texts have no words and no finds. Repeated rows are judged each. Where a file quotes
    a passage without its beginning, the find starts at the first word.
    """
    mine = ("words", "n_words", "places", "finds", "there", "lookup", "pool", "hits", "proposed", "starts")
    split = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in mine], words(text).alias("words"))
    df, n = frequencies(split)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary()}
    rarest = lambda items: sorted(set(items), key=lambda w: (-idf[w], w))
    templates = F.array(*[F.struct(F.lit(label).alias("label"), literal(body).alias("body"), literal(key).alias("key"), F.lit(phrase_at(body, key)).alias("at")) for label, body, key in TEMPLATES])
    keys = F.array(*[F.struct(F.lit(t).alias("t"), literal(sorted(set(key))).alias("key"), literal(rarest(key)[:2]).alias("first"), literal(body).alias("body")) for t, (_, body, key) in enumerate(TEMPLATES)])
    own = lambda c: F.element_at(templates, c["t"] + 1)

    def looked_up(t: Column) -> Column:
        rare = F.slice(F.filter("there", lambda w: F.array_contains(t["body"], w)), 1, RARE)  # in order of IDF
        return F.struct(t["t"].alias("t"), F.array_union(rare, t["first"]).alias("look"))

    def proposals(x: Column) -> Column:
        def of_hit(h: Column) -> Column:
            postings = F.transform(own(x)["body"], lambda w, q: F.when(w == h["word"], F.struct(x["t"].alias("t"), (h["i"] - q).alias("start"))))
            return F.filter(postings, lambda p: p.isNotNull())

        return F.flatten(F.transform(F.filter("hits", lambda h: F.array_contains(x["look"], h["word"])), of_hit))

    def judged(c: Column) -> Column:
        t = own(c)
        verified = (c["start"] + t["at"] >= 0) & (F.slice("words", F.greatest(c["start"] + t["at"], F.lit(0)) + 1, F.size(t["key"])) == t["key"])
        inside = F.size(F.filter(t["body"], lambda w, j: (c["start"] + j >= 0) & F.coalesce(F.get("words", F.greatest(c["start"] + j, F.lit(0))) == w, F.lit(False))))
        return F.when(verified, F.struct(t["label"].alias("label"), F.greatest(c["start"], F.lit(0)).cast("long").alias("start"), (inside / F.size(t["body"])).alias("score")))

    there = F.array_intersect(literal(rarest(vocabulary())), "words")
    gates = literal(sorted({rarest(key)[0] for _, _, key in TEMPLATES}))
    lookup = F.when(F.arrays_overlap("there", gates), F.transform(F.filter(keys, lambda t: F.size(F.array_except(t["key"], F.col("there"))) == 0), looked_up))
    pool = F.when(F.size("lookup") > 0, F.array_distinct(F.flatten(F.transform("lookup", lambda x: x["look"]))))
    hits = F.when(F.size("pool") > 0, F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("pool", w), F.struct(w.alias("word"), i.cast("int").alias("i")))), lambda h: h.isNotNull()))
    proposed = F.when(F.size("hits") > 1, F.array_sort(F.flatten(F.transform("lookup", proposals))))
    starts = F.when(F.size("proposed") > 1, F.array_distinct(F.filter("proposed", lambda c, i: (i > 0) & (F.get("proposed", i - 1) == c))))
    nothing = F.array().cast("array<struct<label:string,start:bigint,score:double>>")
    finds = F.when(F.size("starts") > 0, F.filter(F.transform("starts", judged), lambda f: f.isNotNull())).otherwise(nothing)
    places = F.when(F.array_contains("words", "license"), base_places()).otherwise(F.array().cast("array<struct<start:bigint,label:string>>"))
    step = split.withColumns({"n_words": F.size("words").cast("long"), "there": there, "places": places})
    # Every column of these is used twice by the next, so that the optimizer keeps it a column of its own and no lambda computes it again for each element.
    for name, made in (("lookup", lookup), ("pool", pool), ("hits", hits), ("proposed", proposed), ("starts", starts), ("finds", finds)):
        step = step.withColumn(name, made)
    return step.drop("words", "there", "lookup", "pool", "hits", "proposed", "starts")


def digest(docs: DataFrame) -> DataFrame:
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("finds", lambda f: f["label"]))))
    starts = F.transform("places", lambda p: p["start"])
    score = F.coalesce(F.array_max(F.transform("finds", lambda f: f["score"])), F.when(F.size("places") > 0, 0.5).otherwise(0.0))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
