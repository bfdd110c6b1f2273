"""Phrase collocations: candidates from sketch upper bounds, counted by Aho-Corasick automata over shards of the corpus.

Shards of about 8 MB of text are written once as word numbers, by language. A count sketch of a level (words; pairs of words; three to five
words) lies in stripes of cells that follow the corpus in number: every shard sends a cell's count to its stripe, which adds up and answers which cells
reach the least count. A cell is never below the count of a phrase in it, so no phrase is lost. What does not reach it leaves the shard
before the next level: a pair is looked up only if both words pass, a longer phrase only if all its pairs do. What passes in a shard is compiled into automata of
guarded phrases (`` w1 w2 ``, a space at either end), of a bounded number each, which scan the shard and count overlapping matches; only those counts
are summed up, and the least count and the scores are taken from the sums, so a cell that two phrases share changes nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, pack_strings, stored, tidied, unpack_strings
from .packing import Numbers
from .tokencount import pack_planes, unpack_planes

SHARD = 8 << 20
#: Cells of a stripe, and words of the corpus for each cell.
STRIPE, PER_CELL = 1 << 18, 8
#: Phrases of an automaton.
PATTERNS = 50_000
LONGEST = 5
BREAK, NOTHING = b"\n", b""
#: A-Z to lower case, tabs to spaces, what ends a piece to one mark.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
HELD = "id bigint, lang string, n bigint, words binary, seq binary"


def shards(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard and language: its distinct words, and its words as numbers from 1, 0 where a piece ends."""
    part, made = TaskContext.get().partitionId(), 0
    for table in chunks(batches, size):
        by: dict[str, list[str]] = {}
        for lang, text in zip(table.column("lang").to_pylist(), table.column("text").to_pylist()):
            if text:
                by.setdefault("und" if lang is None else lang, []).append(text)
        for lang, texts in by.items():
            number = Numbers({BREAK: 0, NOTHING: 1})
            split = "\n".join(texts).encode().translate(TABLE).replace(BREAK, b" \n ").split(b" ")
            seq = np.fromiter(map(number.__getitem__, split), np.int64, len(split))
            seq = seq[seq != 1]
            seq[seq > 0] -= 1
            words = [w for w, i in number.items() if i > 1]
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([lang]), pa.array([int((seq > 0).sum())], pa.int64()), pa.array([pack_strings(words)], pa.binary()), pa.array([pack_planes(seq)], pa.binary())], ["id", "lang", "n", "words", "seq"])
            made += 1


def hashes(words: list[bytes], lang: str) -> np.ndarray:
    """A 64-bit number for each word of a language; place 0 is the break."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter([0, *(xxhash.xxh3_64_intdigest(w, seed) for w in words)], np.uint64, len(words) + 1)


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A 64-bit number for each phrase from those of its words."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def grams(seq: np.ndarray, n: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By number of words from 2 to ``n``: the places of all phrases between breaks, the number of each, and the first place and the count of every distinct one."""
    out = {}
    at = np.flatnonzero(seq > 0)
    own = seq[at]
    for k in range(2, n + 1):
        on = at + k - 1 < len(seq)
        at, own = at[on], own[on]
        on = seq[at + k - 1] > 0
        at, own = at[on], own[on]
        _, first, own, counts = np.unique(own << 32 | seq[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
        out[k] = at, own, at[first], counts
    return out


def level_words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    words, seq = unpack_strings(row["words"]), unpack_planes(row["seq"])
    return mixed([hashes(words, row["lang"])[1:]]), np.bincount(seq, minlength=len(words) + 1)[1:]


def level_phrases(row: dict, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    h, seq = hashes(unpack_strings(row["words"]), row["lang"]), unpack_planes(row["seq"])
    found = [x for k, x in grams(seq, most).items() if k >= least]
    made = [mixed([h[seq[first + j]] for j in range(k)]) for k, (_, _, first, _) in zip(range(least, most + 1), found)]
    return np.concatenate(made), np.concatenate([x[3] for x in found])


def cells_of(made: np.ndarray, stripes: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and the place among them of each phrase."""
    return np.unique(made % np.uint64(stripes * STRIPE), return_inverse=True)


def looked_up(held: DataFrame, level, stripes: int, least: int) -> DataFrame:
    """``id, stripe, bits``: which cells of a shard reach ``least`` in all shards together."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made, counts = level(row)
                cells, place = cells_of(made, stripes)
                sums = np.bincount(place, counts, len(cells)).astype(np.int64)
                own, begins = np.unique(cells // np.uint64(STRIPE), return_index=True)
                ends = [*begins[1:].tolist(), len(cells)]
                inside = (cells % np.uint64(STRIPE)).astype(np.int64)
                steps = [pack_planes(np.diff(inside[a:b], prepend=0)) for a, b in zip(begins.tolist(), ends)]
                tallies = [pack_planes(sums[a:b]) for a, b in zip(begins.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array([row["id"]] * len(own), pa.int64()), pa.array(steps, pa.binary()), pa.array(tallies, pa.binary())], ["stripe", "id", "cells", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        total = np.zeros(STRIPE, np.int64)
        for cells, counts in zip(table.column("cells"), table.column("counts")):
            total[np.cumsum(unpack_planes(cells.as_py()))] += unpack_planes(counts.as_py())
        bits = [np.packbits(total[np.cumsum(unpack_planes(cells.as_py()))] >= least).tobytes() for cells in table.column("cells")]
        return pa.table({"id": table.column("id"), "stripe": table.column("stripe"), "bits": pa.array(bits, pa.binary())})

    sent = held.select("id", "lang", "words", "seq").mapInArrow(tidied(deal), "stripe bigint, id bigint, cells binary, counts binary")
    return sent.groupBy("stripe").applyInArrow(add_up, "id bigint, stripe bigint, bits binary")


def passes(made: np.ndarray, stripes: int, answers: pa.Table) -> np.ndarray:
    """Which phrases of a shard lie in a cell that reaches the least count."""
    cells, place = cells_of(made, stripes)
    if not len(cells):
        return np.zeros(0, bool)
    sizes = np.unique(cells // np.uint64(STRIPE), return_counts=True)[1].tolist()
    by = dict(zip(answers.column("stripe").to_pylist(), answers.column("bits").to_pylist()))
    return np.concatenate([np.unpackbits(np.frombuffer(by[s], np.uint8), count=n) for s, n in zip(sorted(by), sizes)]).astype(bool)[place]


def closed_up(seq: np.ndarray) -> np.ndarray:
    """Without breaks that follow each other and words that stand alone."""
    padded = np.concatenate([[0], seq, [0]])
    alone = (padded[1:-1] > 0) & (padded[:-2] == 0) & (padded[2:] == 0)
    seq = np.where(alone, 0, seq)
    return seq[(seq > 0) | (np.concatenate([[0], seq[:-1]]) > 0)]


def table_of(row: dict, words: list[bytes], seq: np.ndarray, **more: list) -> dict:
    """The row with the words that are still in ``seq`` or ``more``, numbered anew."""
    kept = np.unique(seq[seq > 0])
    anew = np.zeros(len(words) + 1, np.int64)
    anew[kept] = np.arange(1, len(kept) + 1)
    return {"id": row["id"], "lang": row["lang"], "n": row["n"], "words": pack_strings([words[i - 1] for i in kept.tolist()]), "seq": pack_planes(anew[seq]), **more}


def keep_words(stripes: int):
    """Words that do not pass become breaks; the counts of those that do go along."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            made, counts = level_words(row)
            on = passes(made, stripes, right)
            words, seq = unpack_strings(row["words"]), unpack_planes(row["seq"])
            own = np.flatnonzero(on)
            seq = closed_up(np.where(np.concatenate([[False], on])[seq], seq, 0))
            out.append(table_of(row, words, seq, passing=pack_strings([words[i] for i in own.tolist()]), counts=pack_planes(counts[own])))
        return pa.Table.from_pylist(out, pa.schema([("id", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), *((c, pa.binary()) for c in ("words", "seq", "passing", "counts"))]))

    return run


def keep_pairs(stripes: int):
    """A break goes between two words that are no passing pair."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            seq = unpack_planes(row["seq"])
            at, own, _, _ = grams(seq, 2)[2]
            on = passes(level_phrases(row, 2, 2)[0], stripes, right)
            cut = at[~on[own]] + 1
            out.append(table_of(row, unpack_strings(row["words"]), closed_up(np.insert(seq, cut, 0))))
        return pa.Table.from_pylist(out, pa.schema([("id", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("seq", pa.binary())]))

    return run


TALLY = [("stripe", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())]
TALLIES = "stripe bigint, lang string, phrases binary, counts binary"


def tallied(lang: str, phrases: list[bytes], counts: np.ndarray, stripes: int) -> list[dict]:
    """Counts of a shard as packed lists, a row for each stripe of phrases."""
    stripe = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases)) % np.uint64(stripes)
    order = np.argsort(stripe, kind="stable")
    own, begins = np.unique(stripe[order], return_index=True)
    groups = np.split(order, begins[1:]) if len(own) else []
    return [{"stripe": s, "lang": lang, "phrases": pack_strings([phrases[i] for i in g.tolist()]), "counts": pack_planes(counts[g])} for s, g in zip(own.tolist(), groups)]


def added_up(tallies: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, f`` of the phrases that reach ``least`` over all shards."""

    def run(table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for phrases, counts in zip(table.column("phrases"), table.column("counts")):
            for phrase, n in zip(unpack_strings(phrases.as_py()), unpack_planes(counts.as_py()).tolist()):
                total[phrase] += n
        found = [(p.decode(), n) for p, n in total.items() if n >= least]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(found), pa.string()), "phrase": pa.array([p for p, _ in found], pa.string()), "f": pa.array([n for _, n in found], pa.int64())})

    return tallies.groupBy("stripe", "lang").applyInArrow(run, "lang string, phrase string, f bigint")


def word_tallies(first: DataFrame, stripes: int) -> DataFrame:
    """The counts of the words that pass."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from pa.Table.from_pylist(tallied(row["lang"], unpack_strings(row["passing"]), unpack_planes(row["counts"]), stripes), pa.schema(TALLY)).to_batches()

    return first.select("lang", "passing", "counts").mapInArrow(tidied(deal), TALLIES)


def scanned(phrases: list[str], text: str) -> np.ndarray:
    """How often each of the guarded phrases stands in ``text``, overlaps included; the automata hold a bounded number of phrases each."""
    counts = np.zeros(len(phrases), np.int64)
    order = sorted(range(len(phrases)), key=phrases.__getitem__)
    for k in range(0, len(order), PATTERNS):
        automaton = ahocorasick.Automaton()
        for i in order[k : k + PATTERNS]:
            automaton.add_word(phrases[i], i)
        automaton.make_automaton()
        counts += np.bincount(np.fromiter((i for _, i in automaton.iter(text)), np.int64), minlength=len(phrases))
    return counts


def count_matches(stripes: int):
    """Candidates of a shard compiled into automata; the counts of their overlapping matches in its text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in left.to_pylist():
            seq, words = unpack_planes(row["seq"]), [w.decode() for w in unpack_strings(row["words"])]
            found = grams(seq, LONGEST)
            on = passes(level_phrases(row, 3, LONGEST)[0], stripes, right)
            phrases, at = [], 0
            for k, (_, _, first, _) in found.items():
                if k > 2:
                    first, at = first[on[at : at + len(first)]], at + len(first)
                phrases += [f" {' '.join(words[j - 1] for j in seq[a : a + k].tolist())} " for a in first.tolist()]
            names = ["\n", *words]
            text = " " + " ".join([names[i] for i in seq.tolist()]) + " "
            if phrases:
                out += tallied(row["lang"], [p[1:-1].encode() for p in phrases], scanned(phrases, text), stripes)
        return pa.Table.from_pylist(out, pa.schema(TALLY))

    return run


def phrase_counts(docs: DataFrame, least: int = 100, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of every phrase of one to five words that occurs ``least`` times in its language, and ``lang, n``: all words."""
    held = stored(docs.select("lang", "text").mapInArrow(tidied(lambda it: shards(it, shard)), HELD), "collocations-shards")
    total = held.agg(F.sum("n")).first()[0] or 0
    stripes = max(1, -(-total // (PER_CELL * STRIPE)))
    paired = lambda one, level: one.groupBy("id").cogroup(looked_up(one, level, stripes, least).groupBy("id"))
    first = stored(paired(held, level_words).applyInArrow(keep_words(stripes), HELD + ", passing binary, counts binary"), "collocations-words")
    slim = first.drop("passing", "counts")
    second = stored(paired(slim, lambda r: level_phrases(r, 2, 2)).applyInArrow(keep_pairs(stripes), HELD), "collocations-pairs")
    found = paired(second, lambda r: level_phrases(r, 3, LONGEST)).applyInArrow(count_matches(stripes), TALLIES)
    return stored(added_up(found.unionByName(word_tallies(first, stripes)), least), "collocations-counts"), held.groupBy("lang").agg(F.sum("n").alias("n"))


def exact_score() -> F.Column:
    """``floor(1000 a n / (l r))`` from the columns of these names, in decimals of 38 digits."""
    return F.expr("cast(cast(1000 * a AS decimal(19, 0)) * cast(n AS decimal(19, 0)) AS decimal(38, 0)) div cast(cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)) AS decimal(38, 0))")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, shard: int = SHARD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language, from the rows of ``(lang, text)``.

    A phrase of 2 to 5 words that occurs ``a >= least`` times scores ``floor(1000 a n / (l r))`` at its weakest cut; one that never occurs outside a
    longer phrase is dropped. Null texts are empty, a null language is ``und``; repeated rows count each; ties go by score, count and phrase. Other
    columns are not read. An empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, least, shard)
    words = F.split("phrase", " ")
    known = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.size(words).alias("size"))
    candidates = known.where("size > 1")
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    inner = candidates.where("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("longer"))
    # One word more is enough: between a phrase and a longer one that is as frequent, all are.
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = candidates.alias("c").join(inner.alias("i"), (F.col("c.lang") == F.col("i.lang")) & (F.col("c.phrase") == F.col("i.phrase")) & (F.col("i.longer") >= F.col("c.a")), "left_anti")
    cut = left.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("one"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("two"))
    one = counts.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l"))
    two = counts.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r"))
    scored = cut.join(one, ["lang", "one"]).join(two, ["lang", "two"]).join(totals, "lang").withColumn("score", exact_score())
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
