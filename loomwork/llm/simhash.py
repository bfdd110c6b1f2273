"""SimHash near-duplicates found through a positional inverted index of fingerprint bytes, with count filtering.

Fingerprints within ``BITS`` = 2 bits differ in at most 2 of their 8 bytes, so they share at least ``LEAST_BYTES`` = 6 positional bytes, the
guaranteed minimum of the count filter. Postings of single bytes would list N/256 fingerprints each; so the index is keyed by combinations of positions: two
differing bits touch at most two of the four pairs of neighbouring bytes, hence two linked fingerprints meet in one of the 6 postings of two whole
pairs. Each posting tallies the positional bytes that its members share, keeps pairs that reach the minimum and verifies their bits; a long
posting looks up the 528 variants of each member in its 32 free bits instead, so that the work is linear in its size. Equal fingerprints count
once and no list of all pairs arises.

``deduplicate`` filters by similarity of word shingles (five words, 0.8) with the same index, tally and verification. SimHash bits cannot give
that: at similarity 0.8 two fingerprints differ in 9.7 of 64 bits on average, so no byte is guaranteed to agree. Its fingerprint therefore has
``SIGNATURE`` positional bytes, each from the least of the hashed shingles, which agree as often as the shingle sets do. The index is keyed by runs of ``ROWS``
positions; in a posting the shared bytes of each pair are tallied once, under the first run that the two share. Verification on the whole
shingle sets goes in two rounds: first a forest of the best tallies in each posting, then every pair that reaches the minimum and whose texts are
not connected yet. So no pair that shares a run and reaches the minimum is lost, and copies of one another are not listed in pairs.

Runs and tallies of minima find a similar pair with a high probability only. A last round therefore indexes all texts by a prefix of their sorted shingles,
counts the keys that two texts of different components share against the number that the similarity guarantees, and verifies what reaches it
(``remaining_links``). After it no pair of the similarity is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, attach, components, forest, row_key, stored, tidied

BITS = 2
LEAST_BYTES = 8 - BITS
SEED = 42
#: Two of the four pairs of neighbouring bytes, as masks over the 64 bits.
MASKS = [0xFFFF << 16 * a | 0xFFFF << 16 * b for a, b in combinations(range(4), 2)]
SHORT = 24
#: Members of a posting that one task looks up.
PART = 50_000
PER_TASK = 60_000

WIDTH = 5
SIMILARITY = 0.8
RUNS, ROWS = 20, 5
SIGNATURE = 400
#: Of the signature's bytes, the share that two texts must have in common, less than the similarity by so much: 3.5 standard deviations at 0.8.
SLACK = 0.07
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)
STIR = np.uint64(0x9E3779B97F4A7C15)
BLOCK, PIVOTS = 512, 16
#: Of so many texts one is looked at for frequent shingles, of which so many are put last.
SHOWN, HOT = 16, 1 << 18


def tally(a: int, b: int) -> int:
    """Positional bytes that two 64-bit fingerprints share."""
    return 8 - sum(1 for p in range(0, 64, 8) if (a ^ b) >> p & 0xFF)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of all words if there are fewer."""
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, SEED)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits over the hashes of a text's word shingles; 0 without words."""
    hashes = shingle_hashes(words_of(text), width)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default: doc_id) and ``fp`` (signed 64 bits) for every row."""

    def kernel(texts: list) -> list:
        return [np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)]

    return append_columns(docs, kernel, [("fp", "bigint", pa.int64())], keep=keep or ["doc_id"])


def linked(members: list[int], free: list[int], some: list[int] | None = None) -> list[tuple[int, int]]:
    """A star for each set of members chained by links of at most BITS bits; ``free``: bits in which members can differ. With ``some`` only the links of these members.

    In a long posting the partners of a member are looked up, so that work is linear; they are tallied and verified like any pair.
    """
    close = lambda a, b: tally(a, b) >= LEAST_BYTES and (a ^ b).bit_count() <= BITS
    if len(members) <= SHORT:
        return forest((a, b) for a, b in combinations(members, 2) if close(a, b))
    there = set(members)
    flips = [sum(c) for n in range(1, BITS + 1) for c in combinations([1 << b for b in free], n)]
    return forest((a, a ^ f) for a in (members if some is None else some) for f in flips if a ^ f in there and close(a, a ^ f))


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` among distinct fingerprints ``fp``, enough to connect everything that chains of links connect."""
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bytes")) for i, m in enumerate(MASKS)])
    spread = prints.select("fp").repartition(max(1, -(-prints.count() // PER_TASK)), "fp")  # each row becomes 6
    postings = spread.select("fp", F.explode(keys).alias("k")).groupBy("k.mask", "k.bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    # A posting goes to as many tasks as it has parts of PART members, each of which looks up its own part's links.
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.size("fps") - 1) / PART).cast("int"))).alias("part")
    postings = postings.select("mask", "bytes", "fps", parts).repartition("mask", "bytes", "part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stars: list[tuple[int, int]] = []
            for mask, fps, part in zip(*(batch.column(c).to_pylist() for c in ("mask", "fps", "part"))):
                free = [b for b in range(64) if not MASKS[mask] >> b & 1]
                members = [f & (1 << 64) - 1 for f in fps]
                stars += linked(members, free, members[part * PART : (part + 1) * PART])
            pairs = np.array(stars, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return postings.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (default: doc_id; it must be among them), ``fp``, ``root`` and ``component_id`` per row.

    ``root`` is the component's least fingerprint, ``component_id`` the smallest doc_id reachable over links of at most 2 bits. Null and empty
    texts have fingerprint 0 and link like any other. A null doc_id takes part through its fingerprint but is never a component's id;
    the id is null only if all members' are.
    """
    rows = stored(fingerprints(docs, width, keep), "simhash")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    roots = components(links(prints))
    by_root = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    heads = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(by_root.join(heads, "root").select("fp", "root", "component_id", "rows"), "simhash-components")
    return attach(rows, found, "fp").select(*rows.columns, "root", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def signature(own: np.ndarray, n: int = SIGNATURE) -> np.ndarray:
    """The first ``n`` positional bytes of a set of shingle hashes: of each hash function the least value, stirred into one byte."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 2048):
        np.minimum(least, np.multiply.outer(FACTORS[:n], own[i : i + 2048]).min(axis=1), out=least)
    return (((least ^ (least >> np.uint64(31))) * STIR) >> np.uint64(56)).astype(np.uint8)


def run_keys(own: np.ndarray) -> list[int]:
    """A key for each run of positions, the run's number above its bytes; none for a text without words."""
    if not len(own):
        return []
    marks = signature(own, RUNS * ROWS).tobytes()
    return [r << 8 * ROWS | int.from_bytes(marks[r * ROWS : (r + 1) * ROWS], "little") for r in range(RUNS)]


def digest_of(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63) if words else 0


def sketches(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep``, ``digest`` of the words (0 without any) and ``keys``."""

    def kernel(texts: list) -> list:
        made = [(digest_of(w), run_keys(np.unique(shingle_hashes(w, WIDTH)))) for w in map(words_of, texts)]  # one text's words at a time
        return [[m[k] for m in made] for k in range(2)]

    return append_columns(docs, kernel, [("digest", "bigint", pa.int64()), ("keys", "array<bigint>", pa.list_(pa.int64()))], keep=keep)


def cross_pairs(key: int, marks: np.ndarray, keys: np.ndarray, label: np.ndarray, side: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a posting's members that differ in label, share no earlier run and have ``least`` positional bytes in common; and their tallies.

    side: 0 or 1 per member, only pairs across are meant; None: all pairs.
    """
    run, found = key >> 8 * ROWS, []
    for x in range(len(label)):
        others = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1 if side is None else np.flatnonzero((label != label[x]) & (side == 1)) if side[x] == 0 else np.zeros(0, np.int64)
        if run and len(others):
            others = others[~(keys[others, :run] == keys[x, :run]).any(axis=1)]
        if len(others):
            shared = (marks[others] == marks[x]).sum(axis=1)
            good = shared >= least
            found.append((np.full(int(good.sum()), x), others[good], shared[good]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def best_forest(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which of the pairs make a spanning forest of the largest tallies."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    keep = []
    for k in np.argsort(-shared, kind="stable").tolist():
        a, b = root(int(x[k])), root(int(y[k]))
        if a != b:
            parent[a] = b
            keep.append(k)
    return np.array(keep, np.int64)


def candidates(members: DataFrame, least: int, spanning: bool) -> DataFrame:
    """Pairs ``a < b`` of digests from postings ``key, i, j, side, digest, label, keys, marks``, one posting or pair of its blocks for each (key, i, j)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def posting(rows: list[dict]) -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            digest = np.array([r["digest"] for r in rows], np.int64)
            marks = np.array([np.frombuffer(r["marks"], np.uint8) for r in rows])
            two = rows[0]["i"] != rows[0]["j"]
            side = np.array([r["side"] for r in rows]) if two else None
            x, y, shared = cross_pairs(rows[0]["key"], marks, np.array([r["keys"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), side, least)
            if spanning and len(x):
                keep = best_forest(x, y, shared)
                x, y = x[keep], y[keep]
            return list(zip(np.minimum(digest[x], digest[y]).tolist(), np.maximum(digest[x], digest[y]).tolist()))

        held: list[dict] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["key"], held[0]["i"], held[0]["j"]) != (row["key"], row["i"], row["j"]):
                    out += posting(held)
                    held = []
                held.append(row)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            out = []
        pairs = np.array(posting(held), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = members.select("key", "i", "j", "side", "digest", "label", "keys", "marks").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "digest")
    return dealt.mapInArrow(tidied(run), "a bigint, b bigint").distinct()


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have a Jaccard similarity of at least ``least``. sets: digest, own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                good.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.select(F.col("digest").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("digest").alias("b"), F.col("own").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(tidied(run), "a bigint, b bigint")


def crossing(labelled: DataFrame) -> DataFrame:
    """Postings ``key, digest, label`` and further columns, those of one label left out, by pairs of blocks ``i, j`` (and the ``side``) in which members of different labels meet.

    The texts of a posting outside its largest label, in blocks, meet all blocks of the posting; those inside have met already.
    """
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("all")).where("inside < all")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rest = labelled.join(largest, "key").withColumn("u", blocks(F.col("all") - F.col("inside"))).withColumn("m", blocks(F.col("inside")))
    place = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    outside = F.col("label") != F.col("main")
    rest = rest.withColumn("block", F.when(outside, place(F.col("u"))).otherwise(F.col("u") + place(F.col("m"))))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("u") - 1 + F.when(outside, F.col("m")).otherwise(0))))
    return rest.select(*labelled.columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def similarity_links(keyed: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Verified edges ``a, b`` among digests, enough to connect what chains of them connect. keyed: __key, text; prints: digest, keys, rows, __key."""
    least = round((similarity - SLACK) * SIGNATURE)
    spread = prints.select("digest", "rows", F.explode("keys").alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    postings = stored(spread.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")), "simhash-postings")

    def packed(texts: list) -> list:
        own = [np.unique(shingle_hashes(words_of(t), WIDTH)) for t in texts]
        return [[s.tobytes() for s in own], [signature(s).tobytes() for s in own]]

    wanted = prints.join(postings.select("digest").distinct(), "digest", "left_semi").select("digest", "keys", "__key")
    texts = keyed.select("__key", "text").join(wanted, "__key").dropDuplicates(["digest"])
    sets = stored(append_columns(texts, packed, [("own", "binary", pa.binary()), ("marks", "binary", pa.binary())], keep=["digest", "keys"]), "simhash-sets")
    marked = sets.select("digest", "keys", "marks")

    # Round 1: a forest in each posting; the blocks of a long one meet in the texts of it that have most copies.
    most = Window.partitionBy("key").orderBy(F.desc("rows"), "digest")
    pivots = postings.where("blocks > 1").withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= PIVOTS)
    own = postings.select("key", F.col("block").alias("i"), "digest")
    shown = pivots.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> block").select("key", "i", "digest")
    first = own.union(shown).join(marked, "digest").withColumn("j", F.col("i")).withColumn("side", F.lit(0)).withColumn("label", F.col("digest"))
    tried = stored(candidates(first, least, True), "simhash-forest")
    edges = stored(similar(tried, sets, similarity), "simhash-edges")

    # Round 2: all other pairs that reach the minimum and are not connected yet.
    roots = stored(components(edges), "simhash-roots")
    labelled = stored(postings.join(roots, postings.digest == roots.node, "left").select("key", "digest", F.coalesce("root", "digest").alias("label")), "simhash-labels")
    rest = crossing(labelled)
    second = candidates(rest.join(marked, "digest"), least, False).join(tried, ["a", "b"], "left_anti")
    return edges.union(stored(similar(stored(second, "simhash-rest"), sets, similarity), "simhash-edges"))


def frequent(plain: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many texts have, the most frequent HOT of them at most, told from one text in SHOWN. They only decide in what order shingles are taken."""

    def kernel(texts: list) -> list:
        own = (np.unique(shingle_hashes(words_of(t), WIDTH)) for t in texts)
        return [[o[: np.searchsorted(o, np.uint64(1 << 63))].view(np.int64).copy() for o in own]]  # a prefix seldom reaches further

    some = plain.where(F.pmod(F.xxhash64("__key"), F.lit(SHOWN)) == 0).select("text")
    each = append_columns(some, kernel, [("own", "array<bigint>", pa.list_(pa.int64()))], keep=[]).select(F.explode("own").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(HOT)
    return np.sort(np.array([r["shingle"] for r in often.select("shingle").collect()], np.int64).view(np.uint64))


def prefix(own: np.ndarray, hot: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones after all others, so many that two sets of the similarity share one of them at least."""
    late = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(len(own), bool)
    return np.concatenate([own[~late], own[late]])[: prefix_length(len(own), similarity)].copy()


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-6) + 1 if n else 0


def shared_postings(spread: DataFrame) -> DataFrame:
    """The rows ``key, digest, size`` whose key several digests have, each once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = np.zeros((0, 3), np.int64), False  # the last row, and whether the row before has its key
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)])
            rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows
            if not len(rows):
                continue
            same = rows[1:, 0] == rows[:-1, 0]
            good = np.append(again, same) | np.append(same, False)
            held, again = rows[-1:], bool(good[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:-1][good[:-1]].T], ["key", "digest", "size"])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (held if again else held[:0]).T], ["key", "digest", "size"])

    return spread.select("key", "digest", "size").repartition("key").sortWithinPartitions("key", "digest").mapInArrow(tidied(run), "key bigint, digest bigint, size bigint")


def counted_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a < b`` of digests of different labels that share as many keys of their prefixes as two sets of the similarity must. members: key, i, j, side, digest, label, size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(rows: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Each row with the row ``apart`` places on, while that is of its posting. ends: where the postings end."""
            i, j, side, digest, label, size = rows[:, 1:].T
            left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(rows))
            x, apart, found, held = np.arange(len(rows)), 0, [], 0
            while len(x := x[left[x] > apart + 1]):
                apart += 1
                y = x + apart
                good = (label[x] != label[y]) & ((i[x] == j[x]) | (side[x] != side[y])) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-6)
                a, b = x[good], y[good]
                # Of the shingles that both must share, all but those beyond the prefix that ends first are in both prefixes.
                both = np.ceil(similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6)
                need = (both + 1 - np.ceil(similarity * np.maximum(size[a], size[b]) - 1e-6)).astype(np.int64)
                found.append((np.minimum(digest[a], digest[b]), np.maximum(digest[a], digest[b]), need))
                held += len(a)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "need"])
                    found, held = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "need"])

        held = np.zeros((0, 7), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in range(7)], axis=1)])
            ends = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            if len(ends):
                yield from met(rows[: ends[-1]], ends)
                rows = rows[ends[-1] :]
            held = rows
        yield from met(held, np.array([len(held)]))

    dealt = members.select("key", *[F.col(c).cast("bigint") for c in ("i", "j", "side")], "digest", "label", "size").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "digest")
    pairs = dealt.mapInArrow(tidied(run), "a bigint, b bigint, need bigint")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("a", "b")


def remaining_links(plain: DataFrame, prints: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Verified edges among digests that ``links`` don't connect: none of the similarity is left out.

    Minima of two similar sets agree with a high probability, not always. So every text is indexed once more, by the first shingles of its set in one order
    for all; two sets of the similarity share some of these, and at least a number that follows from their sizes. Only pairs of different components are
    formed. plain: __key, text; prints: digest, __key.
    """
    roots = components(links)
    labels = prints.join(roots, prints.digest == roots.node, "left").select("digest", F.coalesce("root", "digest").alias("label"))
    hot = frequent(plain)

    def kernel(texts: list) -> list:
        def one(words: list[bytes]) -> tuple:
            own = np.unique(shingle_hashes(words, WIDTH))
            return digest_of(words), len(own), prefix(own, hot, similarity).view(np.int64)

        made = [one(w) for w in map(words_of, texts)]  # one text's words at a time
        return [[m[k] for m in made] for k in range(3)]

    fields = [("digest", "bigint", pa.int64()), ("size", "bigint", pa.int64()), ("keys", "array<bigint>", pa.list_(pa.int64()))]
    spread = append_columns(plain.select("text"), kernel, fields, keep=[]).select("digest", "size", F.explode("keys").alias("key"))
    labelled = stored(shared_postings(spread).join(labels, "digest"), "simhash-prefixes")
    pairs = stored(counted_pairs(crossing(labelled), similarity), "simhash-counted")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(prints.select("digest", "__key"), "digest")
    texts = plain.select("__key", "text").join(wanted, "__key").dropDuplicates(["digest"])
    sets = append_columns(texts, lambda texts: [[np.unique(shingle_hashes(words_of(t), WIDTH)).tobytes() for t in texts]], [("own", "binary", pa.binary())], keep=["digest"])
    return similar(pairs, stored(sets, "simhash-sets"), similarity).select("a", "b").union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row, with all its columns, of each set of rows chained by similarities of at least ``similarity`` between their five-word shingles.

    It is the row with the smallest doc_id, and of its rows the one with the least hash of the text. Texts equal up to case and white space are always of one set;
    rows without words (null, empty, blank) are one set. A set whose ids are all null keeps one row too. Of rows equal in id and text one stays.
    """
    name, key = row_key(docs)
    keyed = docs.withColumn(name, key)
    plain = keyed.select("doc_id", "text", F.col(name).alias("__key"))
    rows = stored(sketches(plain, ["doc_id", "__key"]), "simhash-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))
    prints = stored(rows.groupBy("digest").agg(F.first("keys").alias("keys"), F.count("*").alias("rows"), first.alias("first")).select("digest", "keys", "rows", "first", "first.__key"), "simhash-texts")
    links = stored(similarity_links(plain, prints, similarity), "simhash-links")
    roots = components(stored(remaining_links(plain, prints, links, similarity), "simhash-links"))
    by_root = prints.join(roots, prints.digest == roots.node, "left").select(F.coalesce("root", "digest").alias("root"), "first")
    chosen = by_root.groupBy("root").agg(F.min("first")["__key"].alias(name)).select(name)
    return keyed.join(chosen, name, "left_semi").dropDuplicates([name]).drop(name)
