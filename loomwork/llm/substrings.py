"""Substring dedup by prefix-partitioned suffix trees over words.

Only the tree's nodes ``width`` or more words deep matter: a suffix whose first ``width`` words stand nowhere else hangs from a shallower node and
needs no place in any subtree. The steps, all on chunks of documents (by hash of the id) and buckets (by hash of a prefix):

1. Anchors. Every window of ``width`` words is anchored at the ``ANCHOR``-word gram with the least hash in it, which is the same wherever the
   window stands. Chunks send the hashes of their distinct anchors, with counts, to buckets; these add up the counts.
2. Prefix groups. Suffixes whose anchor stands once in the corpus are dropped, exactly. The others are grouped by a prefix of variable length: the
   anchor's ``ANCHOR`` words, or all ``width`` words where the anchor is too frequent for a subtree to fit in memory. Chunks send each group
   their distinct stretches of words, with the least document id of each: copies within a chunk travel once.
3. Subtrees. A group sorts its suffixes by their first ``width`` words (ranks of depths 1, 2, 4, ... joined in pairs, on the words themselves, so no hash
   decides). Suffixes of equal rank lie under one deep internal node; the node's least document id settles its windows, and a bit per window goes
   back to the chunk.
4. Chunks cover the words of windows that also start in a smaller document and keep the rest.

Every chunk is read three times from one shuffle of the texts; what a chunk sends is a function of its sorted rows, so a recomputed task
sends the same. Chunks hold about CHUNK bytes, groups about as much; neither grows with the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, pack, pack_strings, ranges, unpack, unpack_strings

CHUNK = 8 << 20
PARTITIONS = 4096
BATCH = 2 << 20
ANCHOR = 5
HEAVY = 20_000
U = np.uint64
ODD, MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
CODES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=U)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = U(pow(int(ODD), -1, 2**64))
    return np.cumprod(np.full(n, ODD, U)), np.cumprod(np.full(n, back, U))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * MIX
    return h ^ (h >> U(29))


class Words:
    """Words of a few documents: their bytes, hashes, documents, and the anchored windows."""

    def __init__(self, texts: list[str | None], usable: list[bool], width: int) -> None:
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        space = IS_SPACE[data]
        before = np.concatenate([[True], space[:-1]]) if len(data) else space
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        self.lengths = ends - starts
        self.doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
        self.count = np.bincount(self.doc, minlength=len(raw))
        # Normal form: words, each followed by one space.
        self.bytes = np.where(space, np.uint8(32), data)[~space | ~before]
        self.ends = np.cumsum(self.lengths + 1)
        self.starts = self.ends - self.lengths - 1
        up, down = powers(1 << max(16, int(len(data)).bit_length()))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(CODES[data] * up[: len(data)])])
        self.hashes = mixed((sums[ends] - sums[starts]) * down[starts] + self.lengths.astype(U))
        n = max(0, len(starts) - width + 1)
        self.width = width
        good = np.array(usable, bool)
        self.windows = np.flatnonzero((self.doc[:n] == self.doc[width - 1 : width - 1 + n]) & good[self.doc[:n]]) if n else np.zeros(0, np.int64)
        span = min(ANCHOR, width)
        self.grams = self.gram(span)
        if len(self.windows):
            self.anchors = self.windows + sliding_window_view(self.grams, width - span + 1)[self.windows].argmin(axis=1)
        else:
            self.anchors = self.windows

    def gram(self, k: int) -> np.ndarray:
        n = max(0, len(self.hashes) - k + 1)
        h = np.zeros(n, U)
        for i in range(k):
            h = h * ODD + self.hashes[i : i + n]
        return mixed(h)


def batches(table: pa.Table, width: int):
    """Words of a chunk's rows in a fixed order, a few documents at a time; and the rows' ids."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    own, size = [], 0
    for row in rows:
        own.append(row)
        size += len(row[1] or "")
        if size >= BATCH:
            yield [r[0] for r in own], Words([r[1] for r in own], [r[0] is not None for r in own], width)
            own, size = [], 0
    if own:
        yield [r[0] for r in own], Words([r[1] for r in own], [r[0] is not None for r in own], width)


def anchors_of(parts: list[tuple[list, Words]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct anchor hashes by bucket, then hash; and how often each is an anchor."""
    found = [w.grams[np.unique(w.anchors)] for _, w in parts]
    prints, counts = np.unique(np.concatenate(found) if found else np.zeros(0, U), return_counts=True)
    order = np.argsort(prints % U(buckets), kind="stable")
    return prints[order], counts[order]


def send_anchors(table: pa.Table, width: int, buckets: int) -> pa.Table:
    prints, counts = anchors_of(list(batches(table, width)), buckets)
    ids, starts = np.unique(prints % U(buckets), return_index=True)
    own, cuts = ids.astype(np.int64).tolist(), list(zip(starts.tolist(), [*starts.tolist()[1:], len(prints)]))
    return pa.table(
        {
            "bucket": pa.array(own, pa.int64()),
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(own), pa.int64()),
            "prints": pa.array([pack(prints[a:b]) for a, b in cuts], pa.binary()),
            "counts": pa.array([pack(counts[a:b].astype(np.uint32)) for a, b in cuts], pa.binary()),
        }
    )


def weigh_anchors(table: pa.Table) -> pa.Table:
    """0: stands once in the corpus; 1: a prefix group; 2: too frequent, all words make the prefix."""
    prints = [unpack(b, U) for b in table.column("prints").to_pylist()]
    counts = np.concatenate([unpack(b, np.uint32) for b in table.column("counts").to_pylist()]).astype(np.int64)
    _, where = np.unique(np.concatenate(prints), return_inverse=True)
    total = np.bincount(where, weights=counts)[where]
    state = ((total > 1).astype(np.uint8) + (total >= HEAVY)).astype(np.uint8)
    cuts = np.cumsum([0, *map(len, prints)])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "state": pa.array([pack(state[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})


class Stretches:
    """A chunk's distinct stretches by group, in order of first appearance, and for every batch which stretch its candidate windows lie in."""

    def __init__(self, parts: list[tuple[list, Words]], states: dict[int, bytes], buckets: int, width: int) -> None:
        prints, _ = anchors_of(parts, buckets)
        state = np.concatenate([unpack(states[b], np.uint8) for b in sorted(states)]) if states else np.zeros(0, np.uint8)
        order = np.argsort(prints)
        prints, state = prints[order], state[order]
        self.groups: dict[int, dict[bytes, int]] = defaultdict(dict)
        self.least: dict[int, list[int]] = defaultdict(list)
        self.found: list[list[tuple[int, int, int, int]]] = []  # first window, windows, group, stretch
        for ids, words in parts:
            own: list[tuple[int, int, int, int]] = []
            self.found.append(own)
            mark = words.grams[words.anchors]
            kind = state[np.searchsorted(prints, mark)] if len(mark) else np.zeros(0, np.uint8)
            heads, group, sizes = [], [], []
            one = np.flatnonzero(kind == 1)
            if len(one):
                w, a = words.windows[one], words.anchors[one]
                new = np.concatenate([[True], (w[1:] != w[:-1] + 1) | (a[1:] != a[:-1])])
                at = np.flatnonzero(new)
                heads.append(w[at])
                sizes.append(np.diff(np.append(at, len(w))))
                group.append(mark[one][at] % U(buckets))
            two = words.windows[kind == 2]
            if len(two):
                heads.append(two)
                sizes.append(np.ones(len(two), np.int64))
                group.append(words.gram(width)[two] % U(buckets))
            if not heads:
                continue
            head, n, where = np.concatenate(heads), np.concatenate(sizes), np.concatenate(group)
            begin, end = words.starts[head].tolist(), (words.ends[head + n + width - 2] - 1).tolist()
            raw, docs = words.bytes.tobytes(), words.doc[head].tolist()
            for h, k, g, a, b, d in zip(head.tolist(), n.tolist(), where.tolist(), begin, end, docs):
                known, least = self.groups[g], self.least[g]
                s = known.setdefault(raw[a:b], len(known))
                if s == len(least):
                    least.append(ids[d])
                elif ids[d] < least[s]:
                    least[s] = ids[d]
                own.append((h, k, g, s))


def states_of(table: pa.Table, column: str) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column(column).to_pylist()))


def send_stretches(docs: pa.Table, states: pa.Table, width: int, buckets: int) -> pa.Table:
    made = Stretches(list(batches(docs, width)), states_of(states, "state"), buckets, width)
    own = sorted(made.groups)
    chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
    return pa.table(
        {
            "bucket": pa.array(own, pa.int64()),
            "chunk": pa.array([chunk] * len(own), pa.int64()),
            "stretches": pa.array([pack_strings(list(made.groups[b])) for b in own], pa.binary()),
            "least": pa.array([pack(np.array(made.least[b], np.int64)) for b in own], pa.binary()),
        }
    )


def ranks(words: np.ndarray, width: int) -> np.ndarray:
    """Ranks of all positions by their next ``width`` words; those too near the end are ranked with what wraps around."""
    rank, depth = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while depth < width:
        step = min(depth, width - depth)
        pair = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
        rank, depth = np.unique(pair, return_inverse=True)[1].astype(np.int64), depth + step
    return rank


def subtree(table: pa.Table, width: int) -> pa.Table:
    """The bits of a group: for each chunk's stretches, whether a window also starts in a document below the stretch's least."""
    lists = [unpack_strings(b) for b in table.column("stretches").to_pylist()]
    least = [unpack(b, np.int64) for b in table.column("least").to_pylist()]
    known: dict[bytes, int] = {}
    codes: list[int] = []
    sizes: list[int] = []
    place: dict[bytes, int] = {}  # distinct stretches of the group
    for own in lists:
        for s in own:
            if s not in place:
                place[s] = len(sizes)
                split = s.split(b" ")
                sizes.append(len(split))
                codes += [known.setdefault(w, len(known)) for w in split]
    length = np.array(sizes, np.int64)
    first = np.cumsum(length) - length
    node = ranks(np.array(codes, np.int64), width)
    n_windows = length - width + 1
    begin = np.cumsum(n_windows) - n_windows
    window_node = node[ranges(first, n_windows)]
    # The least document of each distinct stretch, then of each node.
    low = np.full(len(sizes), np.iinfo(np.int64).max)
    at = [np.fromiter(map(place.__getitem__, own), np.int64, len(own)) for own in lists]
    for a, m in zip(at, least):
        np.minimum.at(low, a, m)
    lowest = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, window_node, np.repeat(low, n_windows))
    answer = lowest[window_node]
    bits = [pack(answer[ranges(begin[a], n_windows[a])] < np.repeat(m, n_windows[a])) for a, m in zip(at, least)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def cut(docs: pa.Table, answers: pa.Table, width: int, buckets: int, spans: bool) -> pa.Table:
    """Cover the words of the windows found before, and keep the rest."""
    parts = list(batches(docs, width))
    rows = answers.to_pylist()
    states = {r["bucket"]: r["blob"] for r in rows if r["kind"] == 0}
    made = Stretches(parts, states, buckets, width)
    bits, offsets = {}, {}
    for r in rows:
        if r["kind"] == 1:
            g = r["bucket"]
            bits[g] = unpack(r["blob"], np.bool_)
            n = np.fromiter((s.count(b" ") + 2 - width for s in made.groups[g]), np.int64, len(made.groups[g]))
            offsets[g] = np.cumsum(n) - n
    out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
    for (ids, words), found in zip(parts, made.found):
        cover = np.zeros(len(words.doc) + 1, np.int64)
        for h, k, g, s in found:
            if made.least[g][s] < ids[words.doc[h]]:
                cover[h] += 1
                cover[h + k + width - 1] -= 1
            else:
                at = offsets[g][s]
                hit = np.flatnonzero(bits[g][at : at + k]) + h
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + width, -1)
        keep = np.cumsum(cover[:-1]) == 0
        kept = words.bytes[np.repeat(keep, words.lengths + 1)].tobytes()
        size = np.bincount(words.doc, weights=np.where(keep, words.lengths + 1, 0), minlength=len(ids)).astype(np.int64)
        stop = np.cumsum(size)
        removed = np.bincount(words.doc, weights=~keep, minlength=len(ids)).astype(np.int64)
        if spans:
            out["removed"] += runs(~keep, words)
        out["doc_id"] += ids
        out["n_words"] += words.count.tolist()
        out["n_removed"] += removed.tolist()
        out["kept_text"] += [kept[b - n : max(b - n, b - 1)].decode() for b, n in zip(stop.tolist(), size.tolist())]
    made = {c: pa.array(out[c], pa.string() if c == "kept_text" else pa.int64()) for c in ("doc_id", "n_words", "n_removed", "kept_text")}
    return pa.table(made | ({"removed": pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))} if spans else {}))


def runs(gone: np.ndarray, words: Words) -> list[list[dict[str, int]]]:
    """The stretches of marked words of each document, as word positions with exclusive ends: where repeats overlap, their union."""
    edge = words.doc[1:] != words.doc[:-1] if len(gone) else np.zeros(0, bool)
    starts = np.flatnonzero(gone & np.concatenate([[True], edge | ~gone[:-1]])) if len(gone) else np.zeros(0, np.int64)
    stops = np.flatnonzero(gone & np.concatenate([edge | ~gone[1:], [True]])) + 1 if len(gone) else np.zeros(0, np.int64)
    first = np.cumsum(words.count) - words.count
    out: list[list[dict[str, int]]] = [[] for _ in words.count]
    for a, b in zip(starts.tolist(), stops.tolist()):
        d = int(words.doc[a])
        out[d].append({"start": a - int(first[d]), "end": b - int(first[d])})
    return out


def dedup_substrings(docs: DataFrame, width: int = 13, spans: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` per row of ``(doc_id, text)``; with ``spans`` also ``removed``, the stretches of removed words.

    A word goes if a window of ``width`` words over it also starts in a document with a smaller id. Null texts have no words; a row whose id is
    null neither loses words nor takes them from others; rows of one id do not count as each other's smaller ones.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // CHUNK))
    held = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(n))).select("doc_id", "text", "chunk")
    # As many partitions as chunks, so that what a task reads does not grow with the corpus; beyond ``PARTITIONS`` a task takes several chunks, one after the
    # other, since an exchange has a block for each pair of partitions.
    parts = min(n, PARTITIONS)
    by_chunk = lambda df: df.repartition(parts, "chunk").groupBy("chunk")
    by_bucket = lambda df: df.repartition(parts, "bucket").groupBy("bucket")
    sent = by_chunk(held).applyInArrow(lambda t: send_anchors(t, width, n), "bucket bigint, chunk bigint, prints binary, counts binary")
    states = by_bucket(sent).applyInArrow(weigh_anchors, "chunk bigint, bucket bigint, state binary")
    stretches = by_chunk(held).cogroup(by_chunk(states)).applyInArrow(lambda d, s: send_stretches(d, s, width, n), "bucket bigint, chunk bigint, stretches binary, least binary")
    bits = by_bucket(stretches).applyInArrow(lambda t: subtree(t, width), "chunk bigint, bucket bigint, bits binary")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string" + (", removed array<struct<start:bigint,end:bigint>>" if spans else "")
    answers = states.select("chunk", "bucket", F.lit(0).alias("kind"), F.col("state").alias("blob")).union(bits.select("chunk", "bucket", F.lit(1).alias("kind"), F.col("bits").alias("blob")))
    return by_chunk(held).cogroup(by_chunk(answers)).applyInArrow(lambda d, a: cut(d, a, width, n, spans), schema)


def digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
