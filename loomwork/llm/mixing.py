"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source is a queue of its tokens, in the order of the stored chunks. A round fills one window. In it every queue that is not empty earns credit in
proportion to its target and sends as many whole tokens as its credit covers; the fraction left over is its deficit, carried into the next window and, since
the state before a window depends on the targets and the sizes of the queues alone, from one partition to the next without any exchange. An empty
queue's share goes to the others. So a token's place in the queue of its source decides its window and its place there: each chunk, told where its
queues stand, places its own documents. The stream of windows is cut into sequences of ``capacity`` tokens; the last tokens fall into sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, pack, ranges, stored, tidied, unpack
from .packing import Numbers

CHUNK = 8 << 20
CACHE = 400_000
GROUP = 500
#: Queues of their own in a natural mixture; smaller sources share one.
QUEUES = 1000
#: A stop between a letter and white space is a pre-token, so it can be set apart.
STOP = r"([a-zA-Z])([.,])([ \n])"
#: White space of any kind. Three in a row, or two at the end, may be one pre-token; else each space begins a pre-token and each line end is one.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LONG_SPACE = f"{WHITE}{WHITE}(?:{WHITE}|\\z)"
#: Stretches after a space that hold no white space: printable ASCII, and the two-byte letters beyond U+00BF.
PLAIN = re.compile(rb"(?:[!-~]|[\xc3-\xc9][\x80-\xbf])+").fullmatch
REST = "rest"
OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint"


class ByteIds:
    """Token ids of texts by way of their distinct stretches between spaces, each encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; no threads of its own
        library = Tokenizer.from_file(path)
        self.encode = getattr(library, "encode_batch_fast", library.encode_batch)
        vocabulary = library.get_vocab()
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # a token that starts with a space
        self.kind = np.uint16 if len(self.opens) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.ids = np.zeros(0, self.kind)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [m.ids for i in range(0, len(texts), 10_000) for m in self.encode([t.decode() for t in texts[i : i + 10_000]], add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """The ids of stretches numbered last: most begin with a space and hold no other; they are encoded many at a time, as each opens with a token that begins with a space."""
        if not new:
            return
        plain = np.fromiter((PLAIN(w) is not None for w in new), bool, len(new))
        many = [new[i] for i in np.flatnonzero(plain).tolist()]
        made = self.encoded([b" " + b" ".join(many[k : k + GROUP]) for k in range(0, len(many), GROUP)])
        ids = np.array([i for m in made for i in m], self.kind)
        begins = np.flatnonzero(self.opens[ids])
        if len(begins) != len(many) or (len(begins) and begins[0]):
            plain[:], ids, begins = False, ids[:0], begins[:0]
        others = self.encoded([w[1:] if w[:1] == b"\0" else b" " + w for w in (new[i] for i in np.flatnonzero(~plain).tolist())])
        sizes, starts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        sizes[plain], starts[plain] = np.diff(begins, append=len(ids)), begins
        own = np.fromiter(map(len, others), np.int64, len(others))
        sizes[~plain], starts[~plain] = own, len(ids) + np.cumsum(own) - own
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids, np.array([i for m in others for i in m], self.kind)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their numbers. Texts with rare spacing or special strings go to the library whole."""
        if len(self.known) > CACHE:
            self.forget()
        before = len(self.known)
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, LONG_SPACE)
        for special in ("\0", *self.special):
            hard = pc.or_(hard, pc.match_substring(texts, special))
        spread = pc.replace_substring(pc.replace_substring_regex(texts.filter(pc.invert(hard)), STOP, "\\1 \0\\2\\3"), "\n", " \0\n \0")
        split = pc.split_pattern(pc.binary_join_element_wise("", spread, "\0"), " ")
        coded = split.flatten().dictionary_encode()
        number = np.fromiter(map(self.known.__getitem__, coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
        self.learn(list(islice(self.known, before, None)))
        own = number[coded.indices.to_numpy()]
        sizes = self.sizes[own]
        ids = self.ids[ranges(self.starts[own], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())]).astype(np.int64)]
        hard = hard.to_numpy(zero_copy_only=False)
        if not hard.any():
            return ids, np.diff(ends)
        plain, whole = iter(np.split(ids, ends[1:-1])), iter(self.encoded(texts.filter(pa.array(hard)).cast(pa.binary()).to_pylist()))
        each = [np.array(next(whole), self.kind) if h else next(plain) for h in hard.tolist()]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))


class Schedule:
    """Which tokens of each queue a window sends: ``totals`` and positive whole ``weights`` of the queues, all rational arithmetic exact.

    Time is credit for one unit of weight. At the end of window ``k``, when ``k * window`` tokens are earned, a queue has sent ``sent(k)``: its credit rounded
    down, or all it has.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int) -> None:
        self.totals, self.weights, self.window, self.total = totals, weights, window, sum(totals)
        self.windows = -(-self.total // window)
        ends = sorted({Fraction(t, w) for t, w in zip(totals, weights)})
        self.times = [Fraction(0), *ends]
        self.earned = [sum(min(w * v, Fraction(t)) for t, w in zip(totals, weights)) for v in self.times]
        self.cache: dict[int, np.ndarray] = {}

    def time(self, k: int) -> Fraction:
        """When ``k`` windows are earned."""
        tokens = min(k * self.window, self.total)
        i = bisect_right(self.earned, tokens) - 1
        if i == len(self.times) - 1:
            return self.times[i]
        return self.times[i] + (tokens - self.earned[i]) * (self.times[i + 1] - self.times[i]) / (self.earned[i + 1] - self.earned[i])

    def sent(self, k: int) -> np.ndarray:
        if k not in self.cache:
            if len(self.cache) > 512:
                self.cache.clear()
            v = self.time(k)
            self.cache[k] = np.array([min(t, w * v.numerator // v.denominator) for t, w in zip(self.totals, self.weights)], np.int64)
        return self.cache[k]

    def window_of(self, queue: int, place: int) -> int:
        """The window, from 1, that sends the token at ``place`` of a queue."""
        v = Fraction(place, self.weights[queue])
        i = bisect_right(self.times, v) - 1
        earned = self.earned[i] if i == len(self.times) - 1 else self.earned[i] + (v - self.times[i]) * (self.earned[i + 1] - self.earned[i]) / (self.times[i + 1] - self.times[i])
        k = max(1, int(earned // self.window))
        while self.sent(k)[queue] <= place:
            k += 1
        while k > 1 and self.sent(k - 1)[queue] > place:
            k -= 1
        return k

    def stretches(self, queue: int, first: int, end: int) -> list[tuple[int, int, int]]:
        """``(window, first place of the queue in it, place of that in the stream)`` for the windows that send the places from ``first`` to ``end``."""
        out, k = [], self.window_of(queue, first)
        while True:
            before, after = self.sent(k - 1), self.sent(k)
            if after[queue] > before[queue]:
                out.append((k, int(before[queue]), int(before.sum() + (after - before)[:queue].sum())))
            if after[queue] >= end:
                return out
            k += 1


def edges(total: int, capacity: int) -> tuple[int, list[int]]:
    """The number of full sequences, and where the shorter ones at the end begin: powers of two, in falling order."""
    full, left = divmod(total, capacity)
    begins, at = [], full * capacity
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            begins.append(at)
            at += 1 << bit
    return full, begins


def cut(schedule: Schedule, queue: int, first: int, lengths: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Pieces of documents that follow each other in a queue from place ``first``: document, start, length, sequence, offset, window."""
    bounds = first + np.concatenate([[0], np.cumsum(lengths)])
    stretches = schedule.stretches(queue, first, int(bounds[-1]))
    window, low, at = (np.array(x, np.int64) for x in zip(*stretches))
    full, tails = edges(schedule.total, capacity)
    high = np.concatenate([low[1:], [max(int(bounds[-1]), int(low[-1]))]])
    cuts = [bounds, low]
    for lo, hi, g in zip(low.tolist(), high.tolist(), at.tolist()):
        whole = np.arange(-(-g // capacity), min(full, (g + hi - lo) // capacity) + 1) * capacity
        cuts += [lo + whole - g, lo + np.array([t - g for t in tails if g < t < g + hi - lo], np.int64)]
    places = np.unique(np.concatenate(cuts))
    places = places[(places >= bounds[0]) & (places <= bounds[-1])]
    starts, ends = places[:-1], places[1:]
    doc = np.searchsorted(bounds, starts, side="right") - 1
    run = np.searchsorted(low, starts, side="right") - 1
    stream = at[run] + starts - low[run]
    begins = np.array([*tails, schedule.total], np.int64)
    late = stream >= full * capacity
    tail = np.searchsorted(begins, stream, side="right") - 1
    sequence = np.where(late, full + tail, stream // capacity)
    offset = np.where(late, stream - begins[np.maximum(tail, 0)], stream % capacity)
    return {"doc": doc, "start": starts - bounds[doc], "length": ends - starts, "sequence": sequence, "offset": offset, "window": window[run]}


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """A row for each chunk: its documents' ids, one after the other, with the end id; and its queues with their tokens."""
    fields = [("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("queue", pa.list_(pa.int32())), ("keys", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("wide", pa.bool_()), ("ids", pa.binary())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = ByteIds(tokenizer_path), TaskContext.get().partitionId()
        for k, table in enumerate(chunks(batches, CHUNK)):
            ids, tokens = encoder(table.column("text").combine_chunks())
            ids = np.insert(ids, np.cumsum(tokens), np.array(end_id, ids.dtype))
            tokens += 1
            number = Numbers()
            queue = [number["null" if s is None else "of " + s] for s in table.column("source").to_pylist()]
            sums = np.bincount(queue, tokens, len(number)).astype(np.int64)
            row = [part << 32 | k, table.column("doc_id").to_pylist(), tokens, queue, list(number), sums, encoder.kind is np.uint32, pack(ids)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, fields)], [n for n, _ in fields])

    schema = "chunk bigint, doc_id array<bigint>, tokens array<bigint>, queue array<int>, keys array<string>, sums array<bigint>, wide boolean, ids binary"
    return stored(docs.select("doc_id", "text", "source").mapInArrow(tidied(run), schema), "mixing")


def pack_mixed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, window: int = 256, end_id: int = 1, targets: dict[str | None, int] | None = None, rest: int = 1) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window`` for every piece of every row of ``(doc_id, text, source)``.

    ``window`` is in sequences. ``targets`` gives whole positive weights to sources; those it does not name share a queue of weight ``rest``. Without it,
    sources are mixed in proportion to their tokens, so that all queues end together; the ``QUEUES`` largest have a queue of their own and the others
    share one. Null and empty texts are the end id alone; a null source is a queue of its own; repeated rows are packed each for itself. Within a queue
    documents keep the order in which they were read. An empty table has no rows.
    """
    held = tokenised(docs, tokenizer_path, end_id)
    sums = held.select("chunk", F.explode(F.arrays_zip("keys", "sums")).alias("x")).select("chunk", F.col("x.keys").alias("key"), F.col("x.sums").alias("tokens"))
    totals = sums.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    if targets is None:
        found = {r["key"]: r["tokens"] for r in totals.orderBy(F.desc("tokens"), "key").limit(QUEUES).collect()}
    else:
        names = ["null" if s is None else "of " + s for s in targets]
        found = dict.fromkeys(names, 0) | {r["key"]: r["tokens"] for r in totals.where(F.col("key").isin(names)).collect()}
    shared = (totals.agg(F.sum("tokens")).first()[0] or 0) - sum(found.values())
    keys = [*found, REST]
    given = None if targets is None else [*targets.values(), rest]
    full = [*found.values(), shared]
    kept = [i for i, t in enumerate(full) if t]
    place_of = {keys[i]: n for n, i in enumerate(kept)}
    size, sizes, weights = window * capacity, [full[i] for i in kept], [full[i] if given is None else given[i] for i in kept]
    named = F.broadcast(docs.sparkSession.createDataFrame([(k, place_of[k]) for k in found if k in place_of], "key string, queue int"))
    # Where each queue stands at the start of each chunk: within blocks of partitions, then over blocks.
    by_chunk = sums.join(named, "key", "left").select("chunk", F.coalesce("queue", F.lit(place_of.get(REST, -1))).alias("queue"), "tokens").groupBy("chunk", "queue").agg(F.sum("tokens").alias("tokens"))
    by_chunk = by_chunk.withColumn("block", F.shiftright("chunk", 40))
    blocks = by_chunk.groupBy("queue", "block").agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.select("queue", "block", (F.sum("tokens").over(Window.partitionBy("queue").orderBy("block")) - F.col("tokens")).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("queue", "block").orderBy("chunk")) - F.col("tokens")
    stands = by_chunk.withColumn("within", within).join(blocks, ["queue", "block"]).select(F.col("chunk").alias("of"), "queue", (F.col("within") + F.col("before")).alias("first"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        schedule = Schedule(sizes, weights, size)
        first = dict(zip(right.column("queue").to_pylist(), right.column("first").to_pylist()))
        parts: list[dict[str, np.ndarray]] = []
        out: dict[str, list] = {c.split()[0]: [] for c in OUT.split(", ")}
        for row in left.to_pylist():
            tokens = np.array(row["tokens"], np.int64)
            begins = np.cumsum(tokens) - tokens
            raw = memoryview(unpack(row["ids"], np.uint32 if row["wide"] else np.uint16).astype("<u4").tobytes())
            own = np.array([place_of.get(k, place_of.get(REST)) for k in row["keys"]], np.int64)[np.array(row["queue"], np.int64)]
            for queue in np.unique(own).tolist():
                docs_of = np.flatnonzero(own == queue)
                made = cut(schedule, queue, first[queue], tokens[docs_of], capacity)
                made["doc"] = docs_of[made["doc"]]
                parts.append(made)
                low = (begins[made["doc"]] + made["start"]) * 4
                high = low + made["length"] * 4
                out["doc_id"] += [row["doc_id"][d] for d in made["doc"].tolist()]
                out["ids_crc32"] += [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), high.tolist())]
                out["doc_tokens"] += tokens[made["doc"]].tolist()
        for name, of in (("start", "start"), ("length", "length"), ("sequence_id", "sequence"), ("offset", "offset"), ("window", "window")):
            out[name] = np.concatenate([np.zeros(0, np.int64), *(p[of] for p in parts)])
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return held.drop("sums").groupBy("chunk").cogroup(stands.groupBy("of")).applyInArrow(place, OUT)
