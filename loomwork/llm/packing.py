"""Best-fit packing by large-item matching, on the histogram of lengths.

Only lengths decide a packing, and there are at most ``capacity`` of them. So documents are tokenised once, the counts of the piece
lengths (at most ``capacity`` numbers) come to the driver, and whole classes of equal sequences are packed there at once: pieces above a
third of the capacity are matched greedily, each with the longest partner that fits, so that a sequence has at most two of
them; the smaller ones go, longest first, each into the fullest sequence that has room. The plan is a short list of runs
"ranks a..b of length L stand in these sequences at this offset". Pieces then find their places by their rank within their length;
ranks come from two steps (within a salt, then offsets of the salts), so that a length that a third of all pieces share is not one task.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges, stored, tidied

CACHE = 300_000
GROUP = 500
#: Fixed value: the vocabulary's pre-token expression, in general and for lower-case ASCII without white space.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: A stop after an ASCII letter begins a pre-token in any case: set apart, it leaves fewer distinct words.
STOP = re.compile(rb"(?<=[a-z])[.,]")


class WordIds:
    """Token ids of texts by way of their distinct words: no pre-token of the vocabulary spans ASCII white space.

    New words are encoded many at a time, joined by spaces, which costs a third of single calls. The last token of each pre-token carries the
    end-of-word mark, so the ids fall apart into words by the number of their pre-tokens; should the sums not agree, words are encoded one by one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; no threads of its own
        library = Tokenizer.from_file(path)
        self.encode = getattr(library, "encode_batch_fast", library.encode_batch)
        vocabulary = library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [m.ids for i in range(0, len(texts), 10_000) for m in self.encode([t.decode() for t in texts[i : i + 10_000]], add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """The ids of words numbered last, in their order."""
        if not new:
            return
        n = np.fromiter((1 if w.isalpha() else count_pretokens(w) for w in new), np.int64, len(new))
        made = [np.array(m, np.uint32) for m in self.encoded([b" ".join(new[i : i + GROUP]) for i in range(0, len(new), GROUP)])]
        ids = np.concatenate(made)
        stops = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
        if len(stops) - 1 == n.sum() and stops[-1] == len(ids):
            ends = stops[np.cumsum(n)]
        else:
            each = self.encoded(new)
            ends = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
            ids = np.fromiter((i for m in each for i in m), np.uint32, int(ends[-1]))
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.forget()
        before = len(self.known)
        number = self.known.__getitem__
        # The vocabulary is of lower-case text; only the special strings tell cases apart, and they end pre-tokens of their own.
        raw = [(t or "").encode() for t in texts]
        split = [(r if b"<|" in r else STOP.sub(rb" \g<0>", r.lower())).split() for r in raw]
        numbered = [np.fromiter(map(number, words), np.int64, len(words)) for words in split]
        new = list(islice(self.known, before, None))
        self.learn(new)
        out = []
        for own in numbered:
            starts = self.ends[own]
            out.append(self.ids[ranges(starts, self.ends[own + 1] - starts)])
        return out


class Numbers(dict):
    """Numbers for words, in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def count_pretokens(word: bytes) -> int:
    if b"<|" in word:
        return -1 << 40  # special strings: the sums shall not agree
    if word.isascii():
        return len(ASCII.findall(word.lower()))
    return len(PRETOKEN.findall(unicodedata.normalize("NFC", word.decode()).lower()))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a document's ids and the end id, cut only where longer than the capacity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer_path)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows: list[tuple] = []
            for i in range(0, len(texts), 500):
                for doc_id, ids in zip(ids_of[i : i + 500], encoder(texts[i : i + 500])):
                    ids = np.concatenate([ids, tail]).astype("<u4")
                    rows += [(doc_id, k, at, len(cut := ids[at : at + capacity]), zlib.crc32(cut.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, per sequence, first offset) for counts of pieces by length.

    Piece ``i`` of a run stands in sequence ``first + i // per`` at ``offset + length * (i % per)``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    open_at: dict[int, list[tuple[int, int]]] = {}  # free room -> classes (first sequence, number)
    rooms: list[int] = []

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, used[length], n, first, per, offset))
        used[length] += n
        left[length] -= n

    def opened(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        n = left[length]
        if not n:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - length) - 1
        while k >= 0 and (not left[large[k]] or (large[k] == length and n == 1)):  # a single piece is no partner of its own
            k -= 1
        if k < 0:
            put(length, n, sequences, 1, 0)
            opened(capacity - length, sequences, n)
            sequences += n
            continue
        mate = large[k]
        if mate == length:
            pairs = n // 2
            put(length, 2 * pairs, sequences, 2, 0)
        else:
            pairs = min(n, left[mate])
            put(length, pairs, sequences, 1, 0)
            put(mate, pairs, sequences, 1, length)
        opened(capacity - length - mate, sequences, pairs)
        sequences += pairs
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                n = -(-left[length] // (capacity // length))
                opened(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[k]
            first, n = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[k]
            fill = room // length
            whole = min(n, left[length] // fill)
            if whole:
                put(length, whole * fill, first, fill, capacity - room)
                opened(room - fill * length, first, whole)
            if whole < n and left[length]:
                some = left[length]  # fewer than fill: one more sequence takes them
                put(length, some, first + whole, some, capacity - room)
                opened(room - some * length, first + whole, 1)
                whole += 1
            opened(room, first + whole, n - whole)
    return runs


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``(doc_id, text)``.

    Null and empty texts are the end id alone, a piece of length 1. Repeated rows are packed each for itself.
    """
    found = stored(pieces(docs, tokenizer_path, capacity, end_id), "packing")
    counts = {n: c for n, c in found.groupBy("length").count().collect()}
    runs = sorted(plan(counts, capacity))
    total = sum(counts.values())
    buckets = max(8, min(8192, total // 200_000))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    table = np.array(runs, np.int64).reshape(-1, 6)
    # Lengths are at most the capacity and a length's ranks stay below the total, so one number orders both.
    keys = table[:, 0] * (total + 1) + table[:, 1]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, order = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = table[np.searchsorted(keys, length * (total + 1) + order, side="right") - 1].reshape(-1, 6)
            i = order - run[:, 1]
            new = [pa.array(run[:, 3] + i // run[:, 4]), pa.array(run[:, 5] + length * (i % run[:, 4]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *new], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
