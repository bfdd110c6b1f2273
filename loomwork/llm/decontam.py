"""Benchmark decontamination over a distributed positional inverted index.

The index holds the postings of all tokens of the training documents, whatever the benchmark: each chunk of documents is one stored row with its
distinct terms (64-bit hashes of words) in order and the positions of each, in a numbering with gaps between documents. Its terms are also dealt by term into
stripes, which know the chunks of every term. Benchmark windows are a table: an id, the terms and, apart from it, the items that each stands in. Windows go, in packed blocks,
to the stripes of their terms for the terms' frequencies over all documents; then each window goes to the stripe of its rarest term alone, and from there only to the
chunks that hold that term. There the postings of the rarest are intersected with the others' at their offsets, all windows at a time. What is left are exact places; the
three rarest terms within ``slop`` places of where they should be give proximity matches, each at the place of its rarest term. Of terms that are equally frequent the earlier
in the window counts as rarer. No window and no posting passes through the driver, and nothing is broadcast.

A hit asks for all words of a window, so two words of one hash could only make a false one if all others of a window stood around one of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, pack, ranges, row_key, stored, tidied, unpack
from .substrings import CODES, U, mixed, powers

#: Lower case for A-Z; what stands between words becomes a space; other bytes stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
CHUNK = 6 << 20
BATCH = 1 << 20
#: Free positions between two documents of a chunk.
GAP = 64
#: Windows in a packed block; postings that a task follows at once; chunks for each stripe of terms.
BLOCK = 20_000
AT_ONCE = 1 << 20
PER_STRIPE = 8
LISTS = "ids binary, lengths binary, terms binary, offsets binary"


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of words of each text."""
    hashes, counts, own, size = [], [], [], 0

    def flush() -> None:
        nonlocal own, size
        data = np.frombuffer(b" ".join([*own, b""]).translate(TABLE), np.uint8)
        space = data == 32
        before = np.concatenate([[True], space[:-1]])
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        up, down = powers(1 << max(16, int(len(data)).bit_length()))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(CODES[data] * up[: len(data)])])
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)))
        stops = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        counts.append(np.diff(np.searchsorted(starts, stops), prepend=0))
        own, size = [], 0

    for text in texts:
        own.append((text or "").encode())
        size += len(own[-1])
        if size >= BATCH:
            flush()
    if own:
        flush()
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.zeros(0, U), np.zeros(0, np.int64))


def index(docs: DataFrame) -> DataFrame:
    """A stored row for each chunk of documents: ids, hashes and lengths of its documents, and the postings of its terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        many = pa.list_(pa.int64())
        schema = pa.schema([("chunk", pa.int64()), ("doc_id", many), ("hash", many), ("n_words", many), ("terms", pa.binary()), ("sizes", pa.binary()), ("positions", pa.binary())])
        for k, table in enumerate(chunks(batches, CHUNK)):
            term, lengths = term_hashes(table.column("text").to_pylist())
            place = np.arange(len(term)) + np.repeat(np.arange(len(lengths)) * GAP, lengths)
            order = np.argsort(term, kind="stable")
            terms, first, sizes = np.unique(term[order], return_index=True, return_counts=True)
            place = place[order]
            step = np.diff(place, prepend=0)
            step[first] = place[first]
            row = {
                "chunk": [part << 32 | k], "doc_id": [table.column("doc_id").to_pylist()], "hash": [table.column("hash").to_pylist()], "n_words": [lengths.tolist()],
                "terms": [pack(terms)], "sizes": [pack(sizes.astype(np.int32))], "positions": [pack(step.astype(np.uint32))],
            }
            yield pa.RecordBatch.from_pydict(row, schema)

    return stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(
            tidied(run), "chunk bigint, doc_id array<bigint>, hash array<bigint>, n_words array<bigint>, terms binary, sizes binary, positions binary"
        ),
        "decontam-index",
    )


def windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``window, terms``, and ``window, item_id``. A shorter item is one window; one with a null id or without words has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                terms, _ = term_hashes([text])
                own = {terms[i : i + width].tobytes() for i in range(max(1, len(terms) - width + 1))} if len(terms) else ()
                if own:
                    made = sorted(own)
                    ids = pa.array([xxhash.xxh3_128_digest(w) for w in made], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary()), pa.array([item] * len(made), pa.string())], ["window", "terms", "item_id"])

    usable = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    every = stored(usable.mapInArrow(tidied(run), "window binary, terms binary, item_id string"), "decontam-windows")
    return stored(every.groupBy("window").agg(F.min("terms").alias("terms")), "decontam-distinct"), every.select("window", "item_id").distinct()


class Block:
    """Some windows: ids, numbers of terms, and terms with their offsets, a row each, padded to the width; rarest first once they are ranked."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, terms: np.ndarray, offset: np.ndarray) -> None:
        self.ids, self.length, self.terms, self.offset = ids, length, terms, offset

    @staticmethod
    def unpacked(rows: list[dict], width: int) -> Block:
        """Packed rows put together."""
        join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(unpack(r[name], kind) for r in rows)])
        return Block(join("ids", "S16"), join("lengths", np.int8).astype(np.int64), join("terms", U).reshape(-1, width), join("offsets", np.int8).reshape(-1, width))

    def packed(self, some: np.ndarray) -> list[bytes]:
        return [pack(self.ids[some]), pack(self.length[some].astype(np.int8)), pack(self.terms[some]), pack(self.offset[some])]

    def ranked(self, vocabulary: np.ndarray, seen: np.ndarray) -> Block:
        """Terms in order of their frequencies, ``seen`` of the sorted ``vocabulary``; without the windows of which one of the three rarest occurs nowhere."""
        width = np.arange(self.terms.shape[1])
        often = np.where(width < self.length[:, None], seen[np.minimum(np.searchsorted(vocabulary, self.terms), len(vocabulary) - 1)], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        there = np.flatnonzero(np.take_along_axis(often, order[:, :3], 1).min(axis=1) > 0)
        order = order[there]
        return Block(self.ids[there], self.length[there], np.take_along_axis(self.terms[there], order, 1), np.take_along_axis(self.offset[there], order, 1))

    def numbered(self) -> Block:
        """With a vocabulary of its own and terms as numbers in it, -1 beyond a window's length."""
        self.vocabulary, where = np.unique(self.terms, return_inverse=True)
        self.term = np.where(np.arange(self.terms.shape[1]) < self.length[:, None], where.reshape(self.terms.shape), -1).astype(np.int32)
        return self


def split(values: np.ndarray, stripes: int) -> list[tuple[int, np.ndarray]]:
    """Places of the values by stripe."""
    own = (values % U(stripes)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    found, begins = np.unique(own[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, begins[1:]))) if len(found) else []


def rows_of(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds))})


LONG, BYTES = pa.int64(), pa.binary()


def mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` (row -> tuples) over the rows of a frame."""
    names = [p.split()[0] for p in schema.split(", ")]
    kinds = [LONG if p.split()[1] == "bigint" else BYTES for p in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from rows_of(names, kinds, list(work(row))).to_batches()

    return df.mapInArrow(tidied(run), schema)


def blocks_of(distinct: DataFrame, width: int, size: int) -> DataFrame:
    """Windows in packed blocks: ``block`` and the lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                ids, terms = (batch.column(c).slice(k, size).to_pylist() for c in ("window", "terms"))
                length = np.fromiter((len(t) // 8 for t in terms), np.int64, len(terms))
                table = np.zeros((len(terms), width), U)
                table[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(terms), U)
                block = Block(np.array(ids, "S16"), length, table, np.broadcast_to(np.arange(width, dtype=np.int8), table.shape))
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | made], LONG), *(pa.array([b], BYTES) for b in block.packed(np.arange(len(ids))))], ["block", "ids", "lengths", "terms", "offsets"])
                made += 1

    return stored(distinct.mapInArrow(tidied(run), f"block bigint, {LISTS}"), "decontam-blocks")


def postings(shards: DataFrame, blocks: DataFrame, stripes: int) -> DataFrame:
    """``stripe, chunk, terms, sizes``: the terms of each chunk that windows have, dealt by term."""

    def deal(row: dict):
        terms, sizes = unpack(row["terms"], U), unpack(row["sizes"], np.int32)
        for stripe, at in split(terms, stripes):
            yield stripe, row["chunk"], pack(terms[at]), pack(sizes[at])

    def words(row: dict):
        terms = np.unique(unpack(row["terms"], U))
        for stripe, at in split(terms, stripes):
            yield stripe, pack(terms[at])

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.unique(np.concatenate([np.zeros(0, U), *(unpack(b, U) for b in right.column("terms").to_pylist())]))
        out = []
        for row in left.to_pylist() if len(wanted) else []:
            terms = unpack(row["terms"], U)
            on = wanted[np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)] == terms
            if on.any():
                out.append((row["stripe"], row["chunk"], pack(terms[on]), pack(unpack(row["sizes"], np.int32)[on])))
        return rows_of(["stripe", "chunk", "terms", "sizes"], [LONG, LONG, BYTES, BYTES], out)

    dealt = mapped(shards.select("chunk", "terms", "sizes"), deal, "stripe bigint, chunk bigint, terms binary, sizes binary")
    asked = mapped(blocks.select("terms"), words, "of bigint, terms binary")
    return stored(dealt.groupBy("stripe").cogroup(asked.groupBy("of")).applyInArrow(keep, "stripe bigint, chunk bigint, terms binary, sizes binary"), "decontam-postings")


def ranked_windows(blocks: DataFrame, lists: DataFrame, width: int, stripes: int) -> DataFrame:
    """``of``, the stripe of the rarest term, and the lists of its windows, rarest term first."""

    def ask(row: dict):
        terms = np.unique(unpack(row["terms"], U))
        for stripe, at in split(terms, stripes):
            yield stripe, row["block"], pack(terms[at])

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        terms = np.concatenate([np.zeros(0, U), *(unpack(r["terms"], U) for r in rows)])
        known, where = np.unique(terms, return_inverse=True)
        total = np.bincount(where, np.concatenate([np.zeros(0, np.int32), *(unpack(r["sizes"], np.int32) for r in rows)]), len(known)).astype(np.int64)
        out = []
        for row in left.to_pylist():
            own = unpack(row["terms"], U)
            at = np.searchsorted(known, own)
            seen = np.where(np.append(known, U(0))[at] == own, np.append(total, 0)[at], 0) if len(known) else np.zeros(len(own), np.int64)
            out.append((row["block"], row["terms"], pack(seen)))
        return rows_of(["block", "terms", "seen"], [LONG, BYTES, BYTES], out)

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.to_pylist()
        terms, seen = np.concatenate([np.zeros(0, U), *(unpack(r["terms"], U) for r in told)]), np.concatenate([np.zeros(0, np.int64), *(unpack(r["seen"], np.int64) for r in told)])
        order = np.argsort(terms)
        out = []
        for row in left.to_pylist():
            block = Block.unpacked([row], width).ranked(terms[order], seen[order])
            out += [(stripe, *block.packed(at)) for stripe, at in split(block.terms[:, 0], stripes)]
        return rows_of(["of", "ids", "lengths", "terms", "offsets"], [LONG, BYTES, BYTES, BYTES, BYTES], out)

    asked = mapped(blocks.select("block", "terms"), ask, "stripe bigint, block bigint, terms binary")
    told = asked.groupBy("stripe").cogroup(lists.groupBy("stripe")).applyInArrow(tell, "block bigint, terms binary, seen binary")
    return blocks.groupBy("block").cogroup(told.select(F.col("block").alias("for"), "terms", "seen").groupBy("for")).applyInArrow(rank, f"of bigint, {LISTS}")


def sent_to_chunks(ranked: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """``to``, a chunk, and the lists of the windows whose rarest term it holds."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.unpacked(left.to_pylist(), width)
        out = []
        if len(block.ids):
            rarest, where = np.unique(block.terms[:, 0], return_inverse=True)
            order, sizes = np.argsort(where, kind="stable"), np.bincount(where)
            begins = np.cumsum(sizes) - sizes
            for row in right.to_pylist():
                at = np.searchsorted(rarest, unpack(row["terms"], U))
                at = at[np.append(rarest, U(0))[at] == unpack(row["terms"], U)]
                if len(at):
                    out.append((row["chunk"], *block.packed(order[ranges(begins[at], sizes[at])])))
        return rows_of(["to", "ids", "lengths", "terms", "offsets"], [LONG, BYTES, BYTES, BYTES, BYTES], out)

    return ranked.groupBy("of").cogroup(lists.groupBy("stripe")).applyInArrow(meet, f"to bigint, {LISTS}")


def slots(row: dict, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term of the vocabulary its place among the chunk's terms or -1, and the chunk's posting sizes."""
    terms, sizes = unpack(row["terms"], U), unpack(row["sizes"], np.int32)
    at = np.searchsorted(vocabulary, terms)
    known = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == terms)
    slot = np.full(len(vocabulary) + 1, -1, np.int32)  # the last stands for no term
    slot[at[known]] = known
    return slot, sizes


def matches(row: dict, b: Block, slop: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Exact matches (window, first place) and proximity matches (window, place of its rarest term) in a chunk, in places from GAP on."""
    slot, sizes = slots(row, b.vocabulary)
    own = slot[b.term[:, :3]]
    alive = np.flatnonzero(((own >= 0) | (b.term[:, :3] < 0)).all(axis=1))
    exact, near = [], []
    if not len(alive):
        return exact, near
    steps = unpack(row["positions"], np.uint32).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    run = np.cumsum(steps)
    places = run - np.repeat(run[cuts[:-1]] - steps[cuts[:-1]], sizes) + GAP  # GAP free positions before and after all
    term_at = np.full(int(places.max()) + 2 * GAP, -2, np.int32)
    term_at[places] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    often = sizes[slot[b.term[alive, 0]]].astype(np.int64)
    at = 0
    total = np.cumsum(often)
    while at < len(alive):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
        w = np.repeat(alive[at:stop], often[at:stop])
        start = places[ranges(cuts[slot[b.term[alive[at:stop], 0]]], often[at:stop])] - b.offset[w, 0]
        at = stop
        close = np.flatnonzero(b.length[w] >= 3)
        for i in (1, 2):
            expected, want = start[close] + b.offset[w[close], i], slot[b.term[w[close], i]]
            close = close[np.any([term_at[expected + d] == want for d in range(-slop, slop + 1)], axis=0)] if len(close) else close
        near.append((w[close], start[close] + b.offset[w[close], 0]))
        for i in range(1, b.term.shape[1]):
            if not len(w):
                break
            good = (b.length[w] <= i) | (term_at[np.maximum(start + b.offset[w, i], 0)] == slot[b.term[w, i]])
            w, start = w[good], start[good]
        exact.append((w, start))
    return exact, near


def search(shards: DataFrame, sent: DataFrame, width: int, slop: int) -> DataFrame:
    """``chunk, row, hit_words, windows, n_near, near_windows`` per document with a match; row is its place in its chunk."""
    many = pa.list_(BYTES)
    schema = pa.schema([("chunk", LONG), ("row", LONG), ("hit_words", pa.list_(LONG)), ("windows", many), ("n_near", LONG), ("near_windows", many)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = Block.unpacked(right.to_pylist(), width).numbered(), []
        for row in left.to_pylist() if len(block.ids) else []:
            exact, near = matches(row, block, slop)
            w, start, v, place = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for found in (exact, near) for i in (0, 1)]
            if not len(w) and not len(v):
                continue
            lengths = np.array(row["n_words"], np.int64)
            base = np.cumsum(lengths + GAP) - lengths  # the first word of each document, after GAP free positions
            covered = np.unique(ranges(start, block.length[w]))
            owner, doc, close = (np.searchsorted(base, x, side="right") - 1 for x in (covered, start, place))
            of, ids = len(block.ids), [i.ljust(16, b"\0") for i in block.ids.tolist()]
            hit, met = np.unique(doc * of + w), np.unique(close * of + v)  # distinct pairs of document and window
            some = np.unique(np.concatenate([doc, close]))
            cut = lambda x: list(zip(np.searchsorted(x, some).tolist(), np.searchsorted(x, some, side="right").tolist()))
            n_near = np.bincount(close, minlength=len(lengths))
            for d, (a, b), (h, i), (m, j) in zip(some.tolist(), cut(owner), cut(hit // of), cut(met // of)):
                out.append((row["chunk"], d, (covered[a:b] - base[d]).tolist(), [ids[k] for k in (hit[h:i] % of).tolist()], int(n_near[d]), [ids[k] for k in (met[m:j] % of).tolist()]))
        return rows_of(schema.names, schema.types, out)

    both = shards.select("chunk", "n_words", "terms", "sizes", "positions").groupBy("chunk").cogroup(sent.groupBy("to"))
    return both.applyInArrow(run, "chunk bigint, row bigint, hit_words array<bigint>, windows array<binary>, n_near bigint, near_windows array<binary>")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 3, block_windows: int | None = None) -> DataFrame:
    """Per row of ``(doc_id, text)``: ``n_words``, ``hit_words`` (positions inside an occurring window), ``items``, ``n_near`` (proximity matches: distinct windows by their places), ``near_items``, and ``hash`` of the text.

    Windows are ``width`` consecutive words of an item, or the whole of a shorter one. Null texts have no words; items with a null
    id or without words have no windows; items of one id count as one. Windows of fewer than three words have no proximity matches. Repeated rows are judged each.
    ``width`` must be below GAP, the distance kept between documents.
    """
    if not 0 < width <= GAP - 2 * slop:
        raise ValueError("width out of range")
    shards = index(docs)
    distinct, owners = windows(benchmark, width)
    stripes = max(1, shards.count() // PER_STRIPE)
    blocks = blocks_of(distinct, width, block_windows or BLOCK)
    lists = postings(shards, blocks, stripes)
    found = stored(search(shards, sent_to_chunks(ranked_windows(blocks, lists, width, stripes), lists, width), width, slop), "decontam-matches")

    def items(column: str, name: str) -> DataFrame:
        told = found.select("chunk", "row", F.explode(column).alias("window")).join(owners, "window")
        return told.groupBy("chunk", "row").agg(F.array_sort(F.collect_set("item_id")).alias(name))

    hits = found.select("chunk", "row", "hit_words", "n_near").join(items("windows", "items"), ["chunk", "row"], "left").join(items("near_windows", "near_items"), ["chunk", "row"], "left")
    each = F.posexplode(F.arrays_zip("doc_id", "hash", "n_words")).alias("row", "d")
    rows = shards.select("chunk", each).select("chunk", F.col("row").cast("long").alias("row"), "d.doc_id", "d.hash", "d.n_words")
    none, nobody = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return rows.join(hits, ["chunk", "row"], "left").select(
        "doc_id", "hash", "n_words", F.coalesce("hit_words", none).alias("hit_words"), F.coalesce("items", nobody).alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("near_items", nobody).alias("near_items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs. Null and empty texts stay; of repeated rows all go or stay."""
    name, key = row_key(docs)
    same = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("hash"))
    bad = contamination(docs, benchmark).where(F.size("hit_words") > 0).select(same.alias(name)).distinct()
    return docs.withColumn(name, key).join(bad, name, "left_anti").drop(name)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = F.size("hit_words").cast("long")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        "n_near", F.size("near_items").cast("long").alias("n_near_items"), F.array_join("near_items", ",").alias("near_items"),
    )
