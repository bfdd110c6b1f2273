"""Token counts: pieces are counted once per distinct pre-token, joined to per-document pre-token frequencies and summed.

No document is ever encoded. Chunks of documents are written as one row each: their distinct pre-tokens in order of bucket (a hash) and,
per document, (pre-token, frequency) lists in local numbers, which follow that order. The pre-tokens travel in packed blobs to their buckets;
each bucket counts the pieces of its distinct pre-tokens once; the counts return to the chunks, where put end to end they are
the prices of the local numbers. Both exchanges are chunk x bucket blobs, so a pre-token that every document holds costs one
entry per chunk.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, pack, pack_strings, stored, tidied, unpack, unpack_strings

#: Fixed value: the byte-level pre-token expression of the public vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same for texts below U+0250, spelled out as plain classes that the standard module matches faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WIDE = re.compile("[ɐ-\U0010ffff]")
CHUNK = 12 << 20
BUCKET = 16 << 20
COLUMNS = "chunk bigint, tokens binary, buckets binary, sizes binary, doc_id array<bigint>, n_bytes array<bigint>, special array<bigint>, rows array<int>, ids binary, counts binary"


@lru_cache(maxsize=1)
def library(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; no threads of its own
    return Tokenizer.from_file(path)


def pack_planes(values: np.ndarray) -> bytes:
    """32-bit numbers, byte plane by byte plane: the high planes of small numbers compress to nothing."""
    return pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def unpack_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(blob, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def pretokens(text: str, special: str) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how often the special string stood in it (each is one token of its own)."""
    find = (PRETOKEN if WIDE.search(text) else LATIN).findall
    if special not in text:
        return find(text), 0
    parts = text.split(special)
    return [t for p in parts for t in find(p)], len(parts) - 1


def chunk_rows(batches: Iterable[pa.RecordBatch], special: str, n: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    schema = pa.schema([("chunk", pa.int64()), ("tokens", pa.binary()), ("buckets", pa.binary()), ("sizes", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("special", pa.list_(pa.int64())), ("rows", pa.list_(pa.int32())), ("ids", pa.binary()), ("counts", pa.binary())])
    for k, table in enumerate(chunks(batches, CHUNK)):
        known: dict[str, int] = {}
        ids, counts, rows, sizes, specials = [], [], [], [], []
        for text in table.column("text").to_pylist():
            text = text or ""
            found, n_special = pretokens(text, special)
            tally = Counter(found)
            ids.append(np.fromiter((known.setdefault(t, len(known)) for t in tally), np.uint32, len(tally)))
            counts.append(np.fromiter(tally.values(), np.uint32, len(tally)))
            rows.append(len(tally))
            sizes.append(len(text.encode()))
            specials.append(n_special)
        tokens = [t.encode() for t in known]
        where = bucket_of(tokens, n)
        order = np.argsort(where, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        buckets, per_bucket = np.unique(where, return_counts=True)
        # Within a document the numbers rise, so that their steps are small.
        doc, local = np.repeat(np.arange(len(rows)), rows), number[np.concatenate(ids)]
        rising = np.lexsort((local, doc))
        step = np.diff(local[rising], prepend=0)
        heads = (np.cumsum(rows) - rows)[np.array(rows) > 0]
        step[heads] = local[rising][heads]
        row = {
            "chunk": [part << 32 | k], "tokens": [pack_strings([tokens[i] for i in order.tolist()])], "buckets": [pack_planes(buckets.astype(np.int64))], "sizes": [pack_planes(per_bucket)],
            "doc_id": [table.column("doc_id").to_pylist()], "n_bytes": [sizes], "special": [specials], "rows": [rows], "ids": [pack_planes(step)], "counts": [pack_planes(np.concatenate(counts)[rising])],
        }
        yield pa.RecordBatch.from_pydict(row, schema)


def bucket_of(tokens: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)) % np.uint64(n)


def count_tokens(docs: DataFrame, tokenizer_path: str, special: str = "<|endoftext|>") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` per row of ``(doc_id, text)``: tokens of the byte-level vocabulary in ``tokenizer_path``.

    Nothing is added at either end; the special string inside a text is one token, as by the library's default. Null and empty
    texts have 0 bytes and 0 tokens.
    """
    base = docs.select("doc_id", "text")
    n = max(1, -(-(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    held = stored(base.mapInArrow(tidied(lambda it: chunk_rows(it, special, n)), COLUMNS), "tokencount")

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, buckets, sizes in zip(*(batch.column(c).to_pylist() for c in ("chunk", "tokens", "buckets", "sizes"))):
                tokens, own, ends = unpack_strings(blob), unpack_planes(buckets).tolist(), np.cumsum(unpack_planes(sizes)).tolist()
                blobs = [pack_strings(tokens[a:b]) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([chunk] * len(own), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "tokens"])

    def pieces(table: pa.Table) -> pa.Table:
        encode = getattr(library(tokenizer_path), "encode_batch_fast", library(tokenizer_path).encode_batch)
        lists = [unpack_strings(b) for b in table.column("tokens").to_pylist()]
        known = dict.fromkeys(t for x in lists for t in x)
        tokens = list(known)
        for i in range(0, len(tokens), 5000):
            part = tokens[i : i + 5000]
            for token, made in zip(part, encode([t.decode() for t in part], add_special_tokens=False)):
                known[token] = len(made)
        blobs = [pack(np.fromiter((known[t] for t in x), np.uint32, len(x))) for x in lists]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "pieces": pa.array(blobs, pa.binary())})

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_tokens": []}
        by = dict(zip(right.column("bucket").to_pylist(), right.column("pieces").to_pylist()))
        cost = np.concatenate([np.zeros(0, np.uint32), *(unpack(by[b], np.uint32) for b in sorted(by))]).astype(np.int64)
        for row in left.to_pylist():
            rows = np.array(row["rows"], np.int64)
            ends = np.cumsum(rows)
            run = np.concatenate([[0], np.cumsum(unpack_planes(row["ids"]))])
            # Numbers are running sums of the steps, anew for each document.
            local = run[1:] - np.repeat(run[ends - rows], rows)
            sums = np.concatenate([[0], np.cumsum(cost[local] * unpack_planes(row["counts"]))])
            out["doc_id"] += row["doc_id"]
            out["n_bytes"] += row["n_bytes"]
            out["n_tokens"] += (sums[ends] - sums[ends - rows] + np.array(row["special"])).tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    counted = held.select("chunk", "tokens", "buckets", "sizes").mapInArrow(deal, "bucket bigint, chunk bigint, tokens binary").groupBy("bucket").applyInArrow(pieces, "chunk bigint, bucket bigint, pieces binary")
    return held.drop("tokens", "buckets", "sizes").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(add_up, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def digest(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    return count_tokens(docs, tokenizer_path).withColumn("over_limit", F.col("n_tokens") > limit)
