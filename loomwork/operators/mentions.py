"""Mentions of places and peoples to countries, through one ranked gazetteer."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import distinct_ignoring_case, strip
from ..session import kept

STIR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a block of the names' Bloom filter; bytes of text that are looked up together; columns of such a chunk.
BLOCK_BITS = 1 << 16
CHUNK = 8 << 20
CHUNK_COLUMNS = ["chunk", "keys", "phrases", "size", "row", "start", "number", "words"]


def gazetteer(countries: DataFrame, cities: DataFrame) -> DataFrame:
    """name, country, rank: country names (0), abbreviations (1), cities (2, the last of equal names), peoples (3; '' discards).

    countries: code, name. cities: city, code, ord.
    """
    spark = countries.sparkSession
    own = countries.select(F.lower("name").alias("name"), F.col("name").alias("country"), F.lit(0).alias("rank"))
    towns = cities.join(countries, "code").groupBy(F.lower("city").alias("name")).agg(F.max_by("name", "ord").alias("country")).withColumn("rank", F.lit(2))
    fixed = spark.createDataFrame([(k, v, 1) for k, v in dims.ABBREVIATIONS.items()] + [(k, v, 3) for k, v in dims.DEMONYMS.items()], "name string, country string, rank int")
    every = own.unionByName(towns).unionByName(fixed)
    return every.groupBy("name").agg(F.min_by("country", "rank").alias("country"))


def resolve(df: DataFrame, key: str, mentions: str, names: DataFrame) -> DataFrame:
    """``countries``: the distinct countries of a row's mentions, in order; unknown and discarded mentions go.

    The mentions are exploded and joined, so that a large gazetteer is no matter; rows come back together by their key.
    """
    long = df.select(key, F.posexplode(mentions).alias("pos", "m")).withColumn("name", F.lower(strip("m")))
    found = long.join(names, "name").where("country <> ''").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "country"))), lambda s: s["country"]).alias("countries"))
    return df.join(found, key, "left").withColumn("countries", distinct_ignoring_case(F.coalesce("countries", F.array().cast("array<string>"))))


def words_of(c: str) -> F.Column:
    """Lower-case words: runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def phrase_codes(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code for the ``n`` words from each place of ``first``, out of the codes of single words."""
    out = words[first] * STIR
    for k in range(1, n):
        out = (out ^ out >> np.uint64(29)) * STIR + words[first + k]
    return (out ^ out >> np.uint64(32)) * STIR


def word_codes(words: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64)


def bits_of(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Four of a block's bits for each code."""
    stirred = (codes ^ codes >> np.uint64(31)) * STIR
    return ((stirred >> np.uint64(k) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for k in (0, 16, 32, 48))


def bitmap_of(parts: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the phrases, 24 bits each, in blocks that tasks make up: only the filter itself reaches the driver."""
    blocks = -(-24 * n // BLOCK_BITS)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([phrase_codes(word_codes(w), np.zeros(1, np.int64), len(w))[0] for w in (p.split(" ") for p in batch.column(0).to_pylist())], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((codes % np.uint64(blocks)).astype(np.int64)), pa.array(codes.view(np.int64))], ["block", "code"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for block in np.unique(at).tolist():
                mine = own.setdefault(block, np.zeros(BLOCK_BITS, bool))
                for bits in bits_of(codes[at == block]):
                    mine[bits] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in own.values()], pa.binary())], ["block", "bits"])

    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for row in parts.select("phrase").mapInArrow(code, "block bigint, code bigint").repartition("block").mapInArrow(fill, "block bigint, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def passing(codes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    block, good = (codes % np.uint64(len(bitmap))).astype(np.int64), np.ones(len(codes), bool)
    for bits in bits_of(codes):
        good &= (bitmap[block, bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)
    return good


def chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (key, text) regrouped into tables of about CHUNK bytes of text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            stop = min(len(ends), int(np.searchsorted(ends, before + CHUNK - size)) + 1)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
            if size >= CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(x: np.ndarray) -> pa.Array:
    """Numbers below 2^32, compressed byte by byte of their four."""
    return pa.array([pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)], pa.binary())


def unpacked(x: pa.Scalar, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x.as_buffer(), 4 * n, "zstd"), np.uint8).reshape(4, n).T).view("<u4").ravel()


def possible(texts: pa.Array, lengths: list[int], bitmap: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct phrases of texts (words with one space between) that pass the filter, the most frequent first, and their words; of each place of one, by text, start and then the longest first: text, start, phrase."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    word, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    codes = word_codes(vocabulary)[word]
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))  # words up to the end of the text
    phrases: list[str] = []
    found = []
    for n in lengths:
        first = np.flatnonzero(left >= n)
        first = first[passing(phrase_codes(codes, first, n), bitmap)]
        number = word[first]
        for k in range(1, n):
            number = np.unique(number * len(vocabulary) + word[first + k], return_inverse=True)[1]
        _, one, number = np.unique(number, return_index=True, return_inverse=True)
        found.append((first, np.full(len(first), n), number + len(phrases), np.full(len(one), n)))
        phrases += [" ".join(vocabulary[word[i + k]] for k in range(n)) for i in first[one].tolist()]
    first, n, number, words = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((-n, first))
    first, number = first[order], number[order]
    most = np.argsort(-np.bincount(number, minlength=len(phrases)), kind="stable")
    rank = np.empty_like(most)
    rank[most] = np.arange(len(most))
    return [phrases[i] for i in most.tolist()], words[most], text[first], first - (np.cumsum(sizes) - sizes)[text[first]], rank[number]


def settled(text: np.ndarray, start: np.ndarray, n: np.ndarray, country: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Of places by text, start and then the longest first: the leftmost, of those the longest, no overlaps."""
    now, free = -1, 0
    for place in zip(text.tolist(), start.tolist(), n.tolist(), country.tolist()):
        if place[0] != now:
            now, free = place[0], 0
        if place[1] >= free:
            free = place[1] + place[2]
            yield place


def find_names(df: DataFrame, names: DataFrame, key: str, text: str = "text", listed: bool = False) -> DataFrame:
    """key, start, length (in words), country of each name of the gazetteer ``names(name, country)`` in a text: the leftmost, of those the longest, no overlaps.

    With ``listed`` it is key, countries: the distinct countries of a text in order, without ''; a text without names may be missing. ``key`` must tell rows apart.
    Names without letters or digits match nothing; equal names have the least country.

    Texts are read once, in chunks. A chunk's distinct phrases that pass a Bloom filter of the names are looked up by the whole phrase, by a join (a small
    gazetteer is broadcast by Spark's own check), and the answers meet the chunk's places again. So what travels is a phrase once for each chunk, and the
    places packed: not each word, however many words begin names.
    """
    kind = df.schema[key].dataType.simpleString()
    own = names.select(words_of("name").alias("w"), "country").where("size(w) > 0")
    parts = kept(own.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.first(F.size("w")).alias("length"), F.min("country").alias("country")), "gazetteer")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    lengths, bitmap = sorted(counts) or [1], bitmap_of(parts, sum(counts.values()) or 1)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, table in enumerate(chunked(batches)):
            phrases, words, row, start, number = possible(table.column(1).combine_chunks(), lengths, bitmap)
            chunk = TaskContext.get().partitionId() << 32 | i
            lists = [pa.array([chunk], pa.int64()), pa.array([table.column(0).to_pylist()], pa.list_(table.schema.field(0).type)), pa.array([phrases], pa.list_(pa.string())), pa.array([len(number)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*lists, *map(packed, (np.diff(row, prepend=0), np.diff(start, prepend=0), number, words))], CHUNK_COLUMNS)

    def settle(chunk: pa.Table, hits: pa.Table) -> pa.Table:
        keys, size, asked = chunk.column("keys")[0].values, chunk.column("size")[0].as_py(), chunk.column("phrases")[0].as_py()
        row, start, number = (unpacked(chunk.column(c)[0], size) for c in ("row", "start", "number"))
        row, start = (np.cumsum(x, dtype=np.uint32) for x in (row, start))  # differences, modulo 2^32
        told = pc.dictionary_encode(hits.column("country").combine_chunks(), null_encoding="encode")
        country = np.full(asked, -1)
        country[hits.column("number").to_numpy()] = told.indices.to_numpy(zero_copy_only=False)
        met = country[number]
        hit = np.flatnonzero(met >= 0)
        places = settled(row[hit], start[hit], unpacked(chunk.column("words")[0], asked)[number[hit]], met[hit])
        if listed:
            lands, lists = told.dictionary.to_pylist(), {}
            for i, _, _, c in places:
                lists.setdefault(i, {})[c] = None
            named = [[lands[c] for c in own if lands[c]] for own in lists.values()]
            return pa.table([keys.take(pa.array(list(lists), pa.int64())), pa.array(named, pa.list_(pa.string()))], ["key", "countries"])
        at, start, n, met = np.array(list(places), np.int64).reshape(-1, 4).T
        return pa.table([keys.take(pa.array(at)), pa.array(start), pa.array(n), told.dictionary.take(pa.array(met)).cast(pa.string())], ["key", "start", "length", "country"])

    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    schema = f"chunk bigint, keys array<{kind}>, phrases array<string>, size bigint, " + ", ".join(f"{c} binary" for c in CHUNK_COLUMNS[4:])
    chunks = kept(df.select(key, plain).mapInArrow(look, schema), "gazetteer-chunks")
    asked = chunks.select("chunk", F.posexplode("phrases").alias("number", "phrase"))
    hits = asked.join(parts, "phrase").select(F.col("chunk").alias("of"), "number", "country")
    own = chunks.withColumn("phrases", F.size("phrases"))
    out = "countries array<string>" if listed else "start bigint, length bigint, country string"
    return own.groupBy("chunk").cogroup(hits.groupBy("of")).applyInArrow(settle, f"key {kind}, {out}").withColumnRenamed("key", key)


def referenced(df: DataFrame, names: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``countries``: the distinct countries that a row's text names, in order; '' in the gazetteer discards a name."""
    told = find_names(df, names, key, text, listed=True).groupBy(key)  # one list each, so that no row multiplies
    lists = told.agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list("countries")))).alias("countries"))
    return df.join(lists, key, "left").withColumn("countries", F.coalesce("countries", F.array().cast("array<string>")))


def extract_with(df: DataFrame, extractor: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """Hook for a named-entity model: ``extractor`` maps a batch of texts to arrays of mentions."""
    schema = df.drop("mentions").schema.add("mentions", "array<string>")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(mentions=extractor(pdf[text]))

    return df.drop("mentions").mapInPandas(run, schema)


def detect_with(df: DataFrame, detector: Callable[[str], str], wanted: str = "en", text: str = "text", limit: int | None = None) -> DataFrame:
    """Rows whose text an external detector gives the wanted language; errors count as another language.

    With ``limit`` it sees only so many first characters: a rule that results depend on where it is set (500 in the study).
    """

    def run(batches):
        for pdf in batches:
            yield pdf[[_safe(detector, t[:limit] if t else "") == wanted for t in pdf[text]]]

    return df.mapInPandas(run, df.schema)


def _safe(detector: Callable[[str], str], text: str) -> str | None:
    try:
        return detector(text)
    except Exception:
        return None
