"""Huge nested JSON documents, read by ranges of bytes and written as streams.

A range may begin anywhere, inside a string too. So a first pass tells, for each range, how it changes the state (in a string or not, depth) of whoever
enters it, for either state; summing that up over the ranges of a file gives the state in which each begins. Then every range splits off the entries that
begin in it, reading past its end to finish the last one. Entries leave as JSON text, which ``from_json`` parses.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = 32 << 20
PIECE = 2 << 20
QUOTE, BACKSLASH, COMMA, COLON = b'"\\,:'
STEP = np.zeros(256, np.int8)
STEP[list(b"{[")], STEP[list(b"}]")] = 1, -1
ENTRY = "file string, place bigint, key string, value string"


class Bytes:
    """A file as a source of pieces."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def piece(self, at: int, end: int) -> bytes:
        return self.file.read_at(min(PIECE, end - at), at)

    def escaped(self, at: int) -> bool:
        """Whether an odd number of backslashes stands before ``at``."""
        run = 0
        while at - run > 0:
            before = self.file.read_at(min(64, at - run), max(0, at - run - 64))
            held = len(before) - len(before.rstrip(b"\\"))
            run += held
            if held < len(before):
                break
        return run % 2 == 1


def shape(piece: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """The bytes, where a string opens or closes, and whether the byte after the piece is escaped."""
    raw = np.frombuffer(piece, np.uint8)
    quotes = raw == QUOTE
    slashes = raw == BACKSLASH
    if not escaped and not slashes.any():
        return raw, quotes, False
    place = np.arange(len(raw))
    last = np.maximum.accumulate(np.where(slashes, -1, place))  # the last byte before or here that is no backslash
    before = np.concatenate([[-1], last[:-1]])
    run = place - 1 - before + np.where(before < 0, escaped, 0)
    return raw, quotes & (run % 2 == 0), bool(slashes[-1]) and (len(raw) - 1 - int(last[-1]) + (escaped if last[-1] < 0 else 0)) % 2 == 1


def change(source: Bytes, start: int, end: int) -> tuple[int, int, int]:
    """Strings opened or closed, modulo 2, and the change of depth for a reader that enters outside a string, or inside one."""
    escaped, parity, outside, inside = source.escaped(start), 0, 0, 0
    while start < end:
        piece = source.piece(start, end)
        raw, quotes, escaped = shape(piece, escaped)
        within = (np.cumsum(quotes) + parity) & 1
        steps = STEP[raw]
        outside += int(steps[within == 0].sum())
        inside += int(steps[within == 1].sum())
        parity = int(within[-1])
        start += len(piece)
    return parity, outside, inside


def events(source: Bytes, start: int, end: int, inside: bool, depth: int, level: int) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray]]:
    """Pieces from ``start`` to ``end`` with the places, and the kinds, of what matters at ``level``: 1 an entry may begin, 2 entries end, 3 a colon."""
    escaped = source.escaped(start)
    while start < end:
        piece = source.piece(start, end)
        raw, quotes, escaped = shape(piece, escaped)
        within = (np.cumsum(quotes, dtype=np.int64) + inside) & 1
        steps = np.where(within == 0, STEP[raw], 0)
        deep = depth + np.cumsum(steps, dtype=np.int64)
        kind = np.zeros(len(raw), np.int8)
        kind[(steps == 1) & (deep == level)] = 1
        kind[(within == 0) & (raw == COMMA) & (deep == level)] = 1
        kind[(steps == -1) & (deep == level - 1)] = 2
        kind[(within == 0) & (raw == COLON) & (deep == level)] = 3
        at = np.flatnonzero(kind)
        yield piece, start, at, kind[at]
        inside, depth = bool(within[-1]), int(deep[-1])
        start += len(piece)


def found(source: Bytes, start: int, end: int, inside: bool, depth: int, level: int) -> Iterator[tuple[int, bytes]]:
    """``(place, text)`` of the entries at ``level`` that begin in the range."""
    begun, held = -1, bytearray()
    for piece, base, places, kinds in events(source, start, source.size, inside, depth, level):
        done = 0
        for at, kind in zip(places.tolist(), kinds.tolist()):
            if kind > 2:
                continue
            if begun >= 0:
                text = bytes(held + piece[done:at]) if held else piece[done:at]
                if text.strip():
                    yield begun, text
                held.clear()
            if base + at >= end:
                return
            begun, done = (base + at + 1, at + 1) if kind == 1 else (-1, at)
        if begun >= 0:
            held += piece[done:]
        elif base + len(piece) >= end:
            return


def last_member(source: Bytes, start: int, end: int, inside: bool, depth: int) -> str | None:
    """The last member of the document that begins in the range, its name read to the end."""
    name, begun, held = None, -1, bytearray()
    for piece, base, places, kinds in events(source, start, source.size, inside, depth, 1):
        done = 0
        for at, kind in zip(places.tolist(), kinds.tolist()):
            if kind == 3 and begun >= 0:
                name, begun = json.loads(bytes(held + piece[done:at])), -1
                held.clear()
            elif kind == 1:
                if base + at >= end:
                    return name
                begun, done = base + at + 1, at + 1
                held.clear()
            if kind == 2:
                begun = -1
        if begun >= 0:
            held += piece[done:]
        elif base + len(piece) >= end:
            return name
    return name


def members(source: Bytes, start: int, end: int, inside: bool, depth: int, current: str | None) -> list[tuple[int, str | None]]:
    """Where the members of the document that the range meets begin: (place, name), the one in which it begins first."""
    out, begun, held = [(-1, current)], -1, bytearray()
    for piece, base, places, kinds in events(source, start, end, inside, depth, 1):
        done = 0
        for at, kind in zip(places.tolist(), kinds.tolist()):
            if kind == 3 and begun >= 0:
                out.append((base + at, json.loads(bytes(held + piece[done:at]))))
                begun = -1
                held.clear()
            elif kind == 1:
                begun, done = base + at + 1, at + 1
                held.clear()
        if begun >= 0:
            held += piece[done:]
    return out


def keyed(text: bytes) -> tuple[str | None, str]:
    """Key and value of an entry; an element of an array has no key."""
    whole = text.decode().strip()
    if whole.startswith('"'):
        key, end = json.decoder.scanstring(whole, 1)
        rest = whole[end:].lstrip()
        if rest.startswith(":"):
            return key, rest[1:].strip()
    return None, whole


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and length of a file, of the files of a folder, or of what a pattern matches; hidden ones and empty ones are left out."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(place) or []:
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            if not s.isDirectory() and s.getLen() and not s.getPath().getName().startswith((".", "_")):
                out.append((s.getPath().toString(), s.getLen()))
    return sorted(out)


def spread(df: DataFrame, work, schema: str, n: int) -> DataFrame:
    """``work`` (row -> rows as tuples) over ranges, a task for each few of them."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    fields = pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for made in work(row):
                    held.append(made)
                    size += 100 + sum(len(x) for x in made if isinstance(x, str))
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], fields)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], fields)

    return df.repartition(max(1, n), "file", "start").mapInArrow(run, schema)


def read_entries(spark: SparkSession, path: str, member: str | None = None, size: int = RANGE) -> DataFrame:
    """``file, place, key, value`` of the entries of JSON documents, one document a file: those of the document itself, or of its ``member``.

    A member may be an object or an array, whose elements have no key; ``place`` is the byte at which an entry begins and so orders it. Values are JSON text.
    Documents are read by ranges of ``size`` bytes; an entry must fit into memory, a document need not. Equal keys are all returned, in order; an
    absent or empty member has no rows. The files must be in a store that pyarrow reaches (local, HDFS, S3, GCS).
    """
    files = files_of(spark, path)
    ranges = [(name, length) for name, length in files]
    n = sum(-(-length // size) for _, length in ranges)
    cut = spark.createDataFrame(ranges, "file string, length bigint").select("file", "length", F.explode(F.expr(f"sequence(0, length - 1, {size})")).alias("start"))
    cut = cut.withColumn("end", F.least("length", F.col("start") + size))

    def changes(row: dict):
        yield row["file"], row["start"], row["end"], *change(Bytes(row["file"]), row["start"], row["end"])

    told = spread(cut, changes, "file string, start bigint, end bigint, parity bigint, outside bigint, inside bigint", n)
    # Rows of these windows are ranges, not entries.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("within", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1)
    told = told.withColumn("step", F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside"))).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    told = told.select("file", "start", "end", "within", "depth")
    if member is None:

        def entries(row: dict):
            for place, text in found(Bytes(row["file"]), row["start"], row["end"], row["within"], row["depth"], 1):
                yield row["file"], place, *keyed(text)

        return spread(told, entries, ENTRY, n)

    def named(row: dict):
        yield row["file"], row["start"], row["end"], row["within"], row["depth"], last_member(Bytes(row["file"]), row["start"], row["end"], row["within"], row["depth"])

    known = spread(told, named, "file string, start bigint, end bigint, within boolean, depth bigint, last string", n)
    known = known.withColumn("current", F.last("last", ignorenulls=True).over(before))

    def entries_of(row: dict):
        source = Bytes(row["file"])
        begins = members(source, row["start"], row["end"], row["within"], row["depth"], row["current"])
        if member not in {name for _, name in begins}:
            return
        at = 0
        for place, text in found(source, row["start"], row["end"], row["within"], row["depth"], 2):
            while at + 1 < len(begins) and begins[at + 1][0] < place:
                at += 1
            if begins[at][1] == member:
                yield row["file"], place, *keyed(text)

    return spread(known, entries_of, ENTRY, n)


def write_stream(rows: DataFrame, value: str, order: list[str], path: str, before: str, after: str, between: str = ",") -> None:
    """One file at ``path``: ``before``, the texts of the column ``value`` in the order given, ``after``; nulls are left out.

    Rows are sorted in ranges and written as parts; then one task, which holds a piece at a time, puts the parts one after the other. The file appears
    under its name when it is whole, so a repeated attempt does no harm.
    """
    spark = rows.sparkSession
    staging = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    ready = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), *[F.col(c).alias(f"by_{i}") for i, c in enumerate(order)])
    keys = [f"by_{i}" for i in range(len(order))]
    ready.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.parquet(staging)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for _ in batches:
            fs, root = pafs.FileSystem.from_uri(staging)
            target = pafs.FileSystem.from_uri(path)[1]
            parts = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("part-"))
            unfinished, first = f"{target}.{uuid.uuid4().hex}", True
            with fs.open_output_stream(unfinished) as out:
                out.write(before.encode())
                for part in parts:
                    with fs.open_input_file(part) as source:
                        for batch in pq.ParquetFile(source).iter_batches(batch_size=4096):
                            if batch.num_rows:
                                out.write((("" if first else between) + between.join(batch.column(0).to_pylist())).encode())
                                first = False
                out.write(after.encode())
            fs.move(unfinished, target)
        yield pa.RecordBatch.from_pydict({"done": [True]})

    spark.range(0, 1, 1, 1).mapInArrow(put, "done boolean").collect()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
