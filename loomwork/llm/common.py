"""Shared plumbing: the shared folder, tables written there, Arrow kernels, packed arrays and connected components."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Bytes of ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACE = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages, and would keep their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := ctypes.util.find_library("c"):
        getattr(ctypes.CDLL(libc), "malloc_trim", lambda _: 0)(0)


def tidied(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """An Arrow kernel that tidies up when its task's rows are through."""

    def kernel(batches: Iterable) -> Iterator:
        yield from run(batches)
        tidy()

    return kernel


def append_columns(df: DataFrame, kernel: Callable[[list], list], fields: list[tuple[str, str, pa.DataType]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Row-wise kernel over the text column: the columns in ``keep`` (default: all) stay, and one of an output's name is replaced.

    kernel: texts of one batch -> one list per field. fields: name, Spark type, Arrow type.
    """
    names = {f[0] for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("".join(["__text", *kept])))  # no column has that name
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]] + [f"`{n}` {t}" for n, t, _ in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            made = [pa.array(values, kind) for values, (_, _, kind) in zip(kernel(batch.column(last).to_pylist()), fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *made], [*kept, *(f[0] for f in fields)])

    return base.mapInArrow(tidied(run), schema)


def chunks(batches: Iterable[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Regroup incoming batches into tables of about ``limit`` text bytes, whatever the sizes of the documents."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        total = np.cumsum(lengths.astype(np.int64))
        while at < len(lengths):
            before = int(total[at - 1]) if at else 0
            stop = int(np.searchsorted(total, before + limit - size, side="left")) + 1
            stop = max(at + 1, min(stop, len(lengths)))
            held.append(batch.slice(at, stop - at))
            size += int(total[stop - 1]) - before
            at = stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def pack_strings(items: list[bytes]) -> bytes:
    """Byte strings as lengths and contents, compressed."""
    lengths = np.fromiter(map(len, items), dtype=np.uint32, count=len(items))
    head = np.array([len(items)], dtype=np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + lengths.tobytes() + b"".join(items))


def unpack_strings(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    starts = [4 + 4 * n, *ends[:-1]] if n else []
    return [raw[a:b] for a, b in zip(starts, ends)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ragged ranges [start, start + length), one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths)


def row_key(docs: DataFrame) -> tuple[str, F.Column]:
    """A column that names a row by its id and text, and a name for it that no column of the frame has."""
    name = "__key"
    while name in docs.columns:
        name += "_"
    return name, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")))


def attach(rows: DataFrame, info: DataFrame, key: str, share: int = 4096) -> DataFrame:
    """Join stored ``rows`` with stored ``info`` (one row per key, with the number ``rows`` of its rows; that column goes).

    Keys that hold more than 1 in ``share`` of all rows, ``share`` at most, are broadcast, so that no key gathers in one task; the others are shuffled.
    """
    total = info.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") * share > total
    hot, cold = info.where(often).drop("rows"), info.where(~often).drop("rows")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A star per component of the pairs: (member, least member), members other than the least."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def components(edges: DataFrame, one_task: int = 200_000) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, root)``, root being the least node; nodes without an edge are absent.

    Every partition is first reduced to a forest. If at most ``one_task`` edges are left, one task joins the forests; else alternating large-star and
    small-star steps do, every round checkpointed, so that the number of rounds grows with the logarithm of the longest chain between
    partitions. Both ways give the same rows.
    """

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        if stars := forest(pairs()):
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], ["a", "b"])

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**40)))).first())

    now = checkpointed(edges.where("a <> b").select("a", "b").mapInArrow(local, "a long, b long").distinct())
    seen = state(now)
    if seen[0] <= one_task:
        now = checkpointed(now.coalesce(1).mapInArrow(local, "a long, b long"))
        seen = (0,)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(root, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = checkpointed(small)
        mark = state(after)
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
