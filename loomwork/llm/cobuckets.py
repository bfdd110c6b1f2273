"""A pair of tables rewritten as co-bucketed files: one sorted Parquet file for each table and bucket.

Rows are clustered and fully sorted by (table, bucket, order) in ranges, so that a bucket of any weight is sorted by many tasks; the dynamic
partition writer of (table, bucket), without a limit of records, makes one file of a bucket in each range that has rows of it. A distributed step then
flattens the folders: a single file is renamed; the few parts of a bucket that several ranges share are put end to end, in order, by one streaming task.
Nothing else gathers: what reaches the driver are numbers of files, of which there are at most as many as buckets.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import stored

BATCH = 1 << 17


def hashed(text: F.Column, buckets: int) -> F.Column:
    """Unsigned crc32 of a text, modulo ``buckets``."""
    return F.pmod(F.crc32(text.cast("binary")), F.lit(buckets))


def fresh(name: str, *taken: str) -> str:
    """A column name that is not taken, cases aside."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def in_order(columns: list[str], key: str) -> list[F.Column]:
    """By key descending, then the other columns ascending, nulls first."""
    return [F.col(f"`{key}`").desc_nulls_first(), *(F.col(f"`{c}`").asc_nulls_first() for c in columns if c != key)]


def tasks(spark: SparkSession) -> int:
    """Tasks for steps over files: a few for each core, so that a large file holds up few others."""
    return 4 * spark.sparkContext.defaultParallelism


def each_number(spark: SparkSession, limit: int, work: Callable[[int], dict | None], schema: str) -> DataFrame:
    """``work`` for every number below ``limit``, on the executors; the rows that it returns, stored."""
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for n in batch.column(0).to_pylist() if (row := work(n))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows]) for c in names], names)

    return stored(spark.range(0, limit, 1, min(limit, tasks(spark))).mapInArrow(run, schema), "cobuckets-files")


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put_together(fs: pafs.FileSystem, parts: list[str], target: str) -> None:
    """The rows of ``parts``, in order, as one file; it appears under its name only when it is whole."""
    unfinished = f"{target}.{uuid.uuid4().hex}"
    writer = None
    for path in parts:
        with fs.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            writer = writer or pq.ParquetWriter(fs.open_output_stream(unfinished), file.schema_arrow, compression="snappy")
            for batch in file.iter_batches(batch_size=BATCH):
                writer.write_batch(batch)
    out = writer.file_handle or writer.where
    writer.close()
    if not out.closed:
        out.close()
    fs.move(unfinished, target)


def written(df: DataFrame, table: str, number: str, key: str, limit: int, folder: str, prefix: str) -> DataFrame:
    """``number, path`` of the files ``folder/table/prefix-number.parquet``, one for each value of the column ``number`` (below ``limit``), which they leave out; sorted by ``key``."""
    spark, columns = df.sparkSession, [c for c in df.columns if c != number]
    bucket = fresh("bucket", *columns)
    full = df.select(F.col(f"`{number}`").cast("long").alias(bucket), *[F.col(f"`{c}`") for c in columns])
    order = [F.col(bucket), *in_order(columns, key)]
    staging = f"{folder}/staging-{uuid.uuid4().hex}"
    # A table has columns of its own and so a write of its own. Its folder is part of the path: the writer would sort anew, and by no more than its
    # partition columns, for a constant one.
    full.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).partitionBy(bucket).parquet(f"{staging}/table={table}")
    target_folder = f"{folder}/{table}"

    def flatten(n: int) -> dict | None:
        fs, root = store_of(staging)
        target = f"{target_folder}/{prefix}-{n:05d}.parquet"
        source, path = f"{root}/table={table}/{bucket}={n}", store_of(target)[1]
        if fs.get_file_info(path).type == pafs.FileType.NotFound:  # else an earlier attempt has made it
            found = fs.get_file_info(pafs.FileSelector(source, allow_not_found=True))
            parts = sorted((f.path for f in found if f.path.endswith(".parquet") and not f.base_name.startswith((".", "_"))), key=lambda p: int(p.rpartition("/")[2].split("-")[1]))
            if not parts:
                return None
            if len(parts) == 1:
                fs.move(parts[0], path)
            else:
                put_together(fs, parts, path)
        return {"number": n, "path": target}

    fs, path = store_of(target_folder)
    fs.create_dir(path, recursive=True)
    files = each_number(spark, limit, flatten, "number bigint, path string")
    fs.delete_dir(store_of(staging)[1])
    return files


def read_files(spark: SparkSession, schema, paths: list[str], number: str) -> DataFrame:
    """The rows of numbered files with their file's number."""
    if not paths:
        return spark.createDataFrame([], schema).withColumn(number, F.lit(None).cast("long"))
    columns = [F.col(f"`{f.name}`") for f in schema.fields]
    return spark.read.schema(schema).parquet(*paths).select(*columns, F.regexp_extract(F.col("_metadata.file_name"), r"-(\d+)\.parquet$", 1).cast("long").alias(number))


def described(files: DataFrame, key: str) -> DataFrame:
    """``files`` with the columns, the number of rows and a digest of the keys of each file, which is read as a stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple[str, int, str]] = []
            for uri in batch.column("path").to_pylist():
                fs, path = store_of(uri)
                digest, comma = hashlib.sha256(), ""
                with fs.open_input_file(path) as source:
                    file = pq.ParquetFile(source)
                    for part in file.iter_batches(batch_size=BATCH, columns=[key]):
                        digest.update((comma + ",".join(pc.fill_null(part.column(0).cast(pa.string()), "").to_pylist())).encode())
                        comma = "," if part.num_rows or comma else ""
                    made.append((",".join(file.schema_arrow.names), file.metadata.num_rows, digest.hexdigest()))
            new = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "columns", "n_rows", "ids_sha256"])

    schema = ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", columns string, n_rows bigint, ids_sha256 string"
    return files.repartition(tasks(files.sparkSession), "path").mapInArrow(run, schema)


def co_bucket(sales: DataFrame, lines: DataFrame, key: str = "sale_id", item: str = "item_id", buckets: int = 600, names: tuple[str, str] = ("sales", "sale_lines")) -> tuple[str, DataFrame]:
    """Write both tables into a new folder as numbered files, then rewrite them there as one file for each table and bucket.

    Returns the folder and a row for each final file: ``table_name, path, columns, ids_sha256, lineage_sha256, bucket, n_rows, n_joined, rewritten``. A
    key's bucket is crc32 of "s" and the key modulo ``buckets``; keys of ``lines`` that ``sales`` does not have take ``buckets``, null keys of either
    table ``buckets + 1``. Sales start in the file of their bucket or of the bucket before (modulo 4 equal to 1), lines in that of their item, null items
    in file 0. A starting file that has exactly the rows of a final one stays. Repeated rows are kept; keys may repeat in either table, and
    ``n_joined`` counts pairs. Empty tables have no files. The folder must be one that pyarrow's file systems reach (local, HDFS, S3, GCS).
    """
    spark = sales.sparkSession
    folder = f"{shared_dir(spark)}/cobuckets-{uuid.uuid4().hex}"
    number, bucket, held = (fresh(c, *sales.columns, *lines.columns) for c in ("file_number", "bucket_number", "n_held"))
    hash_of = hashed(F.concat(F.lit("s"), F.col(key).cast("string")), buckets)
    own = F.when(F.col(key).isNull(), buckets + 1).otherwise(hash_of)
    limit = buckets + 2
    begun = {
        names[0]: written(sales.withColumn(number, own - F.when(own % 4 == 1, 1).otherwise(0)), names[0], number, key, limit, folder, "start"),
        names[1]: written(lines.withColumn(number, F.coalesce(hashed(F.col(item).cast("string"), buckets), F.lit(0))), names[1], number, key, limit, folder, "start"),
    }
    starts = {t: {r["number"]: r["path"] for r in files.collect()} for t, files in begun.items()}  # at most one for each bucket
    schemas = {names[0]: sales.schema, names[1]: lines.schema}
    ids = stored(read_files(spark, schemas[names[0]], list(starts[names[0]].values()), number).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(held)), "cobuckets-ids")

    def bucketed(table: str, numbers: list[int], *columns: str) -> DataFrame:
        rows = read_files(spark, schemas[table], [starts[table][n] for n in numbers], number).select(*[F.col(f"`{c}`") for c in columns], number)
        if table == names[0]:
            return rows.withColumns({bucket: own, held: F.lit(0).cast("long")})
        return rows.join(ids, key, "left").select(*[F.col(f"`{c}`") for c in columns], number, held, F.when(F.col(key).isNull(), buckets + 1).when(F.col(held).isNull(), buckets).otherwise(hash_of).alias(bucket))

    def counts_of(table: str) -> DataFrame:
        rows = bucketed(table, list(starts[table]), key).groupBy(F.lit(table).alias("table_name"), F.col(bucket).cast("long").alias("bucket"), F.col(number).alias("number"))
        return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(held), F.lit(0)).alias("joined"))

    counts = stored(counts_of(names[0]).unionByName(counts_of(names[1])), "cobuckets-counts")
    of = lambda *by: F.sum("n").over(Window.partitionBy("table_name", *by))
    stays = {(r["table_name"], r["number"]): r["bucket"] for r in counts.where("n > 0").withColumns({"x": of("bucket"), "y": of("number")}).where("n = x AND n = y").collect()}  # at most one for each bucket
    final = spark.createDataFrame([(t, n, starts[t][n], b, False) for (t, n), b in stays.items()], "table_name string, number long, path string, bucket long, rewritten boolean").drop("number")
    for table, schema in schemas.items():
        moving = [n for n in starts[table] if (table, n) not in stays]
        rows = bucketed(table, moving, *schema.names).select(*[F.col(f"`{c}`") for c in schema.names], bucket)
        made = written(rows, table, bucket, key, limit, folder, "bucket")
        final = final.unionByName(made.select(F.lit(table).alias("table_name"), "path", F.col("number").alias("bucket"), F.lit(True).alias("rewritten")))
        paths = {n: starts[table][n] for n in moving}

        def remove(n: int, paths: dict[int, str] = paths) -> None:
            if n in paths:
                fs, path = store_of(paths[n])
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)

        each_number(spark, limit, remove, "number bigint")
    traced = counts.groupBy("table_name", "bucket").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("x"))  # at most one entry for each starting file
    traced = traced.select("table_name", "bucket", F.sha2(F.array_join(F.transform("x", lambda e: F.concat_ws(":", e["number"].cast("string"), e["n"].cast("string"))), ","), 256).alias("lineage_sha256"))
    joined = counts.groupBy("bucket").agg(F.sum("joined").alias("n_joined"))
    facts = described(final, key).join(traced, ["table_name", "bucket"]).join(joined, "bucket", "left")
    facts = facts.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.coalesce("n_joined", F.lit(0)).alias("n_joined"), "rewritten")
    return folder, stored(facts, "cobuckets-facts")
