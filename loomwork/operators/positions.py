"""Places of rows: exact row numbers without a single task, file order, and frames put side by side by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """The rows with their place from 0 in the given order, which should have no ties.

    Rows are sorted in ranges and written; a row's place is its place within its range plus the sizes of the ranges before, of which there are as many
    as tasks. Only those sizes reach the driver.
    """
    spark = df.sparkSession
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__row": within}), "numbered")
    before, sizes = 0, []
    for part, n in sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        sizes.append((part, before))
        before += n
    offsets = spark.createDataFrame(sizes, "__part int, __before long")
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__row") + F.col("__before")).drop("__part", "__row", "__before")


def read_in_order(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The rows of Parquet files with their place: by the files' names, then by the rows' order in each."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return numbered(rows, "__file", "__index", name=name).drop("__file", "__index")


def side_by_side(left: DataFrame, right: DataFrame, by: str = "position") -> DataFrame:
    """Numbered frames joined by place. Frames of unequal lengths are an error, as nothing says which rows belong together."""
    lengths = [df.agg((F.coalesce(F.max(by), F.lit(-1)) + 1).alias("n")).first()["n"] for df in (left, right)]
    if lengths[0] != lengths[1]:
        raise ValueError(f"{lengths[0]} rows on one side and {lengths[1]} on the other")
    return left.join(right, by)
