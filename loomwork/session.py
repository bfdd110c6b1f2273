"""Session defaults: adaptive execution with skewed-join splitting, UTC, ANSI semantics as Spark ships them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomwork", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword arguments use ``__`` for dots and win over the defaults."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Where the session names none, a local master gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = kept.get() if kept.isDefined() else "file://" + tempfile.mkdtemp(prefix="loomwork-")
        if not kept.isDefined():
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """A frame written to the shared folder and read back: computed once, whatever is lost; the files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
