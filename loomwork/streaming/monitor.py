"""Streams: early stopping with state by run, and a last-wins lookup that grows batch by batch."""

from __future__ import annotations

import bisect
import pickle
import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.curate import last_wins
from ..session import shared_dir


def early_stops(stream: DataFrame, run: str, margin: str, patience: int, *order: str) -> DataFrame:
    """run, stop_step: emitted once, when the last ``patience`` margins are all 0 or below.

    State is the last margins, the number of steps and whether the run has stopped: of constant size per run. Rows of a batch are put in
    order; across batches they must arrive in order, as a log's do.
    """
    kept = stream.select(F.col(run).cast("long").alias(run), F.col(margin).cast("double").alias("__m"), *order)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, done = state.get if state.exists else ([], 0, False)
        last = list(last)
        rows = pd.concat(list(frames)).sort_values(list(order))
        found = None
        if not done:
            for m in rows["__m"]:
                n += 1
                last = [*last, m][-patience:]
                if len(last) == patience and max(last) <= 0:
                    found, done = n, True
                    break
        state.update((last, n, done))
        if found is not None:
            yield pd.DataFrame({run: [key[0]], "stop_step": [found]})

    return kept.groupBy(run).applyInPandasWithState(step, f"{run} long, stop_step long", "last array<double>, n long, done boolean", "append", GroupStateTimeout.NoTimeout)


def early_stops_any_order(stream: DataFrame, run: str, margin: str, patience: int, time: str, tie: str, delay: str, buckets: int = 256) -> DataFrame:
    """run, stop_step, as ``early_stops`` gives them, for rows that arrive in any order but at most ``delay`` behind the latest.

    State is kept by bucket of runs, since a call for each run costs far more than its rows; ``buckets`` stays the same as long as the stream does. It holds the rows that the
    watermark has not passed, by time and ``tie``, and of each run its steps, how many of the last margins are 0 or below, and whether it has stopped; what the watermark has
    passed is complete and is stepped through in order. A timer wakes a bucket whose rows are ready though no new ones come. Rows of null margin are no steps, so a row far in the
    future with a null margin closes a stream.
    """
    own = F.col(run).cast("long")
    kept = stream.withWatermark(time, delay).select(
        F.pmod(F.xxhash64(own), F.lit(buckets)).alias("__b"), F.coalesce(own, F.lit(0)).alias(run), own.isNull().alias("__none"), F.col(margin).cast("double").alias("__m"),
        F.col(time).alias("__time"), F.unix_micros(time).alias("__t"), F.col(tie).cast("long").alias("__tie"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, runs = pickle.loads(state.get[0]) if state.exists else ([], {})
        for frame in frames:
            columns = (frame[c].tolist() for c in ("__t", "__tie", "__m", run, "__none"))
            waiting += [(t, i, m, r, none) for t, i, m, r, none in zip(*columns) if m == m and not runs.get((r, none), (0, 0, False))[2]]
        passed = state.getCurrentWatermarkMs() * 1000 + 999
        waiting.sort()
        ready = bisect.bisect_right(waiting, passed, key=lambda w: w[0])
        found = []
        for _, _, m, r, none in waiting[:ready]:
            n, low, done = runs.get((r, none), (0, 0, False))
            if not done:
                n, low = n + 1, low + 1 if m <= 0 else 0
                runs[r, none] = (n, low, low >= patience)
                if low >= patience:
                    found.append((None if none else r, n))
        waiting = [w for w in waiting[ready:] if not runs.get((w[3], w[4]), (0, 0, False))[2]]
        state.update((pickle.dumps((waiting, runs)),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame({run: pd.array([r for r, _ in found], dtype="Int64"), "stop_step": [n for _, n in found]})

    return kept.groupBy("__b").applyInPandasWithState(step, f"{run} long, stop_step long", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


class RouteProgress(StreamingQueryListener):
    """Counts by route of each batch, as a running query observes them."""

    def __init__(self) -> None:
        self.batches: list[dict[str, int]] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if seen := event.progress.observedMetrics.get("routes"):
            self.batches.append(seen.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def scan_routed(stream: DataFrame, column: str, routes: dict[str, list[str]], path: str, report=None) -> tuple[DataFrame, list[dict[str, int]]]:
    """A bounded scan that writes each route's rows, in one pass, below ``path`` (rows of no route go), and the counts by route that it showed while it ran.

    ``report(counts so far)`` is called after each batch. A source may be in one route only.
    """
    spark = stream.sparkSession
    of = {source: name for name, sources in routes.items() for source in sources}
    if len(of) < sum(map(len, routes.values())):
        raise ValueError("a source in two routes")
    route = F.coalesce(*[F.when(F.col(column).isin(sources), name) for name, sources in routes.items()]).alias("route")
    counts = [F.count(F.when(F.col("route") == name, 1)).alias(name) for name in routes]
    progress = RouteProgress()
    if report:
        progress.onQueryProgress = lambda event, was=progress.onQueryProgress: (was(event), report({k: sum(b[k] for b in progress.batches) for k in routes}))
    spark.streams.addListener(progress)
    try:
        taken = stream.select("*", route).observe("routes", F.count("*").alias("scanned"), *counts).where("route is not null")
        query = taken.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").partitionBy("route").format("parquet").start(f"{path}/rows")
        query.awaitTermination()
        progress.ended.wait(60)
    finally:
        spark.streams.removeListener(progress)
    schema = taken.schema
    return spark.read.schema(schema).parquet(f"{path}/rows"), progress.batches


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Everything a bounded stream gives now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").format("parquet").start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def lookup_from_stream(stream: DataFrame, keys: list[str], order: str, name: str = "lookup") -> DataFrame:
    """A last-wins lookup over a bounded stream; each batch makes a new version of the table, so a repeated batch does no harm."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    versions: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in versions if not v.endswith(f"/v{number}")]
        both = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(before[-1])) if before else batch
        last_wins(both.withColumn("__o", F.col(order)), keys, "__o").drop("__o").select(batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")
        if f"{path}/v{number}" not in versions:
            versions.append(f"{path}/v{number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(merge).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(versions[-1]) if versions else spark.createDataFrame([], stream.schema)


def file_stream(spark: SparkSession, folder: str, name: str, per_batch: int = 1) -> DataFrame:
    """The Parquet table called ``name`` in a folder, a file or a folder of files, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return source.parquet(f"{folder}/{name}")
    return source.option("pathGlobFilter", name).parquet(folder)
