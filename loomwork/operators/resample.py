"""Resampling and rank statistics.

A statistic of resampled countries depends on a country only through its sums, so items are first summed by country: replicates then work on
a few dozen rows, whatever the number of items. Draws of countries come from md5 of (seed, replicate, draw): the same law as a generator's, and repeatable. Items are drawn by
classes of equal ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_number, hashed


def country_sums(df: DataFrame, before, after) -> DataFrame:
    """country, side, and hits and items of both conditions."""
    hit = (F.col("pred") == F.col("gold")).cast("long")
    one = lambda c, v: F.sum(F.when(F.col("cond") == c, v).otherwise(0))
    return df.groupBy("country", "side").agg(one(before, hit).alias("h0"), one(before, F.lit(1)).alias("n0"), one(after, hit).alias("h1"), one(after, F.lit(1)).alias("n1"))


def shift() -> Column:
    """Gap after minus gap before, of the sums by side; null where a side is empty."""
    acc = lambda h, n, s: F.try_divide(F.sum(F.when(F.col("side") == s, F.col(h))).cast("double"), F.sum(F.when(F.col("side") == s, F.col(n))).cast("double"))
    return (acc("h1", "n1", "W") - acc("h1", "n1", "NW")) - (acc("h0", "n0", "W") - acc("h0", "n0", "NW"))


def replicates(df: DataFrame, n: int, of: int, seed: str) -> DataFrame:
    """rep, draw, idx: ``of`` draws with replacement from 1..of, ``n`` times."""
    spark = df.sparkSession
    draws = spark.range(n).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(max(of, 1) - 1))).alias("draw"))
    return draws.withColumn("idx", hash_number(hashed(seed, "rep", "draw")) % max(of, 1) + 1)


def cluster_bootstrap(sums: DataFrame, n: int, seed: str = "boot") -> DataFrame:
    """rep, shift: countries drawn with replacement, each with all its items. ``sums`` is a row per country."""
    numbered = sums.withColumn("idx", F.row_number().over(Window.orderBy("country")).cast("long"))
    of = sums.count()
    return replicates(sums, n, of, seed).join(F.broadcast(numbered), "idx").groupBy("rep").agg(shift().alias("shift"))


def item_bootstrap(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """rep, shift: items drawn with replacement, the same ones before and after. items: idx, side, h0, n0, h1, n1.

    Items that are equal in side and counts are of one class, of which there are a handful (eight for hits of 0 and 1). A replicate's draws fall on the classes by the multinomial
    law with the classes' shares, so a replicate costs as much as there are classes, however many items there are. Replicates have generators of their own.
    """
    kept = ["side", "h0", "n0", "h1", "n1"]
    classes = [tuple(r) for r in items.groupBy(*kept).count().orderBy(*kept).collect()]
    count = np.array([c[-1] for c in classes], np.int64)
    sums = {s: np.array([[v if c[0] == s else 0 for v in c[1:5]] for c in classes], np.float64).reshape(-1, 4) for s in ("W", "NW")}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep in batch.column("rep").to_pylist():
                drawn = np.random.default_rng([seed, rep]).multinomial(int(count.sum()), count / count.sum())
                (h0, n0, h1, n1), (g0, m0, g1, m1) = drawn @ sums["W"], drawn @ sums["NW"]
                out.append((h1 / n1 - g1 / m1) - (h0 / n0 - g0 / m0) if n0 and n1 and m0 and m1 else None)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, pa.float64())], ["rep", "shift"])

    reps = items.sparkSession.range(n if classes else 0).withColumnRenamed("id", "rep")
    return reps.mapInArrow(run, "rep bigint, shift double")


def item_bootstrap_by_draws(items: DataFrame, n: int, seed: str = "item") -> DataFrame:
    """rep, shift, as ``item_bootstrap`` gives them, with draws that can be replayed: each takes the item at its md5's place among the items, ordered by class.

    A row for each draw, counted by replicate and class within tasks, so that a draw costs its md5 and a search among the classes' bounds; the sums take a row for
    each replicate and class. For far more items than the study's few thousand the other form is cheaper by their number.
    """
    kept = ["side", "h0", "n0", "h1", "n1"]
    classes = [tuple(r) for r in items.groupBy(*kept).count().orderBy(*kept).collect()]  # a handful
    total = sum(c[-1] for c in classes)
    if not total:
        return items.sparkSession.createDataFrame([], "rep long, shift double")
    of = F.lit(0)
    for i in range(1, len(classes)):
        of = F.when(F.col("idx") > sum(c[-1] for c in classes[:i]), i).otherwise(of)
    drawn = replicates(items, n, total, seed).groupBy("rep", of.alias("class")).agg(F.count("*").alias("times"))
    value = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in classes]), F.col("class") + 1)
    return drawn.select("rep", value(0).alias("side"), *[(value(i) * F.col("times")).alias(kept[i]) for i in range(1, 5)]).groupBy("rep").agg(shift().alias("shift"))


def permutation(sums: DataFrame, n: int, seed: str = "perm") -> DataFrame:
    """rep, shift: the W label dealt anew to as many countries."""
    n_w = sums.where("side = 'W'").count()
    spread = sums.sparkSession.range(n).withColumnRenamed("id", "rep").crossJoin(F.broadcast(sums.drop("side")))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(hashed(seed, "rep", "country"), "country"))
    return spread.withColumn("side", F.when(rank <= n_w, "W").otherwise("NW")).groupBy("rep").agg(shift().alias("shift"))


def interval(reps: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval with linear interpolation over the replicates that have a value."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return reps.agg(F.count("shift").alias("n"), F.percentile("shift", F.lit(lo)).alias("lo"), F.percentile("shift", F.lit(hi)).alias("hi"))


def p_value(reps: DataFrame, observed: DataFrame) -> DataFrame:
    """Share of replicates at least as far from 0 as the observed shift."""
    return reps.crossJoin(F.broadcast(observed.select(F.col("shift").alias("o")).limit(1))).agg(F.avg((F.abs("shift") >= F.abs("o")).cast("double")).alias("p"), F.max("o").alias("observed"))


def average_rank(x: str, keys: list[str]) -> Column:
    own = Window.partitionBy(*keys)
    return F.rank().over(own.orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def rank_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman's rho over average ranks, and the least-squares line; points: keys, x, y, a few per key."""
    ranked = points.withColumn("rx", average_rank("x", keys)).withColumn("ry", average_rank("y", keys))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def rank_p(rho: Column | str, n: Column | str) -> Column:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom; null below three points, 0 for a perfect one.

    With t = rho sqrt(v / (1 - rho^2)) the angle of the textbook's finite sums has sine |rho|, so p is one sum of v / 2 terms.
    """
    r, v = (F.col(rho) if isinstance(rho, str) else rho), (F.col(n) if isinstance(n, str) else n).cast("int") - 2
    s, c2, odd = F.abs(r), 1 - r * r, v % 2 == 1
    more = F.when(odd, (v - 3) / 2).otherwise((v - 2) / 2).cast("int")
    places = F.when(more >= 1, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * c2 * F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(places, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), step)["total"]
    inside = F.when(odd, 2 / math.pi * (F.asin(F.least(s, F.lit(1.0))) + F.when(v > 1, s * F.sqrt(F.greatest(c2, F.lit(0.0))) * total).otherwise(0.0))).otherwise(s * total)
    return F.when((v < 1) | r.isNull(), None).when(s >= 1, 0.0).otherwise(F.greatest(1 - inside, F.lit(0.0)))
