"""Ordered data: splits and caps by position, early stopping, training trajectories, log search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims


def positions(df: DataFrame, keys: list[str], *order: str, ranges: int = 0) -> DataFrame:
    """Add ``pos`` (from 1) and ``total`` within each key, in the given order.

    With ``ranges`` the rows of a key are cut into so many ranges of the first order column (a number), at its approximate quantiles: a position is then
    the count of the lower ranges plus the place within the own one. Equal to the plain form, but a few large keys are spread over
    keys * ranges tasks; the counts are keys * ranges rows.
    """
    own = Window.partitionBy(*keys)
    if ranges < 2:
        return df.withColumn("pos", F.row_number().over(own.orderBy(*order))).withColumn("total", F.count("*").over(own))
    edges = df.approxQuantile(order[0], [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    spread = df.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(order[0]))) if edges else F.lit(0))
    counts = spread.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    lower = counts.withColumn("__before", F.sum("__n").over(own.orderBy("__b")) - F.col("__n")).withColumn("total", F.sum("__n").over(own)).drop("__n")
    # The counts join by their key and range; keys may be null.
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__b")]
    both = spread.alias("l").join(lower.alias("r"), same)
    rows = both.select(*[F.col(f"l.{c}") for c in spread.columns], "__before", "total")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)) + F.col("__before")).select(*df.columns, "pos", "total")


def half_split(df: DataFrame, keys: list[str], *order: str, ranges: int = 0) -> DataFrame:
    """``part``: the first floor(n/2) rows of each stratum are 'neuron', the rest 'holdout'. ``ranges``: see :func:`positions`."""
    first = F.col("pos") <= F.floor(F.col("total") / 2)
    return positions(df, keys, *order, ranges=ranges).withColumn("part", F.when(first, "neuron").otherwise("holdout")).drop("pos", "total")


def cap_per_group(df: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """The first n rows of each group; the limit reaches below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def cap_then_members(df: DataFrame, keys: list[str], member: str, n: int, *order: str) -> DataFrame:
    """All rows whose member id is among the first n of any group: ids are capped by group, rows kept by id."""
    return df.join(cap_per_group(df, keys, n, *order).select(member).distinct(), member, "left_semi")


def early_stops(df: DataFrame, run: str, margin: Column, patience: int, *order: str) -> DataFrame:
    """The first place of each run where the last ``patience`` margins are all 0 or below."""
    own = Window.partitionBy(run).orderBy(*order)
    last = own.rowsBetween(1 - patience, 0)
    stopped = (F.max("__m").over(last) <= 0) & (F.count("__m").over(last) == patience)
    marked = df.withColumn("__m", margin).withColumn("step", F.row_number().over(own)).withColumn("__s", stopped)
    return marked.where("__s").groupBy(run).agg(F.min("step").cast("long").alias("stop_step"))


def trajectory(df: DataFrame, run: str, loss: Column, margin: Column, *order: str) -> DataFrame:
    """Loss and margin of each run: count, range, first- and last-quarter mean, mean of the last fifth of the margins, verdict.

    The margin counts where it is not null; a run without losses is '?'.
    """
    own = Window.partitionBy(run)
    base = df.select(run, loss.alias("loss"), margin.alias("margin"), *order)
    base = base.withColumn("i", F.sum(F.col("loss").isNotNull().cast("long")).over(own.orderBy(*order))).withColumn("n", F.count("loss").over(own))
    base = base.withColumn("j", F.sum(F.col("margin").isNotNull().cast("long")).over(own.orderBy(*order))).withColumn("m", F.count("margin").over(own))
    quarter, fifth = F.greatest(F.lit(1), F.floor(F.col("n") / 4)), F.greatest(F.lit(1), F.floor(F.col("m") / 5))
    out = base.groupBy(run).agg(
        F.count("loss").alias("n"), F.min("loss").alias("low"), F.max("loss").alias("high"), F.avg(F.when(F.col("i") <= quarter, F.col("loss"))).alias("q1"),
        F.avg(F.when(F.col("i") > F.col("n") - quarter, F.col("loss"))).alias("q4"), F.avg(F.when(F.col("j") > F.col("m") - fifth, F.col("margin"))).alias("final_margin"),
    )
    fell = F.col("q4") < F.col("q1")
    verdict = F.when(F.col("n") == 0, "?").when(F.col("final_margin").isNull(), "?").when(fell & (F.col("final_margin") > 0), "PASS").when(F.col("final_margin") <= 0, "FAIL").otherwise("CHECK")
    return out.withColumn("verdict", verdict)


def grep(lines: DataFrame, keys: list[str], pattern: str = dims.ERRORS, n: int = 5, value: str = "value", *order: str) -> DataFrame:
    """The first n matching lines of each file."""
    return cap_per_group(lines.where(F.col(value).rlike(pattern)), keys, n, *order)


def extremes(df: DataFrame, by: str, key: str, n: int, support: Column) -> DataFrame:
    """The n lowest and n highest rows with enough support, marked; ties by key. Two top-n's, no full sort."""
    kept = df.where(support)
    low = kept.orderBy(F.asc(by), key).limit(n).withColumn("end", F.lit("bottom"))
    return kept.orderBy(F.desc(by), key).limit(n).withColumn("end", F.lit("top")).unionByName(low)


def first_and_last(df: DataFrame, run: str, value: str, n: int, *order: str) -> DataFrame:
    """The first and the last n values of each run, in order; fewer where the run is shorter."""
    own = Window.partitionBy(run)
    up, total = F.row_number().over(own.orderBy(*order)), F.count("*").over(own)
    few = df.withColumn("__i", up).withColumn("__n", total).where((F.col("__i") <= n) | (F.col("__i") > F.col("__n") - n))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("__i", value)))), lambda s: s[value])
    return few.groupBy(run).agg(pick(F.col("__i") <= n).alias("first"), pick(F.col("__i") > F.col("__n") - n).alias("last"))
