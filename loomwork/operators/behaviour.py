"""Comparisons of conditions: group accuracies, deltas, default rates, null baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def right() -> Column:
    return (F.col("pred") == F.col("gold")).cast("double")


def group_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Item-weighted accuracy by the keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(right()).alias("accuracy"))


def accuracy_with_sem(df: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Pooled accuracy, with the standard error over the units' own accuracies; 0 for a single unit."""
    by_unit = df.groupBy(*keys, unit).agg(F.count("*").alias("n"), F.sum(right()).alias("hits"))
    spread = F.stddev_samp(F.col("hits") / F.col("n")) / F.sqrt(F.count("*"))
    return by_unit.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.coalesce(spread, F.lit(0.0)).alias("sem"))


def two_groups(df: DataFrame, group: str = "side") -> DataFrame:
    """Overall, W and NW accuracy and their gap by condition; a missing group is null and so is the gap."""
    part = lambda g: F.avg(F.when(F.col(group) == g, right()))
    return df.groupBy("cond").agg(F.avg(right()).alias("overall"), part("W").alias("w"), part("NW").alias("nw")).withColumn("gap", F.col("w") - F.col("nw"))


def condition_table(df: DataFrame, base: int | str, conditions: DataFrame | None = None, group: str = "side") -> DataFrame:
    """Each condition against the base one; conditions listed without predictions stay as rows of nulls."""
    table = two_groups(df, group)
    one = table.where(F.col("cond") == base).select(F.col("overall").alias("b"), F.col("nw").alias("b_nw"))
    rows = conditions.join(table, "cond", "left") if conditions is not None else table
    # The base is a single row: a cross join with it is a projection.
    return rows.crossJoin(F.broadcast(one.limit(1))).select("cond", "overall", "w", "nw", "gap", (F.col("overall") - F.col("b")).alias("d_overall"), (F.col("nw") - F.col("b_nw")).alias("d_nw"))


def gap_shift(df: DataFrame, comparisons: DataFrame, group: str = "side") -> DataFrame:
    """Deltas of both groups and of their gap for (before, after) pairs."""
    table = two_groups(df, group)
    a = table.select(F.col("cond").alias("before"), F.col("w").alias("w0"), F.col("nw").alias("nw0"), F.col("gap").alias("g0"))
    b = table.select(F.col("cond").alias("after"), F.col("w").alias("w1"), F.col("nw").alias("nw1"), F.col("gap").alias("g1"))
    pairs = comparisons.join(a, "before").join(b, "after")
    return pairs.select("before", "after", (F.col("w1") - F.col("w0")).alias("d_w"), (F.col("nw1") - F.col("nw0")).alias("d_nw"), (F.col("g1") - F.col("g0")).alias("gap_shift"))


def errors(df: DataFrame, us: str = "US", labels: list[str] | None = None) -> DataFrame:
    """Wrong answers of other countries that have an answer for the US too; of the given gold labels only."""
    out = df.where(F.col("us_pred").isNotNull() & (F.col("pred") != F.col("gold")) & (F.col("country") != us))
    return out.where(F.col("gold").isin(labels)) if labels else out


def default_rate(df: DataFrame, keys: list[str], us: str = "US", labels: list[str] | None = None) -> DataFrame:
    """Among errors, the share whose answer is the one given for the US."""
    return errors(df, us, labels).groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("us_pred")).cast("double")).alias("rate"))


def match_rate(df: DataFrame, keys: list[str], us: str = "US") -> DataFrame:
    """The same share over all rows of other countries, right or wrong."""
    rows = df.where(F.col("us_pred").isNotNull() & (F.col("country") != us))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("us_pred")).cast("double")).alias("rate"))


def outcome() -> Column:
    return F.when(F.col("pred") == F.col("gold"), "correct").when(F.col("pred") == F.col("us_pred"), "wrong_us_match").otherwise("wrong_us_diverge")


def trichotomy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the three outcomes side by side; absent ones are 0."""
    kinds = ["correct", "wrong_us_match", "wrong_us_diverge"]
    counted = df.where("us_pred is not null").withColumn("__o", outcome()).groupBy(*keys).agg(*[F.count(F.when(F.col("__o") == k, 1)).alias(k) for k in kinds])
    return counted.withColumn("default_rate", F.try_divide(F.col("wrong_us_match").cast("double"), (F.col("wrong_us_match") + F.col("wrong_us_diverge")).cast("double")))


def overview(df: DataFrame, us: str = "US", keys: tuple[str, ...] = ("cond",)) -> DataFrame:
    """Accuracy and default rate by the keys, in both modes (two sides, clusters), from one pass over the predictions."""
    wrong = F.col("us_pred").isNotNull() & (F.col("pred") != F.col("gold")) & (F.col("country") != us)
    same = (F.col("pred") == F.col("us_pred")).cast("double")
    own = [F.col(k) for k in keys]
    sets = df.withColumn("__w", wrong).withColumn("__s", F.when(wrong, same)).withColumn("__r", right()).groupingSets([[*own, F.col("side")], [*own, F.col("cluster")]], *keys, "side", "cluster")
    out = sets.agg(F.count("*").alias("n"), F.avg("__r").alias("accuracy"), F.avg("__s").alias("default_rate"))
    return out.select(*keys, F.when(F.col("side").isNotNull(), "binary").otherwise("clusters").alias("mode"), F.coalesce("side", "cluster").alias("grp"), "n", "accuracy", "default_rate")


def default_rates(df: DataFrame, keys: list[str], us: str = "US") -> DataFrame:
    """keys, wrong, n, default_rate, match_rate: the share of answers that are the one given for the US, among errors and among all rows of other countries, in one pass."""
    rows = df.where(F.col("us_pred").isNotNull() & (F.col("country") != us))
    same, wrong = (F.col("pred") == F.col("us_pred")).cast("double"), F.col("pred") != F.col("gold")
    return rows.groupBy(*keys).agg(F.count(F.when(wrong, 1)).alias("wrong"), F.count("*").alias("n"), F.avg(F.when(wrong, same)).alias("default_rate"), F.avg(same).alias("match_rate"))


def null_baseline(df: DataFrame, golds: DataFrame, us: str = "US") -> DataFrame:
    """How often an answer is the gold of another country for the same scenario, the US and the country itself left out.

    df: cond, scenario, country, pred. golds: scenario, country, gold, one row each. Countries are not joined with each other: the golds of a scenario, at most
    one for each country, are gathered once and a row looks through those of its scenario. Rows without other countries are skipped.
    """
    gathered = golds.groupBy("scenario").agg(F.collect_list(F.struct("country", "gold")).alias("__g"))
    rows = df.where(F.col("country") != us).join(gathered, "scenario").select("cond", "pred", F.filter("__g", lambda g: (g["country"] != F.col("country")) & (g["country"] != us)).alias("__g"))
    hits = F.size(F.filter("__g", lambda g: g["gold"] == F.col("pred")))
    return rows.where(F.size("__g") > 0).groupBy("cond").agg(F.count("*").alias("n"), F.avg(hits / F.size("__g")).alias("null_match"))
