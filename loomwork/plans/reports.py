"""Reports that compose several operators: significance of shifts, curated splits, health of a training run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curate, resample, series


def significance(predictions: DataFrame, comparisons: list[tuple], n_boot: int = 5000, n_perm: int = 5000, items: bool = False) -> DataFrame:
    """before, after, d_w, d_nw, gap_shift, lo, hi, p, star (where the interval leaves out 0) for each pair of conditions.

    predictions: cond, country, side (W or NW), gold, pred, and item for the item bootstrap, whose items must be the same on both sides. The interval
    comes from drawing countries (or items) with replacement, p from dealing the W label anew. Comparisons are a few.
    """
    rows = []
    for before, after in comparisons:
        sums = resample.country_sums(predictions, before, after)  # a row per country
        acc = lambda h, n, s: F.try_divide(F.sum(F.when(F.col("side") == s, F.col(h))).cast("double"), F.sum(F.when(F.col("side") == s, F.col(n))).cast("double"))
        seen = sums.agg((acc("h1", "n1", "W") - acc("h0", "n0", "W")).alias("d_w"), (acc("h1", "n1", "NW") - acc("h0", "n0", "NW")).alias("d_nw"), resample.shift().alias("shift"))
        if items:
            reps = resample.item_bootstrap(item_rows(predictions, before, after), n_boot)
        else:
            reps = resample.cluster_bootstrap(sums, n_boot, f"boot{before}{after}")
        p = resample.p_value(resample.permutation(sums, n_perm, f"perm{before}{after}"), seen).select("p")
        one = seen.crossJoin(resample.interval(reps).select("lo", "hi")).crossJoin(p)  # single rows
        rows.append(one.select(F.lit(before).alias("before"), F.lit(after).alias("after"), "d_w", "d_nw", F.col("shift").alias("gap_shift"), "lo", "hi", "p", F.when((F.col("lo") > 0) | (F.col("hi") < 0), " *").otherwise("").alias("star")))
    return curate.union_all(*rows)


def item_rows(predictions: DataFrame, before, after) -> DataFrame:
    """idx 1..m, side, h0, n0, h1, n1 of the items; both conditions must have every item."""
    hit = (F.col("pred") == F.col("gold")).cast("long")
    one = lambda c, v: F.sum(F.when(F.col("cond") == c, v).otherwise(0))
    both = predictions.where(F.col("cond").isin(before, after)).groupBy("item", "side").agg(one(before, hit).alias("h0"), one(before, F.lit(1)).alias("n0"), one(after, hit).alias("h1"), one(after, F.lit(1)).alias("n1"))
    whole = F.when((F.col("n0") == 1) & (F.col("n1") == 1), F.col("h0")).otherwise(F.raise_error(F.lit("the conditions have different items")).cast("long"))
    return series.positions(both.withColumn("h0", whole).withColumn("__all", F.lit(0)), ["__all"], "item", ranges=16).select(F.col("pos").cast("long").alias("idx"), "side", "h0", "n0", "h1", "n1")


def build_splits(rows: DataFrame, tagged: DataFrame, text: str, key: str, order: str, cap: int, seed: str = "42") -> dict[str, DataFrame]:
    """The cult and nocult splits of a source: rows with the tags of their normalised text, up to ``cap`` cultural ones and as many others."""
    joined = curate.join_tags(rows, curate.tag_lookup(tagged, text, order).drop(order), text)
    both = curate.balanced(joined, curate.cultural("culture_tag"), cap, seed, key)
    return {side: both.where(F.col("side") == side).drop("side") for side in ("cult", "nocult")}


def training_health(log: DataFrame, lines: DataFrame | None = None, n: int = 5) -> DataFrame:
    """The trajectory of each run with its verdict and, where log lines (run, line_no, value) are given, its first error lines."""
    out = series.trajectory(log, "run", F.col("loss"), F.col("margin"), "step")
    if lines is None:
        return out
    hits = series.grep(lines, ["run"], series.dims.ERRORS, n, "value", "line_no")
    return out.join(hits.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda h: h["value"]).alias("errors")), "run", "left")
