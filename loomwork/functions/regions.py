"""Countries, groups and clusters. The lookups differ on purpose; each is kept under its own name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dims
from .text import col, mapped


def group_of(c: Column | str) -> Column:
    return F.when(col(c).isin(dims.WESTERN), "Western").when(col(c).isin(dims.NON_WESTERN), "Non-Western").otherwise("Other")


def us_similar(cluster: Column | str, near: str = "W", far: str = "NW", clusters: list[str] | None = None) -> Column:
    return F.when(col(cluster).isin(clusters or dims.US_SIMILAR), near).otherwise(far)


def guarded(c: Column | str) -> Column:
    """A survey number: null for empty or other text and for codes below -1.5 (so -1 is a value)."""
    v = col(c).try_cast("double")
    return F.when(v >= -1.5, v)


def weight(c: Column | str) -> Column:
    """A weight that is missing, zero or negative counts as 1."""
    v = col(c).try_cast("double")
    return F.when(F.coalesce(v, F.lit(0.0)) <= 0, 1.0).otherwise(v)


def titled(c: Column) -> Column:
    """Python's title(): capital letters after underscores too."""
    return F.array_join(F.transform(F.split(c, "_"), lambda x: F.initcap(x)), "_")


#: Candidate keys by lookup, tried in order.
LOOKUPS = {
    "exact_lower_alias": lambda c: [c, F.lower(c), mapped(c, dims.ALIASES_SHORT), mapped(F.lower(c), dims.ALIASES_SHORT)],
    "exact_lower": lambda c: [c, F.lower(c)],
    "exact_region": lambda c: [c, mapped(F.lower(c), dims.ALIASES_REGION, F.lower(c))],
    "normalised": lambda c: [F.translate(F.lower(c), " -", "__")],
    "exact_lower_title": lambda c: [c, F.lower(c), titled(c)],
}


def with_cluster(df: DataFrame, clusters: DataFrame, lookup: str, country: str = "country", default: str | None = None) -> DataFrame:
    """Add ``cluster`` from ``clusters(name, cluster)``, the first candidate key that is known.

    Rows without a cluster go, unless there is a default. The dimension holds one row per country name (a few hundred at most); it becomes one
    map literal, so the facts are neither shuffled nor sorted.
    """
    table = {r["name"]: r["cluster"] for r in clusters.select("name", "cluster").limit(10_001).collect()}
    if len(table) > 10_000:
        raise ValueError("a cluster dimension has one row per country name")
    keys = LOOKUPS[lookup](F.col(country))
    found = F.coalesce(*[mapped(k, table) for k in keys], F.lit(default)) if table else F.lit(default).cast("string")
    out = df.withColumn("cluster", found)
    return out if default else out.where("cluster is not null")
