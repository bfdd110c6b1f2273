"""Curation of tagged text: joins on normalised text, last-wins tags, balanced samples, preference pairs, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import col, hashed, norm

TAGS = ["culture_tag", "domain_tag", "language"]


def text_key(c: Column | str) -> Column:
    """Digest of the normalised text: joins move 16 bytes a row, not texts."""
    return F.unhex(F.md5(norm(c).cast("binary")))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest order; partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def tag_lookup(tagged: DataFrame, text: str, order: str) -> DataFrame:
    return last_wins(tagged.withColumn("__key", text_key(text)).drop(text), ["__key"], order)


def join_tags(rows: DataFrame, lookup: DataFrame, text: str, how: str = "inner") -> DataFrame:
    """Rows with the tags of their normalised text; all rows of a text are kept. Left joins fill in ''."""
    out = rows.withColumn("__key", text_key(text)).join(lookup, "__key", how).drop("__key")
    if how == "left":
        out = out.withColumn("matched", F.col("culture_tag").isNotNull()).fillna("", subset=[c for c in TAGS if c in lookup.columns])
    return out


def rekey(lookup_rows: DataFrame, lookup: DataFrame, text: str, wider: Column, order: str) -> DataFrame:
    """The lookup under the key of a wider text: joined on the narrow one, then last wins on the wide one."""
    found = join_tags(lookup_rows.withColumn("__wide", text_key(wider)), lookup.drop(order), text).drop(text)
    return last_wins(found, ["__wide"], order)


def cultural(tag: Column | str) -> Column:
    """Everything but NoCulture, missing tags included."""
    return ~col(tag).eqNullSafe("NoCulture")


def sample(df: DataFrame, n: int, seed: str, *key: str) -> DataFrame:
    """n rows in the order of their hash: a top-n, not a full sort."""
    return df.withColumn("__h", hashed(seed, *key)).orderBy("__h", *key).limit(n).drop("__h")


def balanced(df: DataFrame, flag: Column, cap: int, seed: str, *key: str) -> DataFrame:
    """Up to ``cap`` flagged rows and as many of the others, with ``side`` telling which."""
    first = sample(df.where(flag), cap, seed, *key).withColumn("side", F.lit("cult"))
    other = sample(df.where(~flag), first.count(), seed, *key).withColumn("side", F.lit("nocult"))
    return first.unionByName(other)


def merge(*frames: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which later frames win on equal keys."""
    ranked = reduce(DataFrame.unionByName, [f.withColumn("__rank", F.lit(i)) for i, f in enumerate(frames)])
    return last_wins(ranked, keys, "__rank").drop("__rank")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def preference_pairs(df: DataFrame, keys: list[str], response: str, chosen: Column, score: Column, order: str) -> DataFrame:
    """Per group the first chosen response and the lowest-scored other one (the first on ties); groups that lack either go."""
    best = F.min_by(response, F.when(chosen, F.col(order)))
    worst = F.min_by(response, F.when(~chosen, F.struct(score.alias("s"), F.col(order).alias("o"))))
    out = df.groupBy(*keys).agg(best.alias("chosen"), worst.alias("rejected"), F.bool_or(chosen).alias("__a"), F.bool_or(~chosen).alias("__b"))
    return out.where("__a and __b").drop("__a", "__b")


def usable_pairs(df: DataFrame) -> DataFrame:
    return df.where("length(prompt) > 0 and length(chosen) > 0 and length(rejected) > 0")


def distribution(df: DataFrame, fields: list[str], top: int) -> DataFrame:
    """The most frequent values of each field with their shares; ties by value. One scan: fields are unpivoted, then counted."""
    long = df.select(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields]).unpivot([], fields, "field", "value")
    counted = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    total = counted.groupBy("field").agg(F.sum("n").alias("total"))
    # The group limit reaches below the shuffle: a task passes on at most ``top`` values of a field.
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    best = counted.withColumn("__r", rank).where(F.col("__r") <= top).drop("__r")
    return best.join(total, "field").select("field", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def vocabulary_counts(df: DataFrame, tag: str, vocabulary: list[str] | None = None) -> DataFrame:
    """Counts of a fixed vocabulary, zeros included, and of all other values as 'other'; share in percent."""
    words = vocabulary or dims.CULT_TAGS
    bucket = F.when(F.col(tag).isin(words), F.col(tag)).otherwise("other")
    counted = df.groupBy(bucket.alias("tag")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(w, i) for i, w in enumerate([*words, "other"])], "tag string, ord int")
    out = every.join(F.broadcast(counted), "tag", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counted.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("tag", "n", F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")), 4), F.lit(0.0)).alias("pct"))


def pick_per_label(df: DataFrame, label: str, seed: str, *key: str) -> DataFrame:
    """One row of each label, that with the least hash."""
    rest = [c for c in df.columns if c != label]
    return df.groupBy(label).agg(F.min_by(F.struct(*rest), F.struct(hashed(seed, *key).alias("h"), *key)).alias("r")).select(label, "r.*")


def pick_distinct_then_fill(df: DataFrame, n: int, label: str, seed: str, *key: str) -> DataFrame:
    """n rows by hash, one of each label before any second one. Only n rows per label can matter, so only these are ranked."""
    hashed_rows = df.withColumn("__h", hashed(seed, *key))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__h", *key))
    few = hashed_rows.withColumn("__r", rank).where(F.col("__r") <= n)
    return few.orderBy((F.col("__r") > 1), "__h", *key).limit(n).drop("__h", "__r")
