"""Attribution scores of neurons: accumulation, control-corrected deltas, selection, set overlap, profiles.

A neuron is (module, layer, neuron); the number of neurons is that of the model, not of the data. Scores per (neuron, country, item) can be large, so all
of it is partial aggregation first; windows rank neurons only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims

NEURON = ["module", "layer", "neuron"]
#: A sketch's error is one in ACCURACY; ten times as many neurons as that are ranked beyond the wanted share.
ACCURACY = 10_000
SLACK = 10 / ACCURACY
#: Contributions that one task sums, as long as MOST_TASKS are enough for that.
PER_TASK = 200_000
#: Spark's default for spark.shuffle.sort.bypassMergeThreshold: up to so many tasks the rows go straight to files, beyond them the writer holds a whole split.
MOST_TASKS = 200


def family(module: str = "module") -> Column:
    """Module family; null for modules that are not targets."""
    out = F.lit(None).cast("string")
    for name, modules in dims.FAMILIES.items():
        out = F.when(F.col(module).isin(modules), name).otherwise(out)
    return out


def accumulate(df: DataFrame, keys: list[str], score: str = "score", weight: Column | None = None) -> DataFrame:
    """Sums of contributions, negative ones counted as 0, each times its weight."""
    kept = F.greatest(F.col(score), F.lit(0.0))
    return df.groupBy(*keys).agg(F.sum(kept if weight is None else kept * weight).alias("score"))


def item_contribution(values: Column | str, mask: Column | str, probability: Column) -> Column:
    """An item's score at a neuron: the largest contribution of its tokens that are no padding, negative ones as 0, times the answer's probability."""
    v = F.col(values) if isinstance(values, str) else values
    m = F.col(mask) if isinstance(mask, str) else mask
    kept = F.zip_with(v, m, lambda x, y: F.when(y, F.greatest(x, F.lit(0.0))).otherwise(0.0))
    return F.coalesce(F.array_max(kept), F.lit(0.0)) * probability


def item_counts(df: DataFrame, condition: str, order: list, key: str = "country") -> DataFrame:
    """Items by country, from the first of the listed conditions that has any."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(condition))
    counted = df.where(F.col(condition).isin(order)).groupBy(place.alias("p"), key).agg(F.count("*").alias("n"))
    first = counted.agg(F.min("p").alias("p"))
    return counted.join(F.broadcast(first), "p").drop("p")


def scale_limits(profile: DataFrame, keys: list[str], value: str = "asymmetry", robust: float = 0.95) -> DataFrame:
    """Limits of a colour scale: largest absolute value, its robust percentile, its median (the linear zone of a symmetric log scale)."""
    a = F.abs(value)
    return profile.groupBy(*keys).agg(F.max(a).alias("linear"), F.percentile(a, F.lit(robust)).alias("robust"), F.median(a).alias("symlog"), F.min(value).alias("low"), F.max(value).alias("high"))


def deltas_in_one_pass(df: DataFrame, keys: list[str], score: Column | str = "score", control: Column | str = "control", sample: str = "sample", also: list[Column] | None = None) -> DataFrame:
    """Mean score per sample minus the control's, where a row may carry both (null: neither); a neuron without control rows has control 0.

    One aggregation over the contributions, with further sums in ``also``, and one that counts samples by condition: a row per sample with two flags, then their sums.
    Treatment and control are never joined. Neurons and samples are nearly as many as contributions, so that sums before the shuffle would save little and hold what a
    whole split has: contributions are dealt first, over tasks whose number follows theirs up to MOST_TASKS. From there on a task's share grows, which its sums can spill.
    """
    s, c = (F.col(x) if isinstance(x, str) else x for x in (score, control))
    more = also or []
    tasks = min(MOST_TASKS, max(1, -(-df.count() // PER_TASK)))
    sums = df.repartition(tasks, *keys, *NEURON).groupBy(*keys, *NEURON).agg(F.sum(s).alias("t"), F.sum(c).alias("c"), *more)
    known = F.col(sample).isNotNull()
    flagged = df.select(*keys, sample, (s.isNotNull() & known).alias("n"), (c.isNotNull() & known).alias("m")).repartition(tasks, *keys, sample)
    flags = flagged.groupBy(*keys, sample).agg(F.max("n").cast("long").alias("n"), F.max("m").cast("long").alias("m"))
    samples = flags.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    net = F.col("t") / F.col("n") - F.coalesce(F.try_divide("c", "m"), F.lit(0.0))
    rest = [f for f in sums.columns if f not in [*keys, *NEURON, "t", "c"]]
    return sums.where("t is not null").join(F.broadcast(samples), keys).select(*keys, *NEURON, net.alias("delta"), *rest)


def deltas(treated: DataFrame, control: DataFrame, keys: list[str], sample: str = "sample") -> DataFrame:
    """The same for treatment and control in tables of their own, each with a ``score``."""
    side = lambda df, t, c: df.select(*keys, *NEURON, sample, t.cast("double").alias("score"), c.cast("double").alias("control"))
    return deltas_in_one_pass(side(treated, F.col("score"), F.lit(None)).unionByName(side(control, F.lit(None), F.col("score"))), keys, sample=sample)


def reaching(df: DataFrame, keys: list[str], by: str, which: int = 0) -> DataFrame:
    """The neurons, with ``family`` and the ``__wanted`` number of it, whose score is one that somewhat more than the wanted share of their family reaches, by a sketch."""
    fractions = {name: both[which] for name, both in dims.FRACTIONS.items()}
    of = lambda values: F.coalesce(*[F.when(F.col("family") == name, value) for name, value in values.items()])
    x = F.col(by).cast("double")
    place = F.when(x.isNull(), float("-inf")).when(F.isnan(x), float("inf")).otherwise(x)
    ranked = df.withColumn("family", family()).where("family is not null").withColumn("__x", place)
    shares = F.array(*[F.lit(max(0.0, 1 - p - SLACK)) for p in fractions.values()])
    sizes = ranked.groupBy(*keys, "family").agg(F.count("*").alias("__n"), F.percentile_approx("__x", shares, F.lit(ACCURACY)).alias("__q"))
    limits = sizes.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("family").alias("__f"), F.floor(F.col("__n") * of({name: F.lit(p) for name, p in fractions.items()})).alias("__wanted"),
        of({name: F.col("__q")[i] for i, name in enumerate(fractions)}).alias("__least"),
    )
    same = F.col("family") == F.col("__f")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranked.join(F.broadcast(limits), same & (F.col("__x") >= F.col("__least"))).select(*df.columns, "family", "__wanted")  # limits: a row per condition and family


def top_fraction(df: DataFrame, keys: list[str], by: str, which: int = 0) -> DataFrame:
    """The first floor(n * p) neurons of each family by falling score; ties by module, layer, neuron.

    Families are few and neurons many, so no task ranks a family, only what reaches a sketched score. That too few do is an error, not a shorter selection.
    """
    own = Window.partitionBy(*keys, "family")
    reached = reaching(df, keys, by, which).withColumn("__r", F.row_number().over(own.orderBy(F.desc(by), *NEURON))).withColumn("__c", F.count("*").over(own))
    enough = F.when(F.col("__c") < F.col("__wanted"), F.raise_error(F.lit("too few neurons reach the sketch's score"))).otherwise(F.col("__r") <= F.col("__wanted"))
    return reached.where(enough).select(*df.columns, "family")


def exclude(selected: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return selected.join(excluded, [*keys, *NEURON], "left_anti")


def counts_by(df: DataFrame, key: str, condition: str, values: list, rows: list) -> DataFrame:
    """Neurons by key and condition; every listed row is there, and a cell without neurons is null. Rows are a model's modules or layers."""
    counted = df.groupBy(key).pivot(condition, values).agg(F.count(F.lit(1)))
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, rows))).alias(key))
    return every.join(counted, key, "left")


def mean_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def group_attribution(scores: DataFrame, items: DataFrame, by: str, similar: Column, keys: list[str]) -> DataFrame:
    """Mean of means: per item of a country, then over a neuron's countries, then over neurons; one column for each side.

    scores: keys, neuron, country, score (net of control). items: country, n; countries without items are skipped.
    """
    per = scores.join(F.broadcast(items.where("n > 0")), "country").withColumn("a", F.col("score") / F.col("n")).withColumn("__s", similar)
    by_neuron = per.groupBy(*keys, *NEURON).agg(F.avg(F.when(F.col("__s"), F.col("a"))).alias("s"), F.avg(F.when(~F.col("__s"), F.col("a"))).alias("d"))
    return by_neuron.groupBy(*keys, by).agg(F.avg("s").alias("similar"), F.avg("d").alias("distant"))


def asymmetry(profile: DataFrame, condition: str) -> DataFrame:
    """Similar minus distant, and the same over the largest absolute value of its condition (0 where all are 0)."""
    own = profile.withColumn("asymmetry", F.col("similar") - F.col("distant"))
    return own.withColumn("scaled", F.coalesce(F.try_divide(F.col("asymmetry"), F.max(F.abs("asymmetry")).over(Window.partitionBy(condition))), F.lit(0.0)))


def jaccard(sets: DataFrame, name: str, conditions: list, keys: list[str] | None = None) -> DataFrame:
    """Sizes, intersection, union and Jaccard index of all pairs of conditions' neuron sets (0 for two empty ones), in one aggregation over neurons.

    ``conditions`` are a few: pairs are made of their flags, not by joining sets.
    """
    keys = keys or []
    flags = [F.max(F.when(F.col(name) == c, 1).otherwise(0)).alias(f"f{i}") for i, c in enumerate(conditions)]
    member = sets.groupBy(*keys, *[c for c in NEURON if c not in keys]).agg(*flags)
    pairs = [(i, j) for i in range(len(conditions)) for j in range(i + 1, len(conditions))]
    both = [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"b{i}_{j}") for i, j in pairs]
    sums = member.groupBy(*keys).agg(*[F.sum(f"f{i}").alias(f"s{i}") for i in range(len(conditions))], *both)
    rows = F.array(
        *[F.struct(F.lit(conditions[i]).alias("a"), F.lit(conditions[j]).alias("b"), F.coalesce(f"s{i}", F.lit(0)).alias("n_a"), F.coalesce(f"s{j}", F.lit(0)).alias("n_b"), F.coalesce(f"b{i}_{j}", F.lit(0)).alias("n_both")) for i, j in pairs]
    )
    out = sums.select(*keys, F.explode(rows).alias("p")).select(*keys, "p.*").withColumn("n_union", F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return out.withColumn("jaccard", F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.col("n_union").cast("double")), F.lit(0.0)))


def compare_sources(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Neurons only in one source, only in the other, in both."""
    rows = a.select(*keys, *NEURON, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(*keys, *NEURON, F.lit(0).alias("x"), F.lit(1).alias("y")))
    one = rows.groupBy(*keys, *NEURON).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    n = lambda x, y: F.count(F.when((F.col("x") == x) & (F.col("y") == y), 1))
    return one.groupBy(*keys).agg(n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(1, 1).alias("shared"))
