"""Scoring of answers from score arrays: argmax, calibration, accuracy at several grains."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ["yes", "no", "neutral"]


def argmax(scores: Column | str, labels: list[str]) -> Column:
    """Label of the largest score, the first on ties; -Infinity is an ordinary low score, null scores give null."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return F.try_element_at(F.array(*map(F.lit, labels)), F.array_position(s, F.array_max(s)).cast("int"))


def binary(yes: Column, no: Column) -> Column:
    """Ties go to no."""
    return F.when(yes > no, "yes").otherwise("no")


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def require_scores(df: DataFrame, column: str = "scores") -> DataFrame:
    """The frame itself; a row without scores or with a NaN among them is an error when it is reached."""
    bad = F.col(column).isNull() | F.exists(column, lambda x: x.isNull() | F.isnan(x))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit("a prediction has no usable scores"))).otherwise(F.col(column)))


def sum_scores(df: DataFrame, keys: list[str], scores: str = "scores", n: int = 3, **first: Column) -> DataFrame:
    """Element-wise sums of the score arrays of all templates of an item."""
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col(scores)[k]) for k in range(n)]).alias(scores), *[F.first(c).alias(k) for k, c in first.items()])


def mean_scores(df: DataFrame, keys: list[str], scores: str = "scores", n: int = 3, name: str = "means") -> DataFrame:
    """Mean score of each label: priors over content-free rows, or the centre of a batch."""
    return df.groupBy(*keys).agg(F.array(*[F.avg(F.col(scores)[k]) for k in range(n)]).alias(name))


def calibrated(df: DataFrame, priors: DataFrame, keys: list[str], scores: str = "scores", priors_column: str = "means") -> DataFrame:
    """Scores minus the priors of their key (one row per condition: small by nature, so Spark's own size check decides on the join)."""
    return df.join(priors, keys).withColumn("raw", F.col(scores)).withColumn(scores, minus("raw", priors_column))


def rollup(df: DataFrame, correct: Column, condition: str, *grains: str) -> DataFrame:
    """Items and accuracy by condition and by condition and each grain, in one pass."""
    sets = [[F.col(condition)]] + [[F.col(condition), F.col(g)] for g in grains]
    return df.withColumn("__c", correct.cast("double")).groupingSets(sets, condition, *grains).agg(F.count("*").alias("n"), F.avg("__c").alias("accuracy"))


#: The model that this worker process holds, by the call that asked for it.
_LOADED: dict[str, object] = {}


def with_model(prompts: DataFrame, build: Callable[[], Callable], prompt: str, column: str, kind: T.DataType, batch: int) -> DataFrame:
    """A column that a model makes of each prompt: built once per worker process, fed with batches of prompts of like length. Null prompts give null."""
    call, kept = uuid.uuid4().hex, [c for c in prompts.columns if c != column]
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.list_(pa.float64())
    schema = prompts.select(*[F.col(f"`{c}`") for c in kept]).schema.add(column, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if call not in _LOADED:
            _LOADED.clear()
            _LOADED[call] = build()
        model = _LOADED[call]
        for rows in batches:
            texts = rows.column(prompt).to_pylist()
            order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts[i]))
            made: list = [None] * len(texts)
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                for i, value in zip(part, model([texts[i] for i in part])):
                    made[i] = value
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array(made, arrow)], [*kept, column])

    return prompts.mapInArrow(run, schema)


def score_with(prompts: DataFrame, build: Callable[[], Callable[[list[str], list[str]], list[list[float]]]], choices: list[str], prompt: str = "prompt", leading_space: bool = True, batch: int = 64) -> DataFrame:
    """``scores``: the log-probability of each choice after the prompt, by an external model; ``build()`` returns (prompts, choices) -> score lists.

    Choices are scored with a space before them unless the prompt ends where the model goes on without one.
    """
    shown = [" " + c if leading_space else c for c in choices]

    def ready() -> Callable:
        model = build()
        return lambda texts: model(texts, shown)

    return with_model(prompts, ready, prompt, "scores", T.ArrayType(T.DoubleType()), batch)


def priors_with(prompts: DataFrame, keys: list[str], build: Callable, choices: list[str], **options) -> DataFrame:
    """keys, means: the scores of content-free prompts, a mean over those of a key, to be subtracted by ``calibrated``."""
    return mean_scores(score_with(prompts, build, choices, **options), keys, n=len(choices))


def answer_with(prompts: DataFrame, build: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", batch: int = 64) -> DataFrame:
    """``answer``: the text that an external model goes on with; ``parse_label`` reads a label from it."""
    return with_model(prompts, build, prompt, "answer", T.StringType(), batch)


class PromptBigrams:
    """A stand-in for a language model: letters follow each other as often as they do in the prompt itself. Deterministic and small, for tests."""

    def __call__(self, prompts: list[str], choices: list[str]) -> list[list[float]]:
        def score(text: str, choice: str) -> float:
            pair = text[-1:] + choice[:1]
            return math.log((text.count(pair) + 1) / (text.count(text[-1:]) + 256)) if text else -math.inf

        return [[score(p, c) for c in choices] for p in prompts]

    def answer(self, prompts: list[str], length: int = 8) -> list[str]:
        def go_on(text: str) -> str:
            whole = text
            for _ in range(length):
                followers = Counter(text[i + 1] for i in range(len(text) - 1) if text[i] == whole[-1:])
                whole += min(followers, key=lambda c: (-followers[c], c)) if followers else " "
            return whole[len(text) :]

        return [go_on(p) for p in prompts]
