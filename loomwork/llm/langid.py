"""Language identification by compression: the language whose zstandard raw-content dictionaries encode a text shortest wins.

Training takes at most ``SETS * SET_DOCS`` labelled documents per language, whole (those with the least hash of their id); this bound on rows is the documented
parameter of the model. They make ``SETS`` dictionaries per language. Prediction encodes whole texts, folded to lower-case letters, in blocks of ``BLOCK`` bytes
that each start from a dictionary, so that a long text is judged as sharply as a short one; the sizes over all dictionaries of a language are added.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns

BLOCK = 4096
LEVEL = 6
SETS = 2
SET_DOCS = 40
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")

Model = dict[str, list[bytes]]


def fold(text: str) -> str:
    """Lower-case letters, all else as single spaces, one at either end."""
    return f" {OTHER.sub(' ', text.lower()).strip()} "


def in_training(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is not 1; a null id is not in training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def train(labelled: DataFrame) -> Model:
    """Dictionaries by language from ``(doc_id, text, lang)``; null languages and texts without letters teach nothing.

    At most SETS * SET_DOCS texts per language come to the driver. Only ids are ranked, so no text is sorted.
    """
    usable = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Ranked in two steps, so that one task of a language sees some rows of each of 256 groups of tasks, not of every task.
    rows = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("hash")).withColumn("group", F.spark_partition_id() % 256)
    for keys in (["lang", "group"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))).where(F.col("rank") <= SETS * SET_DOCS)
    chosen = rows.select("lang", "doc_id", "rank")
    picked = usable.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    # Languages in order of their documents: equal encodings go to the more frequent one.
    order = [r["lang"] for r in labelled.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    texts: dict[str, list[str]] = {}
    for row in picked.orderBy("lang", "rank").collect():
        texts.setdefault(row["lang"], []).append(fold(row["text"]))
    return {lang: ["".join(own[k::SETS]).encode() or "".join(own).encode() for k in range(SETS)] for lang in order if (own := texts.get(lang))}


def scorer(model: Model) -> Callable[[str | None], tuple[str, float]]:
    """A function from a text to its language and margin, 0 to 1."""
    langs = list(model)
    packers = []
    for lang in langs:
        packers.append([])
        for content in model[lang]:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            packers[-1].append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def score(text: str | None) -> tuple[str, float]:
        if not text or not langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(langs) == 1:
            return langs[0], 1.0
        raw = fold(text).encode()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(shrink(b)) for shrink in own for b in blocks) for own in packers]
        (least, best), (second, _) = sorted((s, i) for i, s in enumerate(sizes))[:2]
        margin = (second - least) / second
        return langs[best], margin

    return score


def classify(docs: DataFrame, model: Model, text: str = "text", min_margin: float = 0.01, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (the margin) and ``lang_rejected`` (margin under ``min_margin``, or no letters).

    Texts that are null or have no letter get ``und``, score 0 and are rejected; so does everything if nothing was learned.
    """
    made: list[Callable] = []  # of a task: its copy of the kernel fills it at the first batch

    def kernel(texts: list) -> list:
        if not made:
            made.append(scorer(model))
        found = [made[0](t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found], [f[0] == UNKNOWN or f[1] < min_margin for f in found]]

    return append_columns(docs, kernel, [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("lang_rejected", "boolean", pa.bool_())], text, keep)


def train_on(docs: DataFrame) -> Model:
    return train(docs.where(in_training(F.col("doc_id"))))


def digest(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return classify(docs.select("doc_id", "text"), train_on(docs), keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_rejected")
