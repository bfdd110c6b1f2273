"""Named conditions, model sizes and datasets, as small tables that follow rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from .io import latest_checkpoint

#: Epochs by last training stage, preference data by suffix, choices by reading task.
EPOCHS = {"sft": 3, "dpo": 2}
PREFERENCES = ["", "_coig", "_pku"]
SPLITS = ["cult", "nocult"]
MERGED = {"tulu3_sft": "allenai/Llama-3.1-Tulu-3-8B-SFT", "tulu3_dpo": "allenai/Llama-3.1-Tulu-3-8B-DPO"}
TASKS = {
    "boolq": ("google/boolq", None, ["yes", "no"]),
    "csqa": ("tau/commonsense_qa", None, ["A", "B", "C", "D", "E"]),
    "qnli": ("nyu-mll/glue", "qnli", ["yes", "no"]),
    "mrpc": ("nyu-mll/glue", "mrpc", ["yes", "no"]),
}


@dataclass(frozen=True)
class Condition:
    """A model to evaluate: base weights (None: those of the size), adapter folder, adapter merged before it, last epoch."""

    name: str
    base: str | None
    adapter: str | None = None
    before: str | None = None
    epoch: int | None = None


def conditions(size: str = "3b") -> dict[str, Condition]:
    """All conditions of a model size; folder names are below the checkpoints' root."""
    suffix = "" if size == "3b" else f"_{size}"
    out = {"base": Condition("base", None), "sft": Condition("sft", None, f"sft{suffix}", None, EPOCHS["sft"])}
    for p in PREFERENCES:
        out[f"dpo{p}"] = Condition(f"dpo{p}", None, f"dpo{p}{suffix}", None, EPOCHS["dpo"])
        out[f"sftdpo{p}"] = Condition(f"sftdpo{p}", None, f"sftdpo{p}{suffix}", f"sft{suffix}", EPOCHS["dpo"])
    out |= {n: Condition(n, b) for n, b in MERGED.items()}
    mark = "gemma4" if size == "gemma4" else "8b"
    for s in SPLITS:
        out[f"dpo_{s}"] = Condition(f"dpo_{s}", None, f"dpo_{s}_8b", None, EPOCHS["dpo"])
        out[f"sft_aya_{s}"] = Condition(f"sft_aya_{s}", None, f"sft_aya_{s}_{mark}", None, EPOCHS["sft"])
        out[f"sftdpo_aya_{s}"] = Condition(f"sftdpo_aya_{s}", None, f"sftdpo_aya_{s}_{mark}", f"sft_aya_{s}_{mark}", EPOCHS["dpo"])
    return out


def resolve(spark: SparkSession, name: str, root: str, size: str = "3b") -> Condition:
    """A condition with its folders replaced by their latest checkpoints (the folder itself where there is none)."""
    try:
        c = conditions(size)[name]
    except KeyError:
        raise ValueError(f"unknown condition {name}") from None
    latest = lambda d: d and latest_checkpoint(spark, f"{root.rstrip('/')}/{d}", fallback=True)
    return Condition(c.name, c.base, latest(c.adapter), latest(c.before), c.epoch)


def condition_table(spark: SparkSession, size: str = "3b") -> DataFrame:
    return spark.createDataFrame([(c.name, c.base, c.adapter, c.before, c.epoch) for c in conditions(size).values()], "cond string, base string, adapter string, before string, epoch int")


def comparison_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dims.COMPARISONS, "before string, after string")


#: Parts of the names of preference datasets, and how each kind is read.
PAIR_LOADERS = (("COIG-P", "turns"), ("PKU-SafeRLHF", "oriented"), ("hh-rlhf", "transcripts"))


def pair_loader(dataset: str) -> str:
    """Which loader reads a preference dataset, by a part of its name."""
    for part, kind in PAIR_LOADERS:
        if part.lower() in dataset.lower():
            return kind
    return "transcripts"


def pair_loader_column(dataset: Column | str) -> Column:
    """The same for a column of dataset names."""
    name = F.lower(dataset)
    return F.coalesce(*[F.when(F.contains(name, F.lit(part.lower())), kind) for part, kind in PAIR_LOADERS], F.lit("transcripts"))
