"""Text expressions. All are native columns; patterns with ``\\s`` or ``\\b`` are Unicode-aware, as Python's are."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

MARKER = "\n\nAssistant:"
#: Letters that Unicode's full mapping makes into several, with their single capitals or title forms; those that have none stay.
CAPITALS = {c: "\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x20000)) if len(c.upper()) > 1}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space of any kind off both ends (Spark's trim takes only U+0020)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def norm(c: Column | str) -> Column:
    """Runs of Unicode white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def mapped(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A literal lookup table as one map expression."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def first_truthy(*columns: Column | str) -> Column:
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns])


def split_transcript(chosen: Column | str, rejected: Column | str) -> Column:
    """(prompt, chosen, rejected) at the last marker of each side; the prompt is the chosen side's. All empty if a marker is missing."""
    c, r = col(chosen), col(rejected)
    tail_c, tail_r = F.substring_index(c, MARKER, -1), F.substring_index(r, MARKER, -1)
    both = F.contains(c, F.lit(MARKER)) & F.contains(r, F.lit(MARKER))
    empty = F.lit("")
    return F.struct(
        F.when(both, F.substr(c, F.lit(1), F.length(c) - F.length(tail_c))).otherwise(empty).alias("prompt"),
        F.when(both, tail_c).otherwise(empty).alias("chosen"),
        F.when(both, tail_r).otherwise(empty).alias("rejected"),
    )


def render_turns(turns: Column | str, speaker: str = "from", value: str = "value") -> Column:
    """Human and assistant turns in order, unknown speakers dropped, an open assistant turn at the end; null turns are none."""

    def one(t: Column) -> Column:
        text = F.coalesce(t[value], F.lit(""))
        return F.when(t[speaker] == "human", F.concat(F.lit("\n\nHuman: "), text)).when(t[speaker].isin("gpt", "assistant"), F.concat(F.lit("\n\nAssistant: "), text))

    return F.concat(F.coalesce(F.array_join(F.transform(col(turns), one), ""), F.lit("")), F.lit(MARKER))


def orient(better: Column | str, first: Column | str, second: Column | str) -> Column:
    """(chosen, rejected) by the id of the better response; any other id gives empty strings."""
    b, x, y = col(better), col(first), col(second)
    return F.struct(F.when(b == 0, x).when(b == 1, y).otherwise("").alias("chosen"), F.when(b == 0, y).when(b == 1, x).otherwise("").alias("rejected"))


def last_content(turns: Column | str, field: str = "content") -> Column:
    return F.try_element_at(col(turns), F.lit(-1))[field]


def instruct(instruction: Column | str, given: Column | str, output: Column | str) -> Column:
    """Instruction, input if there is one, and output, with blank lines between."""
    return F.concat_ws("\n\n", F.coalesce(col(instruction), F.lit("")), F.nullif(col(given), F.lit("")), F.coalesce(col(output), F.lit("")))


def before_blank_line(c: Column | str) -> Column:
    return F.substring_index(col(c), "\n\n", 1)


def gold_label(*columns: Column | str) -> Column:
    """The first column with a usable label, as yes, no or neutral; null if none has."""
    return F.coalesce(*[F.coalesce(*[F.when(F.lower(strip(c)).isin(words), F.lit(label)) for label, words in dims.GOLD_SYNONYMS.items()]) for c in columns])


def country(*columns: Column | str) -> Column:
    """Canonical form of the first non-empty country column; the raw value if unknown, 'Unknown' if there is none."""
    raw = strip(first_truthy(*columns))
    return F.coalesce(mapped(F.lower(raw), dims.CANONICAL, raw), F.lit("Unknown"))


def country_short(*columns: Column | str) -> Column:
    """The null baseline's form: the first column that exists (not null), with its own short table, '' if none."""
    raw = strip(F.coalesce(*map(col, columns)))
    return F.coalesce(mapped(F.lower(raw), dims.CANONICAL_SHORT, raw), F.lit(""))


def scenario(*columns: Column | str) -> Column:
    return F.coalesce(strip(first_truthy(*columns)), F.lit(""))


def fill(template: str, **slots: Column) -> Column:
    """A template with {name} slots; slots are filled at once, so braces in a value are left alone."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(slots[p].cast("string"), F.lit("")) for i, p in enumerate(parts) if i % 2 or p])


def story_prompt(kind: str, land: Column | str, text: Column | str) -> Column:
    return fill(dims.PROMPTS[kind], country=col(land), scenario=col(text))


def rephrased_prompts(land: Column | str, text: Column | str) -> Column:
    return F.array(*[fill(t, country=col(land), scenario=col(text)) for t in dims.REPHRASED])


def nlu_prompt(dataset: str, choices: Column | None = None, **slots: Column) -> Column:
    """A reading-task prompt; ``choices`` is a struct of label and text arrays that is spread over its letters."""
    if choices is not None:
        by = F.map_from_arrays(choices["label"], choices["text"])
        slots |= {k: F.try_element_at(by, F.lit(k)) for k in "ABCDE"}
    return fill(dims.NLU_PROMPTS[dataset], **slots)


def nlu_gold(dataset: str, answer: Column) -> Column:
    if dataset == "boolq":
        return F.when(answer, "yes").otherwise("no")
    if dataset == "csqa":
        return answer
    return F.when(answer == {"qnli": 0, "mrpc": 1}[dataset], "yes").otherwise("no")


def shots(pairs: Column | str) -> Column:
    """Array of (prompt, answer) to a few-shot prefix, in array order."""
    return F.array_join(F.transform(col(pairs), lambda p: F.concat(p["prompt"], F.lit(" "), p["answer"], F.lit("\n\n"))), "")


def json_shots(pairs: Column | str, lead: Column | None = None) -> Column:
    """Array of (prompt, answer) to a prefix whose answers are JSON left open before the letter and closed after it; with ``lead`` in front of each prompt."""
    before = F.lit("") if lead is None else lead
    return F.array_join(F.transform(col(pairs), lambda p: F.concat(before, p["prompt"], F.lit(dims.JSON_OPEN), p["answer"], F.lit(dims.JSON_CLOSE))), "")


def json_prompt(prefix: Column, question: Column | str) -> Column:
    """The question after its shots, with the answer's JSON left open where the letter is scored."""
    return F.concat(prefix, col(question), F.lit(dims.JSON_OPEN))


def chat(prefix: Column, question: Column | str) -> Column:
    """Alternating user and assistant turns of the shots, then the question."""
    turns = F.flatten(F.transform(prefix, lambda p: F.array(F.struct(F.lit("user").alias("role"), p["prompt"].alias("content")), F.struct(F.lit("assistant").alias("role"), p["answer"].alias("content")))))
    return F.concat(turns, F.array(F.struct(F.lit("user").alias("role"), col(question).alias("content"))))


def parse_label(c: Column | str) -> Column:
    """Label named in free text: neutral or neither first, then yes, then no, as whole words; else 'unparseable'."""
    t = F.lower(col(c))
    return F.when(t.rlike(r"(?U)\b(neutral|neither)\b"), "neutral").when(t.rlike(r"(?U)\byes\b"), "yes").when(t.rlike(r"(?U)\bno\b"), "no").otherwise("unparseable")


def as_if_us(prompt: Column | str, land: Column | str) -> Column:
    """The prompt with its country replaced by US; a name with underscores is tried with spaces if it does not occur."""
    p, c = col(prompt), col(land)
    done = F.replace(p, c, F.lit("US"))
    return F.when((done == p) & F.contains(c, F.lit("_")), F.replace(p, F.replace(c, F.lit("_"), F.lit(" ")), F.lit("US"))).otherwise(done)


def alternatives(names: list[str]) -> str:
    return "|".join(re.escape(x).replace(r"\ ", " ") for x in sorted(set(names), key=lambda x: (-len(x), x)))


def capital(letter: Column) -> Column:
    """A letter to its one capital, as SQL engines map letters one by one; Spark's upper makes two of some (SS of a sharp s)."""
    return mapped(letter, CAPITALS, F.upper(letter))


def strip_mentions(c: Column | str) -> Column:
    """Country and people's names off a story: three forms at its start, then three anywhere; spaces closed up, first letter raised."""
    land, people = alternatives(dims.COUNTRY_NAMES), alternatives(dims.DEMONYM_NAMES)
    # The six patterns, in the order in which they apply.
    out = F.coalesce(col(c), F.lit(""))
    for pattern in (rf"^\s*In\s+(?:the\s+)?(?:{land})\s*,\s*", rf"^\s*In\s+(?:a|an|the)?\s*(?:{people})\s+", rf"^\s*Among\s+(?:{people})s?\s*,\s*", rf"\bin\s+(?:the\s+)?(?:{land})\b", rf"\b(?:{people})\b", rf"\bfrom\s+(?:{land})\b"):
        out = F.regexp_replace(out, "(?iuU)" + pattern, "")
    out = strip(F.regexp_replace(out, r"(?U)\s{2,}", " "))
    return F.concat(capital(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))


def distinct_ignoring_case(items: Column | str) -> Column:
    """The first spelling of each item, in order; nulls and empties dropped."""
    clean = F.filter(col(items), lambda x: x.isNotNull() & (x != ""))
    lowered = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def neuron_key(key: Column | str) -> Column:
    """module_layer_index split from the right: module names hold underscores."""
    pattern = r"^(.*)_(\d+)_(\d+)$"
    part = lambda i: F.regexp_extract(col(key), pattern, i)
    return F.struct(part(1).alias("module_name"), part(2).cast("int").alias("layer_idx"), part(3).cast("int").alias("neuron_idx"))


def hashed(seed: str, *key: Column | str) -> Column:
    """The md5 by which samples and shuffles are ordered."""
    return F.md5(F.concat_ws("_", F.lit(seed), *[col(k).cast("string") for k in key]).cast("binary"))


def hash_number(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def option_order(seed: str, *key: Column | str) -> Column:
    """Whether the two options of an item swap places: a fair, fixed choice by the item's hash."""
    return hash_number(hashed(seed, *key)) % 2 == 1


def permutation(n: int, seed: str, *key: Column | str) -> Column:
    """The numbers 1 to ``n`` (at most 6) in one of their n! orders, picked by the item's hash: every order is as likely, and an item's stays the same."""
    orders = list(itertools.permutations(range(1, n + 1)))
    if not 1 <= n <= 6:
        raise ValueError("1 to 6 options")
    return F.element_at(F.array(*[F.array(*map(F.lit, o)) for o in orders]), (hash_number(hashed(seed, *key)) % len(orders) + 1).cast("int"))


def numbered_options(labels: list[str], numbers: Column) -> Column:
    """``1: no, 2: yes`` for labels that have these numbers, by number."""
    pairs = F.array_sort(F.arrays_zip(numbers.alias("k"), F.array(*map(F.lit, labels)).alias("v")))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"].cast("string"), F.lit(": "), p["v"])), ", ")


def option_number(labels: list[str], numbers: Column, gold: Column | str) -> Column:
    """The number under which the gold label stands; null for a label that is none of them."""
    return F.try_element_at(numbers, F.nullif(F.array_position(F.array(*map(F.lit, labels)), col(gold)), F.lit(0)).cast("int"))


def preview(c: Column | str, limit: int = 120) -> Column:
    short = F.replace(F.substring(col(c), 1, limit), F.lit("\n"), F.lit(" "))
    return F.when(F.length(col(c)) > limit, F.concat(short, F.lit("..."))).otherwise(short)
