"""Line-first cleaning: rules judge every line, failing lines go, documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Phrases of lines that are page furniture, not text, in four languages; the other rules need no language.
BOILERPLATE = re.compile(
    r"(?i)all rights reserved|cookie policy|accept (?:all )?cookies|terms of (?:use|service)|privacy policy|click here|sign up|log ?in\b|subscribe (?:now|to)|"
    r"share (?:this|on)|read more|skip to content|back to top|enable javascript|powered by|lorem ipsum|"
    r"tous droits réservés|politique de confidentialité|accepter (?:tous )?les cookies|mentions légales|cliquez ici|lire la suite|"
    r"alle rechte vorbehalten|datenschutzerklärung|impressum|cookies akzeptieren|hier klicken|weiterlesen|"
    r"todos los derechos reservados|política de (?:privacidad|cookies)|aceptar (?:todas las )?cookies|aviso legal|haga clic aquí|leer más"
)
LOUD = re.compile(r"[!?]{2,}$")
HEAVY = re.compile(r"[#*$%&|<>@^~={}\\]{2,}")
LINK = re.compile(r"^(?:[a-z]+://|www\.)")
#: What ends a sentence, and marks that set the entries of a menu apart.
ENDS = (".", "!", "?", "…", ":", ";", ",", '"', "'", "”", "»", ")", "。", "！", "？", "؟", "।")
BARS = ("|", "»", ">", "·", "•", "/")
SHORT = 3


def line_fails(line: str, words: list[str]) -> str | None:
    """The name of the first rule that a line with words breaks, or None."""
    n = len(words)
    bars = sum(w in BARS for w in words)
    if bars >= 3 and bars * 5 >= n:
        return "navigation"
    if 2 * sum(len(w) for w in words if LINK.search(w)) > sum(map(len, words)):
        return "navigation"  # most of it is links
    odd = sum(bool(LOUD.search(w)) or bool(HEAVY.search(w)) for w in words)
    if odd >= 2 and odd * 4 >= n:
        return "punctuation"
    if not any(c.isalpha() for c in line):
        return "punctuation"
    if n <= SHORT and not words[-1].endswith(ENDS):
        return "punctuation"  # a short line that ends no sentence: a label, an entry of a menu
    if n >= 8 and 2 * max(Counter(words).values()) > n:
        return "repetition"
    if n <= 30 and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def measure(text: str | None, max_lost: float = 0.5) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean text, failed lines."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            until = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, until)
                    until = i + 3
    lines, seen, dup, kept, lost, failed = text.split("\n"), set(), 0, [], 0, 0
    for line in lines:
        inside = WORD.findall(line)
        if not inside:
            kept.append(line)
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, inside):
            lost += sum(map(len, inside))
            failed += 1
        else:
            kept.append(line)
    base_failed = n < 50 or 100 * repeat > 50 * n
    good = not base_failed and lost <= max_lost * chars
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, base_failed, good, "\n".join(kept), failed


def clean_lines(docs: DataFrame, text: str = "text", cleaned: str | None = None, max_lost: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Add the measures, the verdict ``kept`` and, where a name is given, the text without its failing lines.

    A document is rejected if it fails the base rules (under 50 words, or over half of them in repeated 3-word windows) or
    if failing lines hold more than ``max_lost`` of its word characters. A null text is an empty one: no words, base_failed.
    """

    def kernel(texts: list) -> list:
        rows = [measure(t, max_lost) for t in texts]
        columns = [list(c) for c in zip(*rows)] or [[] for _ in range(9)]
        return columns[:7] + [columns[8]] + ([columns[7]] if cleaned else [])

    long = [(c, "bigint", pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    flags = [(c, "boolean", pa.bool_()) for c in ("base_failed", "kept")]
    last = [("n_failed_lines", "bigint", pa.int64())] + ([(cleaned, "string", pa.string())] if cleaned else [])
    return append_columns(docs, kernel, long + flags + last, text, keep)


def digest(docs: DataFrame) -> DataFrame:
    return clean_lines(docs.select("doc_id", "text"), keep=["doc_id"])
