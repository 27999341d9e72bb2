"""Long alternations of words, sought together."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_META = re.compile(r"[\\.^$*+?{}\[\]()|]")


def _parts(pattern: str) -> list[str]:
    """The alternatives of a pattern, those inside of brackets left together."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _spelled(part: str) -> list[str] | None:
    """All texts that an alternative of plain characters, optional ones, and groups of such stands for; None for others."""
    texts, i = [""], 0
    while i < len(part):
        if part.startswith("(?:", i):
            end = part.index(")", i)
            inner = [s for p in _parts(part[i + 3 : end]) for s in (_spelled(p) or [None])]
            if None in inner:
                return None
            i = end + 1
        elif part[i] == "[" and (end := part.index("]", i)) and re.fullmatch(r"[- \w]+", part[i + 1 : end]) and not re.search(r"\w-\w", part[i + 1 : end]):
            inner = list(part[i + 1 : end])
            i = end + 1
        elif _META.match(part[i]):
            return None
        else:
            inner = [part[i]]
            i += 1
        if part[i : i + 1] == "?":
            inner = [*inner, ""]
            i += 1
        texts = [t + s for t in texts for s in inner]
    return texts


def says(text: Column, pattern: str) -> Column:
    """Whether a case-insensitive pattern ``(?i)a|b|...`` without look-arounds occurs in the text; null texts give null.

    All alternatives are sought together in one walk of the text, by RE2, in
    which a word boundary is one of ASCII words.
    """
    if not pattern.startswith("(?i)"):
        raise ValueError("the pattern has to begin with (?i)")

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return found(text)
