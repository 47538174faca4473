"""Text analysis as columns: tokens are runs of alphanumeric characters, each lower-cased by itself."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """Tokens in order. The text is split before it is lower-cased, which can bring in marks; sigma never takes its final form."""
    parts = F.split(text, SEPARATORS)
    return F.filter(F.transform(parts, lambda t: F.lower(F.translate(t, "Σ", "σ"))), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    """The same for a query's text, on the driver."""
    keep = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Mn", "Mc", "So") and _alphabetic(c) else " " for c in text)
    return ["".join("σ" if c == "Σ" else c.lower() for c in t) for t in keep.split()]


def _alphabetic(c: str) -> bool:
    return bool(re.match(r"[Ⓐ-ⓩ]", c))


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the phrase's tokens follow each other in the array."""
    if not phrase:
        return F.lit(False)
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    want = F.array(*map(F.lit, phrase))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - len(phrase) + 1, F.lit(1))), lambda i: F.get(words, i - 1) == phrase[0])
    return F.array_contains(words, phrase[0]) & F.exists(starts, lambda i: F.slice(words, i, len(phrase)) == want)


def has_all(words: Column, wanted: list[str]) -> Column:
    """Whether every token stands in the array; no token at all never matches. The array is evaluated once."""
    if not wanted:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, dict.fromkeys(wanted))), words)) == 0


def may_hold(text: Column, wanted: list[str]) -> Column:
    """A cheap necessary condition for all tokens to stand in a text, before it is split."""
    low = F.lower(F.translate(text, "Σ", "σ"))
    out = F.lit(True)
    for t in dict.fromkeys(wanted):
        out = out & low.contains(t)
    return out
