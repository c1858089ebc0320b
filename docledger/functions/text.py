"""Text normal forms as column expressions.

Everything is JVM-side except :func:`compose`, the compatibility composition (NFKC), which no
built-in expresses: it is an Arrow UDF that callers apply once per distinct source value, and only
on columns that may hold non-ASCII text.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Printed punctuation mapped to ASCII.
PUNCTUATION = {
    "\u00a0": " ", "“": '"', "”": '"', "„": '"', "’": "'", "‘": "'",
    "–": "-", "—": "-", "−": "-", "：": ":", "，": ",", "．": ".",
    "／": "/",
}
ELLIPSIS = "…"
SEPARATORS = r"(?U)[\s:;|,_]+"
NOT_IDENTIFIER = "[^0-9a-zA-ZÀ-ỹ]+"
EDGE = " .-'\""


@functools.cache
def _accent_table() -> tuple[str, str]:
    """Precomposed letters -> base letter, derived from the decompositions of all code points."""
    plain = {"đ": "d"}
    for code in range(0xC0, sys.maxunicode + 1):
        letter = chr(code)
        parts = unicodedata.normalize("NFKD" if code < 0x2000 else "NFD", letter)
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if base != letter and len(base) == 1:
            plain[letter] = base
    return "".join(plain), "".join(plain.values())


# Ranges of letters and marks in common use: composition changes none of them, and the case fold of none
# but sharp s is more than its lower case.
COMMON = r"\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{1EA0}-\x{1EF9}\x{2013}-\x{2014}\x{2018}-\x{201E}\x{400}-\x{45F}"
#: A character out of ASCII and out of those ranges; ASCII is passed over by the first class alone.
UNCOMMON = rf"[^\x00-\x7F](?<![{COMMON}])"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def compose(text: Column) -> Column:
    """NFKC; rows without a character it could change cross to Python as nulls and come back from the JVM side."""
    foreign = text.rlike(UNCOMMON)
    return F.when(foreign, _nfkc(F.when(foreign, text))).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case letters whose full case fold differs: those that stay one letter, and those that grow."""
    one: dict[str, str] = {}
    more: dict[str, str] = {}
    for letter in map(chr, range(0x80, sys.maxunicode + 1)):
        fold = letter.casefold()
        if fold != letter and letter.lower() == letter:
            (one if len(fold) == 1 else more)[letter] = fold
    return one, more


def _fold_common(text: Column) -> Column:
    """Case fold of texts of common characters alone."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _fold_any(text: Column) -> Column:
    """Full case folding letter by letter: lower case, then the folds that lower case alone leaves out."""
    one, more = _folds()
    swapped = F.translate(F.lower(text), "".join(one), "".join(one.values()))
    grown = F.create_map(*(F.lit(c) for pair in more.items() for c in pair))
    return F.array_join(F.transform(F.split(swapped, ""), lambda c: F.coalesce(F.try_element_at(grown, c), c)), "")


def casefold(text: Column) -> Column:
    """Full case folding; only texts with an uncommon character are folded letter by letter."""
    return F.when(text.rlike(UNCOMMON), _fold_any(text)).otherwise(_fold_common(text))


def plain_punctuation(text: Column) -> Column:
    return F.replace(
        F.translate(text, "".join(PUNCTUATION), "".join(PUNCTUATION.values())),
        F.lit(ELLIPSIS), F.lit("..."),
    )


def separated(text: Column) -> Column:
    """A composed text as :func:`normalize_text` has it, but only spaces are taken from its ends.

    Such forms of several texts joined by spaces, the empty ones left out, and then trimmed by ``EDGE`` are the
    normal form of the texts joined by spaces.
    """
    return normalize_text(text, composed=True, edge=" ")


def normalize_text(text: Column, *, composed: bool = False, edge: str = EDGE) -> Column:
    """Comparable text: composed, ASCII punctuation, folded case, single spaces, bare ends.

    Texts of common characters need no composition and take the short way.
    """
    def finish(folded: Column) -> Column:
        return F.btrim(F.regexp_replace(folded, SEPARATORS, " "), F.lit(edge))

    foreign = text.rlike(UNCOMMON)
    source = text if composed else _nfkc(F.when(foreign, text))
    # composing may yield common characters only, so the long way folds whatever it gets
    return F.when(foreign, finish(_fold_any(plain_punctuation(source)))).otherwise(finish(_fold_common(plain_punctuation(text))))


def fold_accents(normalized: Column) -> Column:
    """Base letters of an already normalised text."""
    return F.regexp_replace(F.translate(normalized, *_accent_table()), r"\p{M}+", "")


def fold_text(text: Column, *, composed: bool = False) -> Column:
    return fold_accents(normalize_text(text, composed=composed))


def normalize_identifier(text: Column, *, composed: bool = False) -> Column:
    return F.regexp_replace(normalize_text(text, composed=composed), NOT_IDENTIFIER, "")


def normalize_scalar(text: Column) -> Column:
    """Case- and whitespace-insensitive form of a string value."""
    return collapse(casefold(text))
