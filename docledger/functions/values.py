"""Printed dates, numbers and product descriptions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import plain_punctuation, strip

# Printed patterns.
DATE_NUMERIC = r"(?<![\p{Nd}])(\p{Nd}{1,4})[./-](\p{Nd}{1,2})[./-](\p{Nd}{1,4})(?![\p{Nd}])"
DATE_WORDS = r"(?iuU)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
STRENGTH = r"(?iuU)(?<!\w)(\d+(?:[.,]\d+)?\s*(?:mg|g|mcg|µg|ml|%|IU|UI)(?:\s*/\s*\d+\s*ml)?)"
COUNTRY = r"(?iuU)(?:NSX|nước\s+sản\s+xuất|xuất\s+xứ)\s*:\s*([^;,|]+)"
MANUFACTURER = r"(?iuU)(?:nhà\s+sản\s+xuất|manufacturer)\s*:\s*([^;,|]+)"
NUMBER_TYPE = "decimal(38,10)"


def parse_date(text: Column) -> Column:
    """A DATE when the text prints one unambiguous date, else null."""
    words = [F.regexp_extract(text, DATE_WORDS, i) for i in (1, 2, 3)]
    parts = [F.regexp_extract(text, DATE_NUMERIC, i) for i in (1, 2, 3)]
    first, middle, last = parts

    def day_of(year: Column, month: Column, day: Column) -> Column:
        joined = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return F.to_date(F.try_to_timestamp(joined, F.lit("yyyy-MM-dd")))

    return (
        F.when(words[2] != "", day_of(words[2], words[1], words[0]))
        .when(F.length(first) == 4, day_of(first, middle, last))
        .when(F.length(last) == 4, day_of(last, middle, first))
    )


def normalize_date(text: Column) -> Column:
    """ISO text of :func:`parse_date`."""
    return F.date_format(parse_date(text), "yyyy-MM-dd")


def compatible_date(text: Column) -> Column:
    """Same, after ASCII punctuation."""
    return normalize_date(plain_punctuation(text))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times; keeps nested parsers from multiplying their inputs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(kept: Column) -> Column:
    """Plain decimal text of a text reduced to digits, separators and signs; null if it is no number."""
    sign = F.when(kept.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    unsigned = F.regexp_replace(kept, r"^[+-]", "")
    usable = unsigned.rlike(r"^[0-9.,]*[0-9][0-9.,]*$")
    return F.when(usable, F.concat(sign, bind(unsigned, _plain_digits)))


def _plain_digits(body: Column) -> Column:
    """Digits with at most one decimal point, or null where the grouping is impossible."""
    # one separator kind, every later group of three digits: grouping; a single short group: decimals
    one_kind = ~(body.contains(".") & body.contains(","))
    grouped = body.rlike(r"^[0-9]+([.,][0-9]{3})+$") | body.rlike(r"^[0-9]*([.,][0-9]{3}){2,}$")
    repeated = body.rlike(r"[.,][0-9]*[.,]")
    # both kinds: the later one is the decimal mark
    dot_last = body.rlike(r"\.[^.,]*$")
    mixed = F.when(dot_last, F.translate(body, ",", "")).otherwise(F.translate(F.translate(body, ".", ""), ",", "."))
    return (
        F.when(~one_kind, mixed).when(grouped, F.translate(body, ".,", ""))
        .when(~repeated, F.translate(body, ",", "."))
    )


def parse_number(text: Column) -> Column:
    """Printed Vietnamese or English number as a decimal, never guessed; null beyond the decimal's range.

    For comparing numbers of any length use :func:`number_text`.
    """
    return bind(F.regexp_replace(text, r"[^0-9,.\-+]", ""), _digits).try_cast(NUMBER_TYPE)


def number_text(text: Column) -> Column:
    """Canonical text of a printed number of any length: equal numbers have equal texts.

    No leading zeros, no trailing zeros of a fraction, no sign on zero.
    """
    def canonical(plain: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(plain, r"^(-?)0+(?=[0-9])", "$1"), r"^(-?)(?=\.)", "$10")
        short = F.regexp_replace(F.regexp_replace(bare, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return F.when(plain.rlike(r"^-?[0-9]*\.?[0-9]*$"), F.when(short == "-0", "0").otherwise(short))

    return bind(bind(F.regexp_replace(text, r"[^0-9,.\-+]", ""), _digits), canonical)


def parse_money(text: Column) -> Column:
    return bind(parse_number(text), lambda amount: F.when(amount >= 0, amount))


def describe_product(text: Column) -> dict[str, Column]:
    """Name, strength, manufacturer and country that a printed description states."""
    described = strip(text)
    country = F.regexp_substr(described, F.lit(COUNTRY))
    maker = F.regexp_substr(described, F.lit(MANUFACTURER))
    strength = F.regexp_substr(described, F.lit(STRENGTH))
    cuts = [
        F.when(found.isNotNull(), F.regexp_instr(described, F.lit(pattern)))
        for found, pattern in ((country, COUNTRY), (maker, MANUFACTURER))
    ]
    tail = F.coalesce(F.least(*cuts), F.length(described) + 1)
    strength_at = F.when(strength.isNotNull(), F.regexp_instr(described, F.lit(STRENGTH)))
    cut = F.least(tail, strength_at)
    name = F.btrim(F.substring(described, F.lit(1), (cut - 1).cast("int")), F.lit(" ,;-"))

    def taken(pattern: str) -> Column:
        return F.nullif(strip(F.regexp_extract(described, pattern, 1)), F.lit(""))

    return {
        "medicine_name": F.nullif(name, F.lit("")),
        "strength": taken(STRENGTH),
        "manufacturer": taken(MANUFACTURER),
        "country_of_manufacture": taken(COUNTRY),
    }
