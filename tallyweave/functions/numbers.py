"""Numbers in text: separators, first number, prices and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits, let, unify_letters

# The pattern of a number, and the signs that may part thousands.
NUMBER = "[0-9]{1,3}(?:[.,\u066c\u066b\u060c\\s][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?"
SEPARATORS = "\u066c\u066b\u060c"


def clean_number(raw: Column) -> Column:
    """The text of a number with a decimal point at most: with both signs commas go; a lone kind of sign parts thousands
    if every group after it has three digits (or, for points, if there are two of them)."""
    return let(F.translate(F.regexp_replace(raw, r"\s", ""), SEPARATORS, "," * len(SEPARATORS)), _plain)


def _plain(raw: Column) -> Column:
    tail = lambda sign: F.slice(F.split(raw, sign), 2, 1000)
    threes = lambda sign: F.forall(tail(sign), lambda p: F.length(p) == 3)
    comma, point = raw.contains(","), raw.contains(".")
    return (
        F.when(comma & point, F.replace(raw, F.lit(","), F.lit("")))
        .when(comma, F.when(threes(","), F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.replace(raw, F.lit(","), F.lit("."))))
        .when(point & ((F.size(F.split(raw, r"\.")) > 2) | threes(r"\.")), F.replace(raw, F.lit("."), F.lit("")))
        .otherwise(raw)
    )


def _folded(col: Column) -> Column:
    return ascii_digits(unify_letters(col.cast("string")))


def parse_number(col: Column) -> Column:
    """The first number of a text as double, or null. Signs are lost, as in the text '-5'."""
    return F.nullif(clean_number(F.regexp_extract(_folded(col), NUMBER, 0)), F.lit("")).try_cast("double")


def find_numbers(col: Column) -> Column:
    """All numbers of a text in order."""
    return F.transform(F.regexp_extract_all(_folded(col), F.lit(NUMBER), F.lit(0)), lambda n: clean_number(n).try_cast("double"))


def parse_price(col: Column, low: float = 0.0, high: float = float("inf")) -> Column:
    number = parse_number(col)
    return F.when(number.between(low, high), number)


parse_stock = parse_number


def format_price(value: Column) -> Column:
    return F.when(value.isNull(), "-").when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
