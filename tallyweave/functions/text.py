"""Text normalisation as column expressions; one Arrow UDF folds presentation forms (NFKC)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V

DIGITS = "".join(chr(0x06F0 + i) for i in range(10)) + "".join(chr(0x0660 + i) for i in range(10))
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


def _translate(col: Column, table: dict[str, str]) -> Column:
    """One-to-one maps first in the source string, characters to drop last, as translate() wants it."""
    kept = {k: v for k, v in table.items() if v}
    gone = [k for k, v in table.items() if not v]
    return F.translate(col, "".join([*kept, *gone]), "".join(kept.values()))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fix_glyphs(col: Column) -> Column:
    return _translate(F.coalesce(col, F.lit("")), V.GLYPHS)


def plain_shapes(col: Column) -> Column:
    """Repaired glyphs, then compatibility forms folded."""
    return _nfkc(fix_glyphs(col))


def unify_letters(col: Column) -> Column:
    """Look-alike letters to one form; tatweel, zero-width characters and diacritics go; known respellings."""
    text = F.regexp_replace(_translate(fix_glyphs(col), V.LETTERS), V.MARKS, "")
    for old, new in V.SPELLINGS.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def ascii_digits(col: Column) -> Column:
    return F.translate(col, DIGITS, "0123456789" * 2)


def clean_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE, " "))


def split_scripts(col: Column) -> Column:
    """A space between a Latin or digit run and Persian letters."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), f"(?<={V.PERSIAN})(?=[A-Za-z0-9])", " ")
    return clean_spaces(F.regexp_replace(text, rf"([A-Za-z0-9][A-Za-z0-9\-_/.]*)(?={V.PERSIAN})", "$1 "))


def normalize(col: Column, glue: bool = True, shapes: bool = True) -> Column:
    """The matching key of a name; null and blank give ''. ``shapes=False`` leaves out the UDF for text without
    compatibility forms."""
    text = ascii_digits(unify_letters(plain_shapes(col) if shapes else col))
    text = F.translate(text, V.DASHES + V.SLASHES, "-" * len(V.DASHES) + "/" * len(V.SLASHES))
    text = clean_spaces(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]", " "))
    if glue:
        text = F.regexp_replace(text, r"(?<=[a-z])[\s\-_/]+(?=\p{Nd})", "")
        text = F.regexp_replace(text, r"(?<=\p{Nd})[\s\-_/]+(?=[a-z])", "")
    return text


def dense(col: Column, shapes: bool = True) -> Column:
    return F.replace(normalize(col, shapes=shapes), F.lit(" "), F.lit(""))


def tokens(col: Column) -> Column:
    return F.filter(F.split(normalize(col), " "), lambda w: w != "")


def code_key(col: Column, shapes: bool = True) -> Column:
    """Letters and digits of a code in upper case; an all-digit code loses leading zeros."""
    key = ascii_digits(unify_letters(plain_shapes(col) if shapes else col))
    key = F.upper(F.regexp_replace(key, "[^0-9A-Za-z]", ""))
    return let(key, lambda k: F.when(k.rlike("^[0-9]+$"), F.regexp_replace(k, "^0+(?=.)", "")).otherwise(k))


def code_family(key: Column) -> Column:
    """Leading letters of a code key."""
    return F.regexp_extract(key, "^[A-Z]+", 0)


def words_and_pairs(text: Column) -> Column:
    """Distinct words of a normalised text, then its adjacent pairs as one word."""


    def both(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, b))
        return F.array_distinct(F.concat(words, pairs))

    return let(F.filter(F.split(text, " "), lambda w: w != ""), both)


def unit_name(col: Column) -> Column:
    key = normalize(col)
    named = F.create_map(*[F.lit(x) for unit, names in V.UNIT_NAMES.items() for n in names for x in (py_normalize(n), unit)])
    return F.coalesce(F.try_element_at(named, key), key)


def price_label(section: Column, text: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(F.trim(section), F.lit("")), F.nullif(F.trim(text), F.lit("")))


# The same for short constants and page layout, in Python.
_TABLE = str.maketrans({**V.LETTERS, **V.GLYPHS})
_DIGITS = str.maketrans(DIGITS, "0123456789" * 2)
_SIGNS = str.maketrans(V.DASHES + V.SLASHES, "-" * len(V.DASHES) + "/" * len(V.SLASHES))


def py_shapes(text: str) -> str:
    return unicodedata.normalize("NFKC", text.translate(str.maketrans(V.GLYPHS)))


def py_digits(text: str) -> str:
    return text.translate(_DIGITS)


def py_spaces(text: str) -> str:
    return " ".join(text.split())


def py_normalize(text: str | None) -> str:
    text = re.sub(V.MARKS, "", py_shapes(text or "").translate(_TABLE))
    for old, new in V.SPELLINGS.items():
        text = text.replace(old, new)
    text = py_spaces(re.sub(r"[^\w\s]", " ", py_digits(text).translate(_SIGNS).lower()))
    return re.sub(r"(?<=\d)[\s_]+(?=[a-z])", "", re.sub(r"(?<=[a-z])[\s_]+(?=\d)", "", text))


def py_dense(text: str | None) -> str:
    return py_normalize(text).replace(" ", "")
