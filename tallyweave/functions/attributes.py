"""Specifications, model codes, brands and equivalent wordings of product descriptions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import ascii_digits, clean_spaces, dense, let, normalize, py_dense, py_normalize, split_scripts, unify_letters

# A number that continues no Latin token, the end of a unit, a range and a code.
NUMBER, END = r"(?<![A-Za-z])([0-9]+(?:[./][0-9]+)?)", "(?![A-Za-z0-9])"
RANGE = r"([0-9]+)\s*(?:تا|-|to)\s*([0-9]+)"
CODE = r"\b[A-Za-z]{2,}[A-Za-z0-9]*(?:[\-/][A-Za-z0-9]+)*\b"
HARD, SOFT = ("watt", "amp", "volt", "density"), ("degree", "ip", "cm")


def spec_text(col: Column) -> Column:
    """The form that all specifications are read from: no spaces between Persian letters."""
    text = split_scripts(ascii_digits(unify_letters(col)))
    text = F.translate(text, "\u066b\u066c", ".,")
    text = clean_spaces(F.lower(F.regexp_replace(text, "[()\\[\\]\u060c,\u061b:]", " ")))
    return F.regexp_replace(text, f"(?<={V.PERSIAN}) +(?={V.PERSIAN})", "")


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("/"), F.lit(".")).try_cast("double")


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: n.cast("double"))


def specs(col: Column, hint: Column | None = None) -> Column:
    """A struct of quantities (null: none), their ranges, lengths, dimensions and bare numbers.

    For a unit a range comes first and counts with its first number, then a number before the unit, then one after it.
    ``hint`` adds density_hint and watt_hint, from a struct of these names.
    """
    return let(spec_text(col), lambda text: _specs(text, hint))


def _specs(text: Column, hint: Column | None) -> Column:
    fields, ranges = [], []
    for name, units in V.UNITS.items():
        unit = "(?:" + "|".join(units) + ")"
        ranged = RANGE + r"\s*" + unit + END
        low, high = _number(text, ranged), _number(text, ranged, 2)
        fields.append(F.coalesce(low, _number(text, NUMBER + r"\s*" + unit + END), _number(text, unit + r"\s*" + NUMBER)).alias(name))
        ranges.append(F.when(low.isNotNull(), F.struct(F.least(low, high).alias("lo"), F.greatest(low, high).alias("hi"))).alias(f"{name}_range"))
    mm = _all(text, r"([0-9]+)\s*(?:" + "|".join(V.MILLIMETRES) + ")" + END)
    cm = _all(text, r"([0-9]+)\s*(?:" + "|".join(V.CENTIMETRES) + ")" + END)
    dims = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\s*[*x×]\s*[0-9]+)+"), F.lit(0)), lambda d: F.split(d, r"\s*[*x×]\s*")))
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z.])([0-9]{1,4})(?![0-9.])"), F.lit(1))
    sorted_set = lambda a: F.array_sort(F.array_distinct(a))
    return F.struct(
        *fields, *ranges, F.try_element_at(cm, F.lit(1)).alias("cm"),
        sorted_set(F.concat(mm, F.transform(cm, lambda v: v * 10))).alias("mm"),
        sorted_set(F.array_compact(F.transform(dims, lambda d: d.try_cast("long")))).alias("dims"),
        sorted_set(F.transform(numbers, lambda n: n.cast("int"))).alias("numbers"),
        (hint.getField("density_hint") if hint is not None else F.lit(None).cast("double")).alias("density_hint"),
        (hint.getField("watt_hint") if hint is not None else F.lit(None).cast("double")).alias("watt_hint"),
    )


def code_hints(code: Column, text: Column, section: Column, found: Column) -> Column:
    """The last number of a model code, 1 to 1000, as density if the heading or text names density and none was read,
    else as wattage likewise."""
    value = F.nullif(F.regexp_extract(code, "([0-9]{1,4})(?!.*[0-9])", 1), F.lit("")).cast("double")
    value = F.when(value.between(1, 1000), value)
    around = F.concat(text, F.lit(" "), section)
    density = around.contains(V.UNITS["density"][0]) & found.getField("density").isNull()
    watt = ~density & around.contains(V.WATT_UNIT) & found.getField("watt").isNull()
    return F.struct(F.when(density, value).alias("density_hint"), F.when(watt, value).alias("watt_hint"))


def model_codes(col: Column) -> Column:
    """Distinct keys of the model codes in a name, in order."""
    found = F.regexp_extract_all(split_scripts(col), F.lit(CODE), F.lit(0))
    stop = F.array(*[F.lit(w) for w in V.NOT_CODES])
    pairs = F.transform(found, lambda t: F.struct(F.upper(F.regexp_replace(t, "[^0-9A-Za-z]", "")).alias("key"), F.upper(t).alias("raw")))
    good = F.filter(pairs, lambda p: (F.length(p.key) >= 3) & ~F.array_contains(stop, p.key) & ~F.array_contains(stop, p.raw))
    return F.array_distinct(F.transform(good, lambda p: p.key))


def brand_of(col: Column, prefixes: dict | None = None, shapes: bool = True) -> Column:
    """The first brand of the table whose space-free name occurs in the space-free text, or ''."""

    def first(key: Column) -> Column:
        out = F.lit("")
        for brand in reversed(list(prefixes or V.BRAND_PREFIXES)):
            if py_dense(brand):
                out = F.when(key.contains(py_dense(brand)), brand).otherwise(out)
        return out

    return let(dense(col, shapes), first)


def expand_wording(col: Column, synonyms: dict | None = None, rules: list | None = None, shapes: bool = True) -> Column:
    """The normalised text followed by equivalent wordings of what it contains. None means the default tables, an
    empty table none."""
    return let(normalize(col, shapes=shapes), lambda base: _expanded(base, V.SYNONYMS if synonyms is None else synonyms, V.CONTEXT_RULES if rules is None else rules))


def _expanded(base: Column, synonyms: dict, rules: list) -> Column:
    extra = []
    for source, target in synonyms.items():
        if py_normalize(source):
            extra.append(F.when(base.contains(py_normalize(source)), py_normalize(target)))
    for rule in rules:
        needed = [base.contains(py_normalize(w)) for w in rule.get("when", [])]
        if needed:
            met = needed[0]
            for more in needed[1:]:
                met = met & more
            extra.extend(F.when(met, py_normalize(w)) for w in rule.get("add", []))
    return clean_spaces(F.concat_ws(" ", base, *extra))
