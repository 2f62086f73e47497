"""Scores of candidate pairs: code, text and specifications, with vetoes, and status bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.attributes import HARD, SOFT
from ..functions.text import py_dense

EPSILON = 1e-6


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def spec_equal(name: str, stock: Column, price: Column) -> Column:
    """Equal values, or one inside the other side's range."""
    left, right = stock.getField(name), price.getField(name)

    def within(value: Column, span: Column) -> Column:
        return F.coalesce(value.between(span.getField("lo") - EPSILON, span.getField("hi") + EPSILON), F.lit(False))

    return (F.abs(left - right) < EPSILON) | within(left, price.getField(f"{name}_range")) | within(right, stock.getField(f"{name}_range"))


def spec_verdict(stock: Column, price: Column) -> Column:
    """struct(ratio, comparable, conflicts): share of agreeing specifications (-1: none to compare), compared and
    conflicting hard ones. Hints and bare numbers of a price row support a match and never veto it."""
    agreed, comparable, soft, soft_agreed = [], [], [], []
    for name in HARD:
        left, right, hint = stock.getField(name), price.getField(name), price.getField(f"{name}_hint") if name in ("watt", "density") else F.lit(None).cast("double")
        both = left.isNotNull() & right.isNotNull()
        comparable.append(_flag(both))
        agreed.append(_flag(both & spec_equal(name, stock, price)))
        alone = left.isNotNull() & right.isNull()
        number = F.array_contains(price.getField("numbers"), left.try_cast("int"))
        soft.append(_flag(alone & (hint.isNotNull() | number)))
        soft_agreed.append(_flag(alone & F.when(hint.isNotNull(), F.abs(left - hint) < EPSILON).otherwise(number)))
    for name in SOFT:
        left, right = stock.getField(name), price.getField(name)
        soft.append(_flag(left.isNotNull() & right.isNotNull()))
        soft_agreed.append(_flag(F.abs(left - right) < EPSILON))
    lengths = (F.size(stock.getField("mm")) > 0) & (F.size(price.getField("mm")) > 0)
    soft.append(_flag(lengths))
    soft_agreed.append(_flag(lengths & F.arrays_overlap(stock.getField("mm"), price.getField("mm"))))
    n, total = _sum(comparable), _sum(comparable) + _sum(soft)
    return F.struct(
        F.when(total > 0, (_sum(agreed) + _sum(soft_agreed)) / total).otherwise(-1.0).alias("ratio"),
        n.alias("comparable"), (n - _sum(agreed)).alias("conflicts"),
    )


def ruled_code(codes: Column, key: Column, family: Column) -> Column:
    """The best of the codes by rules alone: 100, 88, 78, or 0 where only a ratio could tell."""

    def one(code: Column) -> Column:
        own = F.regexp_extract(code, "^[A-Z]+", 0)
        return (
            F.when(code == key, 100.0).when(key.startswith(code) | code.startswith(key), 88.0)
            .when((F.length(own) >= 3) & (own == family), 78.0).otherwise(0.0)
        )

    return F.array_max(F.transform(codes, one))


def code_score(codes: Column, key: Column, family: Column, best_ratio: Column) -> Column:
    """100 for an equal code, 88 for a prefix either way, 78 for a family, else half the best ratio; -1 without codes.

    ``best_ratio`` is the best ratio of any code; where a code has a better rule, that rule's score is higher anyway
    unless the ratio is over it, which half a ratio never is.
    """

    ruled = ruled_code(codes, key, family)
    return F.when((F.size(codes) == 0) | (key == ""), -1.0).otherwise(F.greatest(ruled, 0.5 * best_ratio))


def text_score(found: Column, total: Column, overlap: Column, fallback: Column, exponent: float) -> Column:
    """Coverage by weight and overlap; ``fallback`` where the list knows no word of the item."""
    coverage = 100.0 * F.pow(found / F.when(total > 0, total), F.lit(exponent))
    return F.when(F.coalesce(total, F.lit(0.0)) > 0, F.least(F.lit(100.0), 0.75 * coverage + 0.25 * overlap)).otherwise(fallback)


def discriminator_delta(left: Column, right: Column, terms: list[str], penalty: float) -> Column:
    """Minus ``penalty`` for each term that only one of two space-free texts contains."""
    packed = [py_dense(t) for t in terms]
    return 0.0 - penalty * _sum([(left.contains(t) != right.contains(t)).cast("int") for t in packed]) if packed else F.lit(0.0)


def brand_delta(brand: Column, key: Column, prefixes: dict, bonus: float) -> Column:
    out = F.lit(0.0)
    for name, own in prefixes.items():
        if own:
            starts = reduce(lambda a, b: a | b, [key.startswith(p) for p in own])
            out = F.when(brand == name, F.when(starts, bonus).otherwise(-bonus)).otherwise(out)
    return out


def total_score(code: Column, words: Column, verdict: Column, has_hard: Column, extra: Column, cfg: dict) -> Column:
    """Weighted mean of the parts there are, plus ``extra``; a conflict scales it down, an equal code without one
    makes 100. Rounded to 9 digits, so that thresholds don't depend on the order of sums."""
    w, ratio = cfg["weights"], verdict.getField("ratio")
    spec = F.when(ratio >= 0, ratio * 100.0).when(has_hard, float(cfg["neutral_spec_score"]))
    weights = F.when(code >= 0, float(w["code"])).otherwise(0.0) + F.when(spec.isNotNull(), float(w["spec"])).otherwise(0.0) + float(w["text"])
    value = (F.when(code >= 0, code * float(w["code"])).otherwise(0.0) + F.coalesce(spec * float(w["spec"]), F.lit(0.0)) + words * float(w["text"])) / weights + extra
    value = F.when(verdict.getField("conflicts") > 0, value * float(cfg["spec_conflict_factor"])).when(code >= 100.0, 100.0).otherwise(value)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 9)


def match_kind(code: Column, conflicts: Column) -> Column:
    return F.when((code >= 100.0) & (conflicts == 0), "exact_code").when(code > 0, "code_spec").otherwise("text")


def status_of(score: Column, cfg: dict) -> Column:
    return (
        F.when(score >= float(cfg["exact_threshold"]), "EXACT").when(score >= float(cfg["fuzzy_threshold"]), "HIGH")
        .when(score >= float(cfg["review_threshold"]), "REVIEW").otherwise("NOT_FOUND")
    )


def has_hard_specs(stock: Column) -> Column:
    return reduce(lambda a, b: a | b, [stock.getField(n).isNotNull() for n in HARD])


def conflict_note(verdict: Column) -> Column:
    return F.when(verdict.getField("conflicts") > 0, V.NOTE_CONFLICT).otherwise("")
