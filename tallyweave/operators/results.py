"""The query surface over results: filters, search, pages and the logical export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def filter_results(rows: DataFrame, name: str = "all") -> DataFrame:
    """One of: all, priced, matched, review, not_found, in_stock, out_of_stock."""
    stocked = F.coalesce(F.col("stock"), F.lit(0.0)) > 0
    tests = {
        "all": F.lit(True), "priced": F.col("price").isNotNull(), "matched": F.col("status").isin("EXACT", "HIGH"), "review": F.col("status") == "REVIEW",
        "not_found": F.col("status") == "NOT_FOUND", "in_stock": stocked, "out_of_stock": ~stocked,
    }
    if name not in tests:
        raise ValueError(f"no filter {name}")
    return rows.where(tests[name])


def search_results(rows: DataFrame, query: str) -> DataFrame:
    text = F.lower(F.concat(F.coalesce("code", F.lit("")), F.lit(" "), F.coalesce("name", F.lit(""))))
    return rows.where(text.contains(query.lower())) if query else rows


def page_results(rows: DataFrame, offset: int = 0, limit: int = 0, order: str = "item_id") -> DataFrame:
    """A slice in order; limit 0 means all the rest."""
    out = rows.orderBy(order).offset(offset)
    return out.limit(limit) if limit else out


def export_rows(rows: DataFrame, run_brand: str = "", only_priced: bool = False) -> DataFrame:
    """What is written to a sheet: code (a number if it is all digits), name, stock, price, brand and status label."""
    labels = F.create_map(*[F.lit(x) for pair in V.STATUS_LABELS.items() for x in pair])
    out = rows.where("price is not null") if only_priced else rows
    digits = F.trim("code")
    return out.select(
        "item_id", F.trim("code").alias("code"), F.when(digits.rlike("^[0-9]{1,18}$"), digits.try_cast("long")).alias("code_number"), "name", "stock", "price",
        F.coalesce(F.nullif(F.col("source"), F.lit("")), F.when(F.col("price").isNotNull(), F.lit(run_brand)), F.lit("")).alias("brand"),
        F.coalesce(F.try_element_at(labels, F.col("status")), F.lit("")).alias("status_label"),
    )
