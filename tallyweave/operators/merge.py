"""Results of several price lists merged by priority, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_lists(results: DataFrame) -> DataFrame:
    """One row for each item: the row of the first list that prices it, else of the first list.

    ``results`` has list_ord, label, item_id, price and others; ``source`` is the label of the list that priced it,
    or ''.
    """
    order = Window.partitionBy("item_id").orderBy(F.col("price").isNull(), "list_ord")
    first = results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.withColumn("source", F.when(F.col("price").isNotNull(), F.col("label")).otherwise(""))


def list_report(merged: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows priced by each list after merging: list_ord, label, pdf_rows, priced (for later lists newly priced rows)."""
    priced = merged.where("price is not null").groupBy("list_ord").agg(F.count("*").alias("priced"))
    return lists.join(priced, "list_ord", "left").select("list_ord", "label", "pdf_rows", F.coalesce("priced", F.lit(0)).cast("long").alias("priced"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counts of one run in one pass; a null stock counts as out of stock."""
    priced, status = F.col("price").isNotNull(), F.col("status")
    stocked = F.coalesce(F.col("stock"), F.lit(0.0)) > 0
    return results.agg(
        F.count("*").alias("total"), F.count_if(status == "EXACT").alias("exact"), F.count_if(status == "HIGH").alias("high"),
        F.count_if(status == "REVIEW").alias("review"), F.count_if(status == "NOT_FOUND").alias("not_found"),
        F.count_if(status.isin("EXACT", "HIGH") & priced).alias("matched"), F.count_if(priced).alias("priced"),
        F.count_if(priced & stocked).alias("in_stock"), F.count_if(priced & ~stocked).alias("out_of_stock"),
    )


def batch_summary(merged: DataFrame, lists: DataFrame) -> DataFrame:
    """Counts over all lists, the rows they hold and their labels in order."""
    counts = run_summary(merged).select("total", "exact", "high", "review", "not_found", "priced")
    whole = lists.agg(
        F.coalesce(F.sum("pdf_rows"), F.lit(0)).alias("pdf_rows"), F.count("*").alias("files"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("list_ord", "label"))), lambda x: x.label)), "، ").alias("brand"),
    )
    one = F.lit(1).alias("one")  # a row on either side
    return counts.select("*", one).join(whole.select("*", one), "one").drop("one")
