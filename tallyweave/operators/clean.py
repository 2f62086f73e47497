"""Filters and keep-first deduplication of price rows and inventory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attributes, text


def valid_prices(rows: DataFrame, low: float, high: float) -> DataFrame:
    return rows.where(F.col("price").between(low, high) & ((F.col("code_key") != "") | (F.col("context") != "")))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; never dropDuplicates, which keeps any."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clean_prices(rows: DataFrame, low: float, high: float, partition: list[str] = ()) -> DataFrame:
    """Price rows within range, the first of each code, or of each text where there is no code."""
    keyed = valid_prices(rows, low, high).withColumn("_key", F.when(F.col("code_key") != "", F.col("code_key")).otherwise(F.concat(F.lit("t:"), F.col("context"))))
    keys = [*partition, "_key"]
    return keep_first(keyed, [*partition, "_key"], "price_id").drop("_key")


def first_of_equal(rows: DataFrame, low: float, high: float, partition: list[str] = ()) -> DataFrame:
    """Of raw price rows, those that ``clean_prices`` may keep: its key follows from code, section and text, so of rows
    within range that are equal in these only the first is worth its derived columns. Dealt out anew for that work."""
    keys = [*partition, "code", "section_fa", "text"]
    firsts = keep_first(rows.where(F.col("price").between(low, high)), keys, "price_id")
    return firsts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def price_report(rows: DataFrame, low: float, high: float) -> DataFrame:
    """input, dropped_no_price, duplicates and output of ``clean_prices``."""
    good = F.col("price").between(low, high) & ((F.col("code_key") != "") | (F.col("context") != ""))
    key = F.when(F.col("code_key") != "", F.col("code_key")).otherwise(F.concat(F.lit("t:"), F.col("context")))
    out = rows.agg(F.count("*").alias("input"), F.count_if(F.coalesce(good, F.lit(False))).alias("kept"), F.countDistinct(F.when(good, key)).alias("output"))
    return out.select("input", (F.col("input") - F.col("kept")).alias("dropped_no_price"), (F.col("kept") - F.col("output")).alias("duplicates"), "output")


def prepare_inventory(items: DataFrame, cfg: dict) -> DataFrame:
    """Inventory rows (item_id, row, code, name, stock, unit) with the keys that they are matched on."""
    t = {c: F.coalesce(F.col(c), F.lit("")) for c in ("code", "name", "unit")}
    out = items.withColumns(t).withColumns({
        "name_key": text.normalize(F.col("name")),
        "expanded": attributes.expand_wording(F.col("name"), cfg["synonyms"], cfg["context_rules"]),
        "brand": attributes.brand_of(F.col("name"), cfg["brand_prefixes"]),
        "specs": attributes.specs(F.col("name")),
        "_codes": attributes.model_codes(F.col("name")),
        "_own": text.code_key(F.col("code")),
    })
    own = F.when((F.col("_own") != "") & ~F.col("_own").rlike("^[0-9]+$"), F.array("_own")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({
        "codes": F.when(F.size("_codes") > 0, F.col("_codes")).otherwise(own),
        "dense_name": F.replace("name_key", F.lit(" "), F.lit("")),
        "dense_expanded": text.dense(F.col("expanded"), shapes=False),
        "tokens": text.words_and_pairs(F.col("expanded")),
    }).drop("_codes", "_own")


def distinct_names(items: DataFrame) -> DataFrame:
    """``items`` with ``own``: all that is matched on follows from name and own, the code unless it has digits alone."""
    code = F.coalesce("code", F.lit(""))
    return items.withColumns({"name": F.coalesce("name", F.lit("")), "own": F.when(code.rlike(r"\A[0-9]*\z"), "").otherwise(code)})


def clean_inventory(items: DataFrame) -> DataFrame:
    return items.where((F.col("code") != "") | (F.col("name_key") != ""))


def inventory_report(items: DataFrame) -> DataFrame:
    kept = (F.col("code") != "") | (F.col("name_key") != "")
    return items.agg(F.count("*").alias("input"), F.count_if(kept).alias("output"), F.count_if(kept & F.col("stock").isNull()).alias("no_stock"))
