"""The best price row of each item: threshold, ambiguity and alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .score import status_of

RIVALS = 4  # the best row and three after it


def alternative_label(code, price):
    return F.concat(code, F.lit(" - "), F.format_number(price, 0))


def decide(scored: DataFrame, cfg: dict) -> DataFrame:
    """One row for each (list_ord, item_id) of scored pairs (price_id, price_code, price, score, kind, note).

    Below the review threshold the score stays and the match goes. A rival within the margin at another price makes
    any status but EXACT a REVIEW. Ties go to the smaller price_id.
    """
    best = Window.partitionBy("list_ord", "item_id").orderBy(F.col("score").desc(), "price_id")
    ranked = scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= RIVALS)
    pick = lambda c: F.max(F.when(F.col("rn") == 1, F.col(c))).alias(c)
    rival = F.when(
        (F.col("rn") > 1) & (F.col("score") >= float(cfg["review_threshold"])),
        F.struct("rn", "score", "price", alternative_label(F.col("price_code"), F.col("price")).alias("label")),
    )
    out = ranked.groupBy("list_ord", "item_id").agg(
        *[pick(c) for c in ("price_id", "price", "score", "kind", "note")], F.array_sort(F.collect_list(rival)).alias("rivals")
    )
    good = F.col("score") >= float(cfg["review_threshold"])
    close = F.filter("rivals", lambda r: (F.col("score") - r.score < float(cfg["ambiguity_margin"])) & (r.price != F.col("price")))
    out = out.withColumn("close", close).withColumn("status", status_of(F.col("score"), cfg))
    unsure = good & (F.size("close") > 0)
    return out.select(
        "list_ord", "item_id", F.when(good, F.col("price_id")).alias("price_id"), F.when(good, F.col("price")).alias("price"), "score",
        F.when(good, F.col("kind")).otherwise("none").alias("match_type"),
        F.when(unsure & (F.col("status") != "EXACT"), "REVIEW").otherwise(F.col("status")).alias("status"),
        F.when(~good, "").when(unsure & (F.col("note") == ""), V.NOTE_AMBIGUOUS).otherwise(F.col("note")).alias("note"),
        F.when(good, F.transform("close", lambda r: r.label)).otherwise(F.array().cast("array<string>")).alias("alternatives"),
    )
