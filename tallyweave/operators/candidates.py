"""Candidate pairs of inventory and price rows by codes, families, prefixes and contained words.

Tables: items (item_id, codes, tokens), prices (list_ord, price_id, code_key, family, packed). All statistics are
kept for each list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_TOKEN = MIN_FAMILY = 3
EXACT, FAMILY, PREFIX = 3.0, 2.0, 2.0


def item_tokens(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.explode(F.array_distinct("tokens")).alias("token")).where(F.length("token") >= MIN_TOKEN)


def _grams(text: Column) -> Column:
    n = F.length(text) - MIN_TOKEN + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(MIN_TOKEN))))


def containment(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """(list_ord, token, price_id) of all tokens contained in packed texts.

    An equi-join on one three-letter gram of the token, the rarest one of the list, then the test itself: every text
    with the token has all of its grams, so none is lost, and no pair of a token and a text without that gram is made.
    """
    grams = prices.select("list_ord", "price_id", "packed", F.explode(_grams(F.col("packed"))).alias("gram"))
    rare = grams.groupBy("list_ord", "gram").agg(F.count("*").alias("n"))
    words = tokens.select("token").distinct()
    words = words.withColumn("_grams", _grams(F.col("token"))).select("token", F.size("_grams").alias("of"), F.explode("_grams").alias("gram"))
    choice = words.join(rare, "gram").groupBy("list_ord", "token", "of").agg(F.count("*").alias("have"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    met = choice.where("have = of").select("list_ord", "token", "gram").join(grams, ["list_ord", "gram"])
    return met.where(F.col("packed").contains(F.col("token"))).select("list_ord", "token", "price_id")


def token_weights(postings: DataFrame, prices: DataFrame) -> DataFrame:
    """(list_ord, token, df, idf): documents of the list that contain the token, and ln(1 + documents / df)."""
    sizes = prices.groupBy("list_ord").agg(F.count("*").alias("n"))
    df = postings.groupBy("list_ord", "token").agg(F.count("*").alias("df"))
    return df.join(sizes, "list_ord").select("list_ord", "token", "df", F.log(1 + F.greatest(F.lit(1), F.col("n")) / F.col("df")).alias("idf"))


def _codes(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.explode("codes").alias("code"))


def exact_hits(items: DataFrame, prices: DataFrame) -> DataFrame:
    keys = prices.where("code_key != ''").select("list_ord", "price_id", "code_key")
    return _codes(items).join(keys, F.col("code") == F.col("code_key")).select("list_ord", "item_id", "price_id", F.lit(EXACT).alias("w"))


def family_hits(items: DataFrame, prices: DataFrame) -> DataFrame:
    own = _codes(items).withColumn("family", F.regexp_extract("code", "^[A-Z]+", 0)).where(F.length("family") >= MIN_FAMILY)
    return own.join(prices.select("list_ord", "price_id", "family"), "family").select("list_ord", "item_id", "price_id", F.lit(FAMILY).alias("w"))


def _prefixes(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n))


def prefix_hits(items: DataFrame, prices: DataFrame) -> DataFrame:
    """Codes that start with a code key or the other way round, once a code: equi-joins on the prefixes of either."""
    codes = _codes(items).where("code != ''")
    keys = prices.where("code_key != ''").select("list_ord", "price_id", "code_key")
    longer = codes.withColumn("p", F.explode(_prefixes(F.col("code")))).join(keys, F.col("p") == F.col("code_key"))
    shorter = keys.withColumn("p", F.explode(_prefixes(F.col("code_key")))).where("p != code_key").join(codes, F.col("p") == F.col("code"))
    cols = ["list_ord", "item_id", "price_id", F.lit(PREFIX).alias("w")]
    return longer.select(*cols).union(shorter.select(*cols))


def token_hits(tokens: DataFrame, postings: DataFrame, weights: DataFrame) -> DataFrame:
    weighed = postings.join(weights, ["list_ord", "token"])
    return tokens.join(weighed, "token").select("list_ord", "item_id", "price_id", F.col("idf").alias("w"))


def top_candidates(hits: DataFrame, limit: int, sums: tuple[str, ...] = ()) -> DataFrame:
    """The ``limit`` best price rows of each item and list by summed evidence, ties to the smaller price_id; with the sums
    of the columns named."""
    summed = hits.groupBy("list_ord", "item_id", "price_id").agg(F.round(F.sum("w"), 9).alias("evidence"), *[F.sum(c).alias(c) for c in sums])
    best = Window.partitionBy("list_ord", "item_id").orderBy(F.col("evidence").desc(), "price_id")
    return summed.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit).drop("_n")
