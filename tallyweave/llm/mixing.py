"""Mixing sources to target weights by systematic sampling. Native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spared, stage

WORD = r"[^\x20\x09-\x0D]+"
SALTS, SALT_ROWS = 64, 20_000  # parts of the rows alike in source and size: at least so many, and about so many rows in each
SEED = 7


def source_targets(sources: DataFrame, weights: list[float], max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of all sizes by repeating weights in the sources' order,
    stopping at ``max_epochs`` times a source's size; the excess goes to the others by weight.

    The result of resharing until none is above is min(cap, level x weight) at one level. Sorted by cap / weight, the
    first sources are full; windows over one row for each source find where the level lies.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", share).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    lower = by.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    rows = rows.withColumns({
        "full": F.coalesce(F.sum("cap").over(lower), F.lit(0.0)),
        "open": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0)),
        "total": F.sum("source_size").over(all_rows),
    })
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    rows = rows.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(all_rows))
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def plan_mixture(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: int = SEED, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Copies of each document for a mixture whose sources come near their targets.

    ``docs`` has doc_id, source, text; other columns are ignored. Returns doc_id, source, size (words), source_size,
    target and copies. Within a source every document expects target / source_size copies; documents stand in order
    of size, so the systematic sample is spread over the sizes and a source misses its target by about one document at
    most. The running sum of expected copies plus one random offset for the source (from md5 of seed and name) emits
    a copy at each whole number that it passes, never over ``max_epochs``.

    No source is gathered: ranks are sums of counts by (source, size, salt of doc_id), and only rows alike in all
    three are ordered in a task, about ``salt_rows`` of them. Null text: size 0. Null source: a source of its own, last. Null doc_id: as any other
    id. Repeated rows are documents of their own. Sources of size 0 and empty tables take nothing.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = stage(docs.select("doc_id", "source", size.alias("size")), "sizes")
    most = rows.groupBy("source", "size").count().agg(F.max("count")).first()[0] or 0
    salts = max(SALTS, -(-most // salt_rows))
    mixed = F.try_add(F.try_add(F.col("doc_id").cast("long"), F.shiftright("doc_id", 6)), F.shiftright("doc_id", 12))
    rows = rows.withColumn("salt", F.coalesce(F.pmod(mixed, F.lit(salts)), F.lit(0)).cast("int"))
    step = F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    groups = stage(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")).withColumn("step", step), "groups")
    # the rank before each group: groups in smaller steps of size, then earlier groups of the same step
    steps = groups.groupBy("source", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    within = Window.partitionBy("source").orderBy("step")
    steps = steps.withColumn("before", F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = steps.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, list(weights), max_epochs)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    targets = targets.withColumn("offset", unit)

    def same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return a.join(b, on).drop(*[f"_{k}" for k in keys])

    steps = same(steps.select("source", "step", "before"), targets, ["source"])
    inner = Window.partitionBy("source", "step").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    groups = same(groups, steps, ["source", "step"]).withColumn("first", F.col("before") + F.col("inner"))
    out = same(rows, groups.select("source", "size", "salt", "first", "source_size", "target", "offset"), ["source", "size", "salt"])
    alike = Window.partitionBy("source", "size", "salt").orderBy("doc_id")
    out = out.withColumn("i", F.col("first") + F.row_number().over(alike) - 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("rate", rate)
    copies = F.floor((F.col("i") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("i") * F.col("rate") + F.col("offset"))
    copies = F.least(F.when(F.col("size") > 0, copies).otherwise(F.lit(0)), F.lit(max_epochs)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    plan = plan_mixture(docs)
    return plan.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as it was drawn, with its own columns, whatever their names. Rows of one
    doc_id share its copies evenly; an empty table gives none."""
    names, docs = docs.columns, spared(docs, {"_id", "_copies", "_rows", "_k", "_copy"})
    maps = [f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()]  # maps have no hash
    plan = plan_mixture(docs).where("copies > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    out = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")))
    # rows that share a doc_id share its copies: all but the first rows of a tie take the even part
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if c in maps else F.col(f"`{c}`") for c in docs.columns]))
    out = out.withColumn("_k", F.when(F.col("_rows") > 1, F.row_number().over(same)).otherwise(F.lit(1)))
    each = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_k") <= F.col("_copies") % F.col("_rows")).cast("int")
    out = out.withColumn("_copy", F.explode(F.when(each > 0, F.sequence(F.lit(1), each.cast("int")))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns]).toDF(*names)


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    doc_id + (doc_id >> 6) + (doc_id >> 12) AS mixed
  FROM documents),
parts AS (
  SELECT greatest({SALTS}, ceil(coalesce(max(n), 0) / {SALT_ROWS}))::BIGINT AS salts FROM (SELECT count(*) AS n FROM sized GROUP BY source, size)),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals),
ranked AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM ranked WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels WHERE ratio >= level) * weight) AS target,
    ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS shift
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, shift,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY size, coalesce(mixed % salts, 0), doc_id NULLS FIRST) - 1 AS i
  FROM parts, sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * least(3, CASE WHEN size > 0 THEN floor((i + 1) * rate + shift) - floor(i * rate + shift) ELSE 0 END))::BIGINT AS taken
FROM placed
"""
