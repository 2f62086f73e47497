"""SimHash near-duplicates: fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, small_batches, spared, stage

RADIUS = 3
HOT = 1000  # fingerprints that share a segment; beyond it the bucket is split by bytes of the other segment


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the text's shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of (doc_id, text); null and wordless texts have fingerprint 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        return stage(rows.mapInArrow(hashed, "doc_id long, fp long"), "fingerprints")


def near_pairs(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp) that differ in at most ``radius`` <= 3 bits.

    Each fingerprint has two segments of 32 bits; of a pair within 3 bits one segment differs in at most one. So every
    fingerprint probes the table of a segment with the 33 values of the ball around its own, and what it meets is
    verified over all 64 bits. A segment value that over ``hot`` fingerprints share is split further: if one segment
    matches, the other's four bytes hold at least one that is equal, so table and probes also carry such a byte.
    Fingerprints that are all within 3 bits of each other number 128 at most, so links stay near the input in number.
    Spark takes 33 exploded rows for as large as the one they come from and would broadcast them through the driver.
    """
    if radius > 3:
        raise ValueError("two segments and single-bit balls find pairs within 3 bits only")
    value = lambda s: F.shiftrightunsigned("fp", 32) if s else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    key = lambda s: value(s) + F.lit(s << 32)
    rest = lambda s: F.array(*[F.shiftrightunsigned(value(1 - s), 8 * i).bitwiseAND(F.lit(255)) + F.lit(i << 8) for i in range(4)])
    ball = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)]])

    def rows(s: int, masks) -> DataFrame:
        keys = F.transform(masks, lambda m: key(s).bitwiseXOR(m)) if masks is not None else F.array(key(s))
        return fps.select("fp", rest(s).alias("rest"), F.explode(keys).alias("key"))

    table = rows(0, None).union(rows(1, None))
    probes = rows(0, ball).union(rows(1, ball))
    crowded = stage(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "hot")
    plain = F.lit(-1).cast("long")
    if crowded.isEmpty():
        table, probes = (x.select("fp", "key", plain.alias("part")) for x in (table, probes))
    else:
        marked = crowded.withColumn("split", F.lit(True))
        split = F.explode(F.when(F.col("split"), F.col("rest")).otherwise(F.array(plain)))
        table, probes = (x.join(marked, "key", "left").select("fp", "key", split.alias("part")) for x in (table, probes))
    met = table.select(F.col("fp").alias("a"), "key", "part").hint("merge").join(probes.select(F.col("fp").alias("b"), "key", "part"), ["key", "part"])
    return met.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at most ``radius`` bits) for each row.

    ``docs`` has doc_id, text; other columns are ignored. Rows with one fingerprint, such as copies, are one node, so
    copies are never paired. Null texts and texts without words have fingerprint 0. A null doc_id is no candidate for
    component_id; a component of such rows alone has a null one. Repeated rows and empty tables need no care.
    """
    found = fingerprints(docs)
    first = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    parts = connected_components(near_pairs(first.select("fp"), radius))
    linked = first.join(parts.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = linked.select("fp", "component").join(heads, "component").select("fp", "component_id")
    # copies pack so well in Parquet that Spark would take millions of them for a table to broadcast
    return found.hint("merge").join(ids, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component of ``near_duplicates``: that of its smallest doc_id, a null one last, then by the
    text's hash. Other columns are kept, whatever their names."""
    names, docs = docs.columns, spared(docs, {"_row", "fp", "component_id"})
    # a row's number must not change between the two readings of it
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = fingerprints(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    firsts = found.hint("merge").join(rows.select("_row", order.alias("first")), "_row").groupBy("fp").agg(F.min("first").alias("first"))
    firsts = stage(firsts, "firsts")
    parts = connected_components(near_pairs(firsts.select("fp"))).withColumnsRenamed({"node": "fp"})
    kept = firsts.join(parts, "fp", "left").groupBy(F.coalesce("component", "fp").alias("part")).agg(F.min("first").alias("first"))
    return rows.join(kept.select("first._row"), "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).toDF(*names)
