"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A 64-bit SimHash spreads such pairs over 0 to 20 bits, so no radius that can be probed finds all of them. Here every
pair is found: sorted by one order of all shingles, two sets that are similar enough share one of their first few. Of
the pairs that meet so, parity bitmaps rule out nearly all that are not similar, and none that is; the texts of the few
others are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import connected_components, small_batches, small_side, spared, stage, tidy

WORDS = 5
NUM, DEN = 4, 5  # the smallest Jaccard similarity of near copies
HOT = 100_000  # shingles that are put last in the order; the choice decides the cost and not the result
STRETCH = 1 << 17  # bytes of words that are hashed at once
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_SYMBOLS = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse; kept up to the usual stretch."""
    if n <= STRETCH and _powers:
        return _powers[0], _powers[1]
    found = [np.multiply.accumulate(np.full(max(n, STRETCH), base, dtype=np.uint64)) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    if n <= STRETCH:
        _powers[:] = found
    return found[0], found[1]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of bytes in which single spaces part words: a polynomial in its bytes, from prefix sums."""
    out, at = [], 0
    while at < len(data):
        till = len(data)
        if till - at > STRETCH:
            cut = data.rfind(b" ", at, at + STRETCH)
            cut = cut if cut > at else data.find(b" ", at + STRETCH)
            till = cut if cut > 0 else till
        raw = np.frombuffer(data, dtype=np.uint8, count=till - at, offset=at)
        power, inverse = powers(len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOLS[raw] * power[: len(raw)])])
        space = np.flatnonzero(raw == 32)
        start, end = np.append(0, space + 1), np.append(space, len(raw))
        out.append((sums[end] - sums[start]) * inverse[start])
        at = till + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct runs of five lower-cased words; fewer words are one run."""
    plain = [" ".join((t or "").lower().split()) for t in texts]
    w = word_hashes(" ".join(filter(None, plain)).encode("utf-8", "surrogatepass"))
    counts = [t.count(" ") + 1 if t else 0 for t in plain]
    h = np.full(len(w), WORDS, dtype=np.uint64)
    for i, factor in enumerate(_FACTORS):
        h[: len(h) - i] += w[i:] * factor
    h, out, at = _spread(h), [], 0
    for n in counts:
        if n >= WORDS:
            own = h[at : at + n - WORDS + 1]
        else:
            own = _spread(np.array([n + int((w[at : at + n] * _FACTORS[:n]).sum())], dtype=object).astype(np.uint64)) if n else h[:0]
        out.append(np.unique(own.view(np.int64)))
        at += n
    return out


def _spread(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def parity(s: np.ndarray) -> bytes:
    """A bitmap of at least as many bits as the set has members: each flips the bit that its hash names."""
    bits = 1 << max(6, (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & (bits - 1)).astype(np.int64), minlength=bits) & 1 > 0).tobytes()


def may_be_similar(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> bool:
    """No for sets that are surely not similar. Bitmaps differ in at most as many bits as sets differ in members, and
    similar sets differ in a ninth of all their members at most."""
    a, b = np.frombuffer(bits_a, dtype=np.uint64), np.frombuffer(bits_b, dtype=np.uint64)
    size = min(len(a), len(b))  # the longer bitmap is folded: its hashes taken by fewer bits
    a, b = np.bitwise_xor.reduce(a.reshape(-1, size), axis=0), np.bitwise_xor.reduce(b.reshape(-1, size), axis=0)
    return int(np.bitwise_count(a ^ b).sum()) * (NUM + DEN) <= (DEN - NUM) * (n_a + n_b)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (NUM + DEN) >= NUM * (len(a) + len(b))


def head(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles of which a near copy has at least one among its own; those in the sorted ``hot`` come last."""
    if not len(s):
        return s
    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), dtype=bool)
    return np.concatenate([s[~late], s[late]])[: len(s) - (NUM * len(s) + DEN - 1) // DEN + 1]


def hot_shingles(docs: DataFrame, share: int = 16, least: int = 4, limit: int = HOT) -> np.ndarray:
    """The commonest shingles of a sample of the distinct texts, at most ``limit``. They only steer the order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *shingle_sets(batch.column(0).slice(at, 500).to_pylist())]))], names=["shingle"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    counted = sample.mapInArrow(tidy(cut), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    with small_batches(docs.sparkSession):
        return np.sort(np.array([r.shingle for r in counted.orderBy(F.desc("n"), "shingle").limit(limit).select("shingle").collect()], dtype=np.int64))


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with _row (unique), _node (a hash of the shingle set, so that equal sets are one node), _n (shingles of
    the set), _bits (its ``parity``) and _head (see ``head``); the last two are empty where the same task has given the
    node's before."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_shingles(docs))  # HOT numbers
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    text_at = [c.lower() for c in docs.columns].index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        given: set = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = shingle_sets(batch.column(text_at).to_pylist())
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                heads, bits = [], []
                for node, s in zip(nodes.tolist(), sets, strict=True):
                    heads.append(s[:0] if node in given else head(s, hot.value))
                    bits.append(b"" if node in given else parity(s))
                    if len(given) < HOT:
                        given.add(node)
                ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *heads])))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(bits, pa.binary()), lists], names=[*batch.schema.names, "_node", "_n", "_bits", "_head"]
                )

    added = StructType.fromDDL("_node long, _n int, _bits binary, _head array<long>")
    with small_batches(spark):
        return stage(numbered.mapInArrow(tidy(mark), StructType([*numbered.schema.fields, *added.fields])), "marked")


def possible(n_a: str, at_a: str, n_b: str, at_b: str) -> F.Column:
    """Whether sets of these sizes whose first common shingle stands at these places can be similar enough."""
    left = F.least(F.col(n_a) - F.col(at_a), F.col(n_b) - F.col(at_b))
    return left * F.lit(NUM + DEN) >= (F.col(n_a) + F.col(n_b)) * F.lit(NUM)


def verified(pairs: DataFrame, rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are near copies. Only the texts of nodes whose bitmaps allow it are moved."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_be_similar(*row) for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sides = [firsts.select(F.col("_node").alias(x), F.col("_n").alias(f"n_{x}"), F.col("_bits").alias(f"bits_{x}")) for x in ("a", "b")]
    wide = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    with small_batches(pairs.sparkSession):
        pairs = stage(wide.mapInArrow(tidy(compare), "a long, b long"), "allowed")
    nodes = pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct()
    wanted = small_side(stage(firsts.join(nodes, "_node").select("_row", F.col("_node").alias("node")), "wanted"))
    texts = stage(rows.select("_row", "text").join(wanted, "_row").select("node", "text"), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, own = None, None  # pairs stand in order of a
        for batch in batches:
            ok = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != one:
                    one, own = a, shingles(x.as_py())
                ok.append(similar(own, shingles(y.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    wide = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    with small_batches(pairs.sparkSession, 500):  # two texts a row
        return stage(wide.mapInArrow(tidy(check), "a long, b long"), "links")


def links(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have a near copy other than an equal set.

    ``rows`` are those of ``marked``, ``firsts`` (_node, _row, _n, _bits) has one row of each node. Neighbours in the list of a
    shingle's nodes are compared first, which joins most groups by few comparisons; then all pairs of each list that are
    still in different components. So no pair is left out, and a list of copies costs no square of its length.
    """
    lists = Window.partitionBy("shingle").orderBy("n", "node")
    posted = rows.select(F.col("_node").alias("node"), F.col("_n").alias("n"), F.posexplode("_head").alias("at", "shingle"))
    before = {f"{c}_b": F.lag(c).over(lists) for c in ("node", "n", "at")}  # a node may stand there again, for its copies
    posted = posted.withColumns({**before, "after": F.lead("node").over(lists)}).where("node_b != node or after != node").drop("after")
    posted = stage(posted, "shared")

    def pairs(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    near = stage(posted.where("node_b != node").where(possible("n", "at", "n_b", "at_b")).select(*pairs("node", "node_b")).distinct(), "neighbours")
    found = verified(near, rows, firsts)
    parts = stage(connected_components(found), "parts")

    placed = posted.select("shingle", "node", "n", "at").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    mixed = placed.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("shingle")
    placed = stage(placed.join(mixed, "shingle", "left_semi"), "mixed")
    other = placed.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "part")])
    met = placed.join(other, "shingle").where((F.col("node") < F.col("node_b")) & (F.col("part") != F.col("part_b")) & possible("n", "at", "n_b", "at_b"))
    rest = stage(met.select(*pairs("node", "node_b")).distinct().join(near, ["a", "b"], "left_anti"), "rest")
    return connected_components(found.union(verified(rest, rows, firsts)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of each group of near copies: that of its smallest doc_id, a null one last, then by the text's hash.

    Groups are closed over chains of pairs; what a row's doc_id is has no part in it, so repeated rows and different
    texts under one id are rows like others. Null texts and texts without words are one group. Other columns are kept,
    whatever their names; an empty table gives none.
    """
    names, docs = docs.columns, spared(docs, {"_row", "_node", "_n", "_bits", "_head"})
    rows = marked(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    given = F.struct((F.length("_bits") == 0).alias("none"), "_bits")
    firsts = rows.groupBy("_node").agg(F.min(order).alias("first"), F.max("_n").alias("_n"), F.min(given).alias("_given"))
    firsts = stage(firsts.select("_node", "first", "first._row", "_n", F.col("_given._bits").alias("_bits")), "firsts")
    parts = links(rows, firsts).withColumnsRenamed({"node": "_node"})
    kept = firsts.join(parts, "_node", "left").groupBy(F.coalesce("component", "_node").alias("part")).agg(F.min("first").alias("first"))
    dropped = rows.select("_row").join(kept.select("first._row"), "_row", "left_anti")
    return rows.join(small_side(stage(dropped, "dropped")), "_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).toDF(*names)
