"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PARTS, WIDTH, ROTATION = 64, 16, 64  # substrings, their bits, bits that one rotation gives
BITS = PARTS * WIDTH
FIT_ROWS = 8192  # vectors that the rotations and the radii are fitted on, the first by hash of vec_id
TARGET, VERIFIED = 0.94, 0.995  # shares of the nearest among the fitted vectors that a probe must retrieve, and the radius keep
BASE_BLOCK, QUERY_BLOCK, LEAST_QUERIES = 65536, 32768, 512  # rows of a block; a task searches one block of each


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) without vectors that are null or zero, hold nulls or non-finite numbers, or
    differ from the most frequent length (of equally frequent ones the larger)."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(e.isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return rows.where(F.size("embedding") == (sizes.n if sizes else 0))


def lift(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """One more dimension makes all base vectors equally long, so that the largest inner product is the nearest angle."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if query:
        return np.hstack([x / norm, np.zeros_like(norm)])
    return np.hstack([x, np.sqrt(np.maximum(top * top - norm * norm, 0))]) / top


class Codes:
    """Binary codes of ``PARTS`` substrings; each 64 bits have a rotation learned by iterative quantisation of the principal
    directions, from a start of its own.

    A query's bit is worth the query's distance from that bit's plane, so a flip of a doubtful bit is short and one of a sure
    bit long. By the pigeonhole principle a code within ``PARTS`` x ``reach`` in all is within ``reach`` in some substring.
    """

    def __init__(self, sample: np.ndarray, top: float, ranks: int, seed: int = 5, rounds: int = 12):
        rng = np.random.default_rng(seed)
        self.top, x = top, lift(sample, top, False)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :ROTATION]
        if axes.shape[1] < ROTATION:  # fewer dimensions than bits: more directions, at random
            axes = np.hstack([axes, np.linalg.qr(rng.standard_normal((ROTATION, ROTATION)))[0][: len(axes), axes.shape[1] :]])
        v, turned = x @ axes, []
        for _ in range(BITS // ROTATION):
            r = np.linalg.qr(rng.standard_normal((ROTATION, ROTATION)))[0]
            for _ in range(rounds):
                left, _, right = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (left @ right).T
            turned.append(axes @ r)
        self.axes = np.hstack(turned)
        self.reach, self.radius = self._fit(sample, ranks)

    def planes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Signed distances from the planes of all bits."""
        return (lift(x, self.top, query) - self.mean) @ self.axes

    def _fit(self, sample: np.ndarray, ranks: int) -> tuple[float, int]:
        """(reach, Hamming radius) that find ``TARGET`` of the nearest ``ranks`` of some fitted vectors among all of them."""
        base, queries = self.planes(sample, False) > 0, np.arange(0, len(sample), max(1, len(sample) // 256))
        short, far = [], []
        for row, at in zip(queries, self.planes(sample[queries], True), strict=True):
            score = sample @ sample[row]
            score[row] = -np.inf
            near = np.argsort(-score, kind="stable")[: min(ranks, len(sample) - 1)]
            flips = base[near] != (at > 0)
            short.extend((flips * np.abs(at)).reshape(len(near), PARTS, WIDTH).sum(axis=2).min(axis=1))
            far.extend(flips.sum(axis=1))
        if not far:
            return 0.0, BITS
        return float(np.quantile(short, TARGET, method="higher")), int(np.quantile(far, VERIFIED, method="higher"))


def substrings(bits: np.ndarray) -> np.ndarray:
    """(rows, parts) substrings of codes as numbers."""
    return np.packbits(bits.reshape(len(bits), PARTS, WIDTH), axis=2).view(">u2").reshape(len(bits), PARTS).astype(np.int64)


_HALF = WIDTH // 2
_SETS = (np.arange(1 << _HALF)[:, None] >> np.arange(_HALF) & 1).astype(np.float64)  # which bits of half a substring flip


class Index:
    """A table of each substring; a probe of all tables finds every code within a weighted radius."""

    def __init__(self, codes: Codes, x: np.ndarray):
        bits = np.concatenate([codes.planes(x[at : at + 8192], False) > 0 for at in range(0, len(x), 8192)])
        keys = substrings(bits)
        self.words = np.packbits(bits, axis=1).view(np.uint64)
        self.orders = np.argsort(keys, axis=0, kind="stable").T.astype(np.int32).ravel()
        counts = np.stack([np.bincount(keys[:, p], minlength=1 << WIDTH) for p in range(PARTS)])
        self.starts = np.concatenate([[0], np.cumsum(counts.ravel())]).astype(np.int32)  # of (part, key) in ``orders``

    @staticmethod
    def probes(planes: np.ndarray, reach: float) -> np.ndarray:
        """Table places (part, key) of all substrings whose weighted distance from the query's is at most ``reach``."""
        cost = np.abs(planes).reshape(PARTS, 2, _HALF)[:, :, ::-1]  # the last bit of a half is its lowest
        high, low = cost[:, 0] @ _SETS.T, cost[:, 1] @ _SETS.T
        order = np.argsort(low, axis=1)
        apart = (np.arange(PARTS) * (2 * (low.max() + high.max() + reach) + 1))[:, None]  # one sorted row for all parts
        ends = np.searchsorted((np.take_along_axis(low, order, 1) + apart).ravel(), (reach - high + apart).ravel(), side="right")
        count = np.maximum(ends - np.repeat(np.arange(PARTS) << _HALF, 1 << _HALF), 0)  # none where high alone is beyond
        set_high = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(set_high)) - np.repeat(np.cumsum(count) - count, count)
        part, flips_high = set_high >> _HALF, set_high & ((1 << _HALF) - 1)
        own = substrings((planes > 0)[None])[0]
        return part << WIDTH | own[part] ^ (flips_high << _HALF | order[part, nth])

    def within(self, planes: np.ndarray, reach: float, radius: int) -> tuple[np.ndarray, int]:
        """(rows whose complete code differs in at most ``radius`` bits among those that the tables give, number of these)."""
        places = self.probes(planes, reach)
        first, count = self.starts[places], self.starts[places + 1] - self.starts[places]
        first, count = first[count > 0], count[count > 0]
        seen = np.zeros(len(self.words), dtype=bool)
        seen[self.orders[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]] = True
        rows = np.flatnonzero(seen)
        own = np.packbits(planes > 0).view(np.uint64)
        return rows[np.bitwise_count(self.words[rows] ^ own).sum(axis=1, dtype=np.int64) <= radius], len(rows)

    def grown(self, planes: np.ndarray, reach: float, radius: int, least: int) -> np.ndarray:
        """As ``within``; both radii grow until ``least`` rows, or all there are, are found."""
        while True:
            near, _ = self.within(planes, reach, radius)
            if len(near) >= min(least, len(self.words)):
                return near
            reach, radius = 1.2 * reach + 1e-6, min(BITS, radius + BITS // 32)


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``k`` base vectors of largest inner product for each query: (query_id, rank, vec_id, score).

    Both tables have vec_id (a whole number) and embedding; vectors that ``usable`` leaves out take no part, and a query's
    own vec_id is none of its neighbours. Equal vectors are one class: a class is searched once and holds its k + 1
    smallest ids, more than any query can return. Scores are inner products of the given numbers in double precision,
    ties go to the smaller vec_id. Each task indexes one block of classes and probes it for one block of queries; where
    the radius retrieves too few it grows until it does not. Of n vectors the k-th nearest is as near as the k x m / n-th of
    the m fitted ones, so that rank is what the radius is fitted to. Repeated ids stay rows of their own; with no usable
    vectors the result is empty.
    """
    rows = stage(usable(base), "vectors")
    first = stage(rows.groupBy("embedding").agg(F.min("vec_id").alias("class_id")), "classes")
    few = Window.partitionBy("embedding").orderBy("vec_id")
    ids = rows.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stage(ids.select(F.element_at("ids", 1).alias("class_id"), "ids", "embedding"), "base")
    asked = usable(queries)
    spread = lambda n, name: F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int").alias(name)
    wanted = stage(asked.join(first, "embedding").select(F.col("vec_id").alias("query_id"), "class_id", "embedding"), "queries")
    distinct = wanted.groupBy("class_id").agg(F.first("embedding").alias("embedding"))

    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, top = classes.agg(F.count("*"), F.max(squares)).first()
    sample = [r.embedding for r in classes.orderBy(F.xxhash64("class_id"), "class_id").limit(fit_rows).select("embedding").collect()]
    out = "class_id long, vec_id long, score double"
    if not n:
        return wanted.select("query_id", F.lit(1).alias("rank"), F.col("class_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    codes = Codes(np.array(sample), float(np.sqrt(top)) or 1.0, max(1, -(-k * len(sample) // n)))
    blocks, asking = -(-n // BASE_BLOCK), distinct.count()
    tasks = 2 * base.sparkSession.sparkContext.defaultParallelism  # few blocks of vectors: more, smaller blocks of queries
    groups = max(1, -(-asking // QUERY_BLOCK), min(-(-tasks // blocks), -(-asking // LEAST_QUERIES)))
    left = classes.select("class_id", "ids", "embedding", spread(blocks, "b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q"))
    right = distinct.select("class_id", "embedding", spread(groups, "q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def search(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = ([], [], [])
        if len(base) and len(queries):
            x, ids = np.stack(base["embedding"].to_numpy()), base["ids"].to_numpy()
            index = Index(codes, x)
            smallest = base["class_id"].to_numpy()
            y = np.stack(queries["embedding"].to_numpy())
            for class_id, vector in zip(queries["class_id"], y, strict=True):
                near = index.grown(codes.planes(vector[None], True)[0], codes.reach, codes.radius, k + 1)
                score = (x[near] * vector).sum(axis=1)
                if len(near) > k + 1:  # ties with the last one stay
                    some = score >= np.partition(score, -k - 1)[-k - 1]
                    near, score = near[some], score[some]
                order = np.lexsort((smallest[near], -score))[: k + 1]
                pairs = sorted((-s, i) for s, row in zip(score[order], near[order], strict=True) for i in ids[row])[: k + 1]
                found[0].extend([class_id] * len(pairs))
                found[1].extend(i for _, i in pairs)
                found[2].extend(-s for s, _ in pairs)
        return pd.DataFrame(dict(zip(("class_id", "vec_id", "score"), found, strict=True)))

    hits = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, out)
    best = Window.partitionBy("class_id").orderBy(F.col("score").desc(), "vec_id")
    hits = hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = wanted.select("query_id", "class_id").distinct().join(hits, "class_id").where("query_id != vec_id")
    return hits.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_digest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.where("vec_id % 20 = 0"))
