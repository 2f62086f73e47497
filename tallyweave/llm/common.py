"""Shared helpers: the shared folder, staged tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROW_GROUP = 32 << 20  # bytes of a Parquet row group, which readers and writers hold in memory as a whole
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may lack the setting (as in tests); it then gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    context.setCheckpointDir(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop, wherever it lies; a stopped session leaves it alone."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone by then
        pass


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"
    atexit.register(_remove_at_exit, spark, path)
    _staged.append(path)
    return path


def staged() -> list[str]:
    """The paths of all staged tables that have not been discarded."""
    return list(_staged)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables from which nothing is going to be read any more."""
    for path in paths:
        if path in _staged:
            _staged.remove(path)
            remove(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000):
    """While it is open, jobs hand Python at most ``rows`` texts at a time, so that an executor's memory stays bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return memory that Python no longer uses to the system: a worker lives on after its task, beside other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may be another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(work: Callable) -> Callable:
    """``work`` on the batches of a task, with ``give_back`` after each of its results."""

    @functools.wraps(work)
    def run(batches):
        for out in work(batches):
            yield out
            give_back()

    return run


def small_side(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """``table``, a staged one of a few numbers a row, broadcast in joins if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def spared(docs: DataFrame, taken: set[str]) -> DataFrame:
    """``docs`` with columns that are named like one in ``taken`` under other names, in the same places."""
    return docs.toDF(*[f"_{i}_{c}" if c.lower() in taken else c for i, c in enumerate(docs.columns)])


def first_by_hash(rows: DataFrame, group: str, key: str, limit, parts: int = 16) -> DataFrame:
    """The first ``limit`` (a number or column) rows of each group by hash of ``key``, ties by key.

    Each group is cut in ``parts`` first, so that no task gets more than ``limit`` times ``parts`` of its rows.
    """
    place = F.xxhash64(key)
    rows = rows.withColumn("_part", F.pmod(place, F.lit(parts)))
    for by in ([group, "_part"], [group]):
        w = Window.partitionBy(*by).orderBy(place, key)
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return rows.drop("_n", "_part")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph.

    ``edges`` has long columns a and b; rows may repeat, be reversed or be loops; nulls are ignored. Returns
    (node, component), a row for each node that has an edge to another node. Alternates large-star and
    small-star steps; each takes the minimum by a combining aggregate and a join, so that no neighbourhood is
    collected. Every round is staged; no edges leave the executors.
    """
    cur = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = stage(cur, "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def relink(pairs: DataFrame, low: DataFrame) -> DataFrame:
        linked = pairs.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return linked.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    seen = mark(cur)
    for _ in range(max_rounds if seen[0] else 0):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        cur = stage(relink(both.where("v > u"), low), "large")
        down = cur.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = down.union(down.select("u", F.col("u").alias("v")).distinct())
        cur = stage(relink(kept, low), "small")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
