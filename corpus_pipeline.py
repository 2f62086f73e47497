"""The corpus pipeline: documents to packed sequences. Each stage works on all that the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import common, langid, mixing, packing, queries, simhash, suffix_dedup


_earlier: list[str] = []  # what the stage before has staged


def after_the_one_before(work: Callable) -> Callable:
    """A stage is called when the result of the one before has been written, so what that one has staged goes first.

    Results are written, by whoever runs the stages, in row groups of a bounded size, and read without vectored calls:
    for these each of a pool of threads keeps a buffer as large as the largest column chunk it has read outside the heap.
    """

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.discard(spark, _earlier)
        spark.conf.set("parquet.block.size", common.ROW_GROUP)
        spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
        known = set(common.staged())
        out = work(spark, docs, sf_dir)
        _earlier[:] = [path for path in common.staged() if path not in known]
        return out

    return stage


@after_the_one_before
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the classifier learns from the documents themselves."""
    return langid.keep_identified(docs)


@after_the_one_before
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked (three words, 3 bits)."""
    return simhash.drop_near_duplicates(docs)


@after_the_one_before
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents have."""
    return suffix_dedup.drop_repeats(docs)


@after_the_one_before
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mix_documents(docs)


@after_the_one_before
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in packed sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [("language ID", identify), ("near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("source mixing", mix), ("best-fit packing", pack)]
ORACLE_SQL = None  # no stage but mixing can be expressed


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(spark, before)
        before = common.staged()[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
