"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from . import ann, chat_format, langid, licenses, media, mixing, packing, simhash, suffix_dedup, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark, sf_dir):
    return chat_format.chat_digest(spark, table(spark, sf_dir, "conversations"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeats_digest(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark, sf_dir):
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op7_media_columns(spark, sf_dir):
    return media.media_digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op9_nearest(spark, sf_dir):
    return ann.nearest_digest(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (op1_chat_format, op2_best_fit_packing, op3_suffix_dedup, op4_mix_sources, op5_language_id, op6_license_scan, op7_media_columns, op8_simhash, op9_nearest, op10_toxicity)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op1_chat_format": chat_format.CHAT_SQL, "op4_mix_sources": mixing.MIX_SQL}
