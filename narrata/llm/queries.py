"""The thin queries over the tables: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, common, exact, langid, mixing, quality, simhash, suffix, toxicity, wavelet


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(col: str, by: int, value: int):
    """Whether crc32 of a column as text leaves ``value``; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % by == value


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~remainder("doc_id", 5, 0))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~remainder("doc_id", 4, 2)))
    out = langid.identify(docs, model)
    return out.select("doc_id", remainder("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "spans")


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir)).drop("stays")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = toxicity.score(docs, toxicity.fit(docs, training_labels(spark, sf_dir)))
    return out.select("doc_id", remainder("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_wavelet(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = f"{common.shared_dir(spark)}/shards"
    return wavelet.read(wavelet.write(documents(spark, sf_dir), path, vocabulary or public_tokenizers.path("byte_bpe_50k.json")))


def op9_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 5, 1)
    return brown.score(docs, docs.filter(~held_out)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_suffix": op2_suffix,
        "op3_langid": op3_langid,
        "op4_exact": op4_exact,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_quality": op7_quality,
        "op8_wavelet": op8_wavelet,
        "op9_bpe": op9_bpe,
        "op10_brown": op10_brown,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact": exact.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op7_quality": quality.ORACLE,
    }
