"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results: a null or empty text, or one without a letter, is rejected by the first stage; a null language or source
plays no part before mixing, where it is a leaf named ``none``; texts may be of any length; of rows that are equal in id and
text one stays, of equal texts that of the smallest id, ties fall to the smaller hash; an empty table gives an empty one;
further columns, whatever their names, stay with their rows up to the last stage, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, minhash, mixing, naming
from tessera.llm.common import fresh_dir
from tessera.llm.queries import MIX_EPOCHS, MIX_SHARE, MIX_WEIGHTS, source_domain


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identifier rejects go: those without a letter, and those it cannot tell."""
    model = langid.fit(docs)
    return langid.predict(docs, model).filter("NOT rejected").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return naming.deduplicate(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice."""
    return mixing.repeated(mixing.mix(docs, source_domain(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.expr("CAST(octet_length(ids_le) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Language identification, byte-pair merges and the seeded order have no SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
