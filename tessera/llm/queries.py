"""The registered queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, cover_tree, html_text, langid, minhash, mixing, naming, pii, token_files, url_filter
from tessera.llm.common import fresh_dir, read_table


#: Fixed values of the contract: (host, path, action).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Production weights: domains alike, languages as given, sources of one language alike.
MIX_WEIGHTS = {("*", "en"): 0.5, ("*", "de"): 0.2, ("*", "fr"): 0.2, ("*", "es"): 0.1, ("*", "none"): 0.1}
MIX_SHARE = 0.6
MIX_EPOCHS = 4


def source_domain(source: str = "source"):
    """The domain of a source: its trailing number modulo 4; a source without a number is a domain of its own."""
    number = F.regexp_extract(F.col(source), "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string"))).otherwise(F.col(source))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), source_domain(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)
    return mixed.select("doc_id", *(F.col(f"mix_{n}").alias(n) for n in (*mixing.LEVELS, "copies")), mixing.tokens("text").alias("n_tokens"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fresh_dir(spark, "tokens")
    token_files.write(docs, out, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0, vocabulary=50_257)
    return token_files.read(spark, out, tokens=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.fit(docs.filter("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), templates="n_templates")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"), pii.joined("all_spans").alias("spans"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.build(spark, URL_RULES)).drop("url")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.expr("CAST(octet_length(ids_le) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
