"""Answers as they arrive: the batch expressions under Structured Streaming. Stateless, so no watermark is needed;
the sink's checkpoint is the only state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.sentences import claims, valid_span


def read_answers(spark: SparkSession, path: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema("answer_id string, text string").option("maxFilesPerTrigger", files).json(path)


def claim_stream(answers: DataFrame, method: str = "regex") -> DataFrame:
    return claims(answers, "answer_id", "text", method).withColumn("valid", valid_span()).drop("answer_text")


def start(answers: DataFrame, out: str, checkpoint: str):
    return claim_stream(answers).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
