"""Sinks: JSON lines, committed parts with resume, and results whose logits are replaced by their shape."""

from __future__ import annotations

import json
import logging
import os
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_articles(df: DataFrame, path: str, source: str, timestamp: Column | None = None) -> None:
    out = df.withColumn("timestamp", timestamp if timestamp is not None else F.current_timestamp()).withColumn("source", F.lit(source))
    out.write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, model: str, vector: str = "embedding") -> dict:
    """Vectors and, beside them, one row that says what they are: model, dimension, rows and rows by source if there is one."""
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    written = df.sparkSession.read.parquet(f"{path}/vectors")
    facts = written.agg(F.count("*").alias("rows"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("dimension")).first()
    if facts["rows"] and facts["least"] != facts["dimension"]:
        raise ValueError(f"vectors of {facts['least']} to {facts['dimension']} dimensions")
    meta = {"model": model, "dimension": facts["dimension"] or 0, "rows": facts["rows"]}
    df.sparkSession.createDataFrame([tuple(meta.values())], "model string, dimension int, rows long").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return meta


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta, rows = spark.read.schema("model string, dimension int, rows long").json(f"{path}/metadata").first().asDict(), spark.read.parquet(f"{path}/vectors")
    if rows.count() != meta["rows"]:
        raise ValueError(f"{path} holds {rows.count()} vectors, its metadata says {meta['rows']}")
    return rows, meta


def write_results(df: DataFrame, path: str) -> None:
    """Whole records as JSON lines; null fields stay, logits are what ``logits_shape`` made of them."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """df, and counts that are taken while it is written: rows, and what else is asked for. ``log_observed`` reports them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in measures.items())), seen


def log_observed(seen: Observation, began: float, path: str | None = None) -> dict:
    """Logs what was seen and the rows in a second, to a file too if one is named."""
    took = max(1e-9, time.time() - began)
    found = dict(seen.get) | {"seconds": round(took, 3), "rows_per_second": round(seen.get["rows"] / took, 3)}
    log = logging.getLogger("tessera")
    if path and not any(getattr(h, "baseFilename", None) == os.path.abspath(path) for h in log.handlers):
        handler = logging.FileHandler(path)
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    log.info(json.dumps(found))
    return found


def resume(todo: DataFrame, spark: SparkSession, path: str, key: str, model: str, dimension: int) -> DataFrame:
    """Rows whose key no committed part holds. Parts of another model or dimension are refused."""
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # nothing committed yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return todo
    other = done.filter((F.col("model") != model) | (F.size("embedding") != dimension)).select("model", F.size("embedding").alias("d")).limit(1).collect()
    if other:
        raise ValueError(f"committed parts hold model {other[0]['model']} of dimension {other[0]['d']}, not {model} of {dimension}")
    return todo.join(done.select(key), key, "left_anti")


def commit(df: DataFrame, path: str, model: str) -> None:
    """Adds a batch of embeddings; Spark's committer makes it visible as a whole."""
    df.withColumn("model", F.lit(model)).write.mode("append").parquet(path)


def logits_shape(logits: str = "logits") -> Column:
    """What a result file keeps of logits."""
    return F.transform(F.col(logits), lambda x: F.struct(F.array(F.size(x)).alias("shape"), F.lit("float32").alias("dtype")))
