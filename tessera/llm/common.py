"""What the operators share: tables in the shared folder, shipping code, whole-row helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts of the text operators define it.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one
    of its own, and a cluster is refused, as its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[sc.applicationId]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs no recomputation. ``drop`` removes it."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_tessera_path", None):
            jvm = t.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(t._tessera_path)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
            t._tessera_path = None


_caches: dict[str, list] = {}


def remember(operator: str, cache) -> None:
    """Names a worker's cache (anything with clear) as an operator's."""
    _caches.setdefault(operator, []).append(cache)


def claim(operator: str) -> None:
    """Empties what other operators left in this worker: a reused worker holds one operator's memory at a time."""
    held = [cache for name, own in _caches.items() if name != operator for cache in own if len(cache)]
    for cache in held:
        cache.clear()
    if held:
        gc.collect()
    release()


def release() -> None:
    """Gives memory that is free in this worker back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of an Arrow batch where the session has Spark's own default: a batch of texts then takes a few megabytes.
BATCH_ROWS = 1000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, wherever the driver imported it from, and bounds
    the rows of an Arrow batch where the session does not."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    sc: SparkContext = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(), "tessera_code.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column has it in upper or lower case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def free_prefix(columns: list[str], name: str) -> str:
    """The name with so many underscores before it that no column begins with it."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


