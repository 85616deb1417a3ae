"""Exact duplicates by deterministic block naming, with DataFrame functions alone.

A normalised text is cut into blocks of a fixed number of characters. The distinct blocks are sorted
and numbered; then the names of adjacent blocks are paired, the distinct pairs sorted and numbered, and
so on until each document has one name. Names are equal if and only if the texts are.

Only the distinct blocks are shuffled as text, after map-side aggregation. Their names travel back to
the documents under a 64-bit key of the block; that no two distinct blocks share a key is checked on
the blocks themselves, and a new seed is taken if they do, so nothing rests on a hash. Block tables
are cut into the shared folder, where a name stays what it was when an executor is lost. A block, pair
or text that a third of all rows share is one row after aggregation, and on the joins' other side it is
split by Spark's skew handling.

Defined results: a null text counts as empty; empty texts are equal to one another; of equal texts the
row of the smallest id stays (a null id counts as the largest; of rows equal in both, one); every row of
the input has a row in the result; texts may be of any length; an empty table gives an empty one; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, cut, drop, free, text_or_empty

BLOCK = 4096


def normalised(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), ASCII_SPACE, " ")


def blocks(text: Column, size: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(found)


def _named(table: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """The distinct rows of by, sorted within hash partitions and numbered."""
    return cut(table.groupBy(*by).agg(F.lit(1).alias("_one")).sortWithinPartitions(*by).select(*keep, F.monotonically_increasing_id().alias("name")), "names")


def _key(seed: int):
    """A block's 64-bit key. One parameter only: transform would pass an index as the second."""
    return lambda block: F.xxhash64(block, F.lit(seed))


def _must(name: str) -> Column:
    """The name of a block or pair; without one the job fails rather than lose a part of a document."""
    return F.coalesce(F.col(name), F.raise_error(F.lit("a block has no name")).cast("long"))


def identities(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """For each row: uid (a number of the row), id, text_sha256, level and name; and the tables to drop after use."""
    whole = df.select(F.col(doc_id).alias("id"), normalised(text).alias("t"))
    seed, named, slim = 0, None, None
    while True:
        key = _key(seed)
        named = _named(whole.select(F.explode(blocks(F.col("t"), block)).alias("b")), ["b"], [key(F.col("b")).alias("key")])
        if named.groupBy("key").count().filter("count > 1").isEmpty():
            break
        drop(named)
        seed += 1
    slim = cut(whole.select(F.monotonically_increasing_id().alias("uid"), "id", F.sha2("t", 256).alias("text_sha256"), F.transform(blocks(F.col("t"), block), key).alias("keys")), "slim")
    most = slim.agg(F.max(F.size("keys"))).first()[0] or 0
    now = slim.select("uid", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).join(named, "key", "left").select("uid", "n", "pos", _must("name").alias("name"))
    tables, done, level = [slim, named], [], 0
    while True:
        done.append(now.filter("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        pairs = now.filter("n > 1").groupBy("uid", "n", F.expr("pos DIV 2").cast("int").alias("pos"))
        pairs = pairs.agg(F.max(F.expr("IF(pos % 2 = 0, name, NULL)")).alias("a"), F.max(F.expr("IF(pos % 2 = 1, name, NULL)")).alias("b"))
        pairs = cut(pairs.select("uid", F.expr("CAST((n + 1) DIV 2 AS INT)").alias("n"), "pos", "a", F.coalesce("b", F.lit(-1)).alias("b")), "pairs")
        named = _named(pairs, ["a", "b"], ["a", "b"])
        now = pairs.join(named, ["a", "b"], "left").select("uid", "n", "pos", _must("name").alias("name"))
        tables += [pairs, named]
        most, level = (most + 1) // 2, level + 1
    found = done[0]
    for d in done[1:]:
        found = found.unionAll(d)
    return slim.select("uid", "id", "text_sha256").join(found, "uid"), tables


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    found, tables = identities(df, doc_id, text, block)
    rows = cut(found, "identities")
    drop(*tables)
    groups = cut(rows.groupBy("level", "name").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select(
        F.col("id").alias(doc_id),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        "text_sha256",
    )


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names."""
    own_id, kept, sha = free(df.columns, "id", "kept_sha", "sha")
    stay = exact_groups(df, doc_id, text, block).filter("kept").select(F.col(doc_id).alias(own_id), F.col("text_sha256").alias(kept))
    own = df.withColumn(sha, F.sha2(normalised(text), 256))
    both = own.join(stay, F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(kept)), "left_semi")
    return both.dropDuplicates([doc_id, sha]).drop(sha)
