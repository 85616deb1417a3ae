"""Connected components of a link table, by contraction.

In each round every node is renamed to the least of itself and its neighbours, and the links are renamed
with it; links that become loops are gone. A node that is not the least among its neighbours disappears, so
the number of rounds grows with the logarithm of a component's size. Tables end in the shared folder after
each round. A node with very many links is one row after map-side aggregation, and where its links are
joined, both sides are exchanged from files, so that Spark's skew handling can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop


def least_neighbour(links: DataFrame) -> DataFrame:
    """node, least: of itself and its neighbours, for each node of links u, v."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("least"))


def renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links between the new names, each once, without loops."""
    one = links.join(names.select(F.col("node").alias("u"), F.col("least").alias("a")), "u")
    two = one.join(names.select(F.col("node").alias("v"), F.col("least").alias("b")), "v")
    return two.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """links: u, v of any one ordered type, each link once or more, in any direction; null ends and loops are ignored.
    Returns node, root for each node that has a link: root is the least node reachable. No links give no rows."""
    now = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v"), "links")
    roots = None
    while True:
        names = cut(least_neighbour(now), "names")
        if roots is None:
            roots = names.select("node", F.col("least").alias("root"))
            roots._tessera_path = None
            held = names
        else:
            joined = roots.join(names.select(F.col("node").alias("root"), "least"), "root", "left")
            after = cut(joined.select("node", F.coalesce("least", "root").alias("root")), "roots")
            drop(held)
            roots = held = after
        left = cut(renamed(now, names), "links")
        drop(now, None if held is names else names)
        now = left
        if now.isEmpty():
            drop(now)
            return roots
