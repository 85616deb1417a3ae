"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domains, languages and sources in proportion to their weights. A node
that cannot use its share (its supply times the number of epochs allowed) leaves the rest to its siblings
by their weights, and only what the siblings cannot use goes to the parent's siblings. Each leaf then
takes whole epochs and, of one more epoch, the prefix of a seeded order that reaches its budget.

A token is counted as a byte of UTF-8: a byte-level vocabulary's ids are runs of bytes, whatever the script, while
words would make a Chinese or Japanese text a single token.

The prefix is found without sorting a leaf: documents fall into BINS bins of their order hash, whose running
sums name one bin at the edge; that bin's documents fall into BINS bins of the next bits, and so on until a bin
has about BIN_ROWS documents, which are summed one by one. So no window holds more than about BIN_ROWS rows of a leaf, however
large. What is left of the prefix is one threshold for each leaf, so the choice itself is a filter on each
row and no text is shuffled. The leaves are the only thing that the driver sees or broadcasts; more than
MAX_LEAVES are refused, as a budget that leaves some out would be wrong.

Defined results: a null domain, language or source is the name ``none``; a null or empty text has no tokens
and is taken with every epoch that its order reaches; weights that are missing are 1; a budget beyond all
supplies gives every document its greatest number of copies; rows that are equal in id and text share one
place in the order and are taken together; a text of any length is one document; an empty table gives an empty one;
input columns may have any name, the results' names begin with one that none has (``result_prefix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop, free_prefix

MAX_LEAVES = 100_000
BIN_ROWS = 512
BITS = 8
BINS = 1 << BITS
NONE = "none"
LEVELS = ("domain", "lang", "source")


def fill(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """Shares of a budget by weight, none beyond its capacity; what one cannot use goes to the others.
    children: weight and capacity. Whole tokens; the remainder goes to the largest fractions, then the first."""
    out, left = [0] * len(children), min(budget, sum(c for _, c in children))
    open_ = [i for i, (w, c) in enumerate(children) if c > 0 and w > 0]
    while left > 0:
        if not open_:  # only children of weight 0 can still take something
            open_ = [i for i, (_, c) in enumerate(children) if c > out[i]]
            children = [(1.0, c) for _, c in children]
        whole = sum(children[i][0] for i in open_)
        shares = {i: left * children[i][0] / whole for i in open_}
        full = [i for i in open_ if shares[i] >= children[i][1] - out[i]]
        if full:
            for i in full:
                left -= children[i][1] - out[i]
                out[i] = children[i][1]
            open_ = [i for i in open_ if i not in set(full)]
            continue
        for i in open_:
            out[i] += int(shares[i])
        rest = left - sum(int(shares[i]) for i in open_)
        for i in sorted(open_, key=lambda i: (-(shares[i] - int(shares[i])), i)):
            if rest > 0 and out[i] < children[i][1]:
                out[i] += 1
                rest -= 1
        left = rest
    return out


def allocate(supplies: dict[tuple, int], weights: dict[tuple, float], budget: int, epochs: int) -> dict[tuple, int]:
    """Budgets of the leaves. supplies: tokens by path; weights: by path or part of a path from the root (or, for a
    rule that holds at any place, by ('*', ..., name) of the same length)."""

    def weight(path: tuple) -> float:
        return weights.get(path, weights.get(("*",) * (len(path) - 1) + path[-1:], 1.0))

    out: dict[tuple, int] = {}

    def down(path: tuple, paths: list[tuple], amount: int) -> None:
        depth = len(path)
        if len(paths) == 1 and len(paths[0]) == depth:
            out[paths[0]] = amount
            return
        by: dict[tuple, list[tuple]] = {}
        for p in paths:
            by.setdefault(p[: depth + 1], []).append(p)
        names = sorted(by)
        shares = fill(amount, [(weight(n), epochs * sum(supplies[p] for p in by[n])) for n in names])
        for n, share in zip(names, shares, strict=True):
            down(n, by[n], share)

    if supplies:
        down((), sorted(supplies), min(budget, epochs * sum(supplies.values())))
    return out


def tokens(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def result_prefix(columns: list[str]) -> str:
    return free_prefix(columns, "mix_")


def mix(df: DataFrame, domain: Column, weights: dict[tuple, float], share: float, epochs: int, seed: int = 7, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """df with domain, lang, source and copies (how often the mix takes the row, 0 if it does not), each name after the prefix.
    share: the budget as a part of all tokens."""
    spark = df.sparkSession
    level = {"domain": domain, "lang": F.col(lang), "source": F.col(source)}
    path, p = list(level), result_prefix(df.columns)
    named = {n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in level.items()}
    key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    slim = cut(df.select(*(c.alias(n) for n, c in named.items()), key.alias("key"), tokens(text).alias("n")), "mix")
    rows = slim.groupBy(*path).agg(F.sum("n").alias("n"), F.count("*").alias("docs")).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    supplies = {tuple(r[p] for p in path): r["n"] for r in rows}
    budgets = allocate(supplies, weights, int(share * sum(supplies.values())), epochs)
    plan = {leaf: divmod(budgets[leaf], n) if n else (0, 0) for leaf, n in supplies.items()}
    leaves = spark.createDataFrame([(*leaf, *two) for leaf, two in plan.items()], "domain string, lang string, source string, whole long, rest long")
    cutting = slim.join(F.broadcast(leaves.filter("rest > 0")), path).withColumn("h", F.xxhash64(F.lit(seed), F.col("whole"), F.col("key"))).drop("whole", "key")
    edge, bits, most, running = None, 0, max((r["docs"] for r in rows), default=0), "sum(n) OVER (PARTITION BY domain, lang, source ORDER BY bin)"
    while most >> bits > BIN_ROWS:
        inner = cutting.withColumn("before", F.lit(0).cast("long")) if edge is None else _inside(cutting, edge, path, bits)
        bits += BITS
        bins = inner.groupBy(*path, "rest", "before", F.expr(f"shiftright(h, {64 - bits})").alias("bin")).agg(F.sum("n").alias("n"))
        upto = bins.withColumn("upto", F.col("before") + F.expr(running)).filter("upto >= rest AND upto - n < rest")
        old, edge = edge, cut(upto.select(*path, "bin", (F.col("upto") - F.col("n")).alias("before")), "edge")
        drop(old)
    inner = cutting.withColumn("before", F.lit(0).cast("long")) if edge is None else _inside(cutting, edge, path, bits)
    last = inner.groupBy(*path, "rest", "before", F.col("h").alias("bin")).agg(F.sum("n").alias("n"))
    last = last.withColumn("upto", F.col("before") + F.expr(running)).filter("upto >= rest AND upto - n < rest").groupBy(*path).agg(F.min("bin").alias("limit"))
    ends = leaves.join(last, path, "left").collect()
    drop(slim, edge)
    schema = f"{p}domain string, {p}lang string, {p}source string, {p}whole long, {p}limit long"
    ends = spark.createDataFrame([tuple(r[c] for c in (*path, "whole", "limit")) for r in ends], schema)
    out = df.withColumns({**{p + n: c for n, c in named.items()}, f"{p}key": key}).join(F.broadcast(ends), [p + n for n in path])
    taken = F.coalesce(F.xxhash64(F.lit(seed), F.col(f"{p}whole"), F.col(f"{p}key")) <= F.col(f"{p}limit"), F.lit(False)).cast("int")
    return out.select(*df.columns, *(p + n for n in path), (F.col(f"{p}whole") + taken).cast("long").alias(f"{p}copies"))


def _inside(cutting: DataFrame, edge: DataFrame, path: list[str], bits: int) -> DataFrame:
    """The documents of each leaf's bin at the edge."""
    return cutting.withColumn("bin", F.expr(f"shiftright(h, {64 - bits})")).join(F.broadcast(edge), [*path, "bin"]).drop("bin")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix of a table with these columns, each as often as it is taken."""
    p = result_prefix(columns)
    return mixed.filter(f"{p}copies > 0").withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies").cast("int")))).select(*columns)
