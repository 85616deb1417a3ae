"""BM25 over tokens, and its mix with dense scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.functions.vectors import hash_encode
from tessera.shipping import ship

K1 = 1.2
B = 0.75
DECIMALS = 6
#: Rows of a block, and columns of the vocabulary that are multiplied at once.
BLOCK = 2048
COLUMNS = 2048


def _terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(text))).alias("term"))


def _weights(terms: DataFrame, docs: DataFrame, doc_id: str, text: str, k1: float, b: float) -> DataFrame:
    """doc_id, term, w: what each of the queries' tokens adds to a document's score."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("t"))
    whole = sized.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
    words = sized.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term"))
    words = words.join(terms.select("term").distinct(), "term", "left_semi")
    tf = words.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(whole))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return weighted.select("doc_id", "term", weight.alias("w"))


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text: str = "text", k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents for each query's distinct tokens; ties to the smaller id.
    Only tokens of the queries are shuffled; document counts and lengths come from all documents."""
    terms = _terms(queries, query_id, text)
    scored = _weights(terms, docs, doc_id, text, k1, b).join(terms, "term")
    scored = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), DECIMALS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid(dense: Column, lexical: Column, weight: float = 0.5) -> Column:
    """Weighted sum; a lexical score is squashed to [0, 1) first."""
    squashed = F.coalesce(lexical, F.lit(0.0)) / (F.coalesce(lexical, F.lit(0.0)) + 10)
    return weight * F.coalesce(dense, F.lit(0.0)) + (1 - weight) * squashed


def _rounded(x: np.ndarray) -> np.ndarray:
    """Half up on the decimal value, as Spark rounds; x is not negative."""
    return np.floor(x * 10**DECIMALS + 0.5 + 1e-9) / 10**DECIMALS


def _sums(q_size: np.ndarray, q_terms: pa.Array, d_size: np.ndarray, d_terms: pa.Array, d_w: np.ndarray) -> np.ndarray:
    """BM25 of every query with every document: the products over the queries' vocabulary, some columns at a time."""
    vocabulary = pc.unique(q_terms)
    q_at = pc.index_in(q_terms, value_set=vocabulary).to_numpy(zero_copy_only=False)
    known = pc.index_in(d_terms, value_set=vocabulary)
    held = pc.is_valid(known).to_numpy(zero_copy_only=False)
    d_at, d_w = known.drop_null().to_numpy(zero_copy_only=False), d_w[held]
    q_of, d_of = np.repeat(np.arange(len(q_size)), q_size), np.repeat(np.arange(len(d_size)), d_size)[held]
    out = np.zeros((len(q_size), len(d_size)))
    for a in range(0, len(vocabulary), COLUMNS):
        has, weight = np.zeros((len(q_size), COLUMNS)), np.zeros((len(d_size), COLUMNS))
        some = (q_at >= a) & (q_at < a + COLUMNS)
        has[q_of[some], q_at[some] - a] = 1
        some = (d_at >= a) & (d_at < a + COLUMNS)
        np.add.at(weight, (d_of[some], d_at[some] - a), d_w[some])
        out += has @ weight.T
    return out


def hybrid_top_k(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text: str = "text", k: int = 5, weight: float = 0.5, rows: int = BLOCK) -> DataFrame:
    """query_id, doc_id, dense, bm25, hybrid, rank: the k best of all documents with an id by the weighted sum; ties to
    the smaller id. Every query meets every document, in blocks: the cosine of the hashed encodings is one matrix
    product, the full BM25 sum another (0 where no token is shared), and a pair of blocks leaves k rows a query."""
    ship(queries.sparkSession)
    terms = _terms(queries, query_id, text)
    held = _weights(terms, docs, doc_id, text, K1, B).groupBy("doc_id").agg(F.collect_list(F.struct("term", "w")).alias("ws"))
    own = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), hash_encode(text).alias("v")).join(held, "doc_id", "left")
    ws = F.coalesce("ws", F.expr("CAST(array() AS array<struct<term: string, w: double>>)"))
    asked = queries.select(F.col(query_id).alias("query_id"), hash_encode(text).alias("v"), F.array_distinct(tokens(text)).alias("ts"))

    def gathered(df: DataFrame, n: int, key: str, name: str, columns: dict[str, Column]) -> DataFrame:
        """Blocks of about so many rows, dealt by a hash of the key; n: how many tokens each row has."""
        one = F.struct(F.col(key).cast("long").alias("id"), *(c.alias(m) for m, c in columns.items()))
        dealt = df.select(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // rows)))).alias("b"), one.alias("x")).groupBy("b").agg(F.collect_list("x").alias("r"))
        flat = [F.col(f"r.{m}") if m == "n" else F.flatten(f"r.{m}") for m in columns]
        return dealt.select(F.col("r.id").alias(f"{name}_id"), *(c.alias(f"{name}_{m}") for c, m in zip(flat, columns, strict=True)))

    q = gathered(asked, queries.count(), "query_id", "q", {"v": F.col("v"), "ts": F.col("ts"), "n": F.size("ts")})
    d = gathered(own, docs.count(), "doc_id", "d", {"v": F.col("v"), "ts": ws["term"], "w": ws["w"], "n": F.size(ws)})

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                x = {n: batch.column(n)[i].values for n in batch.schema.names}
                qid, did, qn, dn = (np.asarray(x[n], dtype=np.int64) for n in ("q_id", "d_id", "q_n", "d_n"))
                qv, dv = (np.asarray(x[n], dtype=np.float64).reshape(len(ids), -1) for n, ids in (("q_v", qid), ("d_v", did)))
                dense = _rounded(qv @ dv.T)
                sums = _rounded(_sums(qn, x["q_ts"], dn, x["d_ts"], np.asarray(x["d_w"], dtype=np.float64)))
                both = _rounded(weight * dense + (1 - weight) * (sums / (sums + 10)))
                by_id = np.argsort(did, kind="stable")
                top = by_id[np.argsort(-both[:, by_id], axis=1, kind="stable")[:, :k]]
                found = [np.take_along_axis(m, top, axis=1).ravel() for m in (dense, sums, both)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, top.shape[1])), pa.array(did[top].ravel()), *map(pa.array, found)], names=["query_id", "doc_id", "dense", "bm25", "hybrid"])

    found = d.crossJoin(q).mapInArrow(run, "query_id long, doc_id long, dense double, bm25 double, hybrid double")
    order = Window.partitionBy("query_id").orderBy(F.col("hybrid").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
