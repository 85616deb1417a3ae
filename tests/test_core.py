"""The core engine on small tables: sources, sentences, retrieval, evidence, verification."""

import hashlib
import json
import math
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import LOSSLESS_TILE, RULE_LAST, RULE_SENTENCE, RULE_TILE, clean_markup, strip, trimmed
from tessera.functions.vectors import dot, entropy, hash_encode, norm, softmax
from tessera.operators import evidence, lexical, ordinals, plugins, retrieval, sentences, verify
from tessera.plans import catalog
from tessera.plans.rag import Pipeline
from tessera.sources import articles, sinks
from tessera.sources.config import Config, generation_parameters

BODY = "Long enough text to pass the filter of one hundred characters. " * 3


def dump(tmp_path, pages, suffix=""):
    text = "<mediawiki>" + "".join(f"<page><title>{t}</title><id>{i}</id><revision><id>9{i}</id><text xml:space='preserve'>{x}</text></revision></page>" for i, t, x in pages) + "</mediawiki>"
    path = f"{tmp_path}/dump.xml{suffix}"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_dump_filters_limit_and_shape(spark, tmp_path):
    pages = [(1, "One Page", BODY), (2, "Redirect", "#REDIRECT [[X]]" + BODY), (3, "Y (disambiguation)", BODY), (4, "Help:Z", BODY), (5, "Short", "x"), (10, "Talk:Ok", BODY), (11, "Last", BODY)]
    read = articles.read_dump(spark, dump(tmp_path, pages))
    got = articles.articles(read).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == ["enwiki_1", "enwiki_10", "enwiki_11"]
    assert got[0].url == "https://en.wikipedia.org/wiki/One_Page"
    assert [r.doc_id for r in articles.articles(read, 2).collect()] == ["enwiki_1", "enwiki_10"]
    assert articles.counts(read).first().asDict() == {"processed": 3, "skipped": 4}
    with pytest.raises(FileNotFoundError):
        articles.read_dump(spark, f"{tmp_path}/none.xml")


def test_malformed_dump_fails(spark, tmp_path):
    path = f"{tmp_path}/bad.xml"
    with open(path, "w") as f:
        f.write("<mediawiki><page><title>a</title><id>1</id><revision><text>x</revision></page></mediawiki>")
    with pytest.raises(Exception):
        articles.read_dump(spark, path).collect()


CLEAN = [
    ("{{a{{b}}c}}", "c}}"), ("[[A|B|C]]", "B|C"), ("<ref name=a/>x<ref>y</ref>", ""), ("'''b''' ''i''", "b i"), ("[http://x.org y z] [https://q.org]", "y z"),
    ("[[File:a.png|x]]k[[Category:C]]", "kCategory:C"), ("a\n\n\n\nb ", "a\n\nb"), ("<!-- x\ny -->t<b>u</b>", "tu"), ("$1 \\2", "$1 \\2"),
]


def test_cleaner(spark):
    df = spark.createDataFrame(CLEAN, "raw string, want string")
    assert [r for r in df.select("raw", "want", clean_markup("raw").alias("got")).collect() if r.got != r.want] == []


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "T", "x", None)], schemas.ARTICLE)
    sinks.write_articles(df, f"{tmp_path}/a", "src")
    back = articles.read_articles(spark, f"{tmp_path}/a").first()
    assert (back.doc_id, back.url, back.source) == ("a", "", "src") and back.timestamp is not None
    assert articles.dataset_slice(spark.range(10), "id", 3).count() == 3 and articles.dataset_slice(spark.range(10), "id", 0).count() == 10
    shape = spark.createDataFrame([([[0.5, 0.5]],)], "logits array<array<float>>").select(sinks.logits_shape().alias("l")).first().l
    assert shape[0].asDict() == {"shape": [2], "dtype": "float32"}


def test_resume_skips_what_is_committed(spark, tmp_path):
    path, todo = f"{tmp_path}/parts", spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "k long, embedding array<float>")
    assert sinks.resume(todo, spark, path, "k", "m", 2).count() == 5
    sinks.commit(todo.filter("k < 3"), path, "m")
    assert sorted(r.k for r in sinks.resume(todo, spark, path, "k", "m", 2).collect()) == [3, 4]
    with pytest.raises(ValueError):
        sinks.resume(todo, spark, path, "k", "other", 2)


def test_config(tmp_path):
    path = f"{tmp_path}/c.yaml"
    with open(path, "w") as f:
        f.write("models: {sentence_transformer: s, generator: g}\ndata_strategy: {development: {max_articles: 7}}\nprocessing: {device: cpu, batch_size: 2}\nretrieval: {top_k: 5}\n")
    c = Config(path)
    assert c.get("retrieval.top_k") == 5 and c.models.generator == "g" and c["processing"]["device"] == "cpu" and c.get("x.y", 1) == 1
    assert c.limit("development") == 7 and c.limit("validation") == 100_000 and c.limit("production") is None
    assert generation_parameters(None, max_new_tokens=0, temperature=0.0) == {"max_new_tokens": 256, "temperature": 0.0, "top_p": 0.9, "do_sample": True}
    with open(path, "w") as f:
        f.write("models: {generator: g}\n")
    with pytest.raises(ValueError, match="Missing required configuration fields"):
        Config(path)
    with pytest.raises(FileNotFoundError):
        Config(path + "x")




def plain_claims(text):
    if not text or not text.strip():
        return []
    out = [(m.group(1).strip(), m.start(), m.end()) for m in re.finditer(r"([^.!?]+[.!?]+(?:\s+|$))", text)]
    last = out[-1][2] if out else 0
    if text[last:].strip():
        out.append((text[last:].strip(), last, len(text)))
    return out


ADVERSE = [
    "x. y. z", "v1.5 is out! Yes?? ok.", "...lead. x", "a.\n", "", "  ", "no boundary", "tail after. boundary", "é😀. q!", "\x1f a. \x1c", "First one. Second one.",
    "a..b. c", "! ! x. ", ". . .", "x.y.z. w", "a.\n\n b", None, "x" * 50_000, "a.b" * 5_000,
]


def test_claims_equal_plain_search(spark):
    df = spark.createDataFrame(list(enumerate(ADVERSE)), "answer_id long, text string")
    rows = sentences.claims(df).collect()
    for i, t in enumerate(ADVERSE):
        got = [(r.claim_text, r.char_start, r.char_end) for r in sorted((r for r in rows if r.answer_id == i), key=lambda r: r.ordinal)]
        assert got == plain_claims(t), repr(t)
    assert sentences.claims(df).filter(~sentences.valid_span()).count() == 0
    with pytest.raises(ValueError):
        sentences.claims(df, method="nope")



def test_chunks(spark):
    texts = ["This is the first sentence. This is the second sentence.", "Hi. This is a longer sentence that should be included.", "Sentence one. Sentence two. Sentence three.", "Pi is 3.14 today. v1.5 works", None, ""]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    rows = sentences.chunks(df).orderBy("doc_id", "sent_id").collect()
    assert [(r.doc_id, r.sent_id, r.text) for r in rows] == [
        ("0", 0, "This is the first sentence."), ("0", 1, "This is the second sentence."), ("1", 0, "This is a longer sentence that should be included."),
        ("2", 0, "Sentence one."), ("2", 1, "Sentence two."), ("2", 2, "Sentence three."), ("3", 0, "Pi is 3.14 today."), ("3", 1, "v1.5 works"),
    ]
    assert all(texts[int(r.doc_id)][r.char_start : r.char_end].strip() == r.text for r in rows)
    wide = sentences.chunks(df, overlap_sentences=1).filter("doc_id = '2'").orderBy("sent_id").collect()
    assert [r.text for r in wide] == ["Sentence one.", "Sentence one. Sentence two.", "Sentence two. Sentence three."]


def test_tiles_lose_nothing(spark):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab.!? \n é"), 40)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = lambda p: F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(0)), "")
    assert df.filter((whole(RULE_TILE) != F.col("text")) | (whole(LOSSLESS_TILE) != F.col("text"))).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(42)
    m = rng.standard_normal((300, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[7] = m[3]
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")


def plain_top(m, queries, k):
    out = {}
    for q in queries:
        s = np.round(m @ m[q], 9)
        out[q] = sorted(range(len(m)), key=lambda i: (-s[i], i))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_top_k_equals_brute_force(vectors):
    m, df = vectors
    q = df.filter("vec_id % 20 = 0 OR vec_id = 7")
    want = plain_top(m, [i for i in range(300) if i % 20 == 0 or i == 7], 5)
    assert found(retrieval.top_k(q, df, 5, rows=64)) == want
    assert want[7][:2] == [3, 7]
    rows = retrieval.top_k(q, df, 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r["rank"], r.score))
    assert all([x for x, _ in sorted(v)] == [1, 2, 3, 4, 5] and [s for _, s in sorted(v)] == sorted((s for _, s in v), reverse=True) for v in by.values())
    assert retrieval.top_k(q.limit(1), df.limit(3), 5).count() == 3
    assert retrieval.top_k(q.limit(0), df, 5).count() == 0


def test_inverted_file(spark, vectors, tmp_path):
    m, df = vectors
    q = df.filter("vec_id % 20 = 0")
    index = retrieval.InvertedFile.build(df, 8)
    exact = retrieval.top_k(q, df, 5)
    assert found(index.search(q, 5, probes=8)) == found(exact)
    index.write(f"{tmp_path}/index")
    again = retrieval.InvertedFile.read(spark, f"{tmp_path}/index")
    assert found(again.search(q, 5, probes=8)) == found(exact)
    assert retrieval.recall(index.search(q, 5, probes=6), exact).first().recall >= 0.9
    assert retrieval.recall(retrieval.HyperplaneIndex(df, 16, tables=40, bits=3).search(q, 5), exact).first().recall >= 0.9
    again.vectors.limit(5).drop("list_id").withColumn("list_id", F.lit(0)).write.mode("append").partitionBy("list_id").parquet(f"{tmp_path}/index/vectors")
    with pytest.raises(ValueError):
        retrieval.InvertedFile.read(spark, f"{tmp_path}/index")


def test_index_choice_and_dimension(vectors):
    assert retrieval.adapted("ivfflat", 50) == ("FLAT", 0) and retrieval.adapted("IVFFLAT", 500) == ("IVFFLAT", 22) and retrieval.adapted("HNSW", 5)[0] == "HNSW"
    with pytest.raises(ValueError):
        retrieval.adapted("TREE", 1)
    with pytest.raises(Exception, match="dimension"):
        retrieval.check_dimension(vectors[1], 3).collect()


def test_small_tables_are_searched_whole(spark, tmp_path):
    x = np.random.default_rng(6).standard_normal((60, 64))
    rows = [(i, [float(a) for a in v / np.linalg.norm(v)]) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(catalog.ivf_search(spark, str(tmp_path)).collect()) == sorted(catalog.retrieve_top5(spark, str(tmp_path)).collect())
    assert [r.recall for r in catalog.recall_report(spark, str(tmp_path)).filter("index_kind = 'ivf'").collect()] == [1.0]


def test_vectors_that_do_not_fit(spark, vectors):
    """Null vectors, those that hold a null, and those of another length neither crash nor meet the others."""
    m, df = vectors
    odd = spark.createDataFrame([(1000, None), (1001, [1.0, None]), (1002, [0.6, 0.8]), (1003, [1.0, 0.0])], "vec_id long, embedding array<double>")
    both = df.unionByName(odd)
    q = both.filter("vec_id % 20 = 0 OR vec_id > 999")
    got = found(retrieval.top_k(q, both, 5, rows=64))
    assert {k: v for k, v in got.items() if k < 1000} == plain_top(m, range(0, 300, 20), 5) and got[1002] == [1002, 1003] and 1001 not in got
    with pytest.raises(Exception, match="dimension"):
        retrieval.top_k(q, both, 5, dimension=16).collect()
    assert [r.vec_id for r in retrieval.search_one(spark, m[40], df, 3).orderBy("rank").collect()] == plain_top(m, [40], 3)[40]


def test_hyperplanes_lose_no_hit_to_repeats(spark, vectors):
    few = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).standard_normal((12, 8)))], "vec_id long, embedding array<double>")
    index = retrieval.HyperplaneIndex(few, 8, tables=40, bits=3)
    assert retrieval.recall(index.search(few, 5), retrieval.top_k(few, few, 5)).first().recall >= 0.9
    whole = retrieval.HyperplaneIndex(few, 8)
    assert (whole.bits, whole.tables) == (0, 1) and whole.compared(few) == 144


def test_hyperplanes_repeat_no_vector_for_its_buckets(spark, vectors):
    """Only hits and counts leave the tasks; the hits are the best of the rows that share a bucket."""
    m, df = vectors
    q = df.filter("vec_id % 20 = 0")
    index = retrieval.HyperplaneIndex(df, m.shape[1], tables=3, bits=4)
    met = np.zeros((15, len(m)), dtype=int)
    for p in index.planes:
        side = m @ p.T > 0
        met += (side[::20, None] != side).sum(axis=2) <= 1
    assert index.compared(q) == met.sum()
    hits = index.search(q, 5)
    score = np.where(met > 0, np.round(m[::20] @ m.T, 9), -np.inf)
    assert found(hits) == {20 * i: [int(j) for j in np.lexsort((np.arange(len(m)), -s))[:5] if s[j] > -np.inf] for i, s in enumerate(score)}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan


def test_added_rows_are_found(vectors):
    m, df = vectors
    index = retrieval.InvertedFile.build(df.filter("vec_id < 200"), 6).add(df.filter("vec_id >= 200"))
    q = df.filter("vec_id % 20 = 0")
    assert found(index.search(q, 5, probes=6)) == plain_top(m, range(0, 300, 20), 5)
    assert index.compared(q, 6) == 15 * 300 > index.compared(q, 1)


def test_offsets_in_linear_time(spark):
    n = 64_000
    df = spark.createDataFrame([("a", "One two. " * n)], "doc_id string, text string")
    spark.createDataFrame([("b", "One two. " * 10)], df.schema).select(F.size(sentences.lossless_sentences("text"))).first()
    began = time.time()
    last = df.select(F.element_at(sentences.lossless_sentences("text"), -1).alias("s")).first().s
    assert (last.start, last.end) == (9 * (n - 1), 9 * n) and time.time() - began < 4
    assert sentences.chunk_text(spark, "First sentence here. Second one there.").count() == 2


def test_chunks_and_vectors_come_back(spark, tmp_path):
    own = sentences.chunks(spark.createDataFrame([("a", "First sentence here. Second one there.")], "doc_id string, text string"))
    sinks.write_chunks(own, f"{tmp_path}/chunks")
    with open(f"{tmp_path}/chunks/part-x.json", "w") as f:
        f.write('{"doc_id": "b", "text"\n{"doc_id": null, "text": "x"}\n')
    good, bad = articles.read_chunks(spark, f"{tmp_path}/chunks")
    assert sorted(good.collect()) == sorted(own.collect())
    assert sorted(r.line[:13] for r in bad.collect()) == ['{"doc_id": "b', '{"text":"x"}'[:13]]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sinks.write_vectors(vectors, f"{tmp_path}/v", "m") == {"model": "m", "dimension": 2, "rows": 2}
    rows, meta = sinks.read_vectors(spark, f"{tmp_path}/v")
    assert rows.count() == 2 and meta["dimension"] == 2
    with pytest.raises(ValueError, match="dimensions"):
        sinks.write_vectors(vectors.union(spark.createDataFrame([(3, [1.0])], vectors.schema)), f"{tmp_path}/w", "m")
    df, seen = sinks.observed(vectors, "written", wide=F.count_if(F.size("embedding") > 1))
    began = time.time()
    df.write.parquet(f"{tmp_path}/seen")
    facts = sinks.log_observed(seen, began, f"{tmp_path}/log.txt")
    assert (facts["rows"], facts["wide"]) == (2, 2) and "rows_per_second" in open(f"{tmp_path}/log.txt").read()


CONFIG = """
models: {sentence_transformer: none, generator: shouting}
data: {articles: "%s/{strategy}"}
data_strategy: {development: {max_articles: 1}}
processing: {device: cpu, batch_size: 4, min_sentence_length: 12}
retrieval: {top_k: 2}
generation: {max_new_tokens: 3, temperature: 0.5}
"""


def test_pipeline_from_configuration(spark, tmp_path):
    class Shouting(plugins.ExtractiveGenerator):
        name = "shouting"

        def answer(self, df, evidence_texts="evidence_texts"):
            return super().answer(df, evidence_texts).withColumn("draft_response", F.upper("draft_response"))

    plugins.register("generator", "shouting", Shouting())
    with pytest.raises(ValueError):
        plugins.register("generator", "shouting", Shouting())
    with pytest.raises(ValueError):
        plugins.register("painter", "x", None)
    docs = spark.createDataFrame([("a", "T", "Cats sleep all day long. Too short. Dogs bark at night loudly.", "u"), ("b", "T", "Dogs bark at noon, every day.", "u")], schemas.ARTICLE)
    sinks.write_articles(docs, f"{tmp_path}/development", "src")
    path = f"{tmp_path}/config.yaml"
    with open(path, "w") as f:
        f.write(CONFIG % tmp_path)
    plan = Pipeline.from_config(spark, path)
    assert plan.k == 2 and plan.corpus.count() == 2  # one article, two sentences that are long enough
    q = spark.createDataFrame([(1, "dogs bark"), (2, " "), (3, "cats " * 600)], "query_id long, text string")
    got = {r.query_id: r for r in plan.records(q).collect()}
    g = got[1].generator_metadata
    assert got[1].draft_response == g.text == "DOGS BARK AT" and g.tokens == ["DOGS ", "BARK ", "AT "] and len(g.token_ids) == 3 and g.scores == [1.0] * 3
    assert g.evidence_used == ["a", "a"] == got[1].retrieval_metadata.evidence_doc_ids and g.generation_config.asDict()["model_name"] == "shouting" and g.generation_config.temperature == 0.5
    pair = got[1].claim_evidence_pairs[0]
    assert pair.claim_text == "DOGS BARK AT" and len(pair.evidence_candidates) == 2 and pair.top_evidence == pair.evidence_candidates[0] and pair.answer_char_span == [0, 12]
    assert got[2].retrieval_metadata.num_retrieved == 0 and got[2].retrieval_metadata.top_score == 0.0 and got[2].generator_metadata.evidence_used == []
    assert len(got[3].generator_metadata.prompt_text.split()) == 512
    sinks.write_results(plan.records(q), f"{tmp_path}/out")
    lines = [json.loads(x) for p in os.listdir(f"{tmp_path}/out") if p.endswith(".json") for x in open(f"{tmp_path}/out/{p}")]
    assert {x["query_id"] for x in lines} == {1, 2, 3} and set(lines[0]) == {"query_id", "query", "draft_response", "claim_evidence_pairs", "generator_metadata", "retrieval_metadata"}
    with pytest.raises(ValueError):
        Pipeline.from_config(spark, path, "unheard")


def test_rollup_rerank_and_single_encoding(spark):
    pairs = spark.createDataFrame([("c", 0.9, 0.1), ("c", 0.2, 0.7), ("c", None, None), ("d", None, None)], "claim_id string, nli_entail double, nli_contradict double")
    got = {r.claim_id: r for r in verify.entailment_rollup(pairs).collect()}
    assert (got["c"].pairs, got["c"].max_entailment_prob, got["c"].max_contradiction_prob, got["c"].entailment_ratio) == (3, 0.9, 0.7, 0.5) and got["d"].entailment_ratio is None
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3)], "query_id long, vec_id long, score double, rank int")
    assert [r.vec_id for r in retrieval.rerank(hits, (F.col("vec_id") % 2).cast("double"), 2).orderBy("rank").collect()] == [11, 10]
    v = plugins.encode_single(spark, plugins.HashEncoder(), "a b a")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9
    ids = {r.answer_id for r in sentences.claims(spark.createDataFrame([("One. Two.",), ("Three.",)], "text string"), None).collect()}
    assert ids == {hashlib.sha256(t.encode()).hexdigest() for t in ("One. Two.", "Three.")}
    total = sentences.claim_total(sentences.claims(spark.createDataFrame([("x", "One. Two."), (None, "Three.")], "answer_id string, text string"))).first()
    assert (total.answers, total.claims, total.avg_claims) == (2, 3, 1.5)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], "the cat the")], "a array<float>, b array<float>, t string")
    r = df.select(dot("a", "b").alias("d"), norm("a").alias("n"), softmax("b").alias("p"), entropy(softmax("b")).alias("e"), hash_encode("t").alias("h"), norm(hash_encode(F.lit("..."))).alias("z")).first()
    p = np.exp([1.0, 2.0]) / np.exp([1.0, 2.0]).sum()
    assert (r.d, r.n, r.z) == (11.0, 5.0, 0.0) and np.allclose(r.p, p) and abs(r.e + (p * np.log(p)).sum()) < 1e-12
    assert abs(sum(x * x for x in r.h) - 1) < 1e-12 and len(r.h) == 64


def test_lexical(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, "blue")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "Red fox!"), (8, "")], "item_id long, text string")
    rows = lexical.bm25(q, docs, "item_id", "doc_id").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(9, 1, 1), (9, 2, 2)]
    idf = lambda df: math.log((4 - df + 0.5) / (df + 0.5) + 1)
    tf = lambda n, size: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / 1.5))
    assert abs(rows[0].score - round(idf(2) * tf(1, 2) + idf(1) * tf(1, 2), 6)) < 1e-6 or rows[0].doc_id == 2


def test_hybrid_ranks_all_documents(spark):
    """A document of the query's main word has 30 documents before it in BM25; one query shares no token with any."""
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(["red", "fox", *rng.choice(["w1", "w2", "w3", "w4"], int(rng.integers(6, 12)))])) for i in range(30)]
    texts += [(40, "red"), (41, None), (42, "..."), (43, "blue " * 40), (44, "blue")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    q = spark.createDataFrame([(7, "Red red red red fox"), (8, "zebra"), (9, "")], "item_id long, text string")
    sums = lexical.bm25(q, docs, "item_id", "doc_id", k=1000).select("query_id", "doc_id", F.col("score").alias("bm25"), F.col("rank").alias("lexical"))
    pairs = q.select(F.col("item_id").alias("query_id"), hash_encode("text").alias("qv")).crossJoin(docs.select("doc_id", hash_encode("text").alias("dv"))).join(sums, ["query_id", "doc_id"], "left")
    pairs = pairs.select("query_id", "doc_id", F.round(dot("qv", "dv"), 6).alias("dense"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("lexical", F.lit(99)).alias("lexical"))
    every = pairs.withColumn("hybrid", F.round(lexical.hybrid(F.col("dense"), F.col("bm25")), 6)).collect()
    want = [r for k in (7, 8, 9) for r in sorted((r for r in every if r.query_id == k), key=lambda r: (-r.hybrid, r.doc_id))[:5]]
    assert max(r.lexical for r in want if r.query_id == 7) > 20
    for rows in (lexical.BLOCK, 8):
        got = lexical.hybrid_top_k(q, docs, "item_id", "doc_id", rows=rows).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.doc_id, r.dense, r.bm25, r.hybrid) for r in got] == [(r.query_id, r.doc_id, r.dense, r.bm25, r.hybrid) for r in want]
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] * 3


def test_prompt_and_pairs(spark):
    q = spark.createDataFrame([(1, "Q?", ["a", "b"]), (2, "R?", []), (3, "S?", None)], "query_id long, q string, texts array<string>")
    got = [r.p for r in q.orderBy("query_id").select(evidence.prompt("q", "texts").alias("p")).collect()]
    assert got == ["Context: [1] a [2] b\n\nQuestion: Q?\n\nAnswer:", "Question: R?\n\nAnswer:", "Question: S?\n\nAnswer:"]
    claims = sentences.claims(spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "answer_id long, text string"))
    ev = spark.createDataFrame([(1, 2, "d#2", "y"), (1, 1, "d#1", "x")], "answer_id long, rank int, evidence_id string, text string")
    rows = evidence.pairs(claims, ev).orderBy("answer_id", "ordinal").collect()
    assert [r.evidence_candidates for r in rows] == [["d#1", "d#2"]] * 2 + [[]] and [r.top_evidence for r in rows] == ["d#1", "d#1", ""]
    hits = spark.createDataFrame([(1, 5, 0.5, 1), (1, 5, 0.4, 2)], "query_id long, doc_id long, score double, rank int")
    meta = {r.query_id: r for r in evidence.retrieval_metadata(q.select("query_id"), hits, 5).collect()}
    assert (meta[1].num_retrieved, meta[1].top_score, meta[1].evidence_doc_ids) == (2, 0.5, "5,5") and (meta[2].num_retrieved, meta[2].top_score, meta[2].evidence_doc_ids) == (0, 0.0, "")
    assert evidence.unmatched(spark.range(3), spark.range(1, 4), "id").count() == 2


def test_pipeline_end_to_end(spark):
    docs = spark.createDataFrame([(1, "Cats sleep all day long. Dogs bark at night loudly."), (2, "The moon circles the earth slowly.")], "doc_id long, text string")
    q = spark.createDataFrame([(10, "Do dogs bark at night?"), (11, "   "), (12, "moon earth")], "query_id long, text string")
    plan = Pipeline.from_documents(docs, k=2)
    got = {r.query_id: r for r in plan.answer(q).collect()}
    assert got[10].evidence[0].text.startswith("Dogs bark") and got[11].num_retrieved == 0 and got[11].draft_response == "No evidence found."
    rows = plan.run(q).collect()
    assert {r.answer_id for r in rows} == {10, 11, 12} and all(r.claim_text for r in rows)
    assert json.dumps([r.asDict(True) for r in rows])


def test_verification(spark):
    df = spark.createDataFrame([(1, "In Paris 3 cats sat", "3 cats sat in Paris", None), (1, "It has 5 legs", "It has 4 legs", None), (1, "Nothing here", "other words", None), (2, "x", "x", 0.9)], "answer_id long, claim string, ev string, contradict double")
    out = verify.decide(df, verify.token_coverage("claim", "ev"), F.col("contradict"), verify.numeric_check("claim", "ev"))
    assert [r.status for r in out.collect()] == ["Supported", "Contradictory", "Low Confidence", "Contradictory"]
    s = {r.answer_id: r for r in verify.summary(out).collect()}
    assert all(r.supported_high + r.supported_low + r.contradicted + r.insufficient == r.claims_total for r in s.values())
    assert [r.m for r in out.select(verify.mitigated("status", "claim").alias("m")).collect()] == ["In Paris 3 cats sat", "[removed]", "[unverified] Nothing here", "[removed]"]
    steps = spark.createDataFrame([([[0.5, 0.5], [0.9, 0.1]], [0, 1, 0], ["a b", "a b", "c"])], "p array<array<double>>, ids array<int>, samples array<string>")
    r = steps.select(verify.aligned_scores("p", "ids").alias("s"), verify.aligned_scores("p", "ids", True).alias("l"), verify.mean_entropy("p").alias("e"), verify.self_agreement("samples").alias("v")).first()
    assert r.s == [0.5, 0.9] and r.l == [0.5, 0.1] and abs(r.e - (math.log(2) - 0.9 * math.log(0.9) - 0.1 * math.log(0.1)) / 2) < 1e-12 and abs(r.v - 2 / 9) < 1e-12
    gold = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "g boolean, f boolean")
    assert verify.detector_metrics(gold, F.col("g"), F.col("f")).first().f1 == 0.5


def test_ordinals(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long").repartition(5)
    assert [(r.k, r.ordinal) for r in ordinals.with_ordinal(df, "k").orderBy("k").collect()] == [(i, i) for i in range(101)]
    assert sorted(r.k for r in ordinals.systematic(df, 3, "k").collect()) == [0, 50, 100] and ordinals.systematic(df, 500, "k").count() == 101


def test_plug_ins(spark):
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    encoder = plugins.BatchEncoder(lambda: lambda texts: [[float(len(t))] for t in texts], 1, "length")
    assert [r.v for r in df.select(encoder.column("text").alias("v")).collect()] == [[3.0], [0.0]]
    assert plugins.NoDetector().compute_signal(df).first().nli_entail is None
    assert schemas.struct(schemas.PAIR).fieldNames()[0] == "claim_id"
    with pytest.raises(ValueError, match="must have exactly 2 elements"):
        schemas.check_span([1])


def test_streaming_equals_batch(spark, tmp_path):
    from tessera.streaming import scoring

    rows = [(str(i), t) for i, t in enumerate(ADVERSE[:12]) if t is not None]
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/a.json", "w") as f:
        f.write("\n".join(json.dumps({"answer_id": a, "text": t}) for a, t in rows))
    scoring.start(scoring.read_answers(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted(r.claim_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sentences.claims(spark.createDataFrame(rows, "answer_id string, text string"), method="regex")
    assert got == sorted(r.claim_id for r in want.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab.!? \n é")), max_size=40))
def test_rule_tiles_mean_the_plain_search(text):
    """The tiles' alternatives, read by Python's engine, against finditer."""
    space = r"\s"
    tile = RULE_TILE.replace("[" + RULE_TILE.split("(?:[")[1].split("]++")[0] + "]", space).replace(r"\z", r"\Z")
    pieces, at, got = re.findall(tile, text), 0, []
    for i, p in enumerate(pieces):
        whole = re.match(r"^[^.!?]+[.!?]+\s+\Z", p) or (i == len(pieces) - 1 and re.match(RULE_LAST.replace("$", r"\Z"), p))
        if whole:
            got.append((at, at + len(p)))
        at += len(p)
    assert at == len(text) and got == [(m.start(), m.end()) for m in re.finditer(r"[^.!?]+[.!?]+(?:\s+|\Z)", text)]
    assert RULE_SENTENCE.startswith("^")


def test_strip_is_pythons(spark):
    texts = ["\x1f a ", "　x  ", " \t\n", "a b", "\x85z\x1c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(strip("t").alias("s")).collect()] == [t.strip() for t in texts]
    assert [r.s for r in df.select(trimmed("t").alias("s")).collect()] == [t.strip() for t in texts]


def test_search_in_slices_and_tiles_is_exact(spark, vectors, monkeypatch):
    """Queries in many slices, rows in small tiles, vectors that are not finite, huge or equal, and a row that must not find itself."""
    m, df = vectors
    odd = spark.createDataFrame([(900, [float("nan")] * 16), (901, [float("inf")] * 16), (902, [0.0] * 16), (None, [1.0] * 16), (903, [1e20] + [0.0] * 15)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(retrieval, "CELLS", 16 * 4)
    monkeypatch.setattr(retrieval, "TILE", (3, 7))
    q = df.filter("vec_id % 20 = 0 OR vec_id = 7")
    got = found(retrieval.top_k(q, df.unionByName(odd.filter("vec_id < 903")), 5, rows=7))
    whole, rows = np.vstack([m, np.zeros(16)]), [*range(300), 902]
    plain = lambda i, own: sorted((r for r in rows if own or r != i), key=lambda r: (-np.round(whole[rows.index(r)] @ m[i], 9), r))[:5]
    assert got == {i: plain(i, True) for i in [*range(0, 300, 20), 7]}
    assert found(retrieval.top_k(q, df, 5, rows=7, skip_self=True)) == {i: plain(i, False) for i in [*range(0, 300, 20), 7]}
    assert found(retrieval.top_k(odd.filter("vec_id = 903"), df.unionByName(odd), 2))[903][0] == 903
    index = retrieval.InvertedFile.build(df, 8)
    centres = np.array([r.centre for r in index.centres.orderBy("list_id").collect()])
    own = {r.vec_id: r.list_id for r in index.vectors.collect()}
    near = {i: set(np.argsort(-(centres @ m[i]), kind="stable")[:3]) for i in got}
    assert found(index.search(q, 5, probes=3)) == {i: sorted((r for r in own if own[r] in near[i]), key=lambda r: (-np.round(m[r] @ m[i], 9), r))[:5] for i in got}
    assert index.compared(q, 3) == sum(own[r] in near[i] for i in got for r in own)


def test_hash_matrix_equals_the_column(spark):
    texts = ["", "  ", None, "Cats, cats & DOGS 42", "İstanbul 3K Été Σ", "a" * 500 + " b\x00c\nd", "  x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", hash_encode("text").alias("v")).orderBy("i").collect()
    assert np.array_equal(np.array([r.v for r in rows]), plugins.HashEncoder().batch(pa.array(texts)))


def test_keys_follow_document_and_sentence(spark):
    """Ids that are numbers, are none, are missing or come twice: every chunk has a key of its own, in the order of ids."""
    docs = spark.createDataFrame([("10", "Birds sing at dawn. Birds sing at dawn."), ("9", "Birds sing at dawn."), ("x", "Birds sing at dawn."), ("9", "Fish swim in the sea.  Birds sing at dawn. "), (None, "Birds sing at dawn."), ("8", None)], "doc_id string, text string")
    plan = Pipeline.from_documents(docs, k=7)
    rows = plan.corpus.orderBy("chunk_key").collect()
    assert len({r.chunk_key for r in rows}) == 7 and [r.doc_id for r in rows] == [None, "x", "9", "9", "9", "10", "10"]
    hits = plan.retrieve(spark.createDataFrame([(1, "birds sing at dawn")], "query_id long, text string")).orderBy("rank").collect()
    assert len(hits) == 7 and [h.chunk_key for h in hits[:6]] == sorted(r.chunk_key for r in rows if r.text.startswith("Birds")) and {h.text for h in hits[:6]} == {"Birds sing at dawn."}


def test_texts_are_encoded_where_they_are_searched(spark):
    """One Arrow batch of more texts than are encoded at once; copies tie."""
    own = spark.range(5000).coalesce(1).select(F.col("id").alias("vec_id"), F.concat(F.lit("word"), (F.col("id") * 7 % 1900).cast("string"), F.lit(" and number "), (F.col("id") % 300).cast("string")).alias("embedding"))
    encoder = plugins.HashEncoder()
    plain = own.select("vec_id", encoder.column("embedding").alias("embedding"))
    q = plain.filter("vec_id % 500 = 0")
    assert found(retrieval.top_k(q, own, 5, encode=encoder.batch)) == found(retrieval.top_k(q, plain, 5)) != {}
