"""The core queries: each takes (spark, sf_dir) and works on whole tables. Search queries are the rows whose id is
divisible by 20, against all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clean_markup, tokens
from tessera.functions.vectors import entropy, hash_encode, norm, normalised, softmax
from tessera.operators import evidence, lexical, ordinals, retrieval, sentences, verify
from tessera.plans.rag import Pipeline
from tessera.sources import articles

EVERY = 20
K = 5


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# retrieval


def _asked(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    return rows.filter(F.col("vec_id") % EVERY == 0), rows


def _hits(df: DataFrame) -> DataFrame:
    return _longs(df.withColumn("score", F.round("score", 6)), "rank")


def retrieve_top5(spark, sf):
    return _hits(retrieval.top_k(*_asked(spark, sf), K))


def retrieve_single(spark, sf):
    rows = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    return _hits(retrieval.top_k(rows.filter("vec_id = 0"), rows, 10))


def retrieve_exclude_self(spark, sf):
    return _hits(retrieval.top_k(*_asked(spark, sf), K, skip_self=True))


def index_self_test(spark, sf):
    hits = retrieval.top_k(*_asked(spark, sf), K)
    return hits.filter("rank = 1").agg(F.count("*").alias("queries"), F.count_if((F.col("query_id") == F.col("vec_id")) | (F.col("score") > 0.99)).alias("found"))


def batch_report(spark, sf):
    queries, rows = _asked(spark, sf)
    hits = retrieval.top_k(queries, rows, K).groupBy("query_id").agg(F.count("*").alias("hits"), F.avg("score").alias("mean"))
    out = queries.select(F.col("vec_id").alias("query_id")).join(hits, "query_id", "left")
    return out.select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("num_hits"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("avg_score"))


def _index(rows: DataFrame) -> tuple[retrieval.InvertedFile, int, int]:
    """The index, its lists and how many of them a search probes: all where the table is worth a flat one."""
    kind, lists = retrieval.adapted("IVFFLAT", rows.count())
    lists = max(2, lists)
    return retrieval.InvertedFile.build(rows, lists), lists, lists if kind == "FLAT" else max(1, lists * 3 // 4)


def ivf_full_probe_equals_flat(spark, sf):
    queries, rows = _asked(spark, sf)
    index, lists, _ = _index(rows)
    return _hits(index.search(queries, K, probes=lists))


def ivf_search(spark, sf):
    queries, rows = _asked(spark, sf)
    index, _, probes = _index(rows)
    return _hits(index.search(queries, K, probes=probes))


def lsh_search(spark, sf):
    queries, rows = _asked(spark, sf)
    return _hits(retrieval.HyperplaneIndex(rows, 64).search(queries, K))


def _recalls(spark, sf, *wanted: str) -> DataFrame:
    """Recall and the rows compared of the wanted ones: the inverted file at the probes of ivf_search and at a tenth of its lists,
    hyperplanes. The exact search runs once."""
    queries, rows = _asked(spark, sf)
    exact = ordinals.settled(retrieval.top_k(queries, rows, K))
    index, lists, probes = _index(rows)
    planes = retrieval.HyperplaneIndex(rows, 64)
    tenth = max(1, lists // 10)
    kinds = {
        "ivf": lambda: (index.search(queries, K, probes=probes), index.compared(queries, probes)),
        "ivf_tenth": lambda: (index.search(queries, K, probes=tenth), index.compared(queries, tenth)),
        "lsh": lambda: (planes.search(queries, K), planes.compared(queries)),
    }
    whole = queries.count() * rows.count()
    out = [retrieval.recall(found, exact).select(F.lit(n).alias("index_kind"), "*", F.lit(c).cast("long").alias("compared"), F.lit(whole).cast("long").alias("total")) for n in wanted for found, c in [kinds[n]()]]
    return reduce(DataFrame.unionByName, out)


def recall_report(spark, sf):
    return _recalls(spark, sf, "ivf", "ivf_tenth", "lsh")


def recall_at_k(spark, sf):
    """Do the searches reach a recall of 0.9 without more comparisons than the exact one?"""
    return _recalls(spark, sf, "ivf", "lsh").select("index_kind", "wanted", (F.col("recall") >= 0.9).alias("enough"), (F.col("compared") <= F.col("total")).alias("within"))


def index_add_equals_flat(spark, sf):
    """An index of half the rows to which the other half is added, all lists probed."""
    queries, rows = _asked(spark, sf)
    half = rows.filter("vec_id % 2 = 0")
    lists = max(2, int(half.count() ** 0.5))
    index = retrieval.InvertedFile.build(half, lists).add(rows.filter("vec_id % 2 <> 0"))
    return _hits(index.search(queries, K, probes=lists))


def rerank_top5(spark, sf):
    """The five best by inner product, in the order of how near their labels are to the query's."""
    queries, rows = _asked(spark, sf)
    label = _t(spark, sf, "embeddings").select("vec_id", "label")
    hits = retrieval.top_k(queries, rows, K).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return _longs(retrieval.rerank(hits, -F.abs(F.col("label") - F.col("own")).cast("double")), "rank", "first_rank").select("query_id", "vec_id", "first_rank", "rank")


# pages and articles


def wiki_pages(spark, sf) -> DataFrame:
    """Documents as dump pages: titles and redirects are made of the id, so that each filter has rows."""
    d, i = _t(spark, sf, "documents"), F.col("doc_id") % 10
    name = F.concat(F.lit("Page "), F.col("doc_id").cast("string"))
    title = F.when(i == 0, F.concat(F.lit("Help:"), name)).when(i == 1, F.concat(name, F.lit(" (disambiguation)"))).when(i == 2, F.lit("")).otherwise(name)
    text = F.when(i == 3, F.concat(F.lit(" \n#redirect [[X]] "), F.col("text"))).otherwise(F.col("text"))
    return d.select(F.col("doc_id").cast("string").alias("id"), title.alias("title"), text.alias("text"))


def page_filter(spark, sf):
    return articles.articles(wiki_pages(spark, sf)).select("doc_id", "title", "url", F.length("text").cast("long").alias("n_chars"))


def filter_reasons(spark, sf):
    return wiki_pages(spark, sf).groupBy(articles.reason().alias("reason")).agg(F.count("*").alias("pages"))


def extract_counts(spark, sf):
    return articles.counts(wiki_pages(spark, sf))


def clean_pages(spark, sf):
    return _t(spark, sf, "pages").select("page_id", clean_markup("html").alias("text"))


def wikitext() -> Column:
    t = F.col("text")
    return F.concat(
        F.lit("{{Infobox|a={{b}}c}}'''"), F.substring(t, 1, 40), F.lit("''' [[File:x.png|thumb|"), F.substring(t, 5, 20), F.lit("]] [[A|"), F.substring(t, 10, 15),
        F.lit("]]<ref name=a>"), F.substring(t, 3, 10), F.lit("</ref><ref name=b/> [http://x.org/y "), F.substring(t, 7, 12), F.lit("] [https://z.org]\n\n\n\n<!-- c\n -->[[B]] ''i'' <b>"), t, F.lit("</b>  "),
    )


def clean_wikitext_synth(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", clean_markup(wikitext()).alias("text"))


def article_ids(spark, sf):
    own = ordinals.with_ordinal(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return own.select("doc_id", F.format_string("wiki_%08d", "ordinal").alias("article_id"))


def dataset_slice(spark, sf):
    return articles.dataset_slice(_t(spark, sf, "documents"), "doc_id", 100).select("doc_id", "lang", "n_chars")


def systematic_sample(spark, sf):
    return ordinals.systematic(_t(spark, sf, "embeddings").select("vec_id", "label"), 50, "vec_id").select("vec_id", F.col("label").cast("long").alias("label"))


def row_agreement(spark, sf):
    a, b = _t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels").select("doc_id")
    return evidence.unmatched(a, b, "doc_id")


# sentences


def chunk_sentences(spark, sf):
    return _longs(sentences.chunks(_t(spark, sf, "documents")).drop("source", "version"), "sent_id", "char_start", "char_end")


def chunk_stats(spark, sf):
    d = _t(spark, sf, "documents")
    n = d.agg(F.count("*").alias("articles"))
    c = sentences.chunks(d).agg(F.count("*").alias("chunks"))
    return n.crossJoin(F.broadcast(c)).withColumn("avg_chunks", F.round(F.coalesce(F.try_divide("chunks", "articles"), F.lit(0.0)), 6))


def doc_char_stats(spark, sf):
    chars = F.length("text").cast("long")
    return _t(spark, sf, "documents").agg(F.count("*").alias("articles"), F.sum(chars).alias("total_chars"), F.round(F.avg(chars), 6).alias("avg_chars"))


def answers(spark, sf) -> DataFrame:
    own = _t(spark, sf, "conversations").filter("role = 'assistant'")
    return own.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text")


def _claims(spark, sf, method: str = "regex") -> DataFrame:
    return _longs(sentences.claims(answers(spark, sf), method=method), "ordinal", "char_start", "char_end")


def claims_regex(spark, sf):
    return _claims(spark, sf).select("claim_id", "answer_id", "ordinal", "claim_text", "char_start", "char_end", "extraction_method")


def claims_lossless(spark, sf):
    return _claims(spark, sf, "lossless").select("answer_id", "ordinal", "claim_text", "char_start", "char_end", "extraction_method")


def claims_tail(spark, sf):
    """The answers, each with a remainder that no boundary ends."""
    own = answers(spark, sf).withColumn("text", F.concat("text", F.lit(" and what follows has no end")))
    return _longs(sentences.claims(own), "char_start", "char_end").filter("tail AND char_start > 0").select("answer_id", "claim_text", "char_start", "char_end")


def claims_no_boundary(spark, sf):
    """The answers without any boundary: the whole text is one claim."""
    own = answers(spark, sf).withColumn("text", F.translate("text", ".!?", ",;:"))
    return _longs(sentences.claims(own), "char_start", "char_end").filter("tail AND char_start = 0").select("answer_id", "claim_text", "char_start", "char_end")


def claim_totals(spark, sf):
    return sentences.claim_total(sentences.claims(answers(spark, sf)))


def claims_without_ids(spark, sf):
    """Answers that come without an id get the hash of their text."""
    return _longs(sentences.claims(answers(spark, sf).select("text").distinct(), None), "ordinal").select("answer_id", "ordinal", "claim_text")


def claim_span_validation(spark, sf):
    own = sentences.claims(answers(spark, sf))
    return own.groupBy("answer_id").agg(F.bool_and(sentences.valid_span()).alias("valid"), F.count("*").alias("claims"))


# lexical retrieval and evidence


def _lexical(spark, sf, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = _t(spark, sf, "benchmark").filter(F.col("item_id") % EVERY == 0)
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return items, docs, lexical.bm25(items, docs, "item_id", "doc_id", k=k)


def bm25_top5(spark, sf):
    return _longs(_lexical(spark, sf)[2], "rank")


def hybrid_top5(spark, sf):
    items = _t(spark, sf, "benchmark").filter(F.col("item_id") % EVERY == 0)
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return _longs(lexical.hybrid_top_k(items, docs, "item_id", "doc_id", k=K), "rank")


def retrieval_metadata(spark, sf):
    items, _, hits = _lexical(spark, sf)
    return evidence.retrieval_metadata(items.select(F.col("item_id").alias("query_id")), hits, K)


def format_prompt(spark, sf):
    items, docs, hits = _lexical(spark, sf, 3)
    own = evidence.ranked(hits.join(docs, "doc_id").select("query_id", "rank", "text"))
    out = items.select(F.col("item_id").alias("query_id"), "text").join(own, "query_id", "left").withColumn("texts", F.col("evidence.text"))
    return out.select("query_id", evidence.prompt("text", "texts").alias("prompt"))


def claim_evidence_pairs(spark, sf):
    items, _, hits = _lexical(spark, sf)
    own = sentences.claims(items.select(F.col("item_id").alias("answer_id"), "text"))
    found = hits.select(F.col("query_id").alias("answer_id"), "rank", F.concat_ws("#", F.col("doc_id").cast("string"), F.lit("0")).alias("evidence_id"), "score")
    out = evidence.pairs(own, found)
    return out.select("claim_id", "answer_id", F.array_join("evidence_candidates", ",").alias("evidence_candidates"), "top_evidence", F.size("evidence_spans").cast("long").alias("n_evidence"))


# vectors


def vector_norms(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", F.round(norm("embedding"), 6).alias("norm"))


def l2_normalise(spark, sf):
    v = normalised(F.transform(F.col("embedding"), lambda x: x.cast("double") * 3 + 0.25))
    return _t(spark, sf, "embeddings").select("vec_id", F.posexplode(v).alias("place", "value")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


def norm_check(spark, sf):
    ok = F.abs(norm("embedding") - 1) <= 1e-5
    return _t(spark, sf, "embeddings").agg(F.count("*").alias("vectors"), F.count_if(ok).alias("unit"), F.bool_and(ok).alias("all_unit"))


def hash_encoding(spark, sf):
    v = hash_encode("text")
    out = _t(spark, sf, "documents").select("doc_id", F.size(tokens("text")).cast("long").alias("n_tokens"), v.alias("v"))
    mark = F.aggregate(F.transform(F.col("v"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("doc_id", "n_tokens", F.round(mark, 5).alias("mark"))


def softmax_probabilities(spark, sf):
    p = softmax("embedding")
    return _t(spark, sf, "embeddings").select("vec_id", F.round(F.array_max(p), 6).alias("p_max"), F.round(F.array_min(p), 6).alias("p_min"))


def token_entropy(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", F.round(entropy(softmax("embedding")), 6).alias("entropy"))


def perplexity(spark, sf):
    return _t(spark, sf, "embeddings").withColumn("p", softmax("embedding")).select("vec_id", F.round(verify.perplexity("p"), 5).alias("perplexity"))


# verification


def turns(spark, sf) -> DataFrame:
    """Each assistant turn with the user turn before it: claim and evidence."""
    c = _t(spark, sf, "conversations")
    said = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("claim"))
    asked = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    return said.join(asked, ["conv_id", "turn"])


def coverage_tokens(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", verify.token_coverage("claim", "evidence").alias("coverage"))


def coverage_numbers(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", verify.number_coverage("claim", "evidence").alias("coverage"))


def coverage_entities(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", verify.entity_coverage("claim", "evidence").alias("coverage"))


def numeric_check(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", verify.numeric_check("claim", "evidence").alias("numeric_check"))


def citation_match(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", verify.citation_match("claim", "evidence").alias("citation_match"))


def _decided(spark, sf) -> DataFrame:
    own = turns(spark, sf).withColumns({"a": verify.token_coverage("claim", "evidence"), "b": verify.citation_match("claim", "evidence")})
    support = F.round((F.coalesce("a", F.lit(0.0)) + F.col("b") * 4) / 2, 4)
    return verify.decide(own, F.least(support, F.lit(1.0)), F.lit(None).cast("double"), verify.numeric_check("claim", "evidence"))


def claim_decisions(spark, sf):
    return _decided(spark, sf).select("conv_id", "turn", "status", "band", "support_prob", "overall_confidence")


def mitigated_answer(spark, sf):
    own = _decided(spark, sf).withColumn("text", verify.mitigated("status", "claim"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return own.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("final_text"))


def entailment_rollup(spark, sf):
    """Every claim of a turn against each earlier text of its conversation, judged by token overlap."""
    c = _t(spark, sf, "conversations")
    said = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("claim"))
    before = c.select("conv_id", F.col("turn").alias("earlier"), F.col("text").alias("evidence"))
    pairs = said.join(before, "conv_id").filter("earlier < turn").withColumn("claim_key", F.concat_ws("#", "conv_id", "turn"))
    pairs = pairs.withColumns({"nli_entail": verify.token_coverage("claim", "evidence"), "nli_contradict": F.when(verify.numeric_check("claim", "evidence"), 0.0).otherwise(1.0)})
    return verify.entailment_rollup(pairs, "claim_key", least=0.2)


def contradicted_claims(spark, sf):
    """Verdicts where a model's probability of contradiction speaks, and not the numbers."""
    own = turns(spark, sf).withColumns({"a": verify.token_coverage("claim", "evidence"), "n": F.pmod(F.col("turn") + F.col("conv_id"), F.lit(5))})
    out = verify.decide(own, F.coalesce("a", F.lit(0.0)), F.col("n") / 5, F.lit(True))
    return out.select("conv_id", "turn", "status", "band", "contradict_prob", "overall_confidence")


def summary_stats(spark, sf):
    return verify.summary(_decided(spark, sf), "conv_id")


def _signals(spark, sf) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "text").join(_t(spark, sf, "labels"), "doc_id")
    t, n = tokens("text"), F.length("text")
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    return d.withColumns(
        {
            "long_enough": F.when(n >= 200, 1.0).otherwise(0.0),
            "lettered": F.round(F.coalesce(F.try_divide(letters, n), F.lit(0.0)), 6),
            "varied": F.round(F.coalesce(F.try_divide(F.size(F.array_distinct(t)), F.size(t)), F.lit(0.0)), 6),
        }
    )


SIGNALS = ["long_enough", "lettered", "varied"]


def detector_metrics(spark, sf):
    own = _signals(spark, sf)
    flagged = (F.col("long_enough") + F.col("lettered") + F.col("varied")) / 3 >= 0.7
    return verify.detector_metrics(own, F.col("quality") == 1, flagged)


def ablation(spark, sf):
    return verify.ablations(_signals(spark, sf), SIGNALS, F.col("quality") == 1, 0.7)


# the whole plan


def _asking(spark, sf) -> DataFrame:
    asked = _t(spark, sf, "conversations").filter((F.col("role") == "user") & (F.col("conv_id") % EVERY == 0))
    return asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def rag_pipeline(spark, sf):
    """User turns (of the conversations whose id is divisible by 20) answered from the documents' sentences."""
    out = Pipeline.from_documents(_t(spark, sf, "documents"), k=K).run(_asking(spark, sf))
    return out.select("claim_id", "answer_id", F.col("ordinal").cast("long").alias("ordinal"), "claim_text", F.array_join("evidence_candidates", ",").alias("evidence_candidates"), "top_evidence")


def pipeline_records(spark, sf):
    """The whole record of each query, its parts laid side by side; eight new tokens at most."""
    out = Pipeline.from_documents(_t(spark, sf, "documents"), k=K, parameters={"max_new_tokens": 8, "temperature": 0.7, "top_p": 0.9, "do_sample": False}).records(_asking(spark, sf))
    g, r = F.col("generator_metadata"), F.col("retrieval_metadata")
    return out.select(
        "query_id", "query", "draft_response", F.size("claim_evidence_pairs").cast("long").alias("claims"), F.size(g["tokens"]).cast("long").alias("tokens"), F.size(g["scores"]).cast("long").alias("scores"),
        F.array_join(g["evidence_used"], ",").alias("evidence_used"), g["generation_config"]["max_new_tokens"].cast("long").alias("max_new_tokens"), r["top_k"].cast("long").alias("top_k"),
        r["num_retrieved"].cast("long").alias("num_retrieved"), F.array_join(r["evidence_doc_ids"], ",").alias("evidence_doc_ids"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        retrieve_top5, retrieve_single, retrieve_exclude_self, index_self_test, batch_report, ivf_full_probe_equals_flat, ivf_search, lsh_search, recall_at_k, recall_report, index_add_equals_flat, rerank_top5,
        page_filter, filter_reasons, extract_counts, clean_pages, clean_wikitext_synth, article_ids, dataset_slice, systematic_sample, row_agreement,
        chunk_sentences, chunk_stats, doc_char_stats, claims_regex, claims_lossless, claims_tail, claims_no_boundary, claim_totals, claims_without_ids, claim_span_validation,
        bm25_top5, hybrid_top5, retrieval_metadata, format_prompt, claim_evidence_pairs,
        vector_norms, l2_normalise, norm_check, hash_encoding, softmax_probabilities, token_entropy, perplexity,
        coverage_tokens, coverage_numbers, coverage_entities, numeric_check, citation_match, claim_decisions, contradicted_claims, entailment_rollup, mitigated_answer, summary_stats, detector_metrics, ablation,
        rag_pipeline, pipeline_records,
    )
}
