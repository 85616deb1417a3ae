"""DuckDB SQL of the core queries' rows."""

from __future__ import annotations

from tessera.functions.text import CLEANER, LOSSLESS_TILE, RULE_LAST, RULE_SENTENCE, RULE_TILE, WS
from tessera.functions.vectors import DIMENSIONS
from tessera.operators.lexical import K1, B
from tessera.sources.articles import META_PREFIXES, MIN_CHARS, URL_PREFIX


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """A Java pattern without its possessive quantifiers."""
    return pattern.replace("++", "+").replace("*+", "*")


def strip(c: str) -> str:
    return f"regexp_replace({c}, {_q(rf'\A[{WS}]+|[{WS}]+\z')}, '', 'g')"


def cleaned(c: str) -> str:
    for pattern, flags, group in CLEANER:
        flags = flags.replace("d", "")
        to = "'\\" + group + "'" if group.isdigit() else "E" + _q(group.replace("\n", "\\n")) if group else "''"
        c = f"regexp_replace({c}, {_q((f'(?{flags})' if flags else '') + pattern)}, {to}, 'g')"
    return strip(c)


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def numbers(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '[0-9]+(?:[.,][0-9]+)*')"


def entities(c: str) -> str:
    return f"regexp_extract_all(regexp_replace(coalesce({c}, ''), '^[^ ]* ?', ''), '[A-Z][a-z]+')"


def encoded(c: str) -> str:
    """List of DIMENSIONS hashed counts as a unit vector."""
    places = f"list_transform({tokens(c)}, lambda t: ('0x' || substr(md5(t), 1, 8))::bigint % {DIMENSIONS})"
    counts = f"list_transform(range({DIMENSIONS}), lambda d: len(list_filter({places}, lambda b: b = d))::double)"
    return counts


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: CASE WHEN sqrt(list_dot_product({v}, {v})) > 0 THEN x / sqrt(list_dot_product({v}, {v})) ELSE x END)"


def _top(queries: str, k: int, more: str = "") -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding::double[] AS v FROM embeddings WHERE {queries}),
s AS (SELECT q.query_id, e.vec_id, round(list_dot_product(q.v, e.embedding::double[]), 9) AS s FROM q, embeddings e {more}),
r AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= {k}"""


TOP5 = _top("vec_id % 20 = 0", 5)

PAGES = """p AS (
  SELECT doc_id::varchar AS id,
         CASE doc_id % 10 WHEN 0 THEN 'Help:Page ' || doc_id WHEN 1 THEN 'Page ' || doc_id || ' (disambiguation)' WHEN 2 THEN '' ELSE 'Page ' || doc_id END AS title,
         CASE WHEN doc_id % 10 = 3 THEN E' \\n#redirect [[X]] ' || text ELSE text END AS text
  FROM documents)"""
META = " OR ".join(f"starts_with(title, {_q(p)})" for p in META_PREFIXES)
REASON = f"""CASE WHEN NOT coalesce(length(title) > 0 AND length(text) > 0, false) THEN 'empty'
  WHEN starts_with(upper({strip('text')}), '#REDIRECT') THEN 'redirect'
  WHEN contains(lower(title), '(disambiguation)') THEN 'disambiguation'
  WHEN {META} THEN 'meta' WHEN length({strip('text')}) < {MIN_CHARS} THEN 'short' ELSE 'kept' END"""

WIKITEXT = r"""concat('{{Infobox|a={{b}}c}}''''''', substr(text, 1, 40), ''''''' [[File:x.png|thumb|', substr(text, 5, 20), ']] [[A|', substr(text, 10, 15),
  ']]<ref name=a>', substr(text, 3, 10), '</ref><ref name=b/> [http://x.org/y ', substr(text, 7, 12), E'] [https://z.org]\n\n\n\n<!-- c\n -->[[B]] ''i'' <b>'.replace('''i''', '''''i'''''), text, '</b>  ')"""


def _tiled(source: str, key: str, tile: str) -> str:
    """CTE t: key, whole text, position, piece, start and end of each piece."""
    return f"""a AS (SELECT {key}, text AS whole, regexp_extract_all(text, {_q(_re2(tile))}) AS ps FROM {source}),
u AS (SELECT {key}, whole, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM a),
t AS (SELECT *, sum(length(piece)) OVER (PARTITION BY {key} ORDER BY pos)::bigint AS e, count(*) OVER (PARTITION BY {key}) AS n FROM u)"""


CHUNKS = f"""{_tiled('documents', 'doc_id', LOSSLESS_TILE)},
c AS (SELECT doc_id::varchar AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS sent_id, {strip('piece')} AS text, e - length(piece) AS char_start, e AS char_end
      FROM t WHERE length({strip('piece')}) >= 10)"""

ANSWERS = "ans AS (SELECT conv_id * 1000 + turn AS answer_id, text FROM conversations WHERE role = 'assistant')"


def _claims(source: str, key: str = "answer_id") -> str:
    return f"""{_tiled(f"(SELECT * FROM {source} WHERE length({strip("coalesce(text, '')")}) > 0)", key, RULE_TILE)},
m AS (SELECT {key}, whole, piece, e - length(piece) AS s, e FROM t WHERE regexp_matches(piece, {_q(RULE_SENTENCE.replace('$', chr(92) + 'z'))}) OR (pos = n AND regexp_matches(piece, {_q(RULE_LAST.replace('$', chr(92) + 'z'))}))),
l AS (SELECT a.{key}, a.whole, coalesce(max(m.e), 0) AS last FROM a LEFT JOIN m USING ({key}) GROUP BY 1, 2),
z AS (SELECT {key}, {strip('piece')} AS claim_text, s AS char_start, e AS char_end, false AS tail, whole FROM m
      UNION ALL SELECT {key}, {strip('substr(whole, last + 1)')}, last, length(whole), true, whole FROM l WHERE length({strip('substr(whole, last + 1)')}) > 0),
cl AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY char_start) - 1 AS ordinal FROM z)"""


CLAIMS = f"WITH {ANSWERS}, {_claims('ans')}"

def _changed(text: str) -> str:
    """The claims of the answers with another text."""
    return f"WITH {ANSWERS.replace('text FROM', text + ' AS text FROM')}, {_claims('ans')}"


LOSSLESS_CLAIMS = f"""WITH {ANSWERS}, {_tiled(f"(SELECT * FROM ans WHERE length({strip('text')}) > 0)", 'answer_id', LOSSLESS_TILE)}
SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos) - 1 AS ordinal, {strip('piece')} AS claim_text, e - length(piece) AS char_start, e AS char_end,
       'rule_sentence_split_v2' AS extraction_method FROM t WHERE length({strip('piece')}) > 0"""


def _bm25(k: int) -> str:
    return f"""items AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0),
terms AS (SELECT DISTINCT query_id, unnest({tokens('text')}) AS term FROM items),
sized AS (SELECT doc_id, {tokens('text')} AS ts FROM documents),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM sized),
words AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM sized),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT doc_id, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * dl / mean)) AS w FROM tf JOIN df USING (term), stats),
sc AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM w JOIN terms USING (term) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {k})"""


TURNS = """tu AS (SELECT a.conv_id, a.turn, a.text AS claim, u.text AS evidence FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE a.role = 'assistant' AND u.role = 'user')"""


def _share(f) -> str:
    a, b = f("claim"), f("evidence")
    return f"round(CASE WHEN len({a}) > 0 THEN len(list_intersect(list_distinct({a}), {b}))::double / len(list_distinct({a})) END, 6)"


CITATION = f"""round(CASE WHEN len({tokens('claim')}) + len({tokens('evidence')}) = 0 THEN 0.0
  ELSE len(list_intersect(list_distinct({tokens('claim')}), {tokens('evidence')}))::double / len(list_distinct(list_concat({tokens('claim')}, {tokens('evidence')}))) END, 6)"""
NUMERIC = f"len(list_filter({numbers('claim')}, lambda x: NOT list_contains({numbers('evidence')}, x))) = 0"

DECIDED = f"""WITH {TURNS}, d0 AS (SELECT *, least(round((coalesce({_share(tokens)}, 0.0) + {CITATION} * 4) / 2, 4), 1.0) AS s, {NUMERIC} AS num FROM tu),
d AS (SELECT conv_id, turn, claim, CASE WHEN NOT num THEN 'Contradictory' WHEN s >= 0.4 THEN 'Supported' ELSE 'Low Confidence' END AS status,
  CASE WHEN NOT num THEN 'none' WHEN s >= 0.7 THEN 'High' WHEN s >= 0.4 THEN 'Low' ELSE 'none' END AS band, round(s, 6) AS support_prob, round(s, 6) AS overall_confidence FROM d0)"""

SOFTMAX = """WITH p AS (SELECT vec_id, embedding::double[] AS x FROM embeddings),
e AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM p),
s AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)"""

SIGNALS = f"""sg AS (SELECT doc_id, quality, CASE WHEN length(text) >= 200 THEN 1.0 ELSE 0.0 END::double AS a,
  round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::double / length(text) ELSE 0.0 END, 6) AS b,
  round(CASE WHEN len({tokens('text')}) > 0 THEN len(list_distinct({tokens('text')}))::double / len({tokens('text')}) ELSE 0.0 END, 6) AS c
  FROM documents JOIN labels USING (doc_id))"""
METRICS = """tp, fp, fn, tn, round((tp + tn)::double / nullif(tp + tn + fp + fn, 0), 6) AS accuracy, round(tp::double / nullif(tp + fp, 0), 6) AS "precision",
  round(tp::double / nullif(tp + fn, 0), 6) AS recall, round((2 * tp)::double / nullif(2 * tp + fp + fn, 0), 6) AS f1"""
CONFUSION = "count(*) FILTER (g AND f) AS tp, count(*) FILTER (NOT g AND f) AS fp, count(*) FILTER (g AND NOT f) AS fn, count(*) FILTER (NOT g AND NOT f) AS tn"

RAG = f"""WITH c AS (WITH {CHUNKS} SELECT * FROM c),
qs AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user' AND conv_id % 20 = 0),
qe AS (SELECT query_id, {encoded('text')} AS v FROM qs WHERE length({strip("coalesce(text, '')")}) > 0),
ce AS (SELECT doc_id::bigint * 16777216 + sent_id AS key, doc_id || '#' || sent_id AS ev, text, {encoded('text')} AS v FROM c),
sc AS (SELECT query_id, key, ev, text, round(CASE WHEN list_sum(qe.v) = 0 OR list_sum(ce.v) = 0 THEN 0.0
         ELSE list_dot_product(qe.v, ce.v) / (sqrt(list_dot_product(qe.v, qe.v)) * sqrt(list_dot_product(ce.v, ce.v))) END, 9) AS s FROM qe, ce),
h AS (SELECT query_id, ev, text, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM sc QUALIFY rank <= 5),
e AS (SELECT query_id AS answer_id, string_agg(ev, ',' ORDER BY rank) AS ids, max(ev) FILTER (rank = 1) AS top, max(text) FILTER (rank = 1) AS draft FROM h GROUP BY 1),
src AS (SELECT query_id AS answer_id, coalesce(draft, 'No evidence found.') AS text FROM qs LEFT JOIN e ON e.answer_id = qs.query_id),
{_claims('src')}"""

_DRAFT = f"""rtrim(list_aggregate(list_slice(regexp_extract_all(coalesce(draft, 'No evidence found.'), '\\S+\\s*'), 1, 8), 'string_agg', ''))"""
RECORDS = RAG.replace("coalesce(draft, 'No evidence found.') AS text", _DRAFT + " AS text").replace("string_agg(ev, ',' ORDER BY rank) AS ids", "string_agg(ev, ',' ORDER BY rank) AS ids, string_agg(split_part(ev, '#', 1), ',' ORDER BY rank) AS docs, count(*) AS n")
RECORDS += """, k AS (SELECT answer_id, count(*) AS claims FROM cl GROUP BY 1)
SELECT qs.query_id, qs.text AS query, src.text AS draft_response, coalesce(k.claims, 0) AS claims, len(regexp_extract_all(src.text, '\\S+')) AS tokens, len(regexp_extract_all(src.text, '\\S+')) AS scores,
  coalesce(e.docs, '') AS evidence_used, 8::bigint AS max_new_tokens, 5::bigint AS top_k, coalesce(e.n, 0) AS num_retrieved, coalesce(e.docs, '') AS evidence_doc_ids
FROM qs JOIN src ON src.answer_id = qs.query_id LEFT JOIN e ON e.answer_id = qs.query_id LEFT JOIN k ON k.answer_id = qs.query_id"""

RAG += """
SELECT sha256(answer_id || '#' || ordinal) AS claim_id, answer_id, ordinal, claim_text, coalesce(ids, '') AS evidence_candidates, coalesce(top, '') AS top_evidence FROM cl LEFT JOIN e USING (answer_id)"""

ORACLES = {
    "rag_pipeline": RAG,
    "pipeline_records": RECORDS,
    "lsh_search": TOP5,
    "index_add_equals_flat": TOP5,
    "recall_at_k": """SELECT unnest(['ivf', 'lsh']) AS index_kind, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) * least(5, (SELECT count(*) FROM embeddings)) AS wanted, true AS enough, true AS within""",
    "rerank_top5": f"""WITH h AS ({TOP5}) SELECT h.query_id, h.vec_id, h.rank AS first_rank,
        row_number() OVER (PARTITION BY h.query_id ORDER BY abs(e.label - q.label), h.rank) AS rank FROM h JOIN embeddings e USING (vec_id) JOIN embeddings q ON q.vec_id = h.query_id""",
    "contradicted_claims": f"""WITH {TURNS}, d AS (SELECT conv_id, turn, coalesce({_share(tokens)}, 0.0) AS s, ((turn + conv_id) % 5) / 5 AS c FROM tu)
        SELECT conv_id, turn, CASE WHEN c >= 0.5 THEN 'Contradictory' WHEN s >= 0.4 THEN 'Supported' ELSE 'Low Confidence' END AS status,
          CASE WHEN c >= 0.5 THEN 'none' WHEN s >= 0.7 THEN 'High' WHEN s >= 0.4 THEN 'Low' ELSE 'none' END AS band, round(c, 6) AS contradict_prob, round(s * (1 - c), 6) AS overall_confidence FROM d""",
    "entailment_rollup": f"""WITH p AS (SELECT a.conv_id || '#' || a.turn AS claim_key, a.text AS claim, b.text AS evidence FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'assistant'),
        j AS (SELECT claim_key, {_share(tokens)} AS en, CASE WHEN {NUMERIC} THEN 0.0 ELSE 1.0 END::double AS co FROM p)
        SELECT claim_key, count(*) AS pairs, round(max(en), 6) AS max_entailment_prob, round(max(co), 6) AS max_contradiction_prob,
          round(count(*) FILTER (en >= 0.2)::double / nullif(count(en), 0), 6) AS entailment_ratio FROM j GROUP BY 1""",
    "retrieve_top5": TOP5,
    "retrieve_single": _top("vec_id = 0", 10),
    "retrieve_exclude_self": _top("vec_id % 20 = 0", 5, "WHERE q.query_id <> e.vec_id"),
    "ivf_full_probe_equals_flat": TOP5,
    "index_self_test": f"SELECT count(*) AS queries, count(*) FILTER (query_id = vec_id OR score > 0.99) AS found FROM ({TOP5}) WHERE rank = 1",
    "batch_report": f"SELECT query_id, count(*) AS num_hits, round(avg(s), 6) AS avg_score FROM ({TOP5.replace('round(s, 6) AS score', 's')}) GROUP BY query_id",
    "page_filter": f"""WITH {PAGES} SELECT 'enwiki_' || id AS doc_id, title, {_q(URL_PREFIX)} || replace(title, ' ', '_') AS url, length({cleaned('text')}) AS n_chars
        FROM p WHERE {REASON} = 'kept'""",
    "filter_reasons": f"WITH {PAGES} SELECT {REASON} AS reason, count(*) AS pages FROM p GROUP BY 1",
    "extract_counts": f"WITH {PAGES} SELECT count(*) FILTER ({REASON} = 'kept') AS processed, count(*) FILTER ({REASON} <> 'kept') AS skipped FROM p",
    "clean_pages": f"SELECT page_id, {cleaned('html')} AS text FROM pages",
    "clean_wikitext_synth": f"WITH w AS (SELECT doc_id, {WIKITEXT} AS w FROM documents) SELECT doc_id, {cleaned('w')} AS text FROM w",
    "article_ids": "SELECT doc_id, printf('wiki_%08d', row_number() OVER (ORDER BY doc_id) - 1) AS article_id FROM documents",
    "dataset_slice": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "systematic_sample": """WITH o AS (SELECT vec_id, label::bigint AS label, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
        SELECT vec_id, label FROM o WHERE i IN (SELECT floor(j * (n - 1) / 49)::bigint FROM range(50) r(j))""",
    "row_agreement": """SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "chunk_sentences": f"WITH {CHUNKS} SELECT * FROM c",
    "chunk_stats": f"WITH {CHUNKS} SELECT (SELECT count(*) FROM documents) AS articles, count(*) AS chunks, round(count(*)::double / (SELECT count(*) FROM documents), 6) AS avg_chunks FROM c",
    "doc_char_stats": "SELECT count(*) AS articles, sum(length(text))::bigint AS total_chars, round(avg(length(text)), 6) AS avg_chars FROM documents",
    "claims_regex": f"{CLAIMS} SELECT sha256(answer_id || '#' || ordinal) AS claim_id, answer_id, ordinal, claim_text, char_start, char_end, 'rule_sentence_split_v1' AS extraction_method FROM cl",
    "claims_lossless": LOSSLESS_CLAIMS,
    "claims_tail": f"{_changed("text || ' and what follows has no end'")} SELECT answer_id, claim_text, char_start, char_end FROM cl WHERE tail AND char_start > 0",
    "claims_no_boundary": f"{_changed("translate(text, '.!?', ',;:')")} SELECT answer_id, claim_text, char_start, char_end FROM cl WHERE tail AND char_start = 0",
    "claim_totals": f"{CLAIMS} SELECT count(DISTINCT answer_id) AS answers, count(*) AS claims, round(count(*)::double / count(DISTINCT answer_id), 6) AS avg_claims FROM cl",
    "claims_without_ids": f"WITH ans AS (SELECT DISTINCT sha256(text) AS answer_id, text FROM conversations WHERE role = 'assistant'), {_claims('ans')} SELECT answer_id, ordinal, claim_text FROM cl",
    "claim_span_validation": f"{CLAIMS} SELECT answer_id, bool_and({strip('substr(whole, char_start + 1, char_end - char_start)')} = claim_text) AS valid, count(*) AS claims FROM cl GROUP BY 1",
    "bm25_top5": f"WITH {_bm25(5)} SELECT query_id, doc_id, score, rank FROM hits",
    "hybrid_top5": f"""WITH {_bm25(5)}, ie AS (SELECT query_id, {encoded('text')} AS x FROM items), de AS (SELECT doc_id, {encoded('text')} AS y FROM documents),
        v AS (SELECT ie.query_id, de.doc_id, coalesce(sc.score, 0.0) AS bm25, x, y FROM ie CROSS JOIN de LEFT JOIN sc ON sc.query_id = ie.query_id AND sc.doc_id = de.doc_id),
        s AS (SELECT query_id, doc_id, bm25, round(CASE WHEN list_sum(x) = 0 OR list_sum(y) = 0 THEN 0.0 ELSE list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y)) END, 6) AS dense FROM v),
        h2 AS (SELECT *, round(0.5 * dense + 0.5 * (bm25 / (bm25 + 10)), 6) AS hybrid FROM s)
        SELECT query_id, doc_id, dense, bm25, hybrid, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS rank FROM h2 QUALIFY rank <= 5""",
    "retrieval_metadata": f"""WITH {_bm25(5)} SELECT i.query_id, 5::bigint AS top_k, count(h.doc_id) AS num_retrieved, coalesce(max(h.score) FILTER (h.rank = 1), 0.0) AS top_score,
        coalesce(string_agg(h.doc_id::varchar, ',' ORDER BY h.rank), '') AS evidence_doc_ids FROM items i LEFT JOIN hits h USING (query_id) GROUP BY 1""",
    "format_prompt": f"""WITH {_bm25(3)}, e AS (SELECT query_id, string_agg('[' || rank || '] ' || d.text, ' ' ORDER BY rank) AS ctx FROM hits JOIN documents d USING (doc_id) GROUP BY 1)
        SELECT query_id, CASE WHEN ctx IS NULL THEN '' ELSE 'Context: ' || ctx || E'\\n\\n' END || 'Question: ' || text || E'\\n\\nAnswer:' AS prompt FROM items LEFT JOIN e USING (query_id)""",
    "claim_evidence_pairs": f"""WITH {_bm25(5)}, src AS (SELECT query_id AS answer_id, text FROM items), {_claims('src')},
        e AS (SELECT query_id AS answer_id, string_agg(doc_id || '#0', ',' ORDER BY rank) AS ids, max(doc_id || '#0') FILTER (rank = 1) AS top, count(*) AS k FROM hits GROUP BY 1)
        SELECT sha256(answer_id || '#' || ordinal) AS claim_id, answer_id, coalesce(ids, '') AS evidence_candidates, coalesce(top, '') AS top_evidence, coalesce(k, 0) AS n_evidence FROM cl LEFT JOIN e USING (answer_id)""",
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS norm FROM embeddings",
    "l2_normalise": f"""WITH v AS (SELECT vec_id, list_transform(embedding::double[], lambda x: x * 3 + 0.25) AS v FROM embeddings), u AS (SELECT vec_id, {_unit('v')} AS u FROM v),
        e AS (SELECT vec_id, unnest(u) AS value, generate_subscripts(u, 1) - 1 AS place FROM u) SELECT vec_id, place, round(value, 6) AS value FROM e""",
    "norm_check": """WITH n AS (SELECT abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) <= 1e-5 AS ok FROM embeddings)
        SELECT count(*) AS vectors, count(*) FILTER (ok) AS unit, bool_and(ok) AS all_unit FROM n""",
    "hash_encoding": f"""WITH v AS (SELECT doc_id, len({tokens('text')}) AS n_tokens, {encoded('text')} AS c FROM documents)
        SELECT doc_id, n_tokens, round(CASE WHEN n_tokens = 0 THEN 0.0 ELSE list_dot_product(c, range(1, {DIMENSIONS + 1})::double[]) / sqrt(list_dot_product(c, c)) END, 5) AS mark FROM v""",
    "softmax_probabilities": f"{SOFTMAX} SELECT vec_id, round(list_max(p), 6) AS p_max, round(list_min(p), 6) AS p_min FROM s",
    "token_entropy": f"{SOFTMAX} SELECT vec_id, round(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)), 6) AS entropy FROM s",
    "perplexity": f"{SOFTMAX} SELECT vec_id, round(exp(-list_sum(list_transform(p, lambda v: ln(v))) / len(p)), 5) AS perplexity FROM s",
    "coverage_tokens": f"WITH {TURNS} SELECT conv_id, turn, {_share(tokens)} AS coverage FROM tu",
    "coverage_numbers": f"WITH {TURNS} SELECT conv_id, turn, {_share(numbers)} AS coverage FROM tu",
    "coverage_entities": f"WITH {TURNS} SELECT conv_id, turn, {_share(entities)} AS coverage FROM tu",
    "numeric_check": f"WITH {TURNS} SELECT conv_id, turn, {NUMERIC} AS numeric_check FROM tu",
    "citation_match": f"WITH {TURNS} SELECT conv_id, turn, {CITATION} AS citation_match FROM tu",
    "claim_decisions": f"{DECIDED} SELECT conv_id, turn, status, band, support_prob, overall_confidence FROM d",
    "mitigated_answer": f"""{DECIDED} SELECT conv_id, string_agg(CASE status WHEN 'Contradictory' THEN '[removed]' WHEN 'Low Confidence' THEN '[unverified] ' || claim ELSE claim END, ' ' ORDER BY turn) AS final_text
        FROM d GROUP BY 1""",
    "summary_stats": f"""{DECIDED} SELECT conv_id, count(*) AS claims_total, count(*) FILTER (status = 'Supported' AND band = 'High') AS supported_high,
        count(*) FILTER (status = 'Supported' AND band = 'Low') AS supported_low, count(*) FILTER (status = 'Contradictory') AS contradicted,
        count(*) FILTER (status = 'Low Confidence') AS insufficient, round(avg(overall_confidence), 6) AS mean_overall_confidence FROM d GROUP BY 1""",
    "detector_metrics": f"WITH {SIGNALS}, x AS (SELECT quality = 1 AS g, (a + b + c) / 3 >= 0.7 AS f FROM sg), k AS (SELECT {CONFUSION} FROM x) SELECT {METRICS} FROM k",
    "ablation": f"""WITH {SIGNALS}, x AS (
          SELECT 'none' AS disabled, quality = 1 AS g, (a + b + c) / 3 >= 0.7 AS f FROM sg UNION ALL SELECT 'long_enough', quality = 1, (b + c) / 2 >= 0.7 FROM sg
          UNION ALL SELECT 'lettered', quality = 1, (a + c) / 2 >= 0.7 FROM sg UNION ALL SELECT 'varied', quality = 1, (a + b) / 2 >= 0.7 FROM sg),
        k AS (SELECT disabled, {CONFUSION} FROM x GROUP BY 1) SELECT disabled, {METRICS} FROM k""",
}
