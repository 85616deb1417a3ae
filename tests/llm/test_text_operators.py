"""Exact dedup, near dedup, BPE, token files, personal data and language identification on small tables."""

import base64
import hashlib
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, langid, minhash, naming, pii, queries, token_files
from tessera.llm.chunks import ChunkEncoder
from tessera.llm.common import fresh_dir

RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [
    (1, "a  b\tc d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "   "), (6, LONG), (7, LONG + " tail"), (8, LONG.replace(" ", "\n")),
    (9, "short one"), (9, "short one"), (None, "short one"), (None, None), (10, "A B C D E F G"), (11, "é😀 ünï 日本語 word"), (12, "x" * 9000), (13, "x" * 9001),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With null, empty and very long texts, ties, repeated rows, and columns whose names results use."""
    rows = [(i, t, None, "s", None) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"kept": F.lit("mine"), "name": F.lit(1), "class": F.lit(2), "bands": F.lit(3), "key": F.lit(4), "host": F.lit(5), "uid": F.lit(6)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def plain_groups():
    by = {}
    for i, t in TEXTS:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}


def test_exact_groups_equal_plain_grouping(docs, none):
    want = sorted(repr((i, *plain_groups()[n], hashlib.sha256(n.encode()).hexdigest())) for i, t in TEXTS for n in [re.sub(r"[\x20\x09-\x0D]+", " ", t or "")])
    for block in (naming.BLOCK, 1000):
        rows = naming.exact_groups(docs, block=block).collect()
        assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == want
        assert sum(r.kept for r in rows) == len(plain_groups())
    assert naming.exact_groups(none).count() == 0


def test_exact_dedup_keeps_columns(docs):
    out = naming.deduplicate(docs)
    assert out.columns == docs.columns
    assert out.count() == len(plain_groups())


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_of(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, (_, a)), (y, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(y)] = find(x)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(repr((i, len(s), least.get(find(x)))) for x, (i, s) in enumerate(sets))


def test_near_groups_equal_brute_force(docs, none):
    rows = minhash.near_groups(docs).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in rows) == components_of(TEXTS)
    assert minhash.near_groups(none).count() == 0
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns


def test_near_dedup_with_repeated_and_missing_ids(spark):
    """An id that stays for one text does not bring back its other texts; near copies without an id leave one."""
    rng = np.random.default_rng(8)
    a, b, c = (" ".join(rng.choice([f"t{i}" for i in range(400)], 80)) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (None, c), (None, c + " more"), (None, b + " more"), (None, ""), (3, None), (3, "")]
    got = [(r.doc_id, r.text) for r in minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(repr((i, t)) for i, t in got if t) in ([repr((1, a)), repr((2, b)), repr((None, x))] for x in (c, c + " more"))
    assert sorted(repr(i) for i, t in got if not t) == ["3", "None"]


def test_near_chains_and_large_groups(spark):
    """Chains of edits, whose ends are far apart, and a dense group that shares a passage but no links."""
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(400)]
    base, rows = list(rng.choice(words, 120)), []
    for i in range(60):  # each differs from the one before in one word
        rows.append((i + 1, " ".join(base)))
        base[int(rng.integers(0, 120))] = f"new{i}"
    passage = list(rng.choice(words, 60))
    rows += [(100 + i, " ".join(passage + list(rng.choice(words, 60)))) for i in range(60)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == components_of(rows)


def test_bands_meet_at_the_threshold():
    """Sets at a similarity of 0.75 share a band practically always; both ends of a permutation are kept."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        x = rng.integers(0, 2**63, 140, dtype=np.uint64)
        a, b = minhash.bands([np.unique(x[:120]), np.unique(x[17:137])])
        missed += not (a == b).any()
    assert minhash.bands([np.arange(1, 9, dtype=np.uint64)]).shape == (1, 2 * minhash.HASHES // minhash.ROWS)
    assert missed == 0


def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ORACLE = oracle()
ADVERSE = ["", " ", "  x", " \n b\t\tc  ", "it's don't 'll", "a" * 5000, "ab" * 3000, "\x1c \x1dfoo", "a\u0085 b", " \u3000x", "<|endoftext|>", "日本語 " * 40, "trail ", "1 22 333,4.5", "é😀" * 70]


def encode(text):
    _, encoder = bpe.coder(open(RANKS, "rb").read(), P.PATTERN)
    return encoder.encode([text])[0].tolist()


@pytest.mark.parametrize("text", ADVERSE)
def test_bpe_equals_library(text):
    assert encode(text) == ORACLE.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c.,'\n\t0é日\u00a0\x1c\u2028stl")), max_size=80))
def test_bpe_equals_library_on_random_texts(text):
    assert encode(text) == ORACLE.encode_ordinary(text)


def test_bpe_of_a_table(docs, none):
    out = bpe.encode_decode(docs.withColumn("decoded", F.lit(1)), RANKS, P.PATTERN)
    for r in out.collect():
        assert np.frombuffer(r.ids_le, dtype="<u4").tolist() == ORACLE.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    assert out.columns.count("decoded") == 1
    assert bpe.encode_decode(none, RANKS, P.PATTERN).count() == 0


def test_idle_workers_remember_no_words(spark):
    """Spark keeps workers after their tasks: what each holds then counts for its executor."""
    docs = spark.range(0, 64, 1, 8).select(F.concat_ws(" ", F.lit("some words"), F.col("id")).alias("text"))
    assert bpe.encode_decode(docs, RANKS, P.PATTERN).filter("decoded = CAST(text AS BINARY)").count() == 64

    def held(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.known) for _, e in bpe._coders.values())] * len(batch), pa.int64())], names=["n"])

    assert spark.range(0, 16, 1, 16).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_token_files_read_back(spark, docs, none):
    out = fresh_dir(spark, "test")
    manifest = token_files.write(docs, out, P.path("byte_bpe_50k.json"), P.PATTERN, 0, 50_257)
    got = token_files.read(spark, out).collect()
    want, start, library = [], 0, Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]])):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.token_ids) for r in got) == [(s, i, n, c, x) for i, s, n, c, x in want]
    assert manifest["n_tokens"] == start and manifest["dtype"] == "<u2"
    empty = fresh_dir(spark, "test")
    assert token_files.write(none, empty, P.path("byte_bpe_50k.json"), P.PATTERN, 0, 50_257)["n_docs"] == 0
    assert token_files.read(spark, empty).count() == 0


CONTENT = open(P.path("byte_bpe_50k.json"), "rb").read()


def check_against_library(texts):
    """Each text's ids, encoded in one run and alone, as the library's plain call gives them."""
    plain, encoder = Tokenizer.from_str(CONTENT.decode()), token_files.coder(CONTENT, P.PATTERN)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert [encoder.encode([t])[0].tolist() for t in texts] == want


def test_added_tokens_equal_library():
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n\n y <|endoftext", "none", "", "<|endoftext|> 12  <|endoftext|>é😀"]
    assert Tokenizer.from_str(CONTENT.decode()).encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    check_against_library(texts)


def test_token_files_equal_library_on_adverse_texts():
    check_against_library([*ADVERSE, "tab\tx  \t y", " ", "a ", " a", "x  y z", "ab " * 700_000, "x" * 100_000])
    check_against_library(["plain words, without. anything else", "two of them"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab c.,'\n\t0é日\u00a0\x1c\u2028stl")), max_size=60), min_size=1, max_size=4))
def test_token_files_equal_library_on_random_texts(texts):
    check_against_library(texts)


def test_token_files_equal_library_on_a_table():
    check_against_library([t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()])


def test_forgetting_changes_nothing():
    texts = [" ".join(f"w{k * n}x, y{n}." for k in range(200)) for n in range(9)]
    encoder = token_files.coder(CONTENT, P.PATTERN)
    want = [encoder.encode([t])[0].tolist() for t in texts]
    small = ChunkEncoder(encoder.inner.encode_words, P.PATTERN, limit=50)
    assert [small.encode([t])[0].tolist() for t in texts] == want


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            bad = {"ip": any(int(x) > 255 for x in m[0].split(".") if kind == "ip"), "card": not (16 <= len(d) <= 19 and luhn(d)), "phone": not 8 <= len(d) <= 15}
            if not bad.get(kind):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    None, "", "a@b.c_d@e.f", "x@y.z@w.q", "x@y@w.q 1.2.3.4.5.6.7.8.9", "é😀 ab@c.de 😀+1 (017) 555-7713", "4111 1111 1111 1111 and 4111-1111-1111-1112", "256.1.1.1 001.002.003.255",
    "+12345678 +1-2 +1 (((( 2", "call 555-123-4567 Dr. John Smith 123-45-6789 foo (at) bar (dot) com", "1 " * 20000, "a." * 20000 + "@x.com", "a@" + "b." * 20000 + "c", "9" * 50000, "plain words only",
]


def test_personal_data(spark, none):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PERSONAL)], "doc_id long, text string, all_spans string")
    out = pii.find(df).select("doc_id", pii.joined("base_spans").alias("base"), pii.joined("all_spans").alias("all")).collect()
    for r in out:
        want = base_spans(PERSONAL[r.doc_id] or "")
        assert r.base == ",".join(want)
        assert r["all"].startswith(r.base)
    assert [r["all"] for r in out if PERSONAL[r.doc_id] == "plain words only"] == [""]
    assert pii.find(none).count() == 0


def planted(rng):
    """A text with personal data at known places, and one without."""
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) for _ in range(n))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    dni = rng.randrange(10**7, 10**8)
    rest = f"{rng.randrange(10**18):018d}"
    iban = f"DE{98 - int(rest + '131400') % 97:02d}{rest}"
    what, before, found, after = rng.choice([
        ("secret", 'token = "', hexes, '"'), ("secret", "api_key: ", "sk_" + hexes[:28] + "X9", ""), ("secret", "password=", "aB3" + hexes[:24], ""),
        ("iban", "account ", iban, ","), ("iban", "IBAN ", " ".join(iban[i : i + 4] for i in range(0, 22, 4)), ""), ("ipv6", "from host ", "2001:db8::" + hexes[:4], ""),
        ("national_id", "", f"{dni}{'TRWAGMYFPDXBNJZSQVHLCKE'[dni % 23]}", "."), ("private_key", "", "-----BEGIN RSA PRIVATE KEY-----\n" + hexes + "\n-----END RSA PRIVATE KEY-----", ""),
        ("name", "dear ", rng.choice(["Mary Miller", "Hans Gruber", "Dr. Ada Byron"]), ","), ("email_spelt", "write to ", "jo.doe (at) mail (dot) org", ""),
    ])
    left = words(rng.randrange(3, 30)) + " é😀 "
    text = f"{left}{before}{found}{after} {words(9)}"
    clean = f"{words(5)} at 12:30:45 ratio 3:4, path https://x.org/a/b-c-d/{words(1)}_and_so_on_and_on, {words(4)} a-very-long-hyphenated-word-chain DE12 3456 Section Title ISBN 978-3-16-148410-0 {words(3)}"
    return text, f"{what}:{len(left) + len(before)}:{len(left) + len(before) + len(found)}", clean


def test_added_spans_are_those_planted(spark):
    rng = random.Random(4)
    rows = [planted(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "mine") for i, (t, _, _) in enumerate(rows)] + [(1000 + i, c, "mine") for i, (_, _, c) in enumerate(rows)], "doc_id long, text string, _t string")
    got = {r.doc_id: r for r in pii.find(df.withColumns({"_c": F.lit("mine"), "_digit": F.lit(1), "pii_t": F.lit(2)})).select("*", pii.joined("all_spans").alias("all")).collect()}
    caught = sum(want in got[i]["all"].split(",") for i, (_, want, _) in enumerate(rows))
    more = sum(got[i]["all"] not in ("", want) for i, (_, want, _) in enumerate(rows))
    assert caught >= 0.95 * len(rows) and more <= 0.02 * len(rows)
    assert {got[1000 + i]["all"] for i in range(len(rows))} == {""}
    assert got[0]["_t"] == got[0]["_c"] == "mine" and got[0]["pii_t"] == 2


def test_vote_table_is_bounded(spark):
    """However many shapes the texts have, a feature has ten values at most."""
    rows = [(i, "+1" + "".join("(). -"[(i >> k) % 5] + str(k % 10) for k in range(0, 2 + i % 12))) for i in range(3000)]
    values = pii.candidates(spark.createDataFrame(rows, "i int, text string"), "text").select(F.explode("_c").alias("x"))
    assert all(n <= 10 for n in values.agg(*(F.count_distinct(f"x.{f}") for f in pii.FEATURES)).first())


def test_places_in_linear_time(spark):
    text = "a@b.co " * 60_000
    began = time.time()
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base_spans").alias("n"), F.expr("base_spans[59999]").alias("x")).first()
    assert (r.n, r.x.start, r.x.end) == (60_000, 7 * 59_999, 7 * 59_999 + 6) and time.time() - began < 60


def test_expectation_maximisation_finds_the_reliable_labeller():
    rng = np.random.default_rng(3)
    truth, counts = rng.random(4000) < 0.4, {}
    for y in truth:
        votes = tuple(int((1 if y else -1) * (1 if rng.random() < p else -1)) for p in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    prior, rel, _ = pii.expectation_maximisation(counts)
    assert abs(prior - 0.4) < 0.06
    assert rel[0][1][1] > rel[2][1][1] + 0.15


WORDS = {"en": "the of and in that house with water", "de": "der und das ist nicht haus mit wasser", "fr": "le les des maison avec dans une eau"}


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    return [(" ".join(rng.choice(WORDS[lang].split(), 12)), lang) for _ in range(n) for lang in WORDS]


def test_language_held_out_accuracy_and_rejection(spark, none):
    model = langid.train(sentences(80, 1))
    found = [model.predict(t)[0] == lang for t, lang in sentences(50, 2)]
    assert np.mean(found) > 0.97
    again = langid.train(sentences(80, 1))
    assert (again.table == model.table).all()
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, WORDS["de"]), (5, WORDS["fr"] * 20000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "de", "fr"]
    assert [got[i].rejected for i in range(1, 6)] == [True, True, True, False, False]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert langid.predict(df, langid.train([])).filter("lang_pred <> 'und'").count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    """Rows without an id, and repeated rows, take no more of the sample than others; every language has its share."""
    rows = [(None if i % 2 else i, f"text {i} of {lang}", lang) for i in range(1000) for lang in WORDS] + [(None, "again", "en")] * 500
    seen = []
    monkeypatch.setattr(langid, "train", seen.extend)
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=90)
    assert {lang: sum(x[1] == lang for x in seen) for lang in WORDS} == dict.fromkeys(WORDS, 30)
    assert len(set(seen)) == 90 and 20 < sum(int(t.split()[1]) % 2 for t, _ in seen if t != "again") < 70


def test_many_languages_and_long_rows(spark, monkeypatch):
    """More languages than are learned, or than are folded into one table; long rows are sampled over their whole length."""
    rows = [(i, f"word{lang}x word{lang}y " * 9, f"l{lang:03d}") for lang in range(90) for i in range(1 + (lang < 70))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=80)
    assert len(model.languages) == 80 and model.head is not None and all(f"l{k:03d}" in model.languages for k in range(70))
    assert model.predict("word5x")[0] in model.languages
    long = spark.createDataFrame([("a" * 30_000 + "b" * 30_000 + "c" * 9,)], "text string").select(langid.sampled("text").alias("t")).first().t
    assert len(long) <= langid.SAMPLE_CHARS and long.endswith("c" * 9) and 0.45 < long.count("a") / len(long) < 0.55


def test_score_is_calibrated():
    """Among predictions of about a score, about that part is right: on held-out texts."""
    model = langid.train(sentences(200, 1))
    found = [(*model.predict(text), lang) for text, lang in sentences(150, 5)]
    right = np.array([p == lang for p, _, lang in found])
    score = np.array([s for _, s, _ in found])
    assert abs(score.mean() - right.mean()) < 0.05 and ((0 <= score) & (score <= 1)).all()


def test_registered_language_query_on_a_table(spark):
    """The query's split and its accuracy on the documents that it did not learn from."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    lang = {r.doc_id: r.lang for r in rows}
    got = queries.op5_language_id(spark, sf).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99
