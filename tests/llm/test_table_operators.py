"""Embeddings, pages, urls, mixing and the pipeline on small tables."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P

import corpus_pipeline
from tessera.llm import bpe, cover_tree, html_text, langid, minhash, mixing, naming, pii, url_filter
from tessera.llm.components import components
from tessera.llm.queries import MIX_EPOCHS, MIX_WEIGHTS, URL_RULES, source_domain

SMALL = "/root/testdata/sf0.001"


def brute_vectors(rows, cosine=0.93):
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], n[i], least[find(i)]) for i, r in enumerate(rows))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + 0.13 * rng.standard_normal(8))], i % 2) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)] + [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, rows[0][1], None), (304, [1.0, None], 0), (305, [1.0, 2.0], 0), (306, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("mine")).withColumn("v", F.lit(1))
    for chunk in (1024, 20):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_vectors(df, chunk=chunk).collect())
        assert got == brute_vectors(rows)
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def test_clustered_vectors_below_the_square(spark, monkeypatch):
    """20,000 vectors in clusters, one of them with a fifth of all: the links of brute force, for a part of its comparisons."""
    rng = np.random.default_rng(5)
    of = np.where(rng.random(20_000) < 0.2, 0, rng.integers(0, 400, 20_000))
    centres = rng.standard_normal((400, 16))
    x = np.float32(centres[of] + 0.15 * rng.standard_normal((20_000, 16)))
    label = (np.arange(20_000) % 5 == 0).astype(int)
    rows = [(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    report = {}
    found = cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), report=report)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for k in (0, 1):
        at = np.nonzero(label == k)[0]
        near = unit[at] @ unit[at].T >= 0.93
        assert [got[i][0] for i in at.tolist()] == (near.sum(axis=1) - 1).tolist()
        least = at.copy()
        while True:
            after = np.array([least[row].min() for row in near])
            if (after == least).all():
                break
            least = after
        assert [got[i][1] for i in at.tolist()] == least.tolist()
    assert sum(n for n, _ in got.values()) > 1_000_000
    assert report["vectors"] == 20_000 and report["compared"] < 0.25 * report["pairs"], report


def test_few_pivots_and_labels_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "PIVOTS", 6)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(3) + 2).tolist(), int(rng.integers(0, 3) ** 2)) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, float(i % 4)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_vectors(df, chunk=16).collect())
    assert got == brute_vectors(rows)


def test_cover_tree_is_nested_and_covers():
    x = np.random.default_rng(0).standard_normal((200, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, before = cover_tree.Tree(x, 0.05), set()
    for k, (centres, radii, _, of) in enumerate(tree.levels):
        assert before <= set(centres.tolist())
        before = set(centres.tolist())
        away = np.sqrt(np.maximum(0, 2 - 2 * (x * x[centres[of]]).sum(axis=1)))
        assert (away <= radii[of] + 1e-7).all() and (radii <= 2 / 2**k + 1e-7).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>m</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="page has-sidebar"><main><article><header><h1>Title &lt; &amp;amp</h1></header><p><b>One<br>
two<p>Three &#233;<ul><li>a<li>b</ul><div class="share">share me</div><table><tr><td>c1<td>c2</table><section id="comments"><p>nice</p></section></article></main>
<aside>side</aside></div><form>f</form><footer>foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title < &amp\nOne two\nThree é\na\nb\nc1\nc2"
    assert html_text.main_text("") == "" and html_text.main_text("<article>x &amp y<art") == "x & y"
    assert html_text.main_text("a < b <p title=it's>q</p>") == "a < b\nq"
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"


#: The contract's list, case by case: page and text.
CASES = {
    "menus": ("<ul class=menu><li>m</ul><div id=nav-main>n</div><div role=navigation>r</div><article>x</article><p>outside", "x"),
    "no article": ("<ul class=menu><li>m</ul><nav>n</nav><menu><li>k</menu><h1>T</h1><p>x", "T\nx"),
    "headers": ("<header>h</header><div class=site-header>s</div><article><header><h1>T</h1></header>x</article>", "T\nx"),
    "footers": ("<h1>T</h1><p>x<footer>f</footer><div class='page-footer'>g</div>", "T\nx"),
    "sidebars": ("<aside>a</aside><h1>T</h1><div class='left sidebar'>s</div><p>x", "T\nx"),
    "notices": ("<div class=cookie-notice>c</div><div role=alert>a</div><h1>T</h1>x", "T\nx"),
    "adverts": ("<article><h1>T</h1><div class=ad-slot-300x250><h1>Buy</h1>now</div><p>x</p></article>", "T\nx"),
    "adverts with the first heading": ("<div class=ad><h1>Buy</h1></div><p>long enough text here<p>x", "long enough text here\nx"),
    "comments with a heading": ("<article><h1>T</h1>x</article><div class=comment><h1>r</h1><p>reader comment</p></div>", "T\nx"),
    "comments below": ("<h1>T</h1><p>some longer text of the page<div class=comment><h1>r</h1><p>reader comment</div>", "T\nsome longer text of the page"),
    "comments as articles": ("<article><h1>T</h1>x y z</article><section id=comments><article>r</article><article class=comment>s</article></section>", "T\nx y z"),
    "forms": ("<article>x<form>f <input value=v><select><option>o</select></form><textarea>t</textarea></article>", "x"),
    "a form around the page": ("<body><form id=aspnetForm><article><h1>T</h1>x</article><form>y</form></form></body>", "T\nx"),
    "a form around a page without article": ("<form><h1>T</h1><p>many words of text here<button>b</button></form>", "T\nmany words of text here"),
    "scripts and styles": ("<article>x<script>s</script><style>p{}</style><noscript>n</noscript>y</article>", "xy"),
    "parts of a name": ("<article><div class=social-history><p>Real prose.</div><div class=has-sidebar>More.</div></article>", "Real prose.\nMore."),
    "articles outside main": ("<main><h1>T</h1></main><article>x</article>", "T\nx"),
    "main around articles": ("<main>m<article>x</article></main>", "m\nx"),
    "an open head": ("<html><head><title>t</title><body><p>x", "x"),
    "text after an open head": ("<head><title>t</title>x", "x"),
    "lists and tables": ("<article><h1>T1</h1><p>Text 1.</p><ul><li>Shared step</li></ul><dl><dt>a<dd>b</dl><table><tr><td>c</table><figure><figcaption>d</figcaption></figure></article>", "T1\nText 1.\nShared step\na\nb\nc\nd"),
    "references and white space": ("<article> a&nbsp;&amp;\t b &#x41;&eacute; <br>c <pre>d\n  e</pre></article>", "a & b Aé c\nd e"),
    "a class on the article": ("<body class='sidebar-right no-comments'><main class='content has-sidebar'><p>x</p></main></body>", "x"),
}


@pytest.mark.parametrize("case", CASES)
def test_contract_cases(case):
    assert html_text.main_text(CASES[case][0]) == CASES[case][1]


def site(host, n, frame):
    return [(f"{host}-{i}", f"https://{host}.example/{i}", frame.format(i=i, text=f"<p>Story {i} of {host}.</p><p>It ends.</p>")) for i in range(n)]


def test_templates_alone_find_the_text(spark):
    """Sites without telling tags or classes: only what recurs tells frame from text."""
    frames = {
        "a": "<body><div><a href=/>Home</a> <a href=/x>Contact</a></div><div>{text}</div><div>All rights reserved</div></body>",
        "b": "<body><table><tr><td><div class=c1><ul><li>One<li>Two</ul></div><td><div class=c2>{text}</div><td><div>Join us</div></table></body>",
        "c": "<body><section><div>Top</div><div><p>Most read</p><p>Number {i}</p></div></section><div>{text}</div></body>",
    }
    rows = [r for h, f in frames.items() for r in site(h, 30, f)]
    rows += [(f"mirror-{i}", "https://a.example/0", rows[0][2]) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r for r in html_text.extract(df, templates="n_templates").collect()}
    for h, gone in (("a", 2), ("b", 2), ("c", 1)):
        for i in range(30):
            text = f"Story {i} of {h}.\nIt ends."
            r = got[f"{h}-{i}"]
            assert (r.text, r.n_templates) == (f"Most read\nNumber {i}\n{text}" if h == "c" else text, gone)
    assert got["mirror-3"].text == got["a-0"].text
    alone = {r.page_id: r for r in html_text.extract(df.filter("page_id IN ('a-0', 'a-1', 'a-2')"), templates="n_templates").collect()}
    assert alone["a-1"].n_templates == 0 and alone["a-1"].text.startswith("Home Contact\nStory 1")


def test_pages_with_clashing_columns_and_edges(spark):
    names = ["_host", "host", "_one", "one", "_two", "_subs", "subs", "sub", "_page", "page", "n", "pages", "article", "text"]
    long = "<article>" + "<p>word</p>" * 100_000 + "</article>"
    rows = [(None, None), ("x", None), (None, "<p>a</p>"), ("https://h/1", long), ("https://h/1", long)]
    rows += [(f"https://h{i}/", "<div>same</div><p>t") for i in range(50)]
    df = spark.createDataFrame(rows, "url string, html string").select("*", *(F.lit("mine").alias(n) for n in names))
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r[n] == "mine" for r in got for n in names[:-1])
    texts = [r.text for r in got]
    assert texts.count("") == 2 and texts.count("\n".join(["word"] * 100_000)) == 2 and texts.count("same\nt") == 50
    assert html_text.extract(df, page="text", text="text").select("text").distinct().count() == 1


def test_templates_go_and_shared_passages_stay(spark):
    body = "<body><div class=box><p>Join our club of {h}</p></div><div><p>Text {i}</p><p>shared line</p></div></body>"
    rows = [(i, f"https://h{i % 2}.example/{i}", body.format(h=i % 2, i=i)) for i in range(40)]
    rows += [(99, None, None), (98, "x", ""), (97, "https://h0.example/0", rows[0][2]), (96, "https://z.example/", "<article>" + "<p>same</p>" * 3 + "</article>")]
    rows += [(200 + i, "https://z.example/", "<article><p>same</p></article>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("sub", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(got[i] == f"Text {i}\nshared line" for i in range(40))
    assert got[99] == got[98] == "" and got[97] == got[0] and got[96] == "same\nsame\nsame" and got[215] == "same"
    assert html_text.extract(df.limit(0)).count() == 0


def test_near_copies_keep_their_body(spark):
    """The same body, list and table on many pages of a host that differ in menu, title or date."""
    body, shared = "<div><p>One long body</p><p>that all copies carry</p></div>", "<ul><li>a</ul><table><tr><td>c</table>"
    frames = {
        "a": "<body><div class=x><p>Club</p></div><h1>Title {i}</h1>" + body + shared + "</body>",
        "b": "<body><div class=top><h1>Title</h1><span>day {i}</span></div>" + body + shared + "</body>",
        "c": "<body><div><p>menu {i}</p></div><article><h1>T</h1><p>{i}</p>" + body + shared + "</article></body>",
        "d": "<head><title>{i}</title></head><body><nav>{i}</nav>" + body + shared + "</body>",
    }
    text = "One long body\nthat all copies carry\na\nc"
    want = {"a": "Title {i}\n" + text, "b": "Title\nday {i}\n" + text, "c": "T\n{i}\n" + text, "d": text}
    rows = [(h, i, f"https://{h}.example/{i}", f.replace("{i}", str(i))) for h, f in frames.items() for i in range(20)]
    for r in html_text.extract(spark.createDataFrame(rows, "h string, i long, url string, html string")).collect():
        assert r.text == want[r.h].replace("{i}", str(r.i))


def test_templates_go_on_large_hosts_too(spark):
    """A notice on 45 of 600 pages of a host is a template; one on 9 of them is not."""
    notice = lambda i: "<div><p>Notice</p></div>" if i < 45 else "<div><p>Rare</p></div>" if i < 54 else ""
    rows = [(i, "https://a.example/", f"<body>{notice(i)}<div><p>Text {i}</p></div></body>") for i in range(600)]
    got = {r.i: r.text for r in html_text.extract(spark.createDataFrame(rows, "i long, url string, html string")).collect()}
    assert got == {i: f"Rare\nText {i}" if 45 <= i < 54 else f"Text {i}" for i in range(600)}


URLS = {
    "https://WWW.Example.com/en/x?q": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
    "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
    "http://x.net/es": ("x.net", "/es", None, "allow"),
    "http://example.com#/en/": ("example.com", "", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
}


def test_urls(spark):
    df = spark.createDataFrame([(u, "mine") for u in URLS], "url string, verdict string")
    for r in url_filter.judge(df, url_filter.build(spark, URL_RULES)).collect():
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.url]
    assert url_filter.judge(df, url_filter.build(spark, [])).filter("verdict = 'block'").count() == 0
    assert url_filter.judge(df.limit(0), url_filter.build(spark, URL_RULES)).count() == 0


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: 7)
    digests = url_filter.Digests(url_filter.build(spark, [("a.com", "/", "allow"), ("b.com", "/", "block"), ("c.com", "/x", "block")]))
    found = digests.find([("b.com", "/"), ("c.com", "/x"), ("d.com", "/"), ("a.com", "/")])
    assert found[2] == -1 and len(set(found.tolist())) == 4
    assert [int(digests.block[k]) for k in found[[0, 1, 3]]] == [1, 1, 0]


def test_shortages_go_to_siblings_first():
    supplies = {("d1", "en", "a"): 100, ("d1", "en", "b"): 1000, ("d1", "de", "c"): 1000, ("d2", "en", "e"): 10_000}
    got = mixing.allocate(supplies, {}, 2000, 1)
    assert got == {("d1", "en", "a"): 100, ("d1", "en", "b"): 400, ("d1", "de", "c"): 500, ("d2", "en", "e"): 1000}
    got = mixing.allocate(supplies, {("d1",): 3.0}, 4000, 1)
    assert got[("d2", "en", "e")] == 1900 and sum(got.values()) == 4000
    assert mixing.allocate({}, {}, 5, 1) == {} and mixing.fill(10, [(0.0, 20), (1.0, 4)]) == [6, 4]


def plain_shares(supplies, weights, budget, epochs):
    """The budgets by another way: at each node a level is sought at which the children's min(weight * level, capacity) make the amount."""
    weight = lambda path: weights.get(path, weights.get(("*",) * (len(path) - 1) + path[-1:], 1.0))
    out = {}

    def down(path, amount):
        below = {p[: len(path) + 1] for p in supplies if p[: len(path)] == path}
        if below == {path}:
            out[path] = amount
            return
        room = {c: epochs * sum(n for p, n in supplies.items() if p[: len(c)] == c) for c in below}
        low, high = 0.0, 1e15
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(weight(c) * level, room[c]) for c in below) < amount else (low, level)
        for c in below:
            down(c, min(weight(c) * high, room[c]))

    down((), min(budget, epochs * sum(supplies.values())))
    return out


def test_budgets_equal_a_plain_search():
    rng = np.random.default_rng(3)
    for k in range(30):
        leaves = {(f"d{rng.integers(3)}", f"l{rng.integers(4)}", f"s{i}"): int(rng.integers(1, 10_000)) for i in range(25)}
        weights = {("d0",): 2.5, ("*", "l1"): 0.2, ("*", "*", "s3"): 4.0}
        budget, epochs = int(rng.integers(1, 3 * sum(leaves.values()))), 1 + k % 3
        got, want = mixing.allocate(leaves, weights, budget, epochs), plain_shares(leaves, weights, budget, epochs)
        assert sum(got.values()) == min(budget, epochs * sum(leaves.values())) and all(abs(got[p] - want[p]) <= 6 for p in leaves)


def test_mix_takes_prefixes_that_reach_the_budgets(spark, monkeypatch):
    """Copies equal those of sorting each leaf by the seeded order and taking documents until the rest is reached; with few
    documents in a bin the edge is found in several passes."""
    rows = [(i, "w " * (i % 7) + "日本" * (i % 3), ["en", "de", None][i % 3], f"src{i % 5}" if i % 11 else None, i) for i in range(3000)] + [(1, None, None, None, 1)] * 2
    df = spark.createDataFrame([*rows, (5000, "long " * 200_000, "en", "src1", 0)], "doc_id long, text string, lang string, source string, copies long")
    df = df.withColumns({"key": F.lit(1), "mix_copies": F.lit("mine"), "_domain": F.lit(3)})
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    for bin_rows, bits in ((512, 12), (1, 3)):
        monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
        monkeypatch.setattr(mixing, "BITS", bits)
        mixed = mixing.mix(df, source_domain(), MIX_WEIGHTS, 0.6, MIX_EPOCHS)
        rows = mixed.withColumns({"n": mixing.tokens("text"), **{f"h{w}": F.xxhash64(F.lit(7), F.lit(w).cast("long"), key) for w in range(MIX_EPOCHS + 1)}}).collect()
        leaves = {}
        for r in rows:
            leaves.setdefault((r._mix_domain, r._mix_lang, r._mix_source), []).append(r)
        supply = {k: sum(r.n for r in v) for k, v in leaves.items()}
        budgets = mixing.allocate(supply, MIX_WEIGHTS, int(0.6 * sum(supply.values())), MIX_EPOCHS)
        for k, own in leaves.items():
            whole, rest = divmod(budgets[k], supply[k])
            before, last = 0, None
            for r in sorted(own, key=lambda r: r[f"h{whole}"]):
                if before >= rest and r[f"h{whole}"] != last:
                    break
                before, last = before + r.n, r[f"h{whole}"]
                assert r._mix_copies == whole + 1
            assert last is None or sum(r._mix_copies == whole + 1 for r in own) == sum(r[f"h{whole}"] <= last for r in own)
            assert all(r._mix_copies in (whole, whole + 1) and r.mix_copies == "mine" for r in own)
    assert mixing.repeated(mixed, df.columns).columns == df.columns
    assert mixing.mix(df.limit(0), source_domain(), MIX_WEIGHTS, 0.6, MIX_EPOCHS).count() == 0


CLASHES = ["_id", "id", "_sha", "sha", "sha0", "_letter", "letter", "_host", "host", "_t", "t", "_c", "c", "pii_c", "class", "root", "node", "x", "key", "_key", "n", "name", "text_sha256", "keep_id"]


def test_operators_with_clashing_columns(spark):
    """Every operator that keeps columns keeps those that have the names of its own helpers."""
    rows = [(1, "the same words in a longer text here", "en", "src1"), (2, "the same words in a longer text here", "en", "src2"), (3, None, None, None), (4, "call +1 (017) 555-7713", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *(F.lit("mine").alias(c) for c in CLASHES))
    model = langid.train([(t, lang) for _, t, lang, _ in rows if lang] * 3 + [("ein Satz in der Sprache", "de")] * 9)
    outs = {
        "naming": (naming.deduplicate(df), 3), "minhash": (minhash.deduplicate(df), 3), "langid": (langid.predict(df, model), 4), "pii": (pii.find(df), 4),
        "mixing": (mixing.mix(df, source_domain(), {}, 0.5, 1), 4), "bpe": (bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), 4),
    }
    for name, (out, n) in outs.items():
        found = out.collect()
        assert len(found) == n and all(r[c] == "mine" for r in found for c in CLASHES), name


@pytest.mark.skipif(not glob.glob(SMALL), reason="no small tables")
def test_pipeline_stages_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "byte_bpe"]
    extra = spark.createDataFrame([(900_000, None, None, None, None), (900_001, "", "en", "src1", 0), (900_002, "12 34", None, "src1", 5)], docs.schema)
    docs, columns, sizes = docs.unionByName(extra), docs.columns, []
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SMALL)
        assert none.count() == 0 and (name == "byte_bpe" or none.columns == columns)
        out = f"{tmp_path}/{name}"
        stage(spark, docs, SMALL).write.parquet(out)
        docs = spark.read.parquet(out)
        sizes.append(docs.count())
        assert name == "byte_bpe" or docs.columns == columns
    assert sizes[0] == 200 and sizes[0] >= sizes[1] >= sizes[2] and docs.filter("NOT round_trip").count() == 0
