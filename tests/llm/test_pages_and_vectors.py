"""Page text, URL filters and nearest neighbours."""

import html as H
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from meadowlark.llm import neighbours, page_text, url_filters
from meadowlark.llm.queries import QUERIES, table

HEAD = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>no</article>";</script></head><body>'


def layout(article, menu="Home", extra=""):
    return (f'{HEAD}<nav><ul><li><a href="/x">{menu}</a></li></ul></nav><!-- <article>c</article> --><div class="ad">Buy {menu}</div>'
            f'<article><h1>H {menu}</h1>{article}</article>{extra}<footer>&copy; us</footer></body></html>')


@pytest.mark.parametrize("page,text", [
    ("", ""), (None, ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b<div class=ad>q</div>c", "a b c"),
    ("<p>A</p><img class='social-icon'><p>B</p>", "A B"), ("<input id='menu-toggle'><p>A</p>", "A"),
    ("<div class='sidebar'><div>in</div>leak</div><p>out</p>", "out"), ("<p>a <b>b</b>c&nbsp;d\n e&#8217;</p>", "a bc d e\u2019"),
    ("<article>x<section id='comments'><article class='comment'>no</article></section></article>", "x"),
    ("<main>m<form>f</form><aside>s</aside></main><p>outside</p>", "m"), ("<div hidden>h</div><div style='display: none'>n</div>v", "v"),
    ("<article><header><h1>Title</h1></header>x</article><header>site</header>", "Title x"), ("a < b <c", "a < b <c"),
    ("<p>open <a title='1>0'>link</a></P>", "open link"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
    ("<nav>only</nav>", ""), ("<style>p{}", ""), ("<div role=navigation>x</div>y", "y"), ("<p>un&bogus; &am</p>", "un&bogus; &am"),
])
def test_single_pages(page, text):
    assert (page_text.read(page, None) if page else "") == text


def test_wrapper_finds_content_without_an_article_element(spark):
    pages = [(i, "http://h.org/%d" % i, f"<body><div class=top>Site name</div><div class=links><a href=/>l{i}</a></div><div class=box><p>Printed daily"
              f"</p><div><p>story {i} begins</p><p>and {'goes on ' * i}</p></div></div><div class=legal>All rights</div></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in page_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"story {i} begins and {'goes on ' * i}".split()) for i in range(12)}


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in page_text.main_text(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("around", [
    '<div class="content has-sidebar"><article>{}</article></div>', '<div id="sticky-footer-wrap"><article>{}</article></div>',
    '<div class="public-notice">{}</div>', '<form id=aspnet><div>{}</div></form>', '<form><article>{}</article></form>',
    '<div class="page-header-wrap"><main>{}</main></div>', '<article class="post comments-open">{}</article>',
    '<div id="sticky-footer-wrap">{}</div><div class=sidebar>tip @</div>', '<aside><article>{}</article></aside><div class=related>old @</div>'])
@pytest.mark.parametrize("n", [2, 12])
def test_names_do_not_overrule_the_wrapper(spark, around, n):
    body = [" ".join(f"word{i * j}" for j in range(1, 30)) for i in range(1, n + 1)]
    pages = [f"<body><nav><a href=/>m{i}</a></nav>{around.format(f'<p>{b}</p>').replace('@', str(i))}<div class=footer>All rights</div></body>"
             for i, b in enumerate(body)]
    assert texts_of(spark, pages) == body


def test_short_pages_of_another_layout_keep_their_text(spark):
    pages = [f"<body><article><p>{f'long story {i} ' * 200}</p></article></body>" for i in range(20)]
    pages += [f'<body><div class="public-notice"><{t}>short {i}</{t}></div></body>' for i, t in enumerate(["article", "div", "p"])]
    assert texts_of(spark, pages)[20:] == ["short 0", "short 1", "short 2"]


def test_all_varying_slots_are_content_without_an_article_element(spark):
    menu = "<div class=top>Site</div><div class=links><a href=/>one {i}</a><a href=/>two {i}</a></div>"
    post = "<div class=post><h1>title {i}</h1><p class=lead>lead {i}</p>" + menu + "<div class=body><p>" + "story {i} " * 30 + "</p></div></div>"
    parts = ["a {i} " * 10, "b {i} " * 75, "c {i} " * 15]
    split = menu + "".join(f"<section class=s{k}><p>{x}</p></section>" for k, x in zip("xyz", parts)) + "<div class=legal>All rights</div>"
    for page, text in ((post, "title {i} lead {i} " + "story {i} " * 30), (split, "".join(parts))):
        got = texts_of(spark, [f"<body>{page.format(i=i)}</body>" for i in range(12)])
        assert got == [text.format(i=i).strip() for i in range(12)]


@pytest.mark.parametrize("text", ["Printed daily", "By the editors", "Read on", "All the news", "Since 1901", "Our paper"])
def test_a_constant_text_is_counted_after_any_others(text):
    odd = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    pages = [f"<div><p>{x}</p><b>{i}</b></div>" for i, x in enumerate(odd + [text] * 92)]
    for order in (pages, pages[::-1], pages[4:] + pages[:4]):
        rule = page_text.rules(page_text._fold_all([page_text.skeleton(page_text.parse(x)) for x in order]))
        p = rule[3][0][3][0]
        assert (p[0], p[2]) == ("p", zlib.crc32(text.encode()))


@pytest.mark.parametrize("tag", ["div", "span", "font", "a name=x", "form", "section class=s", "main"])
def test_pages_nested_5000_deep_are_read(tag):
    name = tag.split()[0]
    pages = [f"<body><nav>n</nav><article>start {i} {f'<{tag}>x{i} ' * 5000}end<script>no</script>{f'</{name}>' * n}</article></body>"
             for i, n in enumerate([0, 5000])]
    rule = json.loads(json.dumps(page_text.rules(page_text._fold_all([page_text.skeleton(page_text.parse(p)) for p in pages]))))
    for i, p in enumerate(pages):
        assert page_text.read(p, rule) == f"start {i} {f'x{i} ' * 5000}end"


def test_unclosed_anchors_are_no_links(spark):
    pages = [f"<body><div class=links><a href=/x>l{i}</a></div><div class=t>{f'<a name=x>part {i} ' * 600}</div><div class=u>{i}</div></body>" for i in range(6)]
    assert texts_of(spark, pages) == [f"part {i} " * 600 + str(i) for i in range(6)]


def test_deep_pages_keep_their_article_and_drop_their_template(spark):
    deep = "<div>" * 400
    pages = [f"<body>{deep}<nav>menu {i}</nav><article><p>text {i}</p> more {i}</article><footer><p>foot</p></footer></body>" for i in range(6)]
    assert texts_of(spark, [*pages, "<body><article>flat</article></body>"]) == [*[f"text {i} more {i}" for i in range(6)], "flat"]


def test_constant_text_is_template_and_copies_are_not(spark):
    share = "<p class=s>Printed from our site</p>"
    varied = [(i, "https://A.com/p", layout(f"<p>text {i}</p>{share}", f"m{i}")) for i in range(20)]
    copied = [(100 + i, "https://b.com/p", layout("<p>all alike</p>")) for i in range(20)]
    odd = [(200, None, layout("<p>q</p>")), (201, "no url", None), (202, "https://a.com/", "<b>bare</b>"), (203, "https://c.d/", "")]
    df = spark.createDataFrame([(*r, "old") for r in varied + copied + odd], "page_id long, url string, html string, TEXT string").repartition(3)
    out = page_text.main_text(df)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["page_id", "url", "html", "text"]
    assert all(got[i] == f"H m{i} text {i}" for i in range(20))
    assert all(got[100 + i] == "H Home all alike" for i in range(20))
    assert [got[i] for i in range(200, 204)] == ["H Home q", "", "bare", ""]
    assert page_text.main_text(df.limit(0)).count() == 0


def test_tree_matching_keeps_order_and_counts():
    a, b = (page_text.skeleton(page_text.parse(x)) for x in ("<div><h1>a</h1><p>b</p><p>c</p><ul></ul></div>", "<div><p>b</p><hr><ul></ul></div>"))
    n, _ = page_text.match(a, b)
    assert n == 4  # root, div, the repeated p, ul
    both = page_text.fold(a, b)
    assert [x[0] for x in both[5][0][5]] == ["h1", "p", "hr", "ul"] and both[1] == 2


def test_op2_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    for r in QUERIES["op2_page_text"](spark, sf).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        text = " ".join(H.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert (r["text"], r["n_chars"]) == (text, len(text))


URLS = [("http://WWW.Example.NET/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net", "example.net", "", None, None),
        ("https://a.net/de/", "a.net", "/de/", "net/", "block"), ("x://example.com/de/a", "example.com", "/de/a", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://sub.a.org/fr/?q", "sub.a.org", "/fr/", "org/fr/", "allow"),
        ("http://org/fr/x", "org", "/fr/x", "org/fr/", "allow"), ("http://ÄB.org?a/b", "Äb.org", "", None, None), ("no scheme/x", "", "", None, None),
        ("", "", "", None, None), (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://x.org\n/fr/", "x.org\n", "/fr/", None, None)]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, Host string")
    out = url_filters.url_filter(df)
    for r in out.collect():
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert len(out.columns) == len({c.lower() for c in out.columns}) == 7
    assert url_filters.url_filter(df.limit(0)).count() == 0
    alone = df.where("url like '%fr%'")
    assert {r["verdict"] for r in url_filters.url_filter(alone).collect()} == {"allow"}


def log_p(urls, text):
    """The interpolated model, counted anew."""
    seen = {}
    for u, n in urls:
        t = [-1] * url_filters.ORDER + list(u.encode()) + [-2]
        for i in range(url_filters.ORDER, len(t)):
            for k in range(url_filters.ORDER + 1):
                for key in ((tuple(t[i - k: i]), t[i]), (tuple(t[i - k: i]), None)):
                    seen[key] = seen.get(key, 0) + n
    t, total = [-1] * url_filters.ORDER + list(text.encode()) + [-2], 0.0
    for i in range(url_filters.ORDER, len(t)):
        p = 1 / 256
        for k in range(url_filters.ORDER + 1):
            past = tuple(t[i - k: i])
            p = (seen.get((past, t[i]), 0) + url_filters.PRIOR * p) / (seen.get((past, None), 0) + url_filters.PRIOR)
        total += math.log(p)
    return total / (len(t) - url_filters.ORDER)


@pytest.mark.parametrize("hot", [50_000, 40, 1])
def test_scores_and_threshold_equal_the_interpolated_model(spark, hot):
    rnd = random.Random(6)
    ruled = [("".join(rnd.choice("abé/" if i % 2 else "bcz/") for _ in range(rnd.randint(0, 12))) + str(i), rnd.randint(1, 3), i % 2, i // 2 % 2)
             for i in range(40)]
    rows = ruled + [(t, 1, None, i % 2) for i, t in enumerate(["ab", "zza", "", "abba", "日本", "ab" * 3000])]
    urls = spark.createDataFrame(rows, "url string, n long, blocked long, half long").repartition(3)
    scored, threshold = url_filters.scores(urls, hot)
    got = {r["url"]: r["url_score"] for r in scored.collect()}

    def ratio(text, of=(0, 1)):
        return log_p([(u, n) for u, n, b, h in ruled if not b and h in of], text) - log_p([(u, n) for u, n, b, h in ruled if b and h in of], text)
    for text, *_ in rows:
        assert got[text] == pytest.approx(ratio(text), abs=1e-8)
    cross = [(ratio(u, (1 - h,)), n, b) for u, n, b, h in ruled]

    def parted(x):
        return (sum(n for s, n, b in cross if not b and s >= x) / sum(n for _, n, b in cross if not b)
                + sum(n for s, n, b in cross if b and s < x) / sum(n for _, n, b in cross if b))
    step = 2 * url_filters.REACH / url_filters.BINS
    assert parted(threshold) == pytest.approx(max(parted(i * step - url_filters.REACH) for i in range(url_filters.BINS + 1)))


def test_verdicts_stay_when_many_ruled_urls_are_added(spark):
    def rows(n, first=0):
        return [(first + i, f"http://{'good' if i % 2 else 'spam'}-site{i}.{'org/fr' if i % 2 else 'net/de'}/{'quiet' if i % 2 else 'noise'}/{i * 7919 % 10**6:x}")
                for i in range(n)]
    asked = [(-1 - i, f"http://{'good' if i % 2 else 'spam'}-place{i}.com/{'quiet' if i % 2 else 'noise'}/{i}") for i in range(60)]
    few, many = (url_filters.url_filter(spark.createDataFrame(rows(n) + asked, "page_id long, url string")).where("page_id < 0")
                 for n in (300, 20_000))
    want = {-1 - i: "allow" if i % 2 else "block" for i in range(60)}
    assert {r["page_id"]: r["verdict"] for r in few.collect()} == want
    assert {r["page_id"]: r["verdict"] for r in many.collect()} == want


def test_models_part_urls(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'spam'}-site{i}.{'org/fr' if i % 2 else 'net/de'}/page{i}") for i in range(200)]
    rows += [(1000 + i, f"http://{'good' if i % 2 else 'spam'}-place{i}.com/x") for i in range(40)]
    got = {r["page_id"]: r["verdict"] for r in url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(40)) >= 36


def brute(ids, vectors, query, own, k):
    d = np.sqrt(((vectors - query) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != own][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


@pytest.mark.parametrize("n,leaf", [(0, 4), (1, 4), (7, 4), (1500, 64)])
def test_search_block(n, leaf):
    rng = np.random.default_rng(2)
    ids, v = np.arange(n), rng.standard_normal((n, 16))
    q, own = rng.standard_normal((30, 16)), np.full(30, -9)
    score, who = neighbours.search_block(ids, v, own, q, 5, leaf=leaf)
    hits = sum(len(set(who[i]) & {x for x, _ in brute(ids, v, q[i], -9, 5)}) for i in range(30))
    assert hits >= 0.97 * 30 * min(5, n)
    for i in range(30):
        assert all(s == np.sqrt(((v[w] - q[i]) ** 2).sum()) for s, w in zip(score[i], who[i]) if w >= 0)


def test_ties_go_to_the_smaller_id():
    v = np.zeros((500, 8)) + 1.0
    _, who = neighbours.search_block(np.arange(500)[::-1], v, np.array([0, 3]), v[:2], 4)
    assert who.tolist() == [[1, 2, 3, 4], [0, 1, 2, 4]]


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.50731306)
    assert neighbours.chi_square_quantile(0.99, 2) == pytest.approx(-2 * math.log(0.01))


def test_nearest_skips_unusable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]),
            (8, [1.0, 0.0, 0.0]), (9, [5.0, 5.0]), (9, [5.0, 5.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    far = math.sqrt(16 + 25)
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 0.1), (0, 3, 9, far), (100, 1, 0, 0.0), (100, 2, 1, 0.1), (100, 3, 9, far)] or got[:2] == [
        (0, 1, 100, 0.0), (0, 2, 1, pytest.approx(0.1))]
    assert neighbours.nearest(df.limit(0), df, k=3).count() == 0


def test_op9_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "embeddings").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in QUERIES["op9_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    asked = [i for i in ids.tolist() if i % 100 == 0]
    assert sorted(got) == asked
    hits = sum(len({x for x, _ in got[i]} & {x for x, _ in brute(ids, v, v[ids == i][0], i, 10)}) for i in asked)
    assert hits >= 0.95 * 10 * len(asked)


# --- wrappers ------------------------------------------------------------------------------------

def slug_page(i):
    """A page whose theme puts tags, category and slug into classes and ids."""
    return (f'<body class="post-{i} story-{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x"><div id="top-{chr(97 + i * 7 % 26)}q{chr(97 + i // 3 % 26)}"><a href="/">Home</a></div>'
            f'<div class="post tag-{chr(97 + i % 23)}{chr(97 + i % 19)}z category-{chr(97 + i % 17)}{chr(97 + i % 13)}w" id="story-{chr(97 + i % 26)}{chr(97 + i // 26)}k"><h1>Title {i}</h1>'
            f'<p>Body number {i} speaks of {i * 31 % 977} things.</p></div><div class="x{chr(97 + i % 26)}{chr(97 + i // 26)}y"><span>Copyright Example Publishing Company</span></div></body>')


def wrapper_of(pages, words):
    out = None
    for p in pages:
        one = page_text.skeleton(page_text.parse(p, words))
        out = page_text.bounded(page_text.fold(out, one) if out else one)
    return out


def test_slugs_and_tags_do_not_grow_the_wrapper(spark):
    pages = [slug_page(i) for i in range(400)]
    df = spark.createDataFrame([(i, f"http://blog.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    words = page_text.shared_words(df.select(page_text.host_of(page_text.F.col("url")).alias("host"), "html")).collect()
    assert [r["host"] for r in words] == ["blog.example"] and {"post", "story", "tag", "category"} <= set(words[0]["words"].split())
    shared = frozenset(words[0]["words"].split())
    few, many = (page_text._size(wrapper_of(pages[:n], shared)) for n in (100, 400))
    assert few == many < 12
    got = {r["page_id"]: r["text"] for r in page_text.main_text(df).collect()}
    assert all(got[i] == f"Title {i} Body number {i} speaks of {i * 31 % 977} things." for i in range(400))


def test_wrappers_are_bounded(monkeypatch):
    monkeypatch.setattr(page_text, "NODES", 60)
    rnd = random.Random(1)
    pages = ["<body><div class='main'><p>t</p></div>" + "".join(f"<{rnd.choice(['ul', 'table', 'section', 'dl'])} class='{chr(97 + rnd.randint(0, 25)) * 3}'>x</{'ul'}>"
                                                             for _ in range(8)) + "</body>" for _ in range(200)]
    out = wrapper_of(pages, None)
    assert page_text._size(out) <= 60
    body = out[5][0]
    assert body[0] == "body" and body[1] == 200 and any(c[0] == "div.main" and c[1] == 200 for c in body[5])


def simple_tree_matching(a, b):
    """The plain recursion, without its pairs."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[5]) + 1) for _ in range(len(a[5]) + 1)]
    for i, x in enumerate(a[5], 1):
        for j, y in enumerate(b[5], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + simple_tree_matching(x, y))
    return m[-1][-1] + 1


def test_match_is_simple_tree_matching():
    rnd = random.Random(7)

    def tree(depth):
        return [rnd.choice("abc"), 1, 0, 0, {}, [tree(depth - 1) for _ in range(rnd.randint(0, 4))] if depth else []]
    for _ in range(300):
        a, b = tree(3), tree(3)
        b[0] = a[0]
        score, pairs = page_text.match(a, b)
        assert score == simple_tree_matching(a, b)
        assert score == 1 + sum(simple_tree_matching(a[5][i], b[5][j]) for i, j in pairs)
        assert all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("module,name", [("page_text", "read"), ("page_text", "_wrap"), ("decontamination", "candidates"), ("spelling", "slice_words"),
                                         ("divergence", "slice_counts"), ("jaccard_join", "_facts"), ("token_files", "_encoder"), ("url_filters", "runs")])
def test_functions_travel_by_value(module, name, tmp_path):
    """Workers need no copy of the package: what is sent to them is loaded where it cannot be imported."""
    import importlib
    import subprocess
    import sys

    from pyspark import cloudpickle
    sent = tmp_path / "sent"
    sent.write_bytes(cloudpickle.dumps(getattr(importlib.import_module(f"meadowlark.llm.{module}"), name)))
    code = f"import pickle; f = pickle.load(open({str(sent)!r}, 'rb')); import sys; assert not any(m.split('.')[0] == 'meadowlark' for m in sys.modules); print(callable(f))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert done.stdout.strip().endswith("True"), done.stderr[-800:]


def test_cells_leave_far_ones_unsearched(spark):
    """Recall on cells against brute force, for spread and for clustered vectors, and how many cells are entered."""
    rnd = np.random.default_rng(21)
    middles = rnd.normal(size=(40, 32)) * 6
    for name, vectors, least in (("clustered", middles[rnd.integers(0, 40, 6000)] + rnd.normal(size=(6000, 32)), 0.95),
                                 ("spread", rnd.normal(size=(3000, 32)), 0.95)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
        got = {}
        for r in neighbours.nearest(df, df.where("vec_id % 100 = 0"), k=10, block=200).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q in range(0, len(vectors), 100):
            d = ((vectors - vectors[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert hits >= least * 10 * len(got), name
    tree = neighbours.Cells(middles @ neighbours.projections(32), 16)
    points = rnd.normal(size=(500, 32)) @ neighbours.projections(32)
    cell = tree.of(points)
    assert all(tree.gaps(p)[c] == 0 and (np.delete(tree.gaps(p), c) >= 0).all() for p, c in zip(points, cell))
