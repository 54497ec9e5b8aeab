import pytest

from quillon.llm import site_style as S


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("plain", "plain"),
        ("<body><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>a\n  b<br>c<p>d <b>e<p>f</article><footer>x</footer>", "T & U\n\na b c\n\nd e\n\nf"),
        ("<main><p>one</p><form>no</form><div class='cookie-notice'>no</div><section id=comments><p>no</p></section><p>two", "one\n\ntwo"),
        ("<p>1 < 2 &lt;b&gt; &copy; &am</p><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> -->", "1 < 2 <b> © &am"),
        ("<header>no</header><article><header><h1>yes</h1></header><p>x</article>", "yes\n\nx"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><ul><li>d<li>e</ul>", "a b\n\nc\n\nd\n\ne"),
        ("<div role=navigation>no</div><div data-x='a>b'>yes</div>", "yes"),
        ("<p title=\"unclosed>text</p>", "<p title=\"unclosed>text"),
    ],
)
def test_one_page(spark, page, want):
    got = S.extract(spark.createDataFrame([(1, "http://h.example/x", page)], "page_id long, url string, html string")).first()["main_text"]
    assert got == want


def test_entropy_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://H.example:80/{i}", f"<div class=x><p>the same on every page</p></div><div class=y><p>text number {i} is new</p></div>") for i in range(12)]
    rows += [(100 + i, f"http://other{i}.example/", "<div class=x><p>the same on every page</p></div>") for i in range(3)]
    got = {r["page_id"]: r["main_text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text number {i} is new" for i in range(12))
    assert all(got[100 + i] == "the same on every page" for i in range(3))


def test_a_site_of_copies_keeps_its_article(spark):
    rows = [(i, "http://h.example/", "<nav>menu</nav><article><p>one and the same</p></article>") for i in range(10)]
    assert {r["main_text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"one and the same"}


def test_odd_rows(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "not a url", "<p>b"), (2, "http://h/", "<p>" + "word " * 50_000), (3, "http://h/", "<" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "path")
    got = sorted((r["path"] or -1, len(r["main_text"])) for r in S.extract(df).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 249_999), (3, 5000)]
    assert S.extract(df.limit(0)).count() == 0


def test_whole_site_without_markup(spark, sf):
    got = S.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    for r in got:
        body = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert r["main_text"] and r["main_text"].split()[-1] in body.replace("&amp;", "&").replace("&quot;", '"')


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>no</title><script>var t='<div>no</div>';</script><template><p>no</p></template><body><p>yes</p>", "yes"),
        ("<head><meta charset=utf-8><title>no</title><p>yes</p>", "yes"),
        ("<head><title>no</title></head><body><p>yes</p>", "yes"),
        ("<datalist><option>no<option>no</datalist><p>yes</p>", "yes"),
        ("<p>a<option>no<p>yes</p>", "a\n\nyes"),
    ],
)
def test_end_tags_that_may_be_left_out(page, want):
    assert "\n\n".join(b[2] for b in S.parse(page)[0]) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>no</title><body><p>yes</p></body></html>", "yes"),
        ('<body class="has-sidebar"><p>yes</p></body>', "yes"),
        ('<main class="with-sidebar"><p>yes</p></main>', "yes"),
        ('<article><h1 class="article-header">yes</h1><p>x</p></article>', "yes\n\nx"),
        ("<p>a</p><button>b<p>c</p>", "a\n\nb\n\nc"),
        ("<div><button><div>no</div></button><p>yes</p></div>", "yes"),
        ("<svg><svg>no</svg>no</svg><p>yes</p>", "yes"),
        ('<div class="w-1/2 x"><p>yes</p></div>', "yes"),
        ('<div class="main-nav"><p>no</p></div><div class="ad-slot">no</div><p>yes</p>', "yes"),
        ('<body class="menu"><article id="comments"><p>yes</p></article></body>', "yes"),
    ],
)
def test_pages_that_lost_text(page, want):
    assert "\n\n".join(b[2] for b in S.parse(page)[0] if not b[1]) == want


def test_paths_with_slashes_in_names(spark):
    rows = [(i, "http://h/", f'<div class="w-1/2"><p>same</p></div><div class="w-1/3"><p>text {i}</p><p>more {i * 7}</p></div>') for i in range(9)]
    got = [r["main_text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).orderBy("page_id").collect()]
    assert got == [f"text {i}\n\nmore {i * 7}" for i in range(9)]


def brute_importance(pages):
    """Every node's importance from the definition: entropy of its features over the pages that have it, averaged over its branch."""
    import math
    from collections import Counter, defaultdict

    seen = defaultdict(list)
    for host, page in pages:
        for path, (children, own) in S.parse(page)[1].items():
            if path and children:
                seen[host, path, 0].append(children)
            if path and own:
                seen[host, path, 1].append(own)
    h = {}
    for key, values in seen.items():
        m = len(values)
        h[key] = (m, max(0.0, -sum(c / m * math.log(c / m) for c in Counter(values).values()) / math.log(m)) if m > 1 else 1.0)
    out = {}
    for host, path, _ in h:
        below = [(m * S.GAMMA ** (p.count("/") - path.count("/")), e, m) for (o, p, _), (m, e) in h.items() if o == host and (p == path or p.startswith(path + "/"))]
        out[host, path] = (max(m for _, _, m in below), sum(w * e for w, e, _ in below) / sum(w for w, _, _ in below))
    return out


def test_importance_against_brute_force(spark, sf):
    rows = [(r["url"].split("/")[2].lower(), r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").limit(60).collect()]
    rows += [("h", f"<div class='a/b'><ul><li>x<li>{i % 2}</ul></div><p>{i}<p>same") for i in range(6)]
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in S.importance(spark.createDataFrame(rows, "host string, page string"), "host", "page").collect()}
    want = brute_importance(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9


def test_a_fixed_menu_of_changing_links_falls_to_entropy(spark):
    """The presentation is the same on every page, the links aren't; names are off."""
    rows = [(i, "http://h/", f"<nav><ul><li>a{i}</li><li>b{i}</li><li>c{i}</li></ul></nav><article>{'<p>t%d</p>' % i * (1 + i % 5)}<h2>x{i}</h2></article>") for i in range(30)]
    got = [r["main_text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).orderBy("page_id").collect()]
    assert got == ["\n\n".join([f"t{i}"] * (1 + i % 5) + [f"x{i}"]) for i in range(30)]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://h/", "<p>a", "old", 5, 6)], "page_id long, url string, html string, main_text string, host_ int, low int")
    got = S.extract(df)
    assert got.columns == ["page_id", "url", "html", "host_", "low", "main_text"] and tuple(got.first()) == (1, "http://h/", "<p>a", 5, 6, "a")


def test_a_fixed_frame_keeps_new_prose(spark):
    frame = "<div><div><div><div><div><p>{}</p></div></div></div></div></div><div class=x><p>the same notice of many words on every page</p></div>"
    rows = [(i, "http://h/", frame.format(f"page {i} tells of {i * 3} things at some length")) for i in range(12)]
    got = [r["main_text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [f"page {i} tells of {i * 3} things at some length" for i in range(12)]


@pytest.mark.parametrize(
    "page",
    [
        '<body><form id="aspnetForm"><div class="page"><h1>yes</h1><p>yes and more of it</p></div></form></body>',
        '<form id="aspnetForm"><nav>no</nav><article><h1>yes</h1><p>yes and more of it</p></article></form>',
        '<article><h1 class="header">yes</h1><p>yes and more of it</p></article>',
        '<article><h1>yes</h1><section class="related"><p>yes and more of it</p></section></article>',
        '<div class="main side"><h1>yes</h1><p>yes and more of it</p></div><div class="side">no</div>',
        '<main><h1>yes</h1><div id="search"><p>yes and more of it</p></div></main>',
        '<article><h1 hidden>yes</h1><p>yes and more of it</p><div class="comments"><p>no</p></div></article>',
    ],
)
def test_names_that_say_nothing(page):
    assert [b[2] for b in S.parse(page)[0] if not b[1]] == ["yes", "yes and more of it"]


def site(i, unique=True):
    own = f"page {i} is about {i * 7} " if unique else "page "
    paragraphs = "".join(f"<p>{own}and thing {i}-{k} of many more things that are told here at some length</p>" for k in range(2 + i % 4))
    return f"<body><div class=x1>buy {i * 3} new {i} things</div><div class=c7><div class=c8><h1>Title of {i}</h1>{paragraphs}</div></div><div class=z>(c) {i} by {i % 3} and {i * 2}</div></body>", paragraphs


def test_the_main_branch_is_told_by_its_information(spark):
    """No name helps and no text repeats: what is beside the branch with most of the words goes, the title stays."""
    rows = [(i, "http://h/", site(i)[0]) for i in range(12)]
    got = [r["main_text"] for r in S.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).orderBy("page_id").collect()]
    for i, text in enumerate(got):
        assert text.split("\n\n") == [f"Title of {i}", *site(i)[1].replace("</p>", "").split("<p>")[1:]]


def test_the_tree_decides_where_there_is_one(spark):
    """On a site with pages enough names don't take what its tree holds for content, but comments go."""
    page = lambda i: f"<div class=sidebar><div class=q><h2>T{i}</h2><p>this {i * 7} and all the other words that page {i} has</p></div></div><div class=comments><p>reader {i} says {i * 5}</p></div>"
    many = [(i, "http://h/", page(i)) for i in range(9)]
    got = [r["main_text"] for r in S.extract(spark.createDataFrame(many, "page_id long, url string, html string")).collect()]
    assert all("words that page" in t and "reader" not in t for t in got)


def test_information_against_brute_force(spark, sf):
    import math
    from collections import Counter, defaultdict

    rows = [(r["url"].split("/")[2].lower(), r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").limit(60).collect()]
    rows += [("h", f"<div><ul><li>x y<li>{i % 2} z</ul></div><p>{i}<p>same") for i in range(6)]
    own = defaultdict(list)
    for host, page in rows:
        for path, (_, text) in S.parse(page)[1].items():
            if path and text:
                own[host, path].append(text)
    plain = {}
    for key, texts in own.items():
        m = len(texts)
        plain[key] = sum(len(t.split()) * (1 - math.log(Counter(texts)[t]) / math.log(m) if m > 1 else 1) for t in texts)
    tree = {(r["host"], r["path"]): (r["information"], r["plain"]) for r in S.importance(spark.createDataFrame(rows, "host string, page string"), "host", "page").collect()}
    for (host, path), (told, alone) in tree.items():
        below = sum(v for (h, p), v in plain.items() if h == host and (p == path or p.startswith(path + "/")))
        assert abs(told - below) < 1e-6 * max(1, below) and abs(alone - plain.get((host, path), 0)) < 1e-6 * max(1, below)


def test_the_tree_alone_finds_the_articles(spark):
    """On the larger tables every host has pages enough: without names at least nine in ten boilerplate blocks go and no block of an article."""
    import os

    path = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    lost = left = boilerplate = 0
    for r in S.extract(pages, names=False).select("html", "main_text").toLocalIterator():
        blocks = [("/article" in b[0], b[2]) for b in S.parse(r["html"])[0]]
        article = [t for ok, t in blocks if ok]
        kept = r["main_text"].split("\n\n") if r["main_text"] else []
        boilerplate += len(blocks) - len(article)
        lost += len(set(article) - set(kept))
        left += max(0, len(kept) - len(article))
    assert lost == 0 and left <= 0.1 * boilerplate
