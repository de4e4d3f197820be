"""Extraction against a plain reader of articles, hand-made pages, and classes against brute force."""

import glob
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tidewheel.llm import maintext

SCHEMA = "page_id long, url string, html string, host string, tokens string"


class Articles(HTMLParser):
    """Texts of h1 and p elements within articles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "h2", "article", "div"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "h2", "article", "div"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def plain(source):
    reader = Articles()
    reader.feed(source or "")
    reader.close()
    return "\n\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)


def text(source):
    return "\n\n".join(b.text for b in maintext.read(source).kept())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_articles_of_the_given_pages(spark, sf):
    path = f"/root/testdata/{sf}/pages.parquet"
    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in pq.read_table(path).to_pylist()}
    got = maintext.op13_template_text(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(want)
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


CASES = [
    (None, ""),
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>one<p>two <b>bold\n\t x</b>y<br>z", "one\n\ntwo bold xy z"),
    ("<body><nav><a href=/>Home</a></nav><header>Site</header><div class='content'><h2>T&eacute;</h2><p>a&nbsp;b &#x41;&#66; &copy</p></div><footer>f</footer>", "Té\n\na b AB ©"),
    ("<article><header><h1>Head</h1></header><p>x</p><footer>tags</footer><section id='comments'><article class=comment><p>nice</p></article></section></article><article class='ad'>buy</article>", "Head\n\nx"),
    ("<div class='page with-sidebar'><aside><p>s</p></aside><main><p>m</p><form><input><label>mail</label></form></main><div id='cookieNotice'>c</div></div>", "m"),
    ("<script>var a = '<article>no</article>';</script><style>p{}</style><title>t</title><article>yes<script>x</p></script></article><!-- <article>no</article> -->", "yes"),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>a</p><!-- never closed <p>b</p>", "a"),
    ("<ul><li>one<li>two <ul><li>deep</ul><li>three</ul>", "one\n\ntwo\n\ndeep\n\nthree"),
    ("<table><tr><td>a<td>b<tr><td><p>c</table>d", "a\n\nb\n\nc\n\nd"),
    ("<div><a href=1>only</a> <a href=2>links</a></div><p>text with <a>link</a></p>", "text with link"),
    ("<article>1 < 2 and <3 </nosuch> fine <p hidden>no</p><div style='display: none'>no</div></article>", "1 < 2 and <3 fine"),
    ("<form id=page><div><article><p>in a form</p></article></div></form>", "in a form"),
    ('<article><p title="a > b">q</p><img alt="<p>x"/><p>r', "q\n\nr"),
    ("<div class='menu'>m</div><div class='post'><p>a</p><div class='post-comments'>c</div></div><div class='post-nav'>next</div><p>other</p>", "a"),
    ("<div id=main><h1>t</h1><p>a</p><div class='ad box'>buy</div><div class='reader-comments'><p>c</p></div></div><div class='sidebar'>s</div>", "t\n\na"),
    ("<ARTICLE><P>caps</P><SCRIPT>x</SCRIPT ></ARTICLE>", "caps"),
]


@pytest.mark.parametrize("source, want", CASES)
def test_pages(source, want):
    assert text(source) == want


def site(n, host="a.example", fixed="Share this story with friends", extra=lambda k: ""):
    page = "<html><body><div class=x1><p>Welcome to the site</p></div><article><h1>Title {k}</h1><p>Body of {k} is {k} long.</p>{extra}<p>{fixed}</p></article><div>tail</div></body></html>"
    return [(k, f"http://{host}/p/{k}", page.format(k=k, fixed=fixed, extra=extra(k))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "clash") for r in rows], SCHEMA)


def test_texts_of_the_template_go(spark):
    rows = site(12) + site(4, "few.example") + [(99, None, "<p>no url</p>"), (98, "nonsense", None), (None, "http://a.example/q", "<p>no id</p>")]
    rows += [(50, "http://a.example/p/1", rows[1][2])] * 2  # repeated rows
    got = maintext.extracted(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in got}
    assert texts[3, "http://a.example/p/3"] == "Title 3\n\nBody of 3 is 3 long."
    assert texts[50, "http://a.example/p/1"] == "Title 1\n\nBody of 1 is 1 long."
    assert texts[2, "http://few.example/p/2"] == "Title 2\n\nBody of 2 is 2 long.\n\nShare this story with friends"
    assert texts[99, None] == "no url" and texts[98, "nonsense"] == ""


def test_copies_of_an_article_stay(spark):
    """Thirty pages with the same article, menus apart, on one host: its text is no template."""
    rows = [(k, f"http://c.example/{k}", f"<nav>{k}</nav><article><h1>Same</h1><p>The very same text.</p></article>") for k in range(30)] + site(9, "c.example")
    got = {r.page_id: r.text for r in maintext.extracted(frame(spark, [(k, u, h) for k, (_, u, h) in enumerate(rows)])).collect()}
    assert all(got[k] == "Same\n\nThe very same text." for k in range(30))


def test_classes_equal_brute_force(spark):
    rows = site(12, extra=lambda k: "<p>odd</p>" * (k % 3) + "<section><p>in</p></section>" * (k % 2)) + site(5, "b.example")
    df = frame(spark, rows).withColumn("host", maintext.host_of("url"))
    want = Counter()
    for host in ("a.example", "b.example"):
        pages = [Counter(maintext.read(h).tokens) for _, u, h in rows if f"/{host}/" in u]
        vectors = {}
        for token in {t for p in pages for t in p}:
            vectors.setdefault(tuple(p[token] for p in pages), []).append(token)
        for vector, tokens in vectors.items():
            support = sum(n > 0 for n in vector)
            if support >= max(maintext.LEAST_PAGES, maintext.SHARE * len(pages)):
                want[host, support, tuple(sorted(tokens))] += 1
    from pyspark.sql import functions as F

    streams = maintext.coded(df).withColumn("page", F.monotonically_increasing_id())
    got = Counter((r.host, r.support, tuple(r.tokens)) for r in maintext.classes(streams).collect())
    assert got == want


def test_nested_template(spark):
    """The frame is at the top; what some pages have stands in one of its gaps; texts in changing order are no class."""
    def part(k):
        return ("<section><h2>More</h2><p>and more</p></section>" if k % 4 else "") + ("<p>left</p><p>right</p>" if k % 2 else "<p>right</p><p>left</p>")

    rows = site(16, extra=part)
    df = frame(spark, rows).withColumn("host", maintext.host_of("url"))
    found = maintext.templates(df).collect()
    token = {re.sub(r"\d+", "#", b.text): b.token for _, _, h in rows for b in maintext.read(h).blocks}
    frames = [r for r in found if r.parent == -1]
    frames = [r for r in frames if token["Share this story with friends"] in r.tokens]
    assert len(frames) == 1 and frames[0].support == 16 and token["Welcome to the site"] in frames[0].tokens
    nested = [r for r in found if token["More"] in r.tokens]
    assert len(nested) == 1 and nested[0].parent == frames[0]["class"] and nested[0].support == 12 and token["and more"] in nested[0].tokens
    assert not any(token["left"] in r.tokens for r in found)
    # by a shuffle instead of a broadcast
    old, maintext.BROADCAST_BYTES = maintext.BROADCAST_BYTES, 0
    try:
        assert sorted(map(str, maintext.templates(df).collect())) == sorted(map(str, found))
    finally:
        maintext.BROADCAST_BYTES = old


def test_long_pages_and_empty_table(spark):
    many = "<article>" + "<p>word " * 50_000 + "</article>"
    got = maintext.extracted(frame(spark, [(1, "http://l.example/", many)])).collect()[0]
    assert got.text == "\n\n".join(["word"] * 50_000)
    assert text("<b>" * 20_000 + "deep") == "deep"
    assert maintext.extracted(frame(spark, []).where("page_id > 0")).count() == 0


def test_hosts(spark):
    urls = ["http://A.Example:80/x", "https://u:p@b.example?q", "ftp://c#d", "nonsense", None, "", "//d.example/x"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(maintext.host_of("url")).collect()
    assert [r[0] for r in got] == ["a.example", "b.example", "c", "", "", "", ""]
