import gzip
import hashlib
import os
import re
import time
from html import unescape
from urllib.parse import urljoin

import duckdb
import pandas
import pytest

from tallyloom.llm import html_text, url_filter, warc

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def text_of(spark, html):
    return html_text.extract_text(pages(spark, [(1, "http://a.b/", html)])).first().text


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";x(0)</script></head><body>
<header><h1>Site</h1><p>Our slogan, which is long, and has commas, many of them, really.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice"><p>We use cookies, and other things, to make this page, and others, better for you.</p></div>
<div class="ad">Buy now, it is cheap, very cheap, and good, and shiny, and new, and here.</div>
<div id="main"><article><h1>Title   of it</h1><p>First para&shy;graph, with a comma, and <b>bold</b> &lt;b&gt;
 text <a href="#">link</a>.<p>Second one has more, and more,<br>and more text &eacute;&#233;&nbsp;!</p>
<ul><li>one item</li><li>two items</li></ul><form><p>Your name, please, and your mail, and all.</p></form>
<aside><p>Related, or not, this is a box, with many words, and commas, in it.</p></aside><blockquote>Quoted, in full.</blockquote></article>
<section class="comments"><h3>Comments</h3><p>I think, as a reader, that this is wrong, and long, and so on, and on.</p></section></div>
<div class="sidebar"><p>More, of this, and that, and those, all of it, for free, today.</p></div><footer>&copy; 2024, all of it</footer></body></html>"""


@pytest.mark.parametrize(
    "html, want",
    [
        ('<p>One <svg class="i"/> two</p><p>three</p>', "One two\nthree"),
        ('<p>One <svg class="a>b" /> two</p><p>three <svg><path d="M0"/></svg> four</p>', "One two\nthree four"),
        ("<p>One <math/> two</p><p>three</p>", "One two\nthree"),
        ("<p>One <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two</p>", "One x=2 two"),
        ('<p>One <math><semantics><mi>x</mi><annotation encoding="tex">\\chi</annotation></semantics></math> two</p>', "One x two"),
        ("<p>One <select><option>a<option>b</p><p>two</p><p>three</p>", "One\ntwo\nthree"),
        ("<div>One <button>press</div><p>two</p><button>off</button><p>three</p>", "One\ntwo\nthree"),
        ("<p>One</p><button><div>Share</div></button><p>two</p>", "One\ntwo"),
        ("<p>One <svg><g> two</p><p>three</p>", "One\nthree"),
        ("<p>One <svg><svg><text>no</text></svg></svg> two</p>", "One two"),
    ],
)
def test_skipped_elements_end(html, want):
    assert html_text.main_text(html) == want


LONG = "The method was held against earlier ones on all of the data, and the differences were small, as the table shows."


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article><h2 id="discussion">Discussion</h2><p id="notice-2">One, two</p></article>', "Discussion\nOne, two"),
        (f'<article><p>{LONG}</p><section id="related-work"><h2>Related work</h2><p>{LONG}</p></section></article>', f"{LONG}\nRelated work\n{LONG}"),
        (f'<article><p>{LONG}</p><section class="related"><a href="/x">{LONG}</a></section></article>', LONG),
        (f'<article><p>{LONG}</p><section class="discussion comments"><p>{LONG}</p></section></article>', LONG),
        (f'<div class="layout sidebar-right"><h1>Title</h1><p>{LONG}</p><div class="sidebar"><p>{LONG}</p></div></div>', f"Title\n{LONG}"),
        (f'<div class="comments"><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div>', LONG),
        (f'<div class="post-share-enabled"><p>{LONG}</p><p>{LONG}</p></div><nav>x</nav>', f"{LONG}\n{LONG}"),
        (f'<div class="post-share-enabled"><article><p>{LONG}</p><p>{LONG}</p></article></div>', f"{LONG}\n{LONG}"),
        (f"<main><article><h1>A</h1><p>{LONG}</p></article><article><h1>B</h1><p>{LONG}</p></article><article><a href=x>{LONG}</a></article></main>", f"A\n{LONG}\nB\n{LONG}"),
        (f'<article><div data-id="ad"><p>{LONG}</p></div><div title="the hidden cave"><p>{LONG}</p></div></article>', f"{LONG}\n{LONG}"),
        (f'<article><p>{LONG}</p><div hidden><p>no</p></div><div id=ad><p>no</p></div></article>', LONG),
    ],
)
def test_words_of_the_list_are_judged(html, want):
    assert html_text.main_text(html) == want


def test_unclosed_controls_take_linear_time():
    began = time.process_time()
    html_text.main_text("<button><svg><select>x" * 100_000)
    assert time.process_time() - began < 20


def test_article(spark):
    got = text_of(spark, ARTICLE).split("\n")
    assert got == [
        "Title of it",
        "First para\xadgraph, with a comma, and bold <b> text link.",
        "Second one has more, and more, and more text éé !",
        "one item",
        "two items",
        "Quoted, in full.",
    ]


def test_divs_without_article(spark):
    html = "<body><div class=menu><a href=x>a</a> <a href=y>b</a></div><div><div><p>One, two, three, four, five words and more of them.</p></div><p>Short.</p><div><p>Another, one, two, three, four, long enough to be a part.</p></div></div><div id=footer>x</div>"
    assert text_of(spark, html).split("\n") == ["One, two, three, four, five words and more of them.", "Short.", "Another, one, two, three, four, long enough to be a part."]


def test_nested_containers(spark):
    body = "<p>One, two, three, four, five words and more of them.</p><h2>Sub</h2><p>Another, one, two, three, four, long enough to be a part.</p><button>Share</button>"
    want = ["Head", "One, two, three, four, five words and more of them.", "Sub", "Another, one, two, three, four, long enough to be a part."]
    tail = "<div class=x><p>Other, words, of, some, length, that, stand, elsewhere, on, the, page.</p></div>"
    for page in (
        f"<article><header><h1>Head</h1></header><div><div class=body>{body}</div></div></article>",
        f"<main><div><h1>Head</h1><div class=story>{body}</div></div></main>",
        f"<div><h1>Head</h1><div>{body}</div></div>",
        f"<article><h1>Head</h1><section>{body}</section></article>{tail}",
    ):
        assert text_of(spark, f"<body><nav>x</nav>{page}<footer>f</footer></body>").split("\n") == want, page


def test_short_and_broken(spark):
    assert text_of(spark, "<html><body><nav>n</nav><article><h1>A.</h1><p>A.</p></article><footer>f f f</footer>") == "A.\nA."
    assert text_of(spark, "<article><p>cut of</p><p>in the mid &am") == "cut of\nin the mid &am"
    assert text_of(spark, "<article><p>text</p><p>more</p></arti") == "text\nmore"
    assert text_of(spark, None) == "" and text_of(spark, "") == "" and text_of(spark, "<script>x") == ""
    assert text_of(spark, "just text, no tags") == "just text, no tags"
    deep = "<div>" * 20000 + "<p>deep, deep, deep words go down and down here.</p>"
    assert text_of(spark, deep) == "deep, deep, deep words go down and down here."


def test_columns_and_rows(spark):
    df = pages(spark, [(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (None, None, None)]).selectExpr("*", "1 as text", "2 as n_chars")
    got = html_text.extract_text(df).collect()
    assert html_text.extract_text(df).columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "é", 1), (1, "é", 1)]
    assert html_text.extract_text(pages(spark, [])).count() == 0


def test_whole_articles_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.extract_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in rows:
        body = r.html.split("<article>", 1)[1].split("</article>")[0].split("</arti")[0]
        body = re.sub(r"<footer.*|<[^>]*$", "", body, flags=re.S)
        want = [" ".join(unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(b for b in want if b), r.page_id


@pytest.mark.parametrize("mark", [r"<\1div>", r"<\1section>", ""])
def test_scores_find_the_article_without_its_mark(mark):
    """The pages of the table with their article element renamed or removed, against what the element held."""
    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (html,) in rows:
        assert html_text.main_text(re.sub("<(/?)article>", mark, html)) == html_text.main_text(html)


def test_scores_choose_between_articles():
    """A page with a second, smaller article elsewhere keeps its own."""
    rows = duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet'").fetchall()
    for (html,) in rows:
        teaser = "<section><article><h3>More</h3><p>See it.</p></article></section>"
        assert html_text.main_text(html.replace("<article>", teaser + "<article>")) == html_text.main_text(html)


def revisit_rows():
    big, small = "<p>é\r\n\r\nWARC/1.1 " + "x" * 1200, "y" * 999
    rows = [(k, f"http://h{k}.example/", big) for k in range(1, 40)] + [(k, "http://s/", small) for k in range(50, 53)]
    return rows + [(60, "http://n/\r\nX: y", None), (61, None, ""), (62, "http://z/", "z" * 1000), (63, "http://z/", "z" * 1000), (63, "http://z/", "z" * 1000)]


def test_warc_round_trip(spark):
    rows = revisit_rows()
    path = warc.new_path(spark, "warc-test")
    df = pages(spark, rows).selectExpr("*", "'c' as digest", "1 as refers_to")
    warc.write_archives(df.drop("refers_to"), path)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in records:
        if r.record_type == "response":
            assert bytes(r.payload) == html[r.page_id]
        else:
            assert r.payload is None and html[r.refers_to] == html[r.page_id]
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved_records(spark, path).collect())
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        last = max(j for j, _, g in rows if (g or "") == (h or ""))
        again = len(raw) >= 1000 and last != k
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(want)


def test_archives_are_plain_warc(spark, tmp_path):
    """Each file by the gzip module alone: a member a record, warcinfo first, fields of the standard, unique ids."""
    rows, ids = revisit_rows(), set()
    path = f"{tmp_path}/a"
    listed = warc.write_archives(pages(spark, rows), path, date="2026-01-02T03:04:05Z", file_bytes=2000)
    assert listed.agg({"records": "sum"}).first()[0] == len(rows) and listed.count() > 1
    for row in listed.collect():
        with open(f"{path}/{row.file}", "rb") as file:
            data = file.read()
        found = [warc.parse_record(m) for m in warc.members(data)]
        assert b"".join(warc.members(data)) == gzip.decompress(data) and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        assert [f["WARC-Type"] == "warcinfo" for f, _ in found] == [True] + [False] * row.records
        for fields, block in found:
            assert fields["WARC-Date"] == "2026-01-02T03:04:05Z" and len(block) == int(fields["Content-Length"])
            ids.add(fields["WARC-Record-ID"])
    assert len(ids) == len(rows) + listed.count()


def test_revisit_without_its_response_stays(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 2000), (2, "http://b/", "x" * 2000), (3, "http://c/", "y")]
    path = f"{tmp_path}/b"
    listed = warc.write_archives(pages(spark, rows).repartition(3, "page_id"), path, file_bytes=1).collect()
    for row in listed:
        data = open(f"{path}/{row.file}", "rb").read()
        if any(warc.parse_record(m)[0].get("Page-ID") == "2" for m in warc.members(data)):
            os.remove(f"{path}/{row.file}")
    got = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.resolved_records(spark, path).collect()}
    assert got == {1: ("revisit", None, 2), 3: ("response", 1, None)}


def test_warc_clashing_columns(spark):
    crowded = pages(spark, revisit_rows()).selectExpr("*", "1 as n", "'x' as digest", "2 as original", "3 as refers_url", "4 as bytes", "5 as file", "6 as path", "7 as _html")
    path = warc.new_path(spark, "warc-crowded")
    warc.write_archives(crowded, path)
    assert warc.resolved_records(spark, path).count() == len(revisit_rows())


def test_warc_empty(spark):
    path = warc.new_path(spark, "warc-empty")
    warc.write_archives(pages(spark, []), path)
    assert warc.resolved_records(spark, path).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        k = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
        host, tail = rest[:k], rest[k:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0] or [len(tail)])]
    fit = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


URLS = [
    None, "", "no scheme", "http://", "http://COM", "https://example.com/en/1", "http://www.example.com/en/", "HTTP://A.WWW.EXAMPLE.COM/en/x?y#z", "http://example.com/enx", "http://notexample.com/en/",
    "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/", "http://x.org?a=/b", "http://x.org#/fr/", "a://b://c/d", "http://net/es/", "http://x.net:80/es/", "http://u@x.net/es/", "http://ÀB.com/",
    "ht\ntp://x.net/es/\nq",
]


def test_rules(spark):
    rows = [(k, u, "<p>") for k, u in enumerate(URLS)] * 2
    got = url_filter.filter_urls(pages(spark, rows), url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, action = brute_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, action or "allow"), URLS[r.page_id]


LINK = '<link href="%s" rel="canonical">'
GO = "<meta http-equiv='refresh' content='0; url=%s'>"
ALIASES = [
    (1, "http://a.org/1", LINK % "http://b.org/1"),
    (2, "http://b.org/1", GO % "http://x.net/es/1"),
    (3, "http://c.org/1", LINK % "http://x.net/fr/2"),
    (4, "http://c.org/2", LINK % "http://c.org/1"),
    (5, "http://d.com/ok", LINK % "/other"),
    (6, "http://e.org/1#frag", LINK % "http://d.com/ok"),
    (7, "http://e.org/1", GO % "http://x.net/fr/3"),
    (8, "http://lone.org/", ""),
    (9, "http://f.org/", LINK % "//x.net/es/9"),
    (10, "http://g.org/", "<!-- " + LINK % "http://x.net/es/9" + " --><p>"),
    (11, "http://h.org/", "<!-- a --><p>" + LINK % "http://x.net/es/9" + "<!-- b"),
]


def test_aliases(spark):
    rows = ALIASES
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages(spark, rows), url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "block"}
    more = spark.createDataFrame([("http://lone.org/", "https://q.net/es/7"), (None, "x")], "a string, b string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages(spark, rows), url_filter.rule_table(spark, url_filter.RULES), more).collect()}
    assert got[8] == "block"
    assert url_filter.filter_urls(pages(spark, []), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_aliases_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [*ALIASES, (20, None, None)])
    want = sorted(con.sql(url_filter.URL_FILTER_SQL).fetchall())
    got = url_filter.filter_urls(pages(spark, [*ALIASES, (20, None, None)]), url_filter.rule_table(spark, url_filter.RULES))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_urls_with_hot_hosts_repeats_and_clashing_columns(spark):
    """One host and one URL in most rows, a very long page, columns named like the operator's own."""
    rows = [(k, "http://hot.org/a", GO % "http://x.net/es/1" if k == 0 else "") for k in range(600)]
    rows += [(1000 + k, f"http://hot.org/{k}", "x" * 300_000 if k == 0 else None) for k in range(200)] + [(None, None, None)]
    crowded = pages(spark, rows).selectExpr("*", "1 as host", "2 as path", "3 as node", "4 as rule", "5 as action", "6 as _n", "7 as component", "8 as a", "9 as b", "10 as t", "11 as base")
    got = url_filter.filter_urls(crowded, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(got) == len(rows)
    assert {r.verdict for r in got if r.page_id is not None and r.page_id < 1000} == {"block"}
    assert {r.verdict for r in got if r.page_id is None or r.page_id >= 1000} == {"allow"}


def test_relative_and_escaped_aliases(spark):
    page = "http://a.net/fr/dir/page?x=1"
    references = ["page2.html", "../a", "../../../up", "./", "?id=3", "/es/./b/../c", "//b.net/es/", "http://c.org/", "d/e;f?a=1&b=2", "/fr/q?a=1&b=2", ".", ".."]
    for base in (page, "http://a.net/fr/dir/", "http://a.net"):
        for r in references:
            assert url_filter.resolve(base, r).split(":", 1)[1] == urljoin(base, r).split(":", 1)[1], (base, r)
    assert url_filter.resolve(page, "mailto:a@b.c") is None and url_filter.resolve("none", "a") is None
    rows = [
        (1, "http://x.org/s/1", '<link rel="canonical" href="2">'),
        (2, "http://x.org/s/2", '<meta http-equiv="refresh" content="0; url=../../t?a=1&amp;b=2">'),
        (3, "http://x.org/t?a=1&b=2", '<link rel="canonical" href="http://b.net/fr/z?c=1&amp;d=2">'),
        (4, "http://x.org/u", '<base href="http://c.net/es/"><link rel=canonical href="v">'),
        (5, "http://x.org/w", '<link rel="canonical" href="v">'),
        (6, "http://x.org/y", '<link rel="canonical" href="mailto:a@b.net/fr/">'),
    ]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages(spark, rows), url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}


def test_links_in_raw_elements_are_none(spark):
    link = '<link rel="canonical" href="http://q.net/es/z">'
    hidden = ["<script>var t='%s'</script>", "<style>/* %s */</style>", "<TEXTAREA rows=2>%s</TEXTAREA>", "<template><p>%s</p></template>", "<title>%s</title>", "<script>%s", "<!-- <script> --><!-- %s -->", "<script>'<!--'</script><!-- %s"]
    shown = ["<script>'<!--'</script>%s", "<!-- <script> -->%s", "<style></style >%s", "<p>script</p>%s", "<scripted>%s"]
    rows = [(k, f"http://x.org/{k}", h % link) for k, h in enumerate(hidden)] + [(100 + k, f"http://x.org/s{k}", h % link) for k, h in enumerate(shown)]
    rows.append((200, "http://x.org/long", "<p>x</p>" * 200_000 + "<script>" + "y" * 1_000_000 + "</script>" + link))
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages(spark, rows), url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert {k for k, v in got.items() if v == "block"} == {k for k, *_ in rows if k >= 100}
    con = duckdb.connect()
    frame = pandas.DataFrame(rows[:-1], columns=["page_id", "url", "html"])
    con.register("pages", frame)
    told = con.sql(f"SELECT page_id, verdict FROM ({url_filter.URL_FILTER_SQL})").fetchall()
    assert dict(told) == {k: v for k, v in got.items() if k < 200}


PROSE = "This is a long paragraph of the article, with commas, and words, that goes on for a good while so that it scores well here."
IN_ARTICLE = f"<html><body><nav><a href=/a>x</a></nav><%s><h1>T</h1><p>{PROSE}</p>%s<p>{PROSE} End.</p></%s></body></html>"


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("name", ['section id="social-history"', 'section id="ad-hoc"', 'section id="banner-years"', 'div class="widget-text"', 'div id="menu"'])
def test_names_of_the_articles_own_delete_no_prose(name, tag):
    element = name.split()[0]
    text = html_text.main_text(IN_ARTICLE % (tag, f"<{name}><p>Kept. {PROSE}</p></{element}>", tag))
    assert text == f"T\n{PROSE}\nKept. {PROSE}\n{PROSE} End."


@pytest.mark.parametrize(
    "name",
    ['div class="ad"', 'div class="ad-slot-2"', 'div id="comments"', 'section class="comments-area"', 'div class="comment-text-body"', 'div class="cookie-notice"', 'div class="social-share"', 'ol class="thread"', 'div class="sidebar-history"'],
)
def test_what_is_no_article_goes_from_within_it(name):
    element = name.split()[0]
    inner = "li" if element == "ol" else "p"
    text = html_text.main_text(IN_ARTICLE % ("article", f"<{name}><{inner}>Gone. {PROSE}</{inner}></{element}>", "article"))
    assert text == f"T\n{PROSE}\n{PROSE} End."


def test_short_ends_titles_and_open_frames():
    body = f"<body><div id=w><div class=lead><p>Short lead.</p></div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>Bye now.</p></div><div><p><a href=x>More.</a></p></div></div></body>"
    assert html_text.main_text(body) == f"Short lead.\n{PROSE}\n{PROSE}\nBye now."
    assert html_text.main_text(f"<main><h1>Title</h1><article><p>{PROSE}</p></article></main>") == f"Title\n{PROSE}"
    assert html_text.main_text(f"<main><h1>Site</h1><article><h1>Own</h1><p>{PROSE}</p></article></main>") == f"Own\n{PROSE}"
    assert html_text.main_text(IN_ARTICLE % ("article", "<iframe src=x>", "article")).endswith("End.")
    assert "fall" not in html_text.main_text(IN_ARTICLE % ("article", "<iframe src=x>fall</iframe>", "article"))
