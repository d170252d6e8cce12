import duckdb
import numpy as np

from coppice.llm import html_text as ht
from coppice.llm import url_filter as uf
from tests.llm.fixtures import SF

ODD_URLS = [None, "", "x", "://", "http://", "HTTP://A.NET", "http://a.net/", "http://NET/x?y", "http://xnet/", "http://b.example.net/en/1#f", "http://example.net/en", "http://example.net/EN/", "http://example.com/de/?q", "http://u@example.com:80/de/", "http://a.org/fr/x/?u=http://z.net/", "a://b://c.net/", "http://a.b.c.org?/fr/", "http://é.net/", "http://example.com.net/de/", "http://a..net/", "http://a.net/" + "x" * 50000]


def plain_verdict(url):
    host, path = uf.split_url(url)
    fits = [(len(r), r, v) for r, v in uf.RULES for h, p in [uf._rule_parts(r)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_split():
    assert uf.split_url("a://b://c.net/") == ("b:", "//c.net/") and uf.split_url("hTTp://A.É?x#y") == ("a.É", "")


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(ODD_URLS)], "page_id long, url string, host int")
    want = {i: plain_verdict(u) for i, u in enumerate(ODD_URLS)}
    for got in (uf.judge(pages, uf.RULES), uf.judge_by_join(pages, spark.createDataFrame(uf.RULES, "rule string, verdict string"))):
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert {r.page_id: tuple(r)[2:] for r in got.collect()} == want
    assert {r.verdict for r in uf.judge(pages, [], default="block").collect()} == {"block"}
    assert uf.judge(pages.limit(0), uf.RULES).collect() == []
    both = uf.judge(pages, [("net/", "allow"), ("net/", "block"), ("net/", "allow")]).where("rule is not null").collect()
    assert {r.verdict for r in both} == {"block"}


def test_collisions_are_confirmed():
    same = lambda t: 7
    a = uf.DigestArray(np.frombuffer(uf.DigestArray.pack([("a.net/", "block"), ("b.net/", "allow")], same), np.uint8))
    hits = a.probe([b"b.net/", b"c.net/", b"a.net/"], same)
    assert hits[1] == -1 and sorted(hits[[0, 2]].tolist()) == [0, 1] and hits[0] != hits[2]


def test_url_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(uf.OP2_SQL)
    names = [x[0] for x in want.description]
    key = lambda r: r[0]
    assert sorted(map(tuple, uf.op2_url_filter(spark, SF).select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
    con.execute("create or replace view pages as select * from (select unnest($1) as page_id, unnest($2) as url)".replace("$1", str(list(range(len(ODD_URLS))))).replace("$2", "[" + ",".join("NULL" if u is None else "'" + u + "'" for u in ODD_URLS) + "]"))
    assert {r[0]: r[1:] for r in con.execute(uf.OP2_SQL).fetchall()} == {i: plain_verdict(u) for i, u in enumerate(ODD_URLS)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, many of them.</div>
<div class="top ad">Buy, buy, buy, now, please</div><article class="post"><h1>Title &amp; more</h1><p><b>First,
  part&nbsp;one.<br><p>Second <a href="x">link</a> &lt;here&gt;.</p><ul><li>one<li>two</ul><form><input>Send</form></article>
<aside>Side text</aside><section id="comments"><p>Great article, thanks, a lot, really, indeed, yes.</p></section><footer>&copy; x</footer>"""


def test_main_text():
    assert ht.main_text(PAGE) == "Title & more\nFirst, part one.\nSecond link <here>.\none\ntwo"
    assert ht.main_text(None) == ht.main_text("") == ht.main_text("<p></p>") == ""
    assert ht.main_text(" just  text &amp; ") == "just text &"
    assert ht.main_text("<div><p>" + "a, " * 40 + "</p></div>") == ("a, " * 40).strip()
    assert ht.main_text("<body><div>Only a line</div></body>") == "Only a line"
    long = "<article>" + "<p>Some words, here.</p>" * 20000 + "</article>"
    assert ht.main_text(long).count("\n") == 19999
    assert ht.main_text("<div>" * 3000 + "deep text" + "</div>" * 10) == "deep text"


SAID = "Some running text of the article, with commas, and enough of it to be a paragraph that people read. "


def article(inside):
    return f'<body><nav><a href="/">Home</a></nav><div id="menu"><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></div><article><h1>Title</h1><p>{SAID * 3}</p>{inside}<p>{SAID * 2}End.</p></article><div class="page-footer"><p>{SAID}</p></div></body>'


def test_names_within_an_article_drop_no_text():
    frame = ["Title", (SAID * 3).strip()], [SAID * 2 + "End."]
    for inside, text in (
        ('<h2 id="related-work">Related work</h2>', ["Related work"]),
        ('<h2 id="header-files">Header files</h2>', ["Header files"]),
        ('<h3 class="comments">On comments</h3>', ["On comments"]),
        (f'<section id="discussion"><p>{SAID}</p></section>', [SAID.strip()]),
        (f'<div class="widget"><p>{SAID}</p><p>Short.</p></div>', [SAID.strip(), "Short."]),
        ('<div class="share-price-table"><table><tr><td>ACME<td>12.5</table></div>', ["ACME", "12.5"]),
        ('<ul class="menu"><li>Soup 3.50<li>Bread 1.20</ul>', ["Soup 3.50", "Bread 1.20"]),
        ('<p>A <span class="notice-of-death">notice</span> of <a class="related-term" href="x">terms</a>.</p>', ["A notice of terms."]),
        ('<div class="share"><a href="x">Facebook</a> <a href="y">Mail</a></div>', []),
        ('<div class="related-posts"><ul><li><a href="x">One more post that you may like</a><li><a href="y">Another</a></ul></div>', []),
        ('<div class="ad">Buy now</div>', []),
        (f'<div class="sidebar"><p>{SAID}</p></div><div id="cookie-notice">{SAID}</div><div class="comments"><p>{SAID}</p></div>', []),
        ('<form action="s"><input name="q"><label>Your mail</label><button>Send</button></form>', []),
    ):
        assert ht.main_text(article(inside)) == "\n".join([*frame[0], *text, *frame[1]]), inside


def test_what_holds_the_page_is_no_furniture():
    for wrap in ('<form method="post" action="x">%s</form>', '<div id="header-wrapper">%s</div>', '<div class="sidebar-left">%s</div>', '<div class="modal">%s</div>'):
        page = wrap % (article("").removeprefix("<body>").removesuffix("</body>"))
        assert ht.main_text(f"<body>{page}</body>") == ht.main_text(article("")) != ""
    plain = f'<body><div class="top-menu"><a href="/">Home</a> <a href="/x">X</a></div><div><p>{SAID * 2}</p><section id="discussion"><p>{SAID * 2}</p></section></div><div class="footer"><p>{SAID}</p></div><div class="social"><a href="f">F</a></div></body>'
    assert ht.main_text(plain) == "\n".join([(SAID * 2).strip()] * 2)
    assert ht.name_kind("post related-posts") == "link" and ht.name_kind("related-work share-price") == "" and ht.name_kind("pageHeader ad1") == "clear"


def test_rows_of_pages(spark):
    rows = [(1, "u", None, 1), (2, "u", "", 1), (3, "u", PAGE, 1), (3, "u", PAGE, 1), (None, None, "<p>" + "word " * 200_000, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rest int").selectExpr("*", "'old' as Text", "1 as N_Chars", "2 as reST2")
    out = ht.extract(pages)
    assert out.columns == ["page_id", "url", "rest", "reST2", "text", "n_chars"]
    got = [tuple(r) for r in out.collect()]
    assert [len(r[4]) for r in got] == [0, 0, len(ht.main_text(PAGE)), len(ht.main_text(PAGE)), 999_999] and all(r[5] == len(r[4]) for r in got) and got[2] == got[3]


def test_two_sections_are_kept():
    part = "<div><p>%s</p></div>" % ("Some running text, with commas, that goes on. " * 8)
    assert ht.main_text("<body><div>" + part * 2 + "</div><div><a href=x>link one</a> <a href=y>link two</a></div></body>").count("\n") == 1


def test_html_query(spark):
    rows = ht.op4_html_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        import html
        import re

        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", article)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)
    assert ht.extract(spark.createDataFrame([], "page_id long, html string, text int")).columns == ["page_id", "text", "n_chars"]
