"""Page structure, boilerplate of a host, edges."""

import pyarrow as pa

from trafficlens.llm.html_text import Boilerplate, _anchors, _packed, _suffixes, host_of, main_text, page_blocks

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<script>if (a < b) document.write("<p>no</p>")</script><!-- <p>no</p> -->
<article><h1>Title &amp; more</h1><p><b>First
 paragraph.<br><p>Second&nbsp;&lt;one&gt; &eacute;&#233;</p><div class="ad">Buy</div><aside>Side</aside>
<section id="comments"><p>A reader says</p></section><ul><li>point <i>one</i></li><li>two</li></ul></article>
<form><p>Search</p></form><footer>&copy; me</footer></body></html>"""


def test_article():
    main = [t for k, t in page_blocks(PAGE) if k == "main"]
    assert main == ["Title & more", "First paragraph.", "Second <one> éé", "point one", "two"]


def test_hosts():
    assert host_of("https://user@A.Example.org:80/x?y") == "a.example.org"
    assert host_of("//b.example/x") == "b.example" and host_of(None) == host_of("nothing") == ""


def test_boilerplate_of_a_host(spark):
    common = "all rights reserved by the owner of this site since long ago"
    page = "<html><body><p>{}</p><p>" + common + " {}</p></body></html>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page.format(f"unique text of page {i}", f"number {i}")) for i in range(6)]
    rows += [(6, "http://alone.example/", page.format("own", "x")), (7, "http://twice.example/", page.format("own", "y"))]
    rows += [(7, "http://twice.example/", page.format("own", "y"))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"unique text of page {i}\n{i}" for i in range(6))
    assert got[6] == f"own\n{common} x" and got[7] == f"own\n{common} y"


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [
        (1, None, None, 1), (None, "http://a", "", 2), (None, None, None, 3), (2, "x", "plain text", 4),
        (3, "http://a", "<p>unclosed <b>bold", 5), (4, "http://a", "<a title='x>y' href=\"<z>\">l</a", 6),
        (5, "http://a", deep, 7), (6, "http://a", "<article>" + "<p>w &amp; x</p>" * 20000 + "</article>", 8),
        (7, "http://a", "<script>never closed <p>a</p>", 9),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = main_text(frame).collect()
    assert len(got) == 9 and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == "" and by_id[2] == "plain text" and by_id[3] == "unclosed bold" and by_id[5] == "x" and by_id[7] == ""
    assert by_id[6] == "\n".join(["w & x"] * 20000)
    assert main_text(frame.limit(0), Boilerplate()).collect() == []


def test_side_matter_around_and_on_articles(spark):
    body = "<div><p>" + " ".join(f"word{i}" for i in range(60)) + "</p></div>"
    comment = '<section id="comments"><article><p>A reader says</p></article></section>'
    rows = [
        (1, "<article><p>The text</p></article>" + comment),
        (2, "<article><p>The text</p></article><article class='comment depth-2'><p>Reader</p></article>"),
        (3, body + comment),
        (4, body + "<article><p>A teaser</p></article>"),
        (5, "<form id='f'><article class='post has-comments'><p>The text</p></article></form>"),
    ]
    frame = spark.createDataFrame([(i, f"http://h{i}/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(frame).collect()}
    assert got[1] == got[2] == got[5] == "The text"
    assert got[3] == " ".join(f"word{i}" for i in range(60))
    assert got[4].startswith("word0 word1") and got[4].endswith("A teaser")


def test_repeats_inside_articles(spark):
    notice = " ".join(f"notice{i}" for i in range(25))
    quote = " ".join(f"quote{i}" for i in range(15))
    page = "<article><p>{}</p><p>" + notice + "</p><p>" + quote + "</p></article>"
    own = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(5)]
    # what lies between differs, so that the two repeats do not become one run
    rows = [(i, "http://h/", page.format(own[i]).replace("</p><p>quote0", f"</p><p>between{i}</p><p>quote0")) for i in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{own[i]}\nbetween{i}\n{quote}" for i in range(5))


def test_pages_that_must_agree(spark):
    text = " ".join(f"word{i}" for i in range(40))
    phrase = "this is an ordinary phrase that some of the writers like to use often"
    rows = [(i, "http://pair/", f"<p>{text}</p>") for i in range(4)]
    rows += [(10 + i, "http://big/", f"<p>a{i} b{i} c{i} {phrase if i < 3 else ''} d{i}</p>") for i in range(100)]
    rows += [(200 + i, "http://short/", f"<p>one two three four five six own{i}</p>") for i in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text for i in range(4))
    assert all(got[10 + i] == f"a{i} b{i} c{i} {phrase} d{i}" for i in range(3))
    assert all(got[200 + i] == f"one two three four five six own{i}" for i in range(5))


def _batch(n):
    """Pages of a host with texts of their own and 40 common words."""
    common = " ".join(f"common{i}" for i in range(40))
    htmls = [f"<article><p>{' '.join(f'own{i}x{k}' for k in range(60))}</p></article><p>{common}</p>" for i in range(n)]
    return pa.record_batch({"page": pa.array(range(n), pa.int64()), "url": ["http://a.b/"] * n, "html": htmls})


def test_rows_of_pages_come_together():
    pages = _batch(50)
    (marks,) = _anchors(Boilerplate())(iter([pages]))
    assert set(marks.column("page").to_pylist()) == set(range(50))
    several = marks.to_pandas().groupby("anchor")["content"].nunique()
    common = sorted(several[several > 1].index)
    (packed,) = _packed(iter([pages]))
    asked = packed.append_column("_anchors", pa.array([common] * 50, pa.list_(pa.int64())))
    (found,) = _suffixes(Boilerplate())(iter([asked]))
    # the 29 suffixes of the common words, and some that begin before these
    assert (found.to_pandas().groupby("prefix")["content"].nunique() == 50).sum() == 29


def test_pages_travel_without_markup():
    pages = _batch(50)
    (packed,) = _packed(iter([pages]))
    assert sum(map(len, packed.column("packed").to_pylist())) < 0.5 * sum(map(len, pages.column("html").to_pylist()))
