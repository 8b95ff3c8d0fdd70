"""Extraction on written pages, and the host's vote."""

from kinloom.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="x1">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use</div>
<article class="post-12"><h1>Head &amp; line</h1><p>One <b>two</b>\n three<br>four<p>Caf&eacute; &lt;b&gt; a < b
<ul><li>x<li>y <a href="q">z</a></ul><div class="ad">Buy</div><form><p>Mail</p><input></form><blockquote>Said</blockquote></article>
<div id="comments"><p>First! First! First! First! First! First! First! First! First! First! First!</p></div><aside>Side</aside><footer>&copy; me</footer>"""
TEXT = "Head & line\nOne two three four\nCafé <b> a < b\nx\ny z\nSaid"


def test_page():
    path, weight = H.best(H.parse(PAGE))
    assert {b.node.around.path for b in H.parse(PAGE) if b.text == "Said"} == {path}
    assert weight > 900
    assert H.extract(PAGE, path) == TEXT
    assert H.extract(PAGE, "/no/such") == TEXT
    assert H.extract(PAGE.replace("</article>", ""), path) == TEXT


def test_broken_pages():
    for page in (None, "", "<", "<p", "<!--", "<script>", "<p></p>", "</div></div>", "<article></article>", "<a href='x"):
        assert isinstance(H.extract(page, "/a"), str)
    assert H.extract(None, None) == H.extract("<script>x</script>", None) == ""
    assert H.extract("just &lt;text", None) == "just <text"
    assert H.extract("<div>" * 3000 + "deep", None) == "deep"


def _plain(page):
    """Text of an article of sections by the library's own parser: every block, nothing chosen or dropped."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out = [""]

        def handle_starttag(self, tag, attrs):
            self.out.append("")

        handle_endtag = lambda self, tag: self.out.append("")

        def handle_data(self, data):
            self.out[-1] += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n".join(x for x in (" ".join(t.split()) for t in reader.out) if x)


def test_whole_articles():
    import random

    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["stone", "r&amp;d", "water", "&eacute;t&eacute;", "light"]) for _ in range(n))
    for outer in ("main", "article", "div", "section"):
        for sections in (1, 2, 3, 9):
            for tag in ("div", "section"):
                parts = "".join(f"<{tag}><h2>{text(2)}</h2><p class='share'>{text(r.randint(5, 90))}</p><p>{text(4)}</p></{tag}>" for _ in range(sections))
                own = f"<{outer} class='x has-sidebar'><h1>{text(3)}</h1>{parts}</{outer}>"
                page = f"<body class='sidebar'><nav><p>{text(9)}</p></nav><div class='wrap'>{own}</div><div class='ad'>{text(90)}</div><footer>{text(5)}</footer></body>"
                assert H.extract(page, H.best(H.parse(page))[0]) == H.extract(page, None) == _plain(own)


def test_hostile_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    pages = ["<a " * 350_000, "<" * 1_000_000, "<p '\">" * 150_000, "<div>" * 200_000, "<div><p>x" * 50_000 + "</section>" * 100_000, "<x>" * 200_000 + "t", "<!-- " * 200_000, "<script>" * 100_000, "<a href='" * 100_000, "<p><div>" + "<x>y" * 100_000]
    for page in pages:
        first = time.process_time()
        H.extract(page, "/none")
        assert time.process_time() - first < 20, page[:20]
    tracemalloc.start()
    H.extract("<div>" * 50_000, "/none")
    assert tracemalloc.get_traced_memory()[1] < 75e6
    tracemalloc.stop()


def test_host_consensus(spark):
    good = "<body><div class='c{0}'><p>" + "main text of the page " * 5 + "</p></div><div class='z'><p>{1}</p></div></body>"
    pages = [(i, f"http://h.com/{i}", good.format(i, "small")) for i in range(5)]
    odd = (9, "http://h.com/odd", good.format(9, "long text that the page's own score would choose instead " * 9))
    rows = [*pages, odd, (10, None, None), (11, "http://h.com/n", None), (12, "http://other.com", "<p>alone</p>"), (12, "http://other.com", "<p>alone</p>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    for limit in (H.BROADCAST_BYTES, -1):
        got = H.main_text(df, limit).collect()
        assert len(got) == len(rows)
        text = {r.page_id: r.text for r in got}
        assert text[9] == text[0] == ("main text of the page " * 5).strip()
        assert (text[10], text[11], text[12]) == ("", "", "alone")
        assert all(r.n_chars == len(r.text) for r in got)
    assert H.main_text(df.limit(0)).count() == 0
