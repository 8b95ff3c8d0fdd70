"""URL rules against a plain scan of the rule list, and the join form against the trie."""

import re

from kinloom.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.COM/en/7", "https://a.b.example.com/en/70?x=/de/", "http://example.com/en", "http://example.com/en/", "http://example.net/de/80",
    "http://x.net/de/", "http://net/de/1", "http://xnet/de/", "ftp://y.org/es/#t", "http://org?x", "http://example.com:80/en/7", "a://b://com/en/", "http://com/en/x://net/de/", "http://.com/en/", "http://ÉX.com/en/", "http://example.com/en/7",
]


def _plain(url, rules=U.RULES, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h.count("."), len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, default)))


def test_judge(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, path string")
    for rows in (U.judge(pages, U.RULES).collect(), U.judge_by_join(pages, U.RULES).collect()):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: _plain(u) for i, u in enumerate(URLS * 2)}


def test_block_wins_and_partial_segments():
    trie = U.Trie([("block", "a.b", "/x"), ("allow", "a.b", "/x"), ("allow", "b", "/xy/z"), ("allow", "a.b", "")])
    assert trie.find("a.b", "/xy/zz") == ("block", "a.b/x")
    assert trie.find("c.b", "/xy/zz") == ("allow", "b/xy/z")
    assert trie.find("q.a.b", "/") == ("allow", "a.b")
    assert trie.find("b", "/x") is None


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), U.RULES).count() == 0
