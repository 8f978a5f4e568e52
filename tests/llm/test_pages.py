"""URL filter and HTML extraction: brute force and edges."""

import re

import pytest

from scorelens.llm import html_extract as X
from scorelens.llm import queries as Q
from scorelens.llm import url_filter as U

SF = "/root/testdata/sf0.001"


def plain_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path, _ = re.fullmatch(r"([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in U.SITE_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    if best:
        return host, path, *best
    for r in U.PATTERN_RULES if url is not None else ():
        if re.search(r.pattern, url.lower()):
            return host, path, None, r.verdict
    return host, path, None, "allow"


URLS = [
    None, "", "no scheme", "http://", "://x.org", "http://A.Example.ORG/es/1", "http://example.org", "http://org/",
    "http://notexample.org/es/", "http://example.org/en/19?x=://y.com/de/", "http://a.com/fr/?q#f", "http://a.com/de",
    "http://a.com/de/", "http://com/fr/x", "https://www.cheap-pills.example.net/x", "https://cheap.net/pills",
    "https://x.net/banners/a.gif?1", "http://ads12.x.net/", "http://x.net/cgi-bin/a", "http://x.net/a?year=2020&month=1",
    "https://x.net/.well-known/a?u=casino", "https://casino.net", "http://x.net/login.php#top", "HTTP://X.NET/LOGIN.PHP",
    "http://u@h.org:80/p?http://z", "http://h.org?x/y", "http://example.org/en/1/\n", "http://ex.org/\u00e9?\u00e9",
    "http://free-bets.example.de", "http://a.doubleclick.net/x", "http://x.net/wp-admin/", "x://y/z://com/fr/",
]


def test_url_query_is_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in Q.op1_url_filter(spark, SF).collect()}
    assert got == {r.page_id: plain_judge(r.url) for r in pages}


def test_url_rules_and_edges(spark):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(URLS + URLS)}
    assert U.filter_urls(df.limit(0)).count() == 0


def test_every_rule_matches_only_urls_with_its_tokens():
    for r in U.PATTERN_RULES:
        for u in URLS:
            if u and re.search(r.pattern, u.lower()):
                assert set(r.tokens) <= set(U.TOKEN.findall(u.lower())), (r.name, u)


def test_no_production_rule_runs_on_every_url():
    by, always = U.pattern_index(U.PATTERN_RULES, {})
    assert always == [] and sum(map(len, by.values())) == len(U.PATTERN_RULES)
    for url, name in [("http://ads12.x.net/", "ad-server"), ("http://adserver.x.net/", "ad-server"), ("http://x.net/banner/a.png", "banner"),
                      ("http://x.net/signin.aspx", "login"), ("http://x.net/?month=1&day=2", "calendar-trap")]:
        hit = [r.name for r in U.PATTERN_RULES if re.search(r.pattern, url) and set(r.tokens) <= set(U.TOKEN.findall(url))]
        assert hit == [name]


def test_rules_from_a_table(spark):
    kinds = "position int, name string, pattern string, tokens array<string>, verdict string"
    rows = [(2, "b", "/shop[0-9]+/", ["shop"], "block"), (1, "a", "/shop7/", ["shop", "7"], "allow")]
    rules = U.read_rules(spark.createDataFrame(rows, kinds))
    assert [r.name for r in rules] == ["a", "b"]
    df = spark.createDataFrame([("http://x.net/shop7/",), ("http://x.net/shop71/",), ("http://x.net/shop/",)], "url string")
    assert [(r.verdict, r.pattern) for r in U.filter_urls(df, pattern_rules=rules).collect()] == [("allow", "a"), ("block", "b"), ("allow", None)]
    for bad in ((1, "a", "(", ["a"], "block"), (1, "a", "a", [], "block"), (1, "a", "a", None, "block"), (1, "a", "a", ["a7"], "block"),
                (1, "a", "a", ["a"], "maybe"), (1, "a", None, ["a"], "block")):
        with pytest.raises(ValueError, match="'a'"):
            U.read_rules(spark.createDataFrame([bad], kinds))


def test_rules_stand_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://ads.net/",), ("http://ads.org/",), ("http://track.net/",), (None,)], "url string")
    counts = U.token_counts(df, "url", ["ads", "track", "never"])
    assert counts == {"ads": 2, "track": 1}
    by, always = U.pattern_index([U.PatternRule("a", "x", ("ads", "track")), U.PatternRule("b", "y", ("ads", "never")),
                                  U.PatternRule("c", "z", ())], counts)
    assert by == {"track": [0], "never": [1]} and always == [2]


def test_too_many_rules_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_RULES", 3)
    with pytest.raises(ValueError):
        U.filter_urls(spark.createDataFrame([("x",)], "url string"))


PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad box">Buy</div>
<aside>Side</aside><!-- <p>no</p> --><div class=cookie-notice>We use cookies</div>
<article class="post with-sidebar"><header><h1>Real &amp; true</h1></header><p>First <b>bo</b>ld &eacute;&#33;
 line<br>two<p>Second&nbsp;par <table><tr><td>a<td>b</table><div class="share">Share</div>
<form><p>Mail</form><section id=comments><p>Nice!</p></section><ul><li>one<li>two</ul></article>
<div id="sidebar">More</div><footer>&copy; x</footer>"""


def test_structure():
    assert X.main_text(X.parse(PAGE)) == "Real & true First bold é! line two Second par a b one two"


def test_comments_are_not_articles():
    page = "<article class='post comments-open'><p>Text</p></article><article class='comment by-ann'><p>Nice</p></article>"
    assert X.main_text(X.parse(page)) == "Text"


def test_pages_without_article_lose_their_template(spark):
    rows = [(i, "http://h.net/%d" % i, f"<body><div class=x>Welcome to us</div><p>Text number {i}.</p><p>Same words</p>"
             f"<div class=y>Call <b>now</b></div>") for i in range(6)]
    rows += [(6, "http://h.net/6", None), (7, None, "<p>only</p>"), (8, None, ""), (8, None, ""),
             (9, "http://other.net/", "<div class=x>Welcome to us</div><p>stays</p>")]
    df = spark.createDataFrame([r + ("t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = [(r.page_id, r.text) for r in X.extract(df).collect()]
    want = [(i, f"Text number {i}.") for i in range(6)] + [(6, ""), (7, "only"), (8, ""), (8, ""), (9, "Welcome to us stays")]
    assert sorted(got) == want
    assert X.extract(df.limit(0)).count() == 0


def test_copied_articles_stay(spark):
    html = "<nav>Menu</nav><article><p>The same article on every page of the site.</p></article>"
    df = spark.createDataFrame([(i, "http://h.net/", html) for i in range(10)], "page_id long, url string, html string")
    assert {r.text for r in X.extract(df).collect()} == {"The same article on every page of the site."}


def test_articles_lose_what_recurs_on_distinct_articles(spark):
    """A box under a neutral class name, in articles told apart by their longest paragraph."""
    box = "<div class=x7><p>Our shop is open every day until nine in the evening.</p></div>"

    def page(i, body, extra=box):
        return i, f"http://h.net/{i}", f"<main><h1>Head</h1><p>{body}</p>{extra}<p>Shared passage.</p><ul><li>one</ul></main>"

    own = ["Paragraph %d, long enough to tell this article from all of the others there." % i for i in range(6)]
    rows = [page(i, own[i], box + f"<div class=y>{i}</div>") for i in range(6)]
    # Copies of one article do not make its parts template, nor does a box on four articles.
    inner = "<section><p>Only in this article, which was copied to many pages of the host.</p></section>"
    rows += [page(10 + i, own[0], f"{inner}{box}") for i in range(8)]
    rows += [page(20 + i, own[i], "<div class=z>Four times.</div>") for i in range(4)]
    df = spark.createDataFrame([r + (1, 2) for r in rows], "page_id long, url string, html string, own int, host int")
    got = {r.page_id: r.text for r in X.extract(df).collect()}
    section = "Only in this article, which was copied to many pages of the host. "
    want = {i: f"Head {own[i]} {i} Shared passage." for i in range(6)}
    want |= {10 + i: f"Head {own[0]} {section}Shared passage." for i in range(8)}
    want |= {20 + i: f"Head {own[i]} Four times. Shared passage." for i in range(4)}
    # The list is a box on every page.
    assert got == want
    # Below the host's share of articles nothing is template.
    got = {r.page_id: r.text for r in X.extract(df, inner_share=1.1).collect()}
    assert got[0] == f"Head {own[0]} Our shop is open every day until nine in the evening. 0 Shared passage. one"


@pytest.mark.parametrize("html", ["<", "<p", "<!", "<![", "<!x", "<![if]>a", "</", "&#99999999;", "<a b='", "<p>" * 3000, "\x00<p>\x00",
                                  "</p></div>a", "<script>x", "<!--", "<title>t", "<svg/><p>a", "<article>" * 50 + "a"])
def test_broken_markup(html):
    assert isinstance(X.main_text(X.parse(html)), str)
    X.site_subtrees(X.parse(html))


@pytest.mark.parametrize("odd", ["<![ endif]-->", "<![foo[x]]>", "<![endif]-->", "<![if !x]>", "<![]>", "<![CDATA[x>", "<![1]>", "<!>",
                                 "<![ endif]><![foo[x]]>", "<svg><![CDATA[</svg>]]></svg>", "&#" + "9" * 6000 + ";"])
def test_text_behind_malformed_sections(odd):
    root = X.parse(f"<article><p>one</p>{odd}<p>two &#{'0' * 2000}65;</p></article><div>three</div>")
    words = X.main_text(root).split()
    assert words[0] == "one" and words[-2:] == ["two", "A"]
    assert len(X.site_subtrees(root)) == 1


def test_html_query(spark):
    rows = {r.page_id: r for r in Q.op2_html(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        r = rows[p.page_id]
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        import html as h
        want = " ".join(h.unescape(re.sub(r"<br>|</?p>|</?h1>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert (r.url, r.text, r.n_chars) == (p.url, want, len(want))
