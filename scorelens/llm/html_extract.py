"""Main text of web pages: site template removal and structural rules.

1. Every page is parsed to a tree.  Each element with text has a hash of its subtree (tag,
   class, text and children).
2. Spark counts the subtrees per host.  Outside article elements a subtree on at least
   ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's pages is template.  Inside them it is
   the ``BOX`` elements and those with a class or id that count, once per distinct article,
   and ``MIN_PAGES`` articles and ``INNER_SHARE`` of the host's make them template.  A page
   has few subtrees, so a host has few recurring ones, however many pages.
3. From each page the template's subtrees and the elements that are boilerplate by tag, role
   or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
   reader comments) are deleted.  The text is that of the article (``article``, ``main``,
   role main) elements, or of the whole body where there is none.

Articles are copied and share passages: two articles are distinct if their longest plain
paragraphs differ, so a copied article counts once however often it stands there, and a plain
paragraph, heading or list item of an article is never template by itself.
Character references are decoded, white space inside a block becomes one space, blocks are
joined by one space; nothing is capped.  A null html is empty and gives the empty text; a
null url belongs to the host ``''``; repeated rows count as pages of their own; an empty
table gives no rows; other columns but the html are kept, whatever their names, but for one
named like the output.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, stage

MIN_PAGES = 5
MIN_SHARE = 0.3
INNER_SHARE = 0.05  # of a host's distinct articles

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that do not break a block; all others do.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split())
# An open element of the first kind ends where one of the second starts.
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split())
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
            "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
            "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
# Elements of an article that can be template without a class or id, and those that hold its prose.
BOX = frozenset("address center details div dl fieldset figure hr ol section table ul".split())
PROSE = frozenset("p blockquote pre li dd td".split())
# An implied end does not reach beyond these.
SCOPE = frozenset("ul ol dl table td th article main section div body html".split())

GONE_TAGS = frozenset(
    "head script style noscript template iframe object svg math canvas nav aside footer form "
    "button select textarea datalist dialog menu".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert "
                       "menu menubar toolbar".split())
GONE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments disqus respond replies related recommended widget "
    "pagination pager toolbar skip".split())
# Page headers; inside an article a header holds its title.
HEADER_WORDS = frozenset("header masthead topbar".split())
# An article element of one of these is a reader's comment.
COMMENT_WORDS = frozenset("comment comments reply replies".split())
# Class names that start or end so tell what a page has, not what an element is.
STATE_START = frozenset("with without has no is not page layout body".split())
STATE_END = frozenset("open closed enabled disabled on off".split())
WORD = re.compile(r"[a-z]+")
# int() takes no number of thousands of digits; nine tell that a character reference is out of range.
LONG_NUMBER = re.compile(r"&#[0-9]{1000}")
NUMBER = re.compile(r"&#0*([0-9]{1,9})[0-9]*")


class Node:
    __slots__ = ("tag", "attrs", "children", "digest")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children, self.digest = tag, dict(attrs), [], None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for i in range(len(self.open) - 1, 0, -1):
            at = self.open[i].tag
            if tag in ENDED_BY.get(at, ()):
                del self.open[i:]
                break
            if at in SCOPE:
                break
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # "/>" closes void elements only, as in browsers

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.open[-1].children.append(Node("br"))
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("article", "main", "body") and tag in INLINE | {"p", "li"}:
                return  # a stray end tag does not close the article

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def parse_html_declaration(self, i):
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        # As in browsers: a comment up to the next ">", and a section of its own in svg and math only.
        if self.rawdata.startswith("<![CDATA[", i) and any(n.tag in ("svg", "math") for n in self.open):
            end = self.rawdata.find("]]>", i)
            if end >= 0:
                return end + 3
        return self.parse_bogus_comment(i)


def parse(html: str | None) -> Node:
    """Tree of a whole page, however broken its markup."""
    html = html or ""
    if LONG_NUMBER.search(html):
        html = NUMBER.sub(r"&#\1", html)
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _post_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in node.children if not isinstance(c, str))
    return out[::-1]


def hash_subtrees(root: Node) -> None:
    """``digest`` of every element: 0 without text."""
    for node in _post_order(root):
        parts, some = [node.tag, node.attrs.get("class") or ""], False
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                if text:
                    parts.append("t" + text)
                    some = True
            elif c.digest:
                parts.append(f"e{c.digest:x}")
                some = True
        node.digest = (xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1 or 1) if some else 0


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or (node.attrs.get("role") or "").lower() == "main"


def _is_boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in GONE_TAGS or (node.tag == "header" and not in_article):
        return True
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or (a.get("role") or "").lower() in GONE_ROLES:
        return True
    if "display:none" in (a.get("style") or "").replace(" ", "").lower():
        return True
    if node.tag in ("html", "body"):
        return False
    words: set[str] = set()
    for name in f"{a.get('class') or ''} {a.get('id') or ''}".lower().split():
        own = WORD.findall(name)
        if own and own[0] not in STATE_START and own[-1] not in STATE_END:
            words.update(own)
    if _is_article(node) and not in_article:
        return bool(words & COMMENT_WORDS)
    return bool(words & GONE_WORDS or (not in_article and words & HEADER_WORDS))


def site_subtrees(root: Node) -> set[int]:
    """Digests of the elements outside articles."""
    hash_subtrees(root)
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.tag in ("head", "script", "style") or _is_article(node):
            continue
        if node.digest and node.tag not in ("#root", "html", "body"):
            out.add(node.digest)
        todo.extend(c for c in node.children if not isinstance(c, str))
    return out


def _may_recur(node: Node) -> bool:
    """Can an element of an article be template?"""
    return bool(node.digest) and not _is_article(node) and node.tag not in INLINE and (
        node.tag in BOX or bool(node.attrs.get("class") or node.attrs.get("id")))


def article_subtrees(root: Node) -> tuple[set[int], int]:
    """Digests of the elements inside articles that can be template (see ``hash_subtrees``),
    and what tells the article from others: a hash of its longest plain paragraph, 0 without one."""
    out, longest, todo = set(), (0, ""), [(root, False)]
    while todo:
        node, inside = todo.pop()
        if _is_boilerplate(node, inside):
            continue
        if _is_article(node):
            inside = True
        elif inside:
            if _may_recur(node):
                out.add(node.digest)
            if node.tag in PROSE:
                text = " ".join("".join(_strings(node)).split())
                longest = max(longest, (len(text), text))
        todo.extend((c, inside) for c in node.children if not isinstance(c, str))
    return out, xxhash.xxh64_intdigest(longest[1].encode("utf-8", "surrogatepass")) >> 1 if longest[0] else 0


def _strings(node: Node) -> list[str]:
    """A prose element's own strings and those of its inline elements, in page order."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif at is node or at.tag in INLINE:
            todo.extend(reversed(at.children))
        else:
            out.append(" ")
    return out


def main_text(root: Node, template=frozenset(), inner=frozenset()) -> str:
    """Text of a parsed page without the template's subtrees and the boilerplate."""
    return article_text(root, template, inner)[0]


def article_text(root: Node, template=frozenset(), inner=frozenset()) -> tuple[str, bool]:
    """The text, and whether it is that of article elements; ``template`` holds the digests
    deleted outside of articles, ``inner`` those inside."""
    if template or inner:
        hash_subtrees(root)

    def walk(only_articles: bool) -> tuple[list[str], bool]:
        parts, found = [], False
        todo = [(root, False)]
        while todo:
            node, inside = todo.pop()
            if isinstance(node, str):
                if inside or not only_articles:
                    parts.append(node)
                continue
            if _is_boilerplate(node, inside):
                continue
            if (node.digest in inner and _may_recur(node)) if inside else (node.digest and node.digest in template):
                continue
            if _is_article(node):
                inside = found = True
            if node.tag not in INLINE:
                parts.append(" ")
                todo.append((" ", inside))
            todo.extend((c, inside) for c in reversed(node.children))
        return parts, found

    parts, found = walk(True)
    if not found:
        parts, _ = walk(False)
    return " ".join("".join(parts).split()), found


def url_host(url: Column) -> Column:
    """Column: what stands after the first ``://`` up to ``/ ? #``, lower-cased."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def site_templates(seen: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                   inner_share: float = INNER_SHARE) -> DataFrame:
    """``(host, template, inner)``: the digests of each host's recurring subtrees outside and
    inside articles, from one row per page ``(host, site, inside, article)``.

    At most (subtrees of a page) / share digests reach a host's lists."""
    totals = seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("article").alias("articles"))
    outside = (seen.select("host", F.explode("site").alias("digest")).groupBy("host", "digest")
               .agg(F.count(F.lit(1)).alias("n")).withColumn("is_in", F.lit(False)))
    inside = (seen.select("host", "article", F.explode("inside").alias("digest")).distinct().groupBy("host", "digest")
              .agg(F.count(F.lit(1)).alias("n")).withColumn("is_in", F.lit(True)))
    least = F.when(F.col("is_in"), F.col("articles") * inner_share).otherwise(F.col("pages") * min_share)

    def digests(which):
        return F.sort_array(F.collect_set(F.when(which, F.col("digest"))))

    return (outside.unionByName(inside).where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") >= least)
            .groupBy("host").agg(digests(~F.col("is_in")).alias("template"), digests(F.col("is_in")).alias("inner")))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, inner_share: float = INNER_SHARE) -> DataFrame:
    """``out``, the main text of every row, with the row's other columns but the html.

    One pass parses every page and writes its digests with its text.  Only pages that their
    host's template can change (no article element, or elements in it that can recur) wait
    for it, are shuffled (by host; AQE splits a hot one) and parsed again."""
    prepare(pages.sparkSession)
    own = [c for c in pages.columns if c not in (out, html_col)]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    given = pages.select(row.alias("own"), url_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    carried = given.schema["own"]

    def first(batches):
        import pyarrow as pa
        longs = pa.list_(pa.int64())
        for b in batches:
            made = []
            for html in b["html"].to_pylist():
                root = parse(html)
                text, found = article_text(root)
                site = site_subtrees(root)
                inside, article = article_subtrees(root)
                final = not html or (found and not inside)
                made.append((text if final else None, None if final else html, sorted(site), sorted(inside), article if found else None))
            cols = list(zip(*made)) or [()] * 5
            kinds = [pa.string(), pa.string(), longs, longs, pa.int64()]
            yield pa.RecordBatch.from_arrays([b["own"], b["host"], *[pa.array(x, k) for x, k in zip(cols, kinds)]],
                                             names=["own", "host", "done", "open", "site", "inside", "article"])

    def second(batches):
        import pyarrow as pa
        for b in batches:
            made = [main_text(parse(html), frozenset(template or ()), frozenset(inner or ()))
                    for html, template, inner in zip(*[b[c].to_pylist() for c in ("open", "template", "inner")])]
            yield pa.RecordBatch.from_arrays([b["own"], pa.array(made, pa.string())], names=["own", "done"])

    longs = T.ArrayType(T.LongType())
    seen = stage(given.mapInArrow(first, T.StructType([
        carried, T.StructField("host", T.StringType()), T.StructField("done", T.StringType()), T.StructField("open", T.StringType()),
        T.StructField("site", longs), T.StructField("inside", longs), T.StructField("article", T.LongType())])), "html_seen")
    template = stage(site_templates(seen, min_pages, min_share, inner_share), "html_template")
    waiting = seen.where("open is not null").select("own", "host", "open").join(template, "host", "left").select("own", "open", "template", "inner")
    texts = seen.where("open is null").select("own", "done").unionByName(
        waiting.mapInArrow(second, T.StructType([carried, T.StructField("done", T.StringType())])))
    return texts.select(*[F.col("own").getField(c).alias(c) for c in own], F.col("done").alias(out))
