"""Pages against a walk over a tree of their elements, and addresses against the standard library."""

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import pages, urls

BASE = "http://a.example/b/c/d;p?q"
REFERENCES = [
    "g", "./g", "g/", "/g", "//h", "//h/i/../j?k", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..",
    "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/../x", "g#s/../x", "https://x.example/é ü?z", "data:image/png;base64,AA", "javascript:go(1)", "mailto:a@b",
]


@pytest.mark.parametrize("base", [BASE, "https://x.example", "https://x.example/", "http://x.example/a/?p=1#f"])
def test_references_resolve_as_in_the_standard_library(spark, base):
    rows = spark.createDataFrame([(r,) for r in REFERENCES], "r string").select("r", urls.resolve(F.lit(base), F.col("r")).alias("u")).collect()
    for row in rows:
        want = urljoin(base, row.r)
        # a reference to nothing leaves the fragment out there and here
        assert row.u == want or (row.r == "" and row.u == want.split("#")[0]), row


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.handle_endtag("a")
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in pages.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def every(node):
    yield node
    for c in node.children:
        if isinstance(c, Node):
            yield from every(c)


def is_(node, selector):
    classes = node.attrs.get("class", "").split()
    return selector[1:] in classes if selector[0] == "." else node.attrs.get("id") == selector[1:] if selector[0] == "#" else node.tag == selector


def furniture(node):
    return node.tag in pages.FURNITURE_TAGS or bool(pages.FURNITURE_CLASSES & set(node.attrs.get("class", "").split()))


def strings(node, clean=True):
    if clean and furniture(node):
        return
    for c in node.children:
        if isinstance(c, Node):
            yield from strings(c, clean)
        elif c.strip():
            yield " ".join(c.split())


def has_image(node):
    return not furniture(node) and (node.tag == "img" or any(isinstance(c, Node) and has_image(c) for c in node.children))


def brute(html):
    root = Tree(html).root
    best, best_score, quality = None, -1, "empty_detail"
    for selector in pages.SELECTORS:
        for node in every(root):
            if node.tag and is_(node, selector):
                text = " ".join(strings(node))
                score = 0 if not text and not has_image(node) else len(text) - 80 * sum(w in text for w in pages.MENU_WORDS) + 30 * has_image(node)
                if score > best_score:
                    best, best_score, quality = node, score, "real_content" if score >= 20 else "menu_only_content"
        if quality == "real_content":
            break
    body = next((n for n in every(root) if n.tag == "body"), None)
    node = best or body
    heading = next((n for n in every(root) if n.tag and any(is_(n, s) for s in pages.HEADINGS)), None)
    title = next((n for n in every(root) if n.tag == "title"), None)
    return " ".join(strings(node)) if node else "", quality, *(" ".join(strings(n, False)) if n else None for n in (heading, title))


LONG = "A long and telling paragraph about rain on the river. "
PAGES = [
    "", "no tags at all", "<body></body>", f"<title>T &amp; U</title><body><h1>Head <b>line</b></h1><article>{LONG}<nav>HOME</nav> end</article></body>",
    f"<body><div class='menu content'>{LONG}</div><div class='content x'>short</div><article>{LONG}</article>",
    f"<body><main><div class=content>HOME Copyright {LONG}</div></main><td>{LONG}<td>{LONG * 2}</body>",
    f"<body><p>un<p>closed<div class='content'><b>bold<i>both</b> {LONG}<header>no</header></div></span></body>",
    "<body><article><img src='a.png'></article></body>", "<body><div class='content'>Menu</div><article></article></body>", "<body>HOME Copyright Menu</body>",
    f"<nav><article>{LONG}</article></nav><body>b</body>", f"<body><div id='content'>{'<div>' * 300}{LONG}</body>", f"<body><aside><td>{LONG}<img src=x></td></aside><td>x</td></body>",
    "<body><script>var x = '<article>no</article>';</script><style>p{}</style><td>after &lt;b&gt; all of that text here</td></body>", f"<body><h2 class=a>First</h2><h1>Second</h1><article><br/><hr>{LONG}<br></article>",
]


def table_of(spark, rows):
    return spark.createDataFrame([(i, f"http://x.example/{i}/", h, "k") for i, h in enumerate(rows)], "page_id long, url string, html string, heading string")


def test_content_is_that_of_a_walk_over_the_tree(spark):
    got = pages.with_content(pages.with_trees(table_of(spark, [*PAGES, None]), "page_id", "url")).withColumn("text", pages.content_text()).collect()
    for row in got:
        html = ([*PAGES, None])[row.page_id] or ""
        assert (row.text, row.quality, row.heading, row.document_title) == brute(html), html


def test_query_is_a_walk_over_whole_pages(spark, sf):
    from quern.queries.pages import page_content

    given = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = page_content(spark, sf).withColumnRenamed("text_md5", "m").collect()
    assert len(got) == len(given)
    import hashlib

    for row in got:
        text, quality, heading, title = brute(given[row.page_id].html or "")
        assert (row.m, row.quality, row.n_chars) == (hashlib.md5(text.encode()).hexdigest(), quality, len(text))
        assert row.title_md5 == hashlib.md5((heading or title or "document").encode()).hexdigest()


def test_very_deep_and_long_pages():
    deep = pages.tree_of("<div class='content'>" * 20_000 + "text" + "<a href=x>" * 20_000)
    assert len(deep["candidates"]) == 20_000 and {c["chars"] for c in deep["candidates"]} == {4}
    assert len(pages.tree_of("<p>word</i>" * 200_000)["strings"]) == 200_000


def test_images_of_the_content_and_else_of_the_page(spark):
    rows = [
        f"<body><img src='/p/x.png'><article>{LONG}<img src=\"a.png?v=1\" data-src='../b.png' srcset='c.png 1x, d/e.png 2x'><nav><img src=n.png></nav><img src=a.png?v=1>"
        "<p style=\"background: url( 'bg one.jpg' )\">x</p><i style='background-image:URL(//cdn.example/z.gif)'></i><img src='site-logo.png'><img src='data:x'></article></body>",
        f"<body><img src=only.png><article>{LONG}</article></body>", "<body>none</body>", None,
    ]
    got = pages.with_content(pages.with_trees(table_of(spark, rows), "page_id", "url")).select("page_id", pages.absolute_images(F.col("url")).alias("i")).collect()
    at = {r.page_id: r.i for r in got}
    assert at[0] == ["http://x.example/0/a.png?v=1", "http://x.example/b.png", "http://x.example/0/c.png", "http://x.example/0/d/e.png", "http://x.example/0/bg one.jpg", "http://cdn.example/z.gif"]
    assert at[1] == ["http://x.example/1/only.png"] and at[2] == at[3] == []


def test_links_by_keywords(spark):
    html = (
        "<a href='/notice/1'>One <b>two</b></a><a href='x/2'>a Notice</a><a href=other>other</a><a href='#n'>notice</a><a onclick=\"location.href='/go?id=3'\">any</a><a href=\"javascript:f()\">notice</a>"
        "<a href='/notice/1'>again</a><a href='/notice/list.do?x'>notice</a><a href='/0/#notice'>notice</a><a>notice</a><a href='/notice/open'>unclosed <a href='/notice/4'>four"
    )
    got = pages.with_trees(table_of(spark, [html]), "page_id", "url").select(F.explode(pages.keyword_links(F.col("url"), ["notice"])).alias("l")).select("l.*").collect()
    host = "http://x.example"
    assert [tuple(r) for r in got] == [(f"{host}/notice/1", "One two"), (f"{host}/0/x/2", "a Notice"), (f"{host}/go?id=3", "any"), (f"{host}/notice/open", "unclosed"), (f"{host}/notice/4", "four")]


def test_link_query_is_a_plain_loop_over_whole_pages(spark, sf):
    from quern.queries.pages import page_links

    want = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        seen = set()
        for node in every(Tree(r.html or "").root):
            href, text = node.attrs.get("href", "").strip(), " ".join(strings(node, False))
            if node.tag != "a" or not href or re.match("javascript:|#|mailto:", href) or not any(w in f"{href} {text}".lower() for w in ("the", "der", "la", "en")):
                continue
            url = urljoin(r.url, href)
            if url in seen or url.split("#")[0] == r.url.split("#")[0] or urlsplit(url).path.rstrip("/").split("/")[-1].lower() in ("list", "index"):
                continue
            seen.add(url)
            want.append((r.page_id, url, text))
    assert sorted(map(tuple, page_links(spark, sf).collect())) == sorted(want) and want


def test_a_batch_of_many_pages_is_read_in_small_parts():
    texts = [f"<title>{i}</title><main>page {i}<img src=/{i}.png></main>" for i in range(150)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(texts)], names=["page_id", "_html"])
    parts = list(pages.tree_batches(iter([whole, whole.slice(0, 0)]), ["page_id"], pages.SELECTORS, pages.MENU_WORDS))
    assert [p.num_rows for p in parts] == [64, 64, 22]
    rows = pa.Table.from_batches(parts).to_pylist()
    assert [r["page_id"] for r in rows] == list(range(150))
    assert all(r["document_title"] == str(i) and r["images"][0]["url"] == f"/{i}.png" for i, r in enumerate(rows))
