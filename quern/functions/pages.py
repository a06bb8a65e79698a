"""Web pages as trees: what stands where, summed by subtree, so that the part that holds the content can be chosen and
read by column expressions.

One pass over a page's tags keeps the open elements on a stack. An end tag closes everything that is open within its
element; one without an element is passed over; void elements hold nothing; a link ends where the next one starts. Every element has a number in order of
appearance, so the elements inside another are those from its number to its ``end``. The strings of a page stay one
list: an element's text is a stretch of it, without the strings in page furniture (menus, headers, scripts) inside
the element. A string or image names the innermost furniture around it, which is inside an element if its number
is not below the element's. Sizes, menu words and images are summed when an element closes; nothing is read twice,
however deep the candidates stand in each other."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls

# Elements that hold nothing, attributes with addresses of images in their order, and page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
IMAGE_ATTRIBUTES = ("src", "data-src", "data-lazy-src", "data-original", "data-url")
SOURCE_SETS = ("srcset", "data-srcset")
FURNITURE_TAGS = {"script", "style", "header", "footer", "nav", "aside"}
FURNITURE_CLASSES = {"header", "footer", "gnb", "lnb", "menu", "breadcrumb", "pagination", "paging", "copyright", "sidebar"}
#: Where the content of a page may be, the likeliest first; and words that show a menu. Both are parameters.
SELECTORS = (".view-content", ".detail-content", ".content", "#content", "article", "main", "td", "body")
MENU_WORDS = ("HOME", "Copyright", "Menu")
HEADINGS = ("h1", "h2", ".title", ".subject")
#: Pages whose trees are built at once.
TREES = 64
#: Points a menu word takes off and an image adds, and the score from which a part counts as content.
MENU_COST, IMAGE_WORTH, REAL = 80, 30, 20

TREE = (
    "heading string, document_title string, strings array<struct<text:string,furniture:int>>, "
    "candidates array<struct<rank:int,node:int,end:int,first:int,last:int,chars:int,words:int,images:int>>, "
    "images array<struct<node:int,furniture:int,url:string>>, links array<struct<href:string,onclick:string,text:string>>"
)
_KIND = pa.struct([
    ("heading", pa.string()), ("document_title", pa.string()),
    ("strings", pa.list_(pa.struct([("text", pa.string()), ("furniture", pa.int32())]))),
    ("candidates", pa.list_(pa.struct([(n, pa.int32()) for n in ("rank", "node", "end", "first", "last", "chars", "words", "images")]))),
    ("images", pa.list_(pa.struct([("node", pa.int32()), ("furniture", pa.int32()), ("url", pa.string())]))),
    ("links", pa.list_(pa.struct([(n, pa.string()) for n in ("href", "onclick", "text")]))),
])
_BACKGROUND = re.compile(r"url\(\s*(\"[^\"]*\"|'[^']*'|[^)]*?)\s*\)", re.IGNORECASE)


@dataclass
class _Open:
    tag: str
    node: int
    furniture: int
    own_furniture: bool
    rank: int | None
    first: int
    chars: int = 0
    words: int = 0
    images: int = 0
    link: dict | None = None


@dataclass
class _Tree(HTMLParser):
    selectors: Sequence[str]
    menu_words: Sequence[str]
    strings: list = field(default_factory=list)
    candidates: list = field(default_factory=list)
    images: list = field(default_factory=list)
    backgrounds: list = field(default_factory=list)
    links: list = field(default_factory=list)
    heading: str | None = None
    document_title: str | None = None

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.ranks = {s: i for i, s in reversed(list(enumerate(self.selectors)))}
        self.n_nodes = 0
        self.stack = [_Open("", -1, -1, False, None, 0)]
        self.open: Counter[str] = Counter()
        self.first_heading = self.first_title = None

    def names(self, tag: str, own: dict) -> list[str]:
        return [tag, *(f".{c}" for c in (own.get("class") or "").split()), *([f"#{own['id']}"] if own.get("id") else [])]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and self.open["a"]:
            self.handle_endtag("a")
        own = {k: v or "" for k, v in reversed(attrs)}
        names, node = self.names(tag, own), self.n_nodes
        self.n_nodes += 1
        furniture = tag in FURNITURE_TAGS or any(n[1:] in FURNITURE_CLASSES for n in names if n[0] == ".")
        inner = node if furniture else self.stack[-1].furniture
        rank = min((self.ranks[n] for n in names if n in self.ranks), default=None)
        top = _Open(tag, node, inner, furniture, rank, len(self.strings))
        if self.first_heading is None and any(n in HEADINGS for n in names):
            self.first_heading = node
        if self.first_title is None and tag == "title":
            self.first_title = node
        if tag == "img":
            top.images = 1
            found = [own[a] for a in IMAGE_ATTRIBUTES if own.get(a)]
            found += [c.split()[0] for a in SOURCE_SETS for c in own.get(a, "").split(",") if c.strip()]
            self.images += [{"node": node, "furniture": inner, "url": u.strip()} for u in found]
        self.backgrounds += [{"node": node, "furniture": inner, "url": m[1].strip("\"'").strip()} for m in _BACKGROUND.finditer(own.get("style", ""))]
        if tag == "a" and ("href" in own or "onclick" in own):
            top.link = {"href": own.get("href", "").strip(), "onclick": own.get("onclick", "").strip(), "text": ""}
            self.links.append(top.link)
        self.stack.append(top)
        self.open[tag] += 1
        if tag in VOID:
            self.shut()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut()

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.shut() != tag:
                pass

    def handle_data(self, data: str) -> None:
        text, top = " ".join(data.split()), self.stack[-1]
        if text:
            self.strings.append({"text": text, "furniture": top.furniture})
            top.chars += len(text) + 1
            top.words |= sum(1 << i for i, w in enumerate(self.menu_words) if w in text)

    def shut(self) -> str:
        """Close the innermost element and add what it holds to the one around it."""
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if e.own_furniture:
            e.chars = e.words = e.images = 0
        if e.rank is not None:
            self.candidates.append({"rank": e.rank, "node": e.node, "end": self.n_nodes, "first": e.first, "last": len(self.strings), "chars": max(0, e.chars - 1), "words": e.words.bit_count(), "images": e.images})
        if e.link is not None or e.node in (self.first_heading, self.first_title):
            text = " ".join(s["text"] for s in self.strings[e.first :])
            if e.link is not None:
                e.link["text"] = text
            if e.node == self.first_heading:
                self.heading = text
            if e.node == self.first_title:
                self.document_title = text
        around = self.stack[-1]
        around.chars, around.words, around.images = around.chars + e.chars, around.words | e.words, around.images + e.images
        return e.tag

    def read(self, html: str) -> dict:
        self.feed(html)
        self.close()
        while len(self.stack) > 1:
            self.shut()
        names = ("heading", "document_title", "strings", "candidates", "links")
        return {n: getattr(self, n) for n in names} | {"images": self.images + self.backgrounds}


def tree_of(html: str, selectors: Sequence[str] = SELECTORS, menu_words: Sequence[str] = MENU_WORDS) -> dict:
    """One page's strings, candidates for its content, images and links; the first heading and the title."""
    return _Tree(selectors, menu_words).read(html)


def tree_batches(batches: Iterator[pa.RecordBatch], keep: Sequence[str], selectors: Sequence[str], menu_words: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The trees of the pages, of TREES pages at once, however many come in a batch."""
    for batch in (whole.slice(low, TREES) for whole in batches for low in range(0, whole.num_rows, TREES)):
        trees = pa.array([tree_of(h, selectors, menu_words) for h in batch["_html"].to_pylist()], _KIND)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *trees.flatten()], names=[*keep, *(f.name for f in _KIND)])


def with_trees(pages: DataFrame, *keep: str, html: str = "html", selectors: Sequence[str] = SELECTORS, menu_words: Sequence[str] = MENU_WORDS) -> DataFrame:
    """The columns to keep and those of TREE; a null page is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tree_batches(batches, keep, selectors, menu_words)

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("_html")).mapInArrow(run, f"{schema}, {TREE}")


def score_of(candidate: Column) -> Column:
    """Characters, less MENU_COST for each menu word, more IMAGE_WORTH for images; 0 for an empty part."""
    image = F.when(candidate["images"] > 0, IMAGE_WORTH).otherwise(0)
    return F.when((candidate["chars"] == 0) & (candidate["images"] == 0), 0).otherwise(candidate["chars"] - MENU_COST * candidate["words"] + image)


def with_content(trees: DataFrame, selectors: Sequence[str] = SELECTORS) -> DataFrame:
    """``trees`` with content (a struct of node, end, first, last, score; null without a body) and quality.

    Selectors are tried in order until one has a part of REAL points; of all tried so far the best part is taken,
    of equal ones that of the earlier selector, then the first. Parts below 0 are not taken; the body is, if nothing else."""
    scored = F.transform("candidates", lambda c: F.struct(score_of(c).alias("score"), (-c["rank"]).alias("early"), (-c["node"]).alias("first_one"), c["rank"].alias("rank"), c["node"].alias("node"), c["end"].alias("end"), c["first"].alias("first"), c["last"].alias("last")))
    real = F.array_min(F.transform(F.filter("scored", lambda c: c["score"] >= REAL), lambda c: c["rank"]))
    tried = F.filter("scored", lambda c: (c["score"] >= 0) & (c["rank"] <= F.coalesce(F.col("real"), c["rank"])))
    body = list(selectors).index("body") if "body" in selectors else -1
    bodies = F.filter("scored", lambda c: c["rank"] == body)
    fallback = F.array_max(F.transform(bodies, lambda c: F.struct(c["first_one"].alias("first_one"), c.alias("c"))))["c"]
    chosen = trees.withColumn("scored", scored).withColumn("real", real).withColumn("best", F.array_max(tried))
    quality = F.when(F.col("best.score") >= REAL, "real_content").when(F.col("best").isNotNull(), "menu_only_content").otherwise("empty_detail")
    return chosen.withColumn("quality", quality).withColumn("content", F.coalesce("best", fallback)).drop("scored", "real", "best")


def content_text() -> Column:
    """The text of ``content``, furniture inside it left out."""
    own = F.slice("strings", F.col("content.first") + 1, F.col("content.last") - F.col("content.first"))
    return F.coalesce(F.array_join(F.transform(F.filter(own, lambda s: s["furniture"] < F.col("content.node")), lambda s: s["text"]), " "), F.lit(""))


def absolute_images(base: Column, ignored: Sequence[str] = ("logo", "icon", "banner")) -> Column:
    """Distinct addresses of images in order: of the content if it has any, else of the page; those with an ignored
    word in their path are left out, and addresses that carry data or scripts."""

    def usable(images: Column) -> Column:
        given = F.filter(F.transform(images, lambda i: i["url"]), lambda u: (u != "") & ~u.rlike(r"^(?:data:|javascript:|mailto:|#)"))
        found = F.transform(given, lambda u: urls.resolve(base, u))
        none = lambda u: ~F.lower(urls.part(u, 3)).rlike("|".join(map(re.escape, ignored)))
        return F.array_distinct(F.filter(found, none) if ignored else found)

    inside = F.filter("images", lambda i: (i["node"] >= F.col("content.node")) & (i["node"] < F.col("content.end")) & (i["furniture"] < F.col("content.node")))
    own = usable(F.coalesce(inside, F.array().cast("array<struct<node:int,furniture:int,url:string>>")))
    return F.when(F.size(own) > 0, own).otherwise(usable(F.col("images")))


def keyword_links(base: Column, keywords: Sequence[str]) -> Column:
    """Links whose address or text holds a keyword, or that a script's location names, as structs of url and title in
    order: absolute, each url once, without the page itself and pages that end in a list's or index's name."""
    direct = lambda link: F.regexp_extract(link["onclick"], r"(?:location\.href|document\.location)\s*=\s*['\"]([^'\"]+)['\"]", 1)
    wanted = lambda link: F.lower(F.concat_ws(" ", link["href"], link["text"])).rlike("|".join(map(re.escape, keywords)))
    plain = lambda link: (link["href"] != "") & ~link["href"].rlike("^(?:javascript:|#|mailto:)") & wanted(link)
    named = F.filter("links", lambda link: (direct(link) != "") | plain(link))
    found = F.transform(named, lambda link: F.struct(urls.resolve(base, F.when(direct(link) != "", direct(link)).otherwise(link["href"])).alias("url"), link["text"].alias("title")))
    last = lambda url: F.lower(F.regexp_extract(urls.part(url, 3), r"([^/]*)/*$", 1))
    other = F.filter(found, lambda x: (urls.without_fragment(x["url"]) != urls.without_fragment(base)) & ~last(x["url"]).isin("list.do", "list", "index.do", "index"))
    addresses = F.transform(other, lambda x: x["url"])
    return F.filter(other, lambda x, i: F.array_position(addresses, x["url"]) == i + 1)


# Names of a page number in addresses, and of functions that turn pages.
PAGE_NUMBER = r"(?i)[?&](?:pageNo|pageIndex|currentPageNo|page)=([0-9]+)"
PAGE_TURNER = r"(?i)(?:fn[A-Za-z0-9_]*Page|goPage|movePage|linkPage)\s*\(\s*['\"]?([0-9]{1,3})"


def next_page(base: Column, seen: Column | None = None) -> Column:
    """The address of the page with the smallest number above this one's (1, if it has none) that a link, a script's page turner or
    a link's text of digits up to 500 names, and that is not among ``seen`` (array of addresses); null if there is none."""
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    digits = lambda text: F.when(text.rlike("^[0-9]{1,3}$"), text.cast("int"))
    named = lambda link: F.coalesce(number(link["onclick"], PAGE_TURNER), number(link["href"], PAGE_NUMBER), F.when(digits(link["text"]) <= 500, digits(link["text"])))
    here = F.coalesce(number(base, PAGE_NUMBER), F.lit(1))
    first = F.regexp_replace(base, r"(?s)#.*$", "")
    own = F.regexp_extract(first, r"(?i)[?&](pageNo|pageIndex|currentPageNo|page)=[0-9]+", 1)

    def address(n: Column) -> Column:
        added = F.concat(first, F.when(F.contains(first, F.lit("?")), "&").otherwise("?"), F.lit("pageNo="), n.cast("string"))
        put = F.concat(F.regexp_extract(first, r"(?is)^(.*?[?&](?:pageNo|pageIndex|currentPageNo|page)=)[0-9]+", 1), n.cast("string"), F.regexp_extract(first, r"(?is)^.*?[?&](?:pageNo|pageIndex|currentPageNo|page)=[0-9]+(.*)$", 1))
        return F.when(own == "", added).otherwise(put)

    above = F.array_sort(F.array_distinct(F.filter(F.transform("links", named), lambda n: n > here)))
    new = F.transform(above, address)
    return F.try_element_at(new if seen is None else F.filter(new, lambda u: ~F.array_contains(seen, u)), F.lit(1))
