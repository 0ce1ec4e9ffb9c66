"""Article extraction from HTML: one Arrow pass from html to a struct; each page is read once, without a tree."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headlight.functions.lexicons import ACQUIRE_ERRORS, BLOCK_SELECTORS, BODY_SELECTORS, BOILERPLATE, NOISE, PRUNE_CLASSES, PRUNE_PARTS, PRUNE_TAGS

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of these ends an open paragraph, unless one of HOLDS is between them.
BLOCK = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS = set("article div section td body main button".split())
SPACE = re.compile(r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+")
_lists = ("authors", "feeds")
ARTICLE = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n in _lists else T.StringType()) for n in "title body method meta_description published_at authors amp_url feeds".split()])
SECOND = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n in _lists else T.StringType()) for n in "headline body authors published_at meta_description method".split()])
_noise, _boilerplate = re.compile("|".join(NOISE)), re.compile(BOILERPLATE)
_pruned_parts = {a: re.compile("|".join(map(re.escape, ps))) for a, ps in PRUNE_PARTS.items()}


def space(s: str) -> str:
    return SPACE.sub(" ", s).strip(" ")


def sanitize(s: str) -> str:
    return space(re.sub(r'[{}\[\]"]+', " ", space(s)))


def noisy(s: str) -> bool:
    if not s:
        return True
    low = s.lower()
    if _noise.search(low) and sum(x in low for x in NOISE) >= 2:
        return True
    return len(re.findall(r'[{}\[\]"=:;,_]', s)) / len(s) > 0.12 or len(re.findall("[A-Za-z]", s)) / len(s) < 0.45


def readable(s: str) -> bool:
    if len(s) < 60 or noisy(s) or _boilerplate.search(s.lower()):
        return False
    words = s.split(" ")
    return len(words) >= 10 and sum(len(w) > 20 for w in words) <= 2


def count_tokens(s: str) -> int:
    return len(re.findall("[a-z0-9]+", s.lower()))


def selects(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    if selector.startswith("."):
        return selector[1:] in attrs.get("class", "").split()
    return attrs.get("role") == "main" if selector.startswith("[") else tag == selector


def _pruned(tag: str, attrs: dict[str, str]) -> bool:
    if tag in PRUNE_TAGS:
        return True
    if "class" in attrs and (any(c in PRUNE_CLASSES for c in attrs["class"].split()) or _pruned_parts["class"].search(attrs["class"])):
        return True
    return "id" in attrs and bool(_pruned_parts["id"].search(attrs["id"]))


class Stack(HTMLParser):
    """Open elements and the texts that are being taken down.

    A text is (depth of its element, its pieces, whether pruned elements within it are left out).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.pruned = [False]
        self.texts: list[tuple[int, list[str], bool]] = []

    def enter(self, tag: str, attrs: dict[str, str]) -> None:
        raise NotImplementedError

    def take(self, only_kept: bool = False) -> list[str]:
        """Takes the text of the element that is being opened."""
        pieces: list[str] = []
        self.texts.append((len(self.open) + 1, pieces, only_kept))
        return pieces

    def close_to(self, depth: int) -> None:
        del self.open[depth:], self.pruned[depth + 1 :]
        while self.texts and self.texts[-1][0] > depth:
            self.texts.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = {k: v or "" for k, v in reversed(attrs)}
        self.enter(tag, found)
        if tag in VOID:
            self.close_to(len(self.open))
        else:
            self.open.append(tag)
            self.pruned.append(self.pruned[-1] or _pruned(tag, found))

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] == tag:
                return self.close_to(depth)

    def handle_data(self, data: str) -> None:
        gone = self.pruned[-1]
        for _, pieces, only_kept in self.texts:
            if not (gone and only_kept):
                pieces.append(data)


class Page(Stack):
    """What the first engine reads: paragraphs with the selectors above them, and whatever of the head it needs."""

    def __init__(self) -> None:
        super().__init__()
        self.above = [0]
        self.metas: list[tuple[bool, dict[str, str]]] = []
        self.links: list[dict[str, str]] = []
        self.paragraphs: list[tuple[int, list[str]]] = []
        self.titles: list[list[str]] = []
        self.scripts: list[list[str]] = []
        self.h1: list[str] | None = None
        self.time: str | None = None

    def enter(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCK:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth] == "p":
                    self.close_to(depth)
                    break
                if self.open[depth] in HOLDS:
                    break
        gone = self.pruned[-1] or _pruned(tag, attrs)
        if tag == "p" and not gone:
            self.paragraphs.append((self.above[len(self.open)], self.take(True)))
        elif tag == "meta":
            self.metas.append((gone, attrs))
        elif tag == "link":
            self.links.append(attrs)
        elif tag == "title":
            self.titles.append(self.take())
        elif tag == "h1" and self.h1 is None:
            self.h1 = self.take()
        elif tag == "time" and not gone and self.time is None:
            self.time = attrs.get("datetime", "")
        elif tag == "script" and attrs.get("type") == "application/ld+json":
            self.scripts.append(self.take())
        if tag not in VOID:
            del self.above[len(self.open) + 1 :]
            self.above.append(self.above[-1] | sum(1 << i for i, s in enumerate(BODY_SELECTORS) if selects(s, tag, attrs)))

    def meta(self, *wanted: tuple[str, str], kept: bool = True) -> str:
        """Content of the first meta element of the first of `wanted` (attribute, value) whose first element has one."""
        for attr, value in wanted:
            for gone, a in self.metas:
                if a.get(attr) == value and not (gone and kept):
                    if a.get("content"):
                        return a["content"]
                    break
        return ""

    def title(self) -> str:
        first = self.meta(("property", "og:title"), ("name", "twitter:title"), kept=False)
        return space(first or "".join(self.h1 or ()) or "".join("".join(t) for t in self.titles))

    def nodes(self) -> list[dict]:
        """JSON-LD objects, and those in an @graph; a block that is no JSON is passed over."""
        out = []
        for pieces in self.scripts:
            try:
                found = json.loads("".join(pieces))
            except ValueError:
                continue
            todo = found if isinstance(found, list) else [found]
            while todo:
                out += [x for x in todo if isinstance(x, dict)]
                todo = [y for x in todo if isinstance(x, dict) and isinstance(x.get("@graph"), list) for y in x["@graph"]]
        return out

    def published(self, nodes: list[dict]) -> str:
        when = space(self.meta(("property", "article:published_time"), ("name", "article:published_time"), ("name", "pubdate")) or self.time or "")
        return when or next((s for x in nodes if (s := space(str(x.get("datePublished") or x.get("dateCreated") or "")))), "Not available")

    def authors(self, nodes: list[dict]) -> list[str]:
        found = re.split(r",|\||&| and ", space(self.meta(("name", "author"), ("property", "article:author"))), flags=re.I)
        for x in nodes:
            a = x.get("author")
            for y in a if isinstance(a, list) else [a]:
                found.append(y if isinstance(y, str) else str(y.get("name") or "") if isinstance(y, dict) else "")
        return list(dict.fromkeys(s for y in found if (s := space(y))))[:5]

    def body(self, nodes: list[dict]) -> tuple[str, str]:
        """(body, method)."""
        for x in nodes:
            kind = x.get("@type") or ""
            kind = " ".join(map(str, kind)) if isinstance(kind, list) else str(kind)
            if re.search("article|report", kind, re.I) and isinstance(x.get("articleBody"), str):
                s = sanitize(x["articleBody"])
                if len(s) > 220 and not noisy(s):
                    return s, "JSON-LD articleBody"
        good = [(above, s) for above, pieces in self.paragraphs if readable(s := sanitize("".join(pieces)))]
        for i, selector in enumerate(BODY_SELECTORS):
            s = " ".join([s for above, s in good if above >> i & 1][:18])
            if len(s) > 200 and count_tokens(s) >= 80 and not noisy(s):
                return s, f"Paragraph extraction ({selector} p)"
        s = " ".join([s for _, s in good][:20])
        if len(s) > 200 and not noisy(s):
            return s, "Readable paragraph fallback"
        return ("", "No readable article body found") if not s else ("" if noisy(s) else s, "Body paragraph fallback")

    def alternates(self, base: str) -> tuple[str | None, list[str]]:
        """The AMP address, and those of feeds, resolved."""

        def resolved(href: str) -> str | None:
            try:
                url = urljoin(base, href)
                return url if urlsplit(url).scheme else None
            except ValueError:
                return None

        amp = next((a.get("href") for a in self.links if a.get("rel") == "amphtml"), None)
        feeds = [a["href"] for a in self.links if a.get("rel") == "alternate" and a.get("href") and re.search("rss|atom|xml", a.get("type", "").lower())]
        return resolved(amp) if amp else None, [u for x in feeds if (u := resolved(x))]


def _read(reader: Stack, html: str | None) -> Stack:
    reader.feed(html or "")
    reader.close()
    return reader


def extract(html: str | None, url: str | None = "") -> tuple:
    page = _read(Page(), html)
    nodes = page.nodes()
    described = space(page.meta(("name", "description"), ("property", "og:description"), ("name", "twitter:description")))
    return page.title(), *page.body(nodes), described or "Not available", page.published(nodes), page.authors(nodes), *page.alternates(url or "")


class Blocks(Stack):
    """What the second engine reads: whole blocks, without pruning or implied ends; texts are stripped pieces with spaces between."""

    def __init__(self) -> None:
        super().__init__()
        self.blocks: list[list[list[str]]] = [[] for _ in BLOCK_SELECTORS]
        self.paragraphs: list[list[str]] = []
        self.metas: list[dict[str, str]] = []
        self.title: list[str] | None = None
        self.h1: list[str] | None = None

    def enter(self, tag: str, attrs: dict[str, str]) -> None:
        for found, selector in zip(self.blocks, BLOCK_SELECTORS, strict=True):
            if selects(selector, tag, attrs):
                found.append(self.take())
        if tag == "p":
            self.paragraphs.append(self.take())
        elif tag == "meta":
            self.metas.append(attrs)
        elif tag == "title" and self.title is None:
            self.title = self.take()
        elif tag == "h1" and self.h1 is None:
            self.h1 = self.take()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] in ("script", "style", "template"):
            return
        if data := data.strip():
            super().handle_data(data)

    def meta(self, *wanted: tuple[str, str]) -> str:
        """Content of the first element that there is of `wanted`."""
        return next((a.get("content", "") for attr, value in wanted for a in self.metas if a.get(attr) == value), "")


def extract_blocks(html: str | None) -> tuple:
    page = _read(Blocks(), html)
    headline = page.meta(("property", "og:title")) or " ".join(page.title or ()) or " ".join(page.h1 or ())
    body = next((x for x in page.blocks if x), page.paragraphs)
    author, when = space(page.meta(("name", "author"))), space(page.meta(("property", "article:published_time")))
    described = space(page.meta(("name", "description"), ("property", "og:description")))
    return space(headline), space(" ".join(" ".join(x) for x in body)), [author] if author else [], when or None, described, "beautifulsoup"


@F.pandas_udf(ARTICLE)
def article(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(h, u) for h, u in zip(html, url, strict=True)], columns=ARTICLE.names)


@F.pandas_udf(SECOND)
def second_article(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_blocks(h) for h in html], columns=SECOND.names)


def articles(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages without html, with the article's fields."""
    return pages.withColumn("article", article(html, url)).select(*[c for c in pages.columns if c != html], "article.*")


def second_articles(pages: DataFrame, html: str = "html", first: Column | None = None) -> DataFrame:
    """pages without html, with the second engine's fields.

    first: another scraper's struct of these fields, which is taken where it has a headline and more than 180 characters of body.
    """
    found = second_article(html)
    if first is not None:
        found = F.when((first["headline"] != "") & (F.length(first["body"]) > 180), first).otherwise(found)
    return pages.withColumn("article", found).select(*[c for c in pages.columns if c != html], "article.*")


def body_error(body: Column) -> Column:
    """Error struct of a body of fewer than 80 characters, or null."""
    return F.when(F.length(F.coalesce(body, F.lit(""))) < 80, F.struct(F.lit(ACQUIRE_ERRORS["body"]).alias("message"), F.lit(400).alias("status")))


def usable(title, body):
    """A page that is worth analysing: a title and 60 body tokens (Columns)."""
    from headlight.functions.text import tokens

    return (title != "") & (F.size(tokens(body)) >= 60)
