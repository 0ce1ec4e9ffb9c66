"""Feeds, archive answers and robots rules as rows: what a crawler fetched, read without a network."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headlight.functions.text import escape_html

ITEMS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("link", "title", "body"))]))
CONTENT = "{http://purl.org/rss/1.0/modules/content/}encoded"


def _name(node: ElementTree.Element) -> str:
    return "content:encoded" if node.tag == CONTENT else str(node.tag).rsplit("}", 1)[-1]


def _text(node: ElementTree.Element | None) -> str:
    """An element's own text, else its address."""
    if node is None:
        return ""
    return "".join(x.strip() for x in (node.text or "", *(c.tail or "" for c in node))) or node.get("href", "")


def _items(xml: str | None) -> list[tuple[int, str, str, str]]:
    """(pos, link, title, body) of RSS items, then of Atom entries; nothing of what is no XML."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except (ElementTree.ParseError, ValueError):
        return []
    kind = _name(root)
    channel = next((c for c in root if _name(c) == "channel"), None) if kind == "rss" else root
    found = [] if channel is None else [x for x in channel if _name(x) == {"rss": "item", "feed": "entry"}.get(kind)]
    out = []
    for pos, item in enumerate(found):
        by: dict[str, list] = {}
        for c in item:
            by.setdefault(_name(c), []).append(c)
        links = by.get("link", [])
        link = next((x for x in links if x.get("rel", "alternate") == "alternate"), links[0]) if links else None
        first = lambda k, by=by: _text(by[k][0]) if k in by else ""
        out.append((pos, _text(link), first("title"), first("content:encoded") or first("content") or first("description") or first("summary")))
    return out


@F.pandas_udf(ITEMS)
def feed_items(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: [dict(zip(("pos", "link", "title", "body"), i, strict=True)) for i in _items(x)], na_action=None)


def items(feeds: DataFrame, feed: str = "feed", xml: str = "xml") -> DataFrame:
    """feed, pos, link, title and body of each item of each feed."""
    return feeds.select(feed, F.inline(feed_items(xml)))


def wrap(title: Column, body: Column) -> Column:
    """A page of a feed's item: its title, escaped, and its body as it is."""
    head = escape_html(F.coalesce(title, F.lit("")))
    return F.concat(F.lit("<!doctype html><html><head><title>"), head, F.lit("</title></head><body><h1>"), head, F.lit("</h1>"), F.coalesce(body, F.lit("")), F.lit("</body></html>"))


def snapshot(answer: Column) -> Column:
    """The address of the closest archived copy by the archive's JSON answer, or null."""
    closest = "$.archived_snapshots.closest"
    url = F.get_json_object(answer, f"{closest}.url")
    return F.when((F.get_json_object(answer, f"{closest}.available") == "true") & (url != ""), url)


def raw_snapshot(url: Column) -> Column:
    """The form of a copy's address that has no toolbar."""
    return F.regexp_replace(url, r"^(.*?/web/[0-9]+)/", "$1id_/")


def _rule(path: str) -> re.Pattern:
    parts = path[:-1] if path.endswith("$") else path
    return re.compile(".*".join(map(re.escape, parts.split("*"))) + ("$" if path.endswith("$") else ""))


def robots_allow(text: str | None, url: str | None, agent: str) -> bool:
    """By the public standard (RFC 9309): the rules of the groups that name the agent, else of `*`; the longest that fits, allow before disallow.

    Without a file, a group or a rule that fits the address is allowed.
    """
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    ruled = False
    for line in (text or "").splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [value.lower()] if ruled else [*names, value.lower()]
            ruled = False
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            ruled = True
            if value:
                for name in names:
                    groups[name].append((key == "allow", unquote(value)))
    product = agent.split("/")[0].strip().lower()
    rules = groups.get(product, groups.get("*", []))
    parts = urlsplit(url or "")
    path = unquote((parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
    fits = [(len(p), allow) for allow, p in rules if _rule(p).match(path)]
    return max(fits, default=(0, True))[1]


def robots(text: Column, url: Column, agent: str) -> Column:
    """Whether an origin's robots.txt lets the agent fetch the address."""

    @F.pandas_udf("boolean")
    def allowed(texts: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([robots_allow(t, u, agent) for t, u in zip(texts, urls, strict=True)], dtype="bool")

    return allowed(text, url)
