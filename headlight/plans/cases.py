"""Small made-up inputs with the results that the operators must give, as queries and SQL values.

They cover what the driver's pages lack: heads, JSON-LD, selectors, feeds, archive answers, robots rules, addresses.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headlight.functions import text as T
from headlight.functions import urls as U
from headlight.operators import enrich
from headlight.plans import workers
from headlight.sources import feeds
from headlight.sources.html import articles, second_articles, usable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def cases(columns: str, rows: list[tuple]):
    """rows: (id, what the query must give for it ...); columns: their names."""

    def keep(f):
        value = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
        QUERIES[f.__name__] = workers.query(f)
        ORACLE_SQL[f.__name__] = f"select * from (values {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) as t({columns})"
        return f

    return keep


SENTENCE = "The council met and reviewed the ordinary plan for water pipes in the old town again."
P = f"<p>{' '.join([SENTENCE] * 3)}</p>"
THREE = " ".join([SENTENCE] * 9)
LD = "Plain words of an article body. " * 10


def page(body: str, head: str = "") -> str:
    return f"<html><head>{head}<title>Plain title</title></head><body>{body}</body></html>"


def _ld(value) -> str:
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


OG, TW = '<meta property="og:title" content=" OG  title ">', '<meta name="twitter:title" content="TW">'
#: (html, title, published, authors, description)
HEADS = [
    (page("<h1>H</h1>", OG + TW), "OG title", "Not available", "", "Not available"),
    (page("<h1>H <b>x</b></h1>", TW), "TW", "Not available", "", "Not available"),
    (page("<h1>H <b>x</b></h1><h1>second</h1>"), "H x", "Not available", "", "Not available"),
    (page(""), "Plain title", "Not available", "", "Not available"),
    (page("<h1>H</h1>", '<meta property="og:title" content="  ">'), "", "Not available", "", "Not available"),
    (page("<h1>H</h1>", '<meta name="og:title" content="by name"><meta property="twitter:title" content="by property">'), "H", "Not available", "", "Not available"),
    (page("<h1>H</h1>", '<meta property="og:title" content=""><meta property="og:title" content="second">'), "H", "Not available", "", "Not available"),
    (page("", '<meta name="author" content="A AND B"><meta property="article:author" content="E">'), "Plain title", "Not available", "A|B", "Not available"),
    (page("", '<meta property="article:author" content="E | F,G &amp; H and I and J">'), "Plain title", "Not available", "E|F|G|H|I", "Not available"),
    (page("", _ld([{"author": ["Ann", {"name": " Bob  B "}, 7, "Ann"]}, {"author": {"name": "Cy"}}, {"author": "Di"}])), "Plain title", "Not available", "Ann|Bob B|Cy|Di", "Not available"),
    (page('<header><time datetime="2020">x</time></header><time datetime="2021">y</time><time datetime="2022">z</time>'), "Plain title", "2021", "", "Not available"),
    (page('<time>x</time><time datetime="2022">z</time>', _ld({"dateCreated": "2024-05-06"})), "Plain title", "2024-05-06", "", "Not available"),
    (page('<time datetime="2021">y</time>', '<meta name="pubdate" content=" 2019  May "><meta name="article:published_time" content="2018">'), "Plain title", "2018", "", "Not available"),
    (page("", _ld({"@graph": [{"x": 1}, {"datePublished": "2024-01-02"}]}) + _ld("{bad")), "Plain title", "2024-01-02", "", "Not available"),
    (page("", '<meta property="og:description" content="og"><meta name="description" content=" some   words ">'), "Plain title", "Not available", "", "some words"),
    (page("", '<meta name="description"><meta name="twitter:description" content="tw">'), "Plain title", "Not available", "", "tw"),
    (None, "", "Not available", "", "Not available"),
]


@cases("id, title, published_at, authors, meta_description", [(i, *x[1:]) for i, x in enumerate(HEADS)])
def head_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, x[0], "http://s.org/") for i, x in enumerate(HEADS)], "id int, html string, url string")
    return articles(d).select("id", "title", "published_at", F.array_join("authors", "|").alias("authors"), "meta_description")


WRAPS = [("<article>", "</article>", "article"), ("<main>", "</main>", "main"), ('<div role="main">', "</div>", "[role='main']"), *[(f'<div class="x {c}">', "</div>", f".{c}") for c in ("article", "post-content", "entry-content", "story-content", "content")]]
SHORT = "<p>" + " ".join([SENTENCE] * 1) + "</p>"
NOISY = "<p>" + "The cookie widget of a schema was the plain thing in the old town, it said again and again there. " * 3 + "</p>"
#: (html, body, method, usable)
BODIES = [
    *[(page(a + P * 3 + b), THREE, f"Paragraph extraction ({name} p)", True) for a, b, name in WRAPS],
    (page(P * 3), THREE, "Readable paragraph fallback", True),
    (page(SHORT), SENTENCE, "Body paragraph fallback", False),
    (page("<p>short</p>"), "", "No readable article body found", False),
    (page('<div class="roads">' + P * 3 + "</div>"), "", "No readable article body found", False),
    (page('<div id="my-cookie-bar">' + P * 3 + "</div>"), "", "No readable article body found", False),
    (page('<div class="badges ad">' + P * 3 + "</div>" + SHORT), SENTENCE, "Body paragraph fallback", False),
    (page(P * 3, _ld({"@graph": [{"@type": ["Thing", "NewsArticle"], "articleBody": LD}]})), LD.strip(), "JSON-LD articleBody", True),
    (page(P * 3, _ld({"@type": "Person", "articleBody": LD})), THREE, "Readable paragraph fallback", True),
    (page(P * 3, _ld({"@type": "Article", "articleBody": LD[:200]})), THREE, "Readable paragraph fallback", True),
    (page("<article>" + SHORT * 2 + "</article>" + P * 2), " ".join([SENTENCE] * 8), "Readable paragraph fallback", True),
    (page("<p>The council met <b>and <i>reviewed</b></i> the ordinary plan for water&nbsp;pipes in the <script>x()</script>old town again.<p>next"), SENTENCE, "Body paragraph fallback", False),
    (page(NOISY), "", "No readable article body found", False),
    (None, "", "No readable article body found", False),
]


@cases("id, body, method, is_usable", [(i, *x[1:]) for i, x in enumerate(BODIES)])
def body_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, x[0], "http://s.org/") for i, x in enumerate(BODIES)], "id int, html string, url string")
    return articles(d).select("id", "body", "method", usable(F.col("title"), F.col("body")).alias("is_usable"))


#: (html, amp, feeds)
LINKS = [
    ('<link rel="amphtml" href="/amp"><link rel="alternate" type="application/rss+xml" href="f.xml"><link rel="alternate" type="text/html" href="g">', "http://s.org/amp", "http://s.org/a/f.xml"),
    ('<link rel="amphtml"><link rel="amphtml" href="x"><link rel="alternate" type="Application/ATOM+xml" href="//o.org/1"><link rel="alternate" type="text/xml" href="?q">', None, "http://o.org/1 http://s.org/a/b?q"),
    ('<link rel="alternate" href="f.rss"><link rel="alternate" type="rss">', None, ""),
]


@cases("id, amp_url, feeds", [(i, *x[1:]) for i, x in enumerate(LINKS)])
def link_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, page("", x[0]), "http://s.org/a/b") for i, x in enumerate(LINKS)], "id int, html string, url string")
    return articles(d).select("id", "amp_url", F.array_join("feeds", " ").alias("feeds"))


#: (html, headline, body, authors, published, description)
SECOND = [
    (page("<article>One <b>two</b><script>no</script><article>three</article></article><main>never</main>", OG), "OG title", "One two three three", "", None, ""),
    (page('<main>a<style>b</style></main><div role="main">c</div>', '<meta name="author" content=" A and  B ">'), "Plain title", "a", "A and B", None, ""),
    (page('<div class="y post-content">x &amp; y</div><nav>z</nav>', '<meta property="og:title" content=""><meta property="article:published_time" content=" 2020 ">'), "Plain title", "x & y", "", "2020", ""),
    ("<h1>Only <i>this</i></h1><p>a</p><p>b</p>", "Only this", "a b", "", None, ""),
    ('<title>T</title><meta property="og:description" content="og"><meta name="description" content="d">', "T", "", "", None, "d"),
    (None, "", "", "", None, ""),
]


@cases("id, headline, body, authors, published_at, meta_description", [(i, *x[1:]) for i, x in enumerate(SECOND)])
def second_extraction_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, x[0]) for i, x in enumerate(SECOND)], "id int, html string")
    return second_articles(d).select("id", "headline", "body", F.array_join("authors", "|").alias("authors"), "published_at", "meta_description")


RSS = '<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><link>http://a/</link><item><link>http://a/x</link><title>t &amp; u</title><description>d</description><content:encoded><![CDATA[<p>c</p>]]></content:encoded></item><item><link> http://a/y </link><description>d2</description></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="http://a/s"/><link href="http://a/z"/><title>z</title><summary>sum</summary></entry><entry><link rel="self" href="http://a/q"/><content type="html">con</content><summary>sum</summary></entry></feed>'
FEEDS = [("rss", RSS), ("atom", ATOM), ("bad", "<rss><channel>"), ("none", None), ("other", "<x/>")]


@cases("feed, pos, link, title, body", [("rss", 0, "http://a/x", "t & u", "<p>c</p>"), ("rss", 1, "http://a/y", "", "d2"), ("atom", 0, "http://a/z", "z", "sum"), ("atom", 1, "http://a/q", "", "con")])
def feed_cases(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.items(spark.createDataFrame(FEEDS, "feed string, xml string"))


@cases("feed, page", [("rss", "<!doctype html><html><head><title>t &amp; u</title></head><body><h1>t &amp; u</h1><p>c</p></body></html>")])
def feed_wrap_cases(spark: SparkSession, sf: str) -> DataFrame:
    found = feeds.items(spark.createDataFrame(FEEDS, "feed string, xml string")).where("link = 'http://a/x'")
    return found.select("feed", feeds.wrap(F.col("title"), F.col("body")).alias("page"))


def _answer(**closest) -> str:
    return json.dumps({"archived_snapshots": {"closest": closest}})


#: (answer, snapshot, raw form)
ANSWERS = [
    (_answer(available=True, url="http://w.org/web/2020/http://a/web/1/x"), "http://w.org/web/2020/http://a/web/1/x", "http://w.org/web/2020id_/http://a/web/1/x"),
    (_answer(available=False, url="http://w.org/web/2020/http://a/"), None, None), (_answer(available=True), None, None), ('{"archived_snapshots": {}}', None, None), ("no json", None, None), (None, None, None),
]


@cases("id, snapshot, raw_url", [(i, *x[1:]) for i, x in enumerate(ANSWERS)])
def archive_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, x[0]) for i, x in enumerate(ANSWERS)], "id int, answer string")
    return d.select("id", feeds.snapshot(F.col("answer")).alias("snapshot"), feeds.raw_snapshot(feeds.snapshot(F.col("answer"))).alias("raw_url"))


ROBOTS = "User-agent: other\nUser-agent: Bot\nDisallow: /a\nAllow: /a/b$ # end\nDisallow: /*.pdf\n\nUser-agent: *\nDisallow: /\n"
#: (robots.txt, url, allowed)
RULES = [
    (ROBOTS, "http://s/", True), (ROBOTS, "http://s/a/c", False), (ROBOTS, "http://s/a/b", True), (ROBOTS, "http://s/a/bc", False), (ROBOTS, "http://s/x/y.pdf?z", False), (ROBOTS.replace("Bot", "None"), "http://s/x", False),
    (None, "http://s/a", True), ("", "http://s/a", True), ("User-agent: *\nDisallow:\n", "http://s/a", True), ("Disallow: /\n", "http://s/a", True), ("User-agent: bot\nDisallow: /x\nAllow: /x\n", "http://s/x", True), (ROBOTS, None, True),
]


@cases("id, allowed", [(i, x[2]) for i, x in enumerate(RULES)])
def robots_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(RULES)], "id int, robots string, url string")
    return d.select("id", feeds.robots(F.col("robots"), F.col("url"), "Bot/1.0").alias("allowed"))


#: (address, first engine's class, public for the second engine)
ADDRESSES = [
    ("127.0.0.1", "loopback", False), ("10.0.0.5", "private", False), ("172.31.0.1", "private", False), ("172.32.0.1", "ok", True), ("192.168.1.1", "private", False), ("169.254.169.254", "linkLocal", False), ("100.64.0.1", "carrierGradeNat", True),
    ("0.0.0.0", "unspecified", False), ("255.255.255.255", "broadcast", False), ("240.0.0.1", "reserved", False), ("224.0.0.1", "ok", False), ("8.8.8.8", "ok", True), ("1.1.1.1", "ok", True), ("::1", "loopback", False), ("::", "unspecified", False),
    ("fe80::1", "linkLocal", False), ("fd00::1", "uniqueLocal", False), ("2001:db8::1", "reserved", False), ("::ffff:127.0.0.1", "loopback", False), ("::ffff:8.8.8.8", "ok", True), ("ff02::1", "ok", False), ("2606:4700::1111", "ok", True), ("x", "invalid", None), (None, "invalid", None),
]


@cases("id, address_range, is_public", [(i, *x[1:]) for i, x in enumerate(ADDRESSES)])
def address_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, x[0]) for i, x in enumerate(ADDRESSES)], "id int, ip string")
    return d.select("id", U.address_range(F.col("ip")).alias("address_range"), U.ip_public(F.col("ip")).alias("is_public"))


#: (url, normalized, host, domain, allowed where its addresses are public, allowed with private ones)
URLS = [
    ("http://user:pw@A.com:80/X/?q#f", "http://a.com/x", "a.com", "user:pw@A.com:80", True, True), ("https://www.a.com:443//", "https://www.a.com", "www.a.com", "a.com:443", True, True), ("https://a.com:80/x", "https://a.com:80/x", "a.com", "a.com:80", True, True),
    ("HTTP://www.B.org", "http://www.b.org", "www.b.org", "B.org", True, True), ("ftp://a.com/X/", "ftp://a.com/x", "", "a.com", False, False), ("Not a URL//", "not a url", "", "", False, False), ("http://localhost:3000/", "http://localhost:3000", "localhost", "localhost:3000", False, True),
    ("http://x.local/", "http://x.local", "x.local", "x.local", False, True), ("http://metadata.google.internal/a", "http://metadata.google.internal/a", "metadata.google.internal", "metadata.google.internal", False, True), ("", "", "", "", False, False), (None, None, None, None, False, False),
]


@cases("id, url_norm, host, domain, allowed, allowed_private", [(i, *x[1:]) for i, x in enumerate(URLS)])
def url_cases(spark: SparkSession, sf: str) -> DataFrame:
    d, u = spark.createDataFrame([(i, x[0]) for i, x in enumerate(URLS)], "id int, url string"), F.col("url")
    safe = F.array(F.lit(True))
    return d.select("id", U.normalize_url(u).alias("url_norm"), U.host(u).alias("host"), U.domain(u).alias("domain"), U.url_allowed(u, safe).alias("allowed"), U.url_allowed(u, F.array(F.lit(False)), True).alias("allowed_private"))


#: (status, content type, message, error status)
STATUSES = [
    (200, "text/html; charset=x", None, None), (200, None, None, None), (204, "application/xhtml+xml", None, None), (200, "image/png", "The address is not an HTML page.", 415), (404, "image/png", "Failed to fetch article: HTTP 404", 502), (301, "", "Failed to fetch article: HTTP 301", 502),
    (429, "text/html", "The site is rate-limiting automated requests (HTTP 429). Try again in a little while.", 502), (403, "text/html", "The site blocked our request (HTTP 403). Many large news sites sit behind bot protection that refuses automated readers.", 502),
]


@cases("id, message, error_status", [(i, *x[2:]) for i, x in enumerate(STATUSES)])
def status_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(STATUSES)], "id int, status int, kind string")
    e = U.status_error(F.col("status"), F.col("kind"))
    return d.select("id", e["message"].alias("message"), e["status"].alias("error_status"))


#: (entities, highlights, groups)
ENTITIES = [
    ([("Acme  Corp", "ORG"), ("Ann", "PERSON"), ("Acme Corp", "ORG"), ("EU", "ORG"), ("May 5", "DATE"), ("seven", "CARDINAL")], "Acme Corp (ORG)|Ann (PERSON)|May 5 (DATE)|seven (CARDINAL)", "ORG=Acme Corp|PERSON=Ann|DATE=May 5"),
    ([(f"City {i}", "GPE") for i in range(9)], "|".join(f"City {i} (GPE)" for i in range(6)), "GPE=" + ",".join(f"City {i}" for i in range(6))), ([], "", ""),
]


@cases("id, highlights, grouped", [(i, *x[1:]) for i, x in enumerate(ENTITIES)])
def entity_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, x[0]) for i, x in enumerate(ENTITIES)], "id int, found array<struct<text:string,label:string>>")
    groups = F.array_join(F.transform(F.map_entries(enrich.grouped_entities(F.col("found"))), lambda g: F.concat(g["key"], F.lit("="), F.array_join(g["value"], ","))), "|")
    return d.select("id", F.array_join(enrich.entity_highlights(F.col("found")), "|").alias("highlights"), groups.alias("grouped"))


#: (text, second engine's words, its snippet's length, its end)
TEXTS = [("Thé Élan won't 42% 3.5 a_b", 8, 26, "3.5 a_b"), ("x" * 420, 1, 420, "x" * 7), ("x" * 421, 1, 423, "xxxx..."), ("  a   b ", 2, 3, "a b"), ("½ Ⅷ 二", 3, 5, "½ Ⅷ 二")]


@cases("id, words, snippet_length, snippet_end", [(i, *x[1:]) for i, x in enumerate(TEXTS)])
def second_text_cases(spark: SparkSession, sf: str) -> DataFrame:
    d, t = spark.createDataFrame([(i, x[0]) for i, x in enumerate(TEXTS)], "id int, t string"), F.col("t")
    s = T.snippet_dots(t)
    return d.select("id", T.word_count(t).alias("words"), F.length(s).alias("snippet_length"), F.right(s, F.lit(7)).alias("snippet_end"))
