from datetime import datetime, timedelta

from pyspark.sql import functions as F

from headlight.functions import urls as U
from headlight.operators import traffic
from headlight.plans import cases, report
from headlight.sources import acquire, html
from headlight.streaming import stateful, windows

P = "<p>" + "The council met and reviewed the ordinary plan for water pipes in the old town again. " * 3 + "</p>"
page = lambda body, head="": f"<html><head>{head}<title>Plain title</title></head><body>{body}</body></html>"


def test_title_tiers():
    og, tw = '<meta property="og:title" content="OG">', '<meta name="twitter:title" content="TW">'
    for head, body, want in ((og + tw, "<h1>H</h1>", "OG"), (tw, "<h1>H</h1>", "TW"), ("", "<h1>H <b>x</b></h1>", "H x"), ("", "", "Plain title"), (og.replace("OG", "  "), "<h1>H</h1>", "")):
        assert html.extract(page(body, head))[0] == want


def test_body_tiers_and_pruning():
    for open_, close, name in (("<article>", "</article>", "article"), ("<main>", "</main>", "main"), ('<div role="main">', "</div>", "[role='main']"), ('<div class="post-content">', "</div>", ".post-content")):
        assert html.extract(page(open_ + P * 3 + close))[2] == f"Paragraph extraction ({name} p)"
    assert html.extract(page(P * 3))[2] == "Readable paragraph fallback"
    assert html.extract(page("<p>short</p>"))[1:3] == ("", "No readable article body found")
    assert html.extract(page('<div class="roads">' + P * 3 + "</div>"))[1] == ""
    assert html.extract(page('<div id="my-cookie-bar">' + P * 3 + "</div>"))[1] == ""
    ld = '<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "NewsArticle"], "articleBody": "%s", "author": [{"name": "Ann"}, "Bob"], "datePublished": "2024-01-02"}]}</script><script type="application/ld+json">{bad</script>' % ("Plain words of an article body. " * 10)
    got = html.extract(page(P * 3, ld))
    assert got[2] == "JSON-LD articleBody" and got[4] == "2024-01-02" and got[5] == ["Ann", "Bob"]


def test_metadata_and_links():
    head = '<meta name="author" content="A, B & C and D"><meta property="article:author" content="E|F"><link rel="amphtml" href="/amp"><link rel="alternate" type="application/rss+xml" href="f.xml"><meta name="description" content="desc">'
    got = html.extract(page('<header><time datetime="2020">x</time></header><time datetime="2021">y</time>', head), "http://s.org/a/b")
    assert got[3:] == ("desc", "2021", ["A", "B", "C", "D"], "http://s.org/amp", ["http://s.org/a/f.xml"])
    assert html.extract(None)[:3] == ("", "", "No readable article body found")


def test_guards(spark):
    ips = ["127.0.0.1", "10.0.0.5", "192.168.1.1", "169.254.169.254", "::1", "::ffff:127.0.0.1", "8.8.8.8", "1.1.1.1", "x"]
    d = spark.createDataFrame([(x,) for x in ips], "ip string")
    assert [r[0] for r in d.select(U.ip_public(F.col("ip"))).collect()] == [False] * 6 + [True, True, None]
    assert [r[0] for r in d.select(U.ipv4_unsafe(F.col("ip"))).collect()][:4] == [True] * 4
    urls = spark.createDataFrame([("ftp://example.com/",), ("http://localhost:3000/",), ("HTTP://A.org/B/?q#f",), (None,)], "u string")
    got = urls.select(U.scheme_allowed(F.col("u")), U.host_blocked(U.host(F.col("u"))), U.normalize_url(F.col("u"))).collect()
    assert [r[0] for r in got] == [False, True, True, False] and got[1][1] and got[2][2] == "http://a.org/b"


def test_acquisition(spark):
    good = page("<article>" + P * 3 + "</article>")
    rows = [("u1", "http", 403, "text/html", good), ("u1", "wayback", 200, "text/html", good), ("u1", "feed", 200, None, good), ("u2", "http", 200, "text/html; charset=x", page("thin"))]
    got = acquire.choose(spark.createDataFrame(rows, "url string, via string, status int, content_type string, html string")).collect()
    assert [(r.url, r.via) for r in got] == [("u1", "feed")]
    hops = spark.createDataFrame([*((f"http://h{i}", f"http://h{i + 1}") for i in range(7)), ("http://in", "http://localhost/x"), ("http://file", "ftp://x")], "src string, dst string")
    asked = spark.createDataFrame([(f"http://{x}",) for x in ("h0", "h2", "z", "in", "file")], "url string")
    assert {r.url[7:]: r.final_url for r in acquire.resolve(asked, hops).collect()} == {"h0": None, "h2": "http://h7", "z": "http://z", "in": None, "file": None}
    items = spark.createDataFrame([("f", 2, "http://A/x/", "second", ""), ("f", 1, "http://a/x?utm", "", "first"), ("f", 0, "http://a/x", "", "")], "feed string, pos int, link string, title string, body string")
    assert [(r.url, r.body) for r in acquire.match_feed(spark.createDataFrame([("http://a/x#y",)], "url string"), items).collect()] == [("http://a/x#y", "first")]


def test_acquire_with_robots_and_hints(spark):
    good = page("<article>" + P * 3 + "</article>")
    tries = spark.createDataFrame([("http://a/x", "http", 200, "text/html", good), ("http://b/x", "http", 200, "text/html", good), ("http://c/x", "http", 200, "text/html", good), ("http://c/x", "wayback", 200, "text/html", good), ("http://d/x", "http", 500, "text/html", good)], "url string, via string, status int, content_type string, html string")
    rules = spark.createDataFrame([("http://b", "User-agent: *\nDisallow: /"), ("http://c", "User-agent: *\nDisallow: /")], "origin string, robots string")
    hints = spark.createDataFrame([("http://d/x", "http://w/1"), ("http://b/x", None)], "url string, snapshot string")
    asked = spark.createDataFrame([(f"http://{x}/x",) for x in "abcde"], "url string")
    got = {r.url[7]: r for r in acquire.acquire(asked, tries, rules, hints, "bot").collect()}
    assert {k: r.via for k, r in got.items()} == {"a": "http", "b": None, "c": "wayback", "d": None, "e": None}
    assert got["a"].error is None and "robots.txt" in got["b"].error.message and got["d"].error.message.endswith("A public archive snapshot exists: http://w/1") and got["e"].error.status == 502


CLICKBAIT = "You won't believe this SHOCKING secret doctors hate!"


def test_records_of_both_engines(spark):
    pages = spark.createDataFrame([(1, "http://www.a.org:80/x", page("<article>" + P * 3 + "</article>")), (2, None, None), (3, "https://b.org/", page("<main>" + P * 3 + "</main>", f'<meta property="og:title" content="{CLICKBAIT}">'))], "page_id int, url string, html string")
    first = report.analyze(pages)
    got = {r.page_id: r for r in first.collect()}
    assert got[1].source_domain == "www.a.org" and got[1].fetch_via == "direct fetch" and got[1].key_phrases[0] == "council"
    assert (got[2].score, got[2].body_snippet, got[2].published_at, got[2].headline_extracted) == (65, "Body text was unavailable.", "Not available", False)
    assert (got[3].verdict, got[3].bucket, got[3].composite_sensationalism_score) == ("Clickbait", "risky", 100) and got[3].score_breakdown.hook_points == 74
    second = report.analyze_semantic(pages, entities=F.expr("array(named_struct('text', 'Town', 'label', 'GPE'))"), polarity=F.lit(0.9))
    got = {r.page_id: r for r in second.collect()}
    assert got[1].source_domain == "a.org:80" and got[1].named_entities == ["Town (GPE)"] and got[1].entity_groups == {"GPE": ["Town"]} and got[1].sentiment_polarity == 0.9
    assert got[2].headline == "Article from source" and got[2].error.status == 400 and got[1].error is None
    both = report.union_records(first, second)
    rows = both.collect()
    assert len(rows) == 6 and {r.fetch_label for r in rows} == {"Direct fetch"} and all(r.title == r.headline and r.bucket and r.published_at for r in rows)
    assert report.display(both).count() == 6 and report.display(both).where("source = 'Unknown'").count() == 2
    other = F.struct(F.lit("H").alias("headline"), F.lit("x" * 181).alias("body"), F.array(F.lit("A")).alias("authors"), F.lit("p").alias("published_at"), F.lit("d").alias("meta_description"), F.lit("newspaper3k").alias("method"))
    assert {r.method for r in html.second_articles(pages, first=other).collect()} == {"newspaper3k"}


def test_extraction_and_address_cases(spark):
    """Fixed inputs and the results they must give."""
    import duckdb

    for name, query in cases.QUERIES.items():
        got = query(spark, "")
        want = duckdb.sql(cases.ORACLE_SQL[name])
        assert got.columns == want.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall())), name


def test_caches(spark):
    at = lambda s: datetime.fromtimestamp(1_700_000_040 + s)
    rows = [(i, "n", k, at(s)) for i, (k, s) in enumerate((("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 4), ("a", 5), ("a", 2000), ("b", 2001)))]
    e = spark.createDataFrame(rows, "id int, n string, k string, ts timestamp")
    hits = lambda d: [r.hit for r in d.orderBy("id").collect()]
    assert hits(traffic.lru_cache(e, "n", "k", "ts", "id", capacity=2)) == [False, False, True, False, False, False, False, False]
    assert hits(traffic.lru_cache(e, "n", "k", "ts", "id", capacity=3)) == [False, False, True, False, True, True, False, False]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = spark.range(400).selectExpr("id", "concat('k', id % 3) as k", "timestamp_seconds(1700000000 + id * id % 5000) as ts")
        got = {r.id: r.hit for r in traffic.ttl_cache(many, "k", "ts", "id", 600_000).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    held, want = {}, {}
    for r in sorted(many.collect(), key=lambda r: (r.ts, r.id)):
        want[r.id] = r.k in held and r.ts <= held[r.k]
        if not want[r.id]:
            held[r.k] = r.ts + timedelta(minutes=10)
    assert got == want


def test_stateful_streams(spark, tmp_path):
    e = spark.range(60).selectExpr("id", "concat('k', id % 4) as k", "timestamp_seconds(1700000000 + id * 7) as ts")
    for i in range(3):
        e.where(f"id >= {i * 20} and id < {i * 20 + 20}").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    for name, batch, stream in (("hits", traffic.ttl_cache(e, "k", "ts", "id", 60_000), stateful.ttl_cache), ("slots", traffic.politeness(e, "k", "ts", "id", 30_000).select("k", "id", "start_us"), stateful.politeness)):
        gap = 60_000 if name == "hits" else 30_000
        source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
        run = stream(source, "k", "ts", "id", gap).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        run.awaitTermination(180)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))


def test_traffic_and_stream(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(1_700_000_040 + s)
    e = spark.createDataFrame([(i, "a", at(s)) for i, s in enumerate((0, 1, 2, 61, 2000))], "id int, c string, ts timestamp")
    assert [r.accepted for r in traffic.rate_limit(e, "c", "ts", "id", 2).orderBy("id").collect()] == [True, True, False, True, True]
    assert [r.hit for r in traffic.ttl_cache(e, "c", "ts", "id").orderBy("id").collect()] == [False, True, True, True, False]
    starts = [r.start_us for r in traffic.politeness(e, "c", "ts", "id", 1500).orderBy("id").collect()]
    assert [b - a for a, b in zip(starts, starts[1:], strict=False)][:2] == [1_500_000] * 2
    e.write.parquet(f"{tmp_path}/in")
    stream = windows.client_counts(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "c", "ts", 2)
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(spark.table("counts").select("c", "requests", "accepted", "rejected").collect()) == sorted(windows.client_counts(e, "c", "ts", 2).select("c", "requests", "accepted", "rejected").collect())
