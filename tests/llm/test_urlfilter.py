import random

from headlight.llm import urlfilter
from tests.llm import fixtures


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


def test_against_brute_force(spark):
    rng = random.Random(4)
    label = ["a", "b", "net", "com", "x-y", "", "a.b"]
    rules = sorted({(".".join(rng.choice(label[:5]) for _ in range(rng.randint(1, 4))), rng.choice(["", "/", "/en/", "/en", "/de/x"]), rng.choice(["allow", "block"])) for _ in range(60)})
    urls = [None, "", "no scheme", "://", "http://", "http:///en/", "HTTP://A.B.NET/en/?q#f", "http://net", "http://net?x://com/", "x://y://a.net/", "http://b.net:80/", "http://a.b.net/en/\nx", "http://.net/", "http://net./", "http://É.NET/"]
    urls += [f"http://{'.'.join(rng.choice(label) for _ in range(rng.randint(1, 5)))}{rng.choice(['', '/', '/en/1', '/en', '/de/xy?z', '#/en/'])}" for _ in range(400)]
    pages = fixtures.clashing(spark.createDataFrame([*enumerate(urls), (None, "http://a.net/en/"), (3, "://")], "page_id long, url string")).repartition(5)
    frame = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = urlfilter.judge(pages, frame).collect()
    want = [(i, *brute(u, rules)) for i, u in [*enumerate(urls), (None, "http://a.net/en/"), (3, "://")]]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert {r["verdict"] for r in urlfilter.judge(pages, fixtures.empty(frame)).collect()} == {"allow"}
    assert urlfilter.judge(fixtures.empty(pages), frame).count() == 0


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = urlfilter.judge(pages, spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
