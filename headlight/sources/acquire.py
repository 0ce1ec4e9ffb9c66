"""Acquisition over captured attempts: what a crawler fetched is rows; choosing, redirects and feed matching are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headlight.functions.lexicons import ACQUIRE_ERRORS
from headlight.functions.urls import content_allowed, normalize_url, url_allowed
from headlight.sources.feeds import robots
from headlight.sources.html import articles, usable

#: Fixed order of the tiers, and their labels.
TIERS = ["http", "amp", "feed", "headless", "wayback"]
LABELS = {"http": "Direct fetch", "amp": "AMP version", "feed": "RSS feed", "headless": "Headless browser", "wayback": "Web archive", "direct fetch": "Direct fetch"}
MOST_BYTES, MOST_REDIRECTS = 5 * 1024 * 1024, 5


def choose(attempts: DataFrame) -> DataFrame:
    """attempts: url, via, status, content_type, html. The first usable tier of each url, with its article."""
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(True)) & content_allowed(F.col("content_type")) & (F.octet_length("html") <= MOST_BYTES)
    good = articles(attempts.where(ok)).where(usable(F.col("title"), F.col("body")))
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("via"))
    return good.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy(tier))).where("r = 1").drop("r")


def acquire(requests: DataFrame, attempts: DataFrame, rules: DataFrame, snapshots: DataFrame, agent: str) -> DataFrame:
    """requests (url) with via and article fields of the first usable tier, or the error struct of a url without one.

    rules: origin, robots (text). An origin without a row allows all; a url that its origin disallows only has its archived copy.
    snapshots: url, snapshot (address of an archived copy, which an error names).
    """
    origin = F.regexp_replace(normalize_url(F.col("url")), r"^([a-z]+://[^/]*).*$", "$1")
    asked = requests.select("url").distinct().withColumn("origin", origin).join(rules.select("origin", "robots"), "origin", "left")
    asked = asked.withColumn("allowed", robots(F.col("robots"), F.col("url"), agent)).select("url", "allowed")
    tried = attempts.join(asked, "url").where(F.col("allowed") | (F.col("via") == "wayback")).drop("allowed")
    hints = snapshots.where("snapshot is not null").groupBy("url").agg(F.min("snapshot").alias("snapshot"))
    message = F.when(F.col("allowed"), ACQUIRE_ERRORS["none"]).otherwise(ACQUIRE_ERRORS["robots"])
    hint = F.coalesce(F.concat(F.lit(ACQUIRE_ERRORS["hint"]), F.col("snapshot")), F.lit(""))
    error = F.when(F.col("via").isNull(), F.struct(F.concat(message, hint).alias("message"), F.lit(502).alias("status")))
    return asked.join(choose(tried), "url", "left").join(hints, "url", "left").withColumn("error", error).drop("allowed", "snapshot")


def resolve(requests: DataFrame, redirects: DataFrame) -> DataFrame:
    """url and final_url after at most five redirects (src, dst); null where a sixth would follow or a hop may not be fetched.

    redirects may have a column safe (of dst, an array of flags); without it scheme and host name are looked at alone.
    """
    safe = F.col("safe") if "safe" in redirects.columns else F.array(F.lit(True))
    edges = redirects.groupBy("src").agg(F.min_by(F.struct("dst", url_allowed(F.col("dst"), safe).alias("ok")), "dst").alias("e"))
    edges = edges.select("src", F.when(F.col("e.ok"), F.col("e.dst")).alias("dst"), F.lit(True).alias("moved"))
    now = requests.withColumn("final_url", F.col("url"))
    for _ in range(MOST_REDIRECTS):
        now = now.join(edges, F.col("final_url") == F.col("src"), "left").withColumn("final_url", F.when(F.col("moved"), F.col("dst")).otherwise(F.col("final_url"))).drop("src", "dst", "moved")
    again = edges.select(F.col("src").alias("again"))
    return now.join(again, F.col("final_url") == F.col("again"), "left").withColumn("final_url", F.when(F.col("again").isNull(), F.col("final_url"))).drop("again")


def match_feed(requests: DataFrame, items: DataFrame) -> DataFrame:
    """items: feed, pos, link, title, body. The first item by place with the request's normalized link and a title or body."""
    want = requests.select("url", normalize_url(F.col("url")).alias("k"))
    have = items.where("coalesce(title, '') <> '' or coalesce(body, '') <> ''").select(normalize_url(F.col("link")).alias("k"), F.struct("pos", "feed", "title", "body").alias("item"))
    return want.join(have.groupBy("k").agg(F.min("item").alias("item")), "k").select("url", "item.title", "item.body", "item.feed")


def via_label(via):
    return F.coalesce(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])[via], via)
