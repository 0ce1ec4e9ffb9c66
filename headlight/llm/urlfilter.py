"""URL filters by a sort-merge range join: DataFrame and SQL functions only.

A host's labels, reversed and each closed by a dot, make a key (`www.example.net` -> `net.example.www.`), so a rule's host
and its subdomains are the interval from `net.example.` to `net.example/` ('/' follows '.'). Intervals nest or are apart.
Interval bounds and urls are sorted together over range partitions; the sweep carries, from bound to bound, the stack of rules
whose interval is open. A partition starts with the stack that the last bound before it left. Of the stack's rules whose path
begins the url's path, the longest text wins (then the longer host, then block over allow).

A url without `://` or null has empty host and path and gets the default. Repeated urls are judged each; null ids are kept;
rules with a null or empty host are ignored, repeated rules count once; extra columns are ignored; an empty rule or page table
works. A hot host is spread over partitions, as the sort key goes on with path and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headlight.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def bounds(rules: DataFrame) -> DataFrame:
    """(key, stack): from this key on, up to the next, the open rules. rules: host, path, verdict.

    Rules are joined to their own ancestors by host (as many rows as labels), so this grows with the rules only.
    """
    host = F.translate("host", UPPER, LOWER)
    rules = rules.where("host is not null and host <> '' and verdict is not null").select(key_of(host).alias("key"), host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    entry = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.col("verdict"), F.concat("host", "path").alias("rule"), F.col("path"))
    own = rules.groupBy("key").agg(F.collect_set(entry).alias("rules"))
    up = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda i: F.concat(F.array_join(F.slice("labels", 1, i), "."), F.lit(".")))
    above = own.select("key", F.split("key", r"\.").alias("labels")).select("key", F.explode(up).alias("ancestor"))
    ancestors = own.select(F.col("key").alias("ancestor"), "rules")
    stacks = above.join(ancestors, "ancestor").groupBy("key").agg(F.flatten(F.collect_list("rules")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("ancestor") != F.col("key"), F.col("rules")))).alias("outer"))
    opens = stacks.select("key", "stack", F.lit(1).alias("opens"))
    closes = stacks.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.col("outer").alias("stack"), F.lit(0).alias("opens"))
    return opens.union(closes)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (text or null) and verdict of each row of pages (page_id, url)."""
    edge = bounds(rules)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    nothing = F.lit(None).cast(edge.schema["stack"].dataType)
    events = urls.select(key_of(F.col("host")).alias("key"), F.lit(2).alias("kind"), "page_id", "host", "path", nothing.alias("stack")).unionByName(
        edge.select("key", F.col("opens").alias("kind"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    )
    # Written once: the partition number must not change between its two uses.
    swept = table(events.repartitionByRange("key", "kind", "path", "page_id").withColumn("part", F.spark_partition_id()))
    last = swept.where("kind < 2").groupBy("part").agg(F.max_by("stack", F.struct("key", "kind")).alias("closing"))
    parts = swept.select("part").distinct().join(last, "part", "left")
    carried = F.last("closing", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("part", carried.alias("carried"))  # one row per partition
    sweep = F.last("stack", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    open_rules = swept.withColumn("open", sweep).where("kind = 2").drop("stack", "kind", "key")
    open_rules = open_rules.join(F.broadcast(carried), "part").withColumn("open", F.coalesce("open", "carried"))
    best = F.array_max(F.filter(F.coalesce("open", nothing), lambda r: F.startswith("path", r["path"])))
    return open_rules.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
