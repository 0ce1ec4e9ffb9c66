"""Request traffic: rate limits, politeness slots and a TTL cache as event-time computations."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limit(df: DataFrame, client: str, ts: str, order: str, limit: int = 20, window: str = "60 seconds") -> DataFrame:
    """Adds n (place in the client's tumbling window) and accepted."""
    w = Window.partitionBy(client, "slot_start").orderBy(ts, order)
    return df.withColumn("slot_start", F.window(ts, window)["start"]).withColumn("n", F.row_number().over(w)).withColumn("accepted", F.col("n") <= limit)


def politeness(df: DataFrame, host: str, ts: str, order: str, gap_ms: int = 1000) -> DataFrame:
    """Adds start_us: the earliest start that keeps gap_ms between requests to a host; a running maximum, no loop."""
    gap = F.lit(gap_ms * 1000).cast("long")
    w = Window.partitionBy(host).orderBy(ts, order)
    d = df.withColumns({"rn": F.row_number().over(w), "us": F.unix_micros(F.col(ts).cast("timestamp"))})
    top = F.max(F.col("us") - gap * F.col("rn")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("start_us", gap * F.col("rn") + top).drop("rn", "us")


def ttl_cache(df: DataFrame, key: str, ts: str, order: str, ttl_ms: int = 900_000) -> DataFrame:
    """(key, order, hit): a miss stores the entry, which serves hits for ttl_ms from then.

    Each key's rows meet in one task in order, and the next miss is found by binary search, so a hot key costs its sort. Robots
    rules are kept alike: the key is then the origin.
    """
    ttl = ttl_ms * 1000

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, expires = None, 0
        for part in parts:
            keys, us = part["k"].to_numpy(), part["us"].to_numpy()
            hit = np.ones(len(part), bool)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                at = a if now_key is None or keys[a] != now_key else a + int(np.searchsorted(us[a:b], expires, side="right"))
                while at < b:
                    hit[at] = False
                    expires = us[at] + ttl
                    at += int(np.searchsorted(us[at:b], expires, side="right"))
                now_key = keys[a]
            yield pd.DataFrame({"k": part["k"], "o": part["o"], "hit": hit})

    kinds = [df.schema[c].dataType.simpleString() for c in (key, order)]
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    out = rows.repartition("k").sortWithinPartitions("k", "us", "o").mapInPandas(run, f"k {kinds[0]}, o {kinds[1]}, hit boolean")
    return out.withColumnsRenamed({"k": key, "o": order})


def lru_cache(df: DataFrame, node: str, key: str, ts: str, order: str, ttl_ms: int = 900_000, capacity: int = 200) -> DataFrame:
    """(node, order, hit) of one cache per node (a server's process), with a bound on entries: the least recently used goes first.

    A hit makes an entry the most recent but does not prolong it; an expired entry is a miss and goes. What a node does depends on
    all its earlier requests, so its rows meet in one task, which holds `capacity` entries.
    """
    ttl = ttl_ms * 1000

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_node, held = None, OrderedDict()
        for part in parts:
            hits = []
            for n, k, us in zip(part["n"], part["k"], part["us"], strict=True):
                if n != now_node:
                    now_node, held = n, OrderedDict()
                if k in held and us > held[k]:
                    del held[k]
                hits.append(k in held)
                if k in held:
                    held.move_to_end(k)
                    continue
                while len(held) >= capacity:
                    held.popitem(last=False)
                held[k] = us + ttl
            yield pd.DataFrame({"n": part["n"], "o": part["o"], "hit": hits})

    kinds = [df.schema[c].dataType.simpleString() for c in (node, order)]
    rows = df.select(F.col(node).alias("n"), F.col(key).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    out = rows.repartition("n").sortWithinPartitions("n", "us", "o").mapInPandas(run, f"n {kinds[0]}, o {kinds[1]}, hit boolean")
    return out.withColumnsRenamed({"n": node, "o": order})
