"""Streaming twins of the TTL cache and the politeness slots: one number of state per key, rows of a batch in time order.

What arrives in a later batch is served later, whatever its time, as a running server would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(events: DataFrame, key: str, ts: str, order: str, out: str, serve: Callable[[int, int | None], tuple[object, int]]) -> DataFrame:
    """serve: (time, state or None) to (result, new state)."""
    name, kind = out.split()
    kinds = [events.schema[c].dataType.simpleString() for c in (key, order)]
    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["us", "o"])
        held = state.get[0] if state.exists else None
        found = []
        for us in rows["us"].tolist():
            result, held = serve(us, held)
            found.append(result)
        state.update((held,))
        yield pd.DataFrame({"k": rows["k"], "o": rows["o"], name: found})

    done = rows.groupBy("k").applyInPandasWithState(run, f"k {kinds[0]}, o {kinds[1]}, {name} {kind}", "held long", "append", "NoTimeout")
    return done.withColumnsRenamed({"k": key, "o": order})


def ttl_cache(events: DataFrame, key: str, ts: str, order: str, ttl_ms: int = 900_000) -> DataFrame:
    """(key, order, hit) of a stream; see operators.traffic.ttl_cache."""

    def serve(us: int, expires: int | None) -> tuple[bool, int]:
        hit = expires is not None and us <= expires
        return hit, expires if hit else us + ttl_ms * 1000

    return _fold(events, key, ts, order, "hit boolean", serve)


def politeness(events: DataFrame, host: str, ts: str, order: str, gap_ms: int = 1000) -> DataFrame:
    """(host, order, start_us) of a stream; see operators.traffic.politeness."""

    def serve(us: int, following: int | None) -> tuple[int, int]:
        start = us if following is None else max(us, following)
        return start, start + gap_ms * 1000

    return _fold(events, host, ts, order, "start_us long", serve)
