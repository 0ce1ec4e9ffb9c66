"""Semantic framing score on hashed embeddings, and vector cosine."""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from headlight.functions import text as T
from headlight.functions.lexicons import GAP_AT, HOOKS, STOPWORDS, TONE_AT

DIMS = 384
_word = re.compile("[a-z0-9]+")


def hash_embedding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dim, weight): the sparse, L2-normalised sum of hashed content tokens; aggregated by token before hashing."""
    toks = df.select(key, F.explode(T.content_bag(T.tokens(F.col(text)))).alias("tok")).groupBy(key, "tok").agg(F.count("*").alias("n"))
    digest = F.sha2(F.col("tok").cast("binary"), 256)
    dim = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % DIMS
    weight = 1 + (F.conv(F.substring(digest, 9, 8), 16, 10).cast("long") % 1000) / F.lit(1000).cast("decimal(5,0)")
    sums = toks.select(key, dim.alias("dim"), (F.col("n") * weight).cast("decimal(28,3)").alias("w")).groupBy(key, "dim").agg(F.sum("w").cast("double").alias("w"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, key).select(key, "dim", (F.col("w") / F.col("norm")).alias("weight"))


class _Weights(dict):
    """token -> (dim, weight in thousandths), remembered up to a bound."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        digest = hashlib.sha256(token.encode()).digest()
        self[token] = found = int.from_bytes(digest[:4], "big") % DIMS, 1000 + int.from_bytes(digest[4:8], "big") % 1000
        return found


_weights, _stop = _Weights(), frozenset(STOPWORDS)


def _vector(text: str | None) -> dict[int, int]:
    out: dict[int, int] = {}
    for token in _word.findall((text or "").lower()):
        if token not in _stop:
            dim, weight = _weights[token]
            out[dim] = out.get(dim, 0) + weight
    return out


@F.pandas_udf(DoubleType())
def _hash_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float:
        u, v = _vector(x), _vector(y)
        dot, norm = sum(n * v[k] for k, n in u.items() if k in v), math.sqrt(sum(n * n for n in u.values())) * math.sqrt(sum(n * n for n in v.values()))
        return max(-1.0, min(1.0, dot / norm)) if norm else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def hash_cosine(title: Column, body: Column) -> Column:
    """Cosine of the sparse hashed vectors of two texts of one row, to six places: one Arrow pass, no shuffle; 0 where either has no content.

    Sums are whole thousandths, so they do not depend on the order of tokens. `hash_embedding` gives the vectors as rows.
    """
    return F.round(_hash_cosine(title, F.substring(body, 1, 6000)), 6)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def hooks(title: Column) -> list[Column]:
    return [F.lower(title).rlike(T.ascii_edges(p)) for p, _ in HOOKS]


def composite(df: DataFrame, title: str, cosine_col: str, polarity_col: str) -> DataFrame:
    """Adds the four-way verdict, its score, parts, signals and summary."""
    sim, pol = F.col(cosine_col), F.col(polarity_col)
    gap, tone = sim < GAP_AT, F.abs(pol) > TONE_AT
    found = hooks(F.col(title))
    hook = F.least(F.lit(35), 12 * sum((h.cast("int") for h in found), F.lit(0))) / F.lit(100.0)
    gap_part = F.when(gap, F.least(F.lit(1.0), (GAP_AT - sim) / GAP_AT)).otherwise(0.0)
    parts = {"gap_part": gap_part * 58, "sentiment_part": F.least(F.lit(1.0), F.abs(pol)) * 28, "hook_part": hook * 40, "synergy_part": F.when(gap & tone, 8.0).otherwise(0.0)}
    d = df.withColumns({"semantic_gap": gap, "sensational_tone": tone, **parts})
    d = d.withColumn("score", T.clamp(F.bround(F.col("gap_part") + F.col("sentiment_part") + F.col("hook_part") + F.col("synergy_part")).cast("int")))
    s = F.col("score")
    v = F.when(F.col("semantic_gap") & F.col("sensational_tone") & (s >= 65), "Clickbait").when(F.col("sensational_tone") & (s >= 45), "Sensationalist").when((s >= 35) | F.col("semantic_gap"), "Borderline").otherwise("Legitimate")
    d = d.withColumn("verdict", v)
    text = F.when(F.col("verdict") == "Clickbait", "High risk of clickbait/deceptive framing (score ").when(F.col("verdict") == "Sensationalist", "Headline appears emotionally exaggerated (score ")
    text = text.when(F.col("verdict") == "Borderline", "Mixed signals detected. Review article context carefully (score ").otherwise("Headline/body alignment appears mostly legitimate (score ")
    signals = [F.when(gap, F.concat(F.lit("Semantic gap detected: cosine similarity "), T.fixed(sim, even=True), F.lit(" is below 0.35."))), F.when(tone, F.concat(F.lit("Strong headline sentiment: polarity "), T.fixed(pol, even=True), F.lit(" exceeds +/-0.50.")))]
    signals += [F.when(h, x) for h, (_, x) in zip(found, HOOKS, strict=True)]
    rounded = {k: F.bround(F.col(k), 1) for k in parts}
    return d.withColumns({"summary": F.concat(text, s.cast("string"), F.lit("/100).")), "signals": F.slice(F.array_compact(F.array(*signals)), 1, 8), **rounded})
