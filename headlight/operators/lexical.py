"""Lexical framing score: every signal is a Column over title and body."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headlight.functions import text as T
from headlight.functions.lexicons import BAIT, DECEPTION, GAP_AT, NEGATIVE, POSITIVE, SIGNALS, TEASERS, TONE_AT, UPPER_AT, W


def prepare(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Adds t_norm, t_low, t_tok, t_set, b_low and b_set, each once, for the expressions below."""
    df = df.withColumns({"t_norm": T.normalize_space(F.col(title)), "b_raw": F.coalesce(F.col(body), F.lit(""))})
    df = df.withColumns({"t_low": F.lower("t_norm"), "b_low": F.lower("b_raw"), "t_tok": T.tokens(F.col("t_norm")), "b_tok": T.tokens(F.col("b_raw"))})
    return df.withColumns({"t_set": T.content_set(F.col("t_tok")), "b_set": T.content_set(F.col("b_tok"))})


def similarity() -> Column:
    n = F.size("t_set")
    return F.when((n == 0) | (F.size("b_set") == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect("t_set", "b_set")) / n)


def polarity() -> Column:
    pos, neg = (F.expr(f"size(filter(t_tok, t -> t in ({T.listed(words)})))") for words in (POSITIVE, NEGATIVE))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (pos - neg) / F.greatest(F.lit(1), pos + neg)))


def with_polarity(df: DataFrame, title: str = "title") -> DataFrame:
    """df with polarity, from the title alone."""
    return df.withColumn("t_tok", T.tokens(F.col(title))).withColumn("polarity", polarity()).drop("t_tok")


def hits(patterns: list[tuple[str, str]]) -> list[Column]:
    return [_find(F.col("t_low"), p) for p, _ in patterns]


def _find(text: Column, pattern: str) -> Column:
    """A pattern without special characters is a plain search."""
    return F.contains(text, F.lit(pattern)) if re.fullmatch(r"[a-z0-9 '%]+", pattern) else text.rlike(T.ascii_edges(pattern))


def hit_count(patterns: list[tuple[str, str]]) -> Column:
    return sum((h.cast("int") for h in hits(patterns)), F.lit(0))


def bang_points() -> Column:
    return F.least(F.lit(W["bang_cap"]), W["mark"] * T.count_of(F.col("t_norm"), "!"))


def ask_points() -> Column:
    return F.least(F.lit(W["ask_cap"]), W["mark"] * T.count_of(F.col("t_norm"), "?"))


def upper_ratio() -> Column:
    letters = T.count_of(F.col("t_norm"), T.LETTERS)
    return F.when(letters == 0, F.lit(0.0)).otherwise(T.count_of(F.col("t_norm"), T.LETTERS[26:]) / letters)


def upper_hit() -> Column:
    return (upper_ratio() > UPPER_AT) & (F.length("t_norm") > 16)


def length_hit() -> Column:
    n = F.size(F.array_remove(F.split("t_norm", " "), ""))
    return (n < 4) | (n > 20)


def teaser_hit() -> Column:
    in_title = [F.col("t_low").rlike(T.EDGE_L + w + T.EDGE_R) for w in TEASERS]
    # A body is searched only for words that are in its title; ASCII words of a body are its tokens, but for underscores.
    some = reduce(Column.__or__, in_title)
    echoed = reduce(Column.__or__, [h & F.col("b_low").rlike(T.EDGE_L + w + T.EDGE_R) for h, w in zip(in_title, TEASERS, strict=True)])
    return (F.length("b_raw") > 200) & F.when(some, ~echoed).otherwise(False)


def verdict(score: Column) -> Column:
    return F.when(score >= W["risky"], "Clickbait").when(score >= W["warning"], "Borderline").otherwise("Likely Legit")


def bucket(v: Column) -> Column:
    return F.when(v == "Clickbait", "risky").when(v.isin("Sensationalist", "Borderline"), "warning").otherwise("safe")


def summary(score: Column) -> Column:
    return (
        F.when(score >= W["risky"], "This article headline shows strong clickbait/deceptive signals.")
        .when(score >= W["warning"], "This article has some clickbait characteristics. Read carefully before trusting the framing.").otherwise("This headline appears relatively neutral with limited clickbait signals.")
    )


def score(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """df with score, verdict, bucket, confidence, the four parts, signals, similarity and polarity. No shuffle, no UDF."""
    d = prepare(df, title, body)
    d = d.withColumns({
        "similarity": similarity(), "polarity": polarity(), "bait": F.array(*hits(BAIT)), "deception": F.array(*hits(DECEPTION)), "bang": bang_points(), "ask": ask_points(),
        "upper": upper_hit(), "odd_length": length_hit(), "teaser": teaser_hit(),
    })
    count = lambda c: F.size(F.array_remove(c, False))
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(0)
    d = d.withColumns({"semantic_gap": F.col("similarity") < GAP_AT, "sensational_tone": F.abs("polarity") > TONE_AT})
    d = d.withColumns({
        "hook_points": W["bait"] * count("bait") + W["deception"] * count("deception") + F.col("bang") + F.col("ask") + flag(F.col("upper"), W["upper"]) + flag(F.col("odd_length"), W["length"]),
        "gap_points": flag(F.col("semantic_gap"), W["gap"]) + flag(F.col("teaser"), W["teaser"]), "sentiment_points": flag(F.col("sensational_tone"), W["tone"]),
    })
    d = d.withColumn("synergy_points", flag((F.col("gap_points") > 0) & (F.col("hook_points") > 0), W["synergy"]))
    texts = [F.when(F.col("bait")[i], SIGNALS["bait"] % x) for i, (_, x) in enumerate(BAIT)] + [F.when(F.col("deception")[i], SIGNALS["deception"] % x) for i, (_, x) in enumerate(DECEPTION)]
    for c, k in ((F.col("bang") > 0, "bang"), (F.col("ask") > 0, "ask"), (F.col("upper"), "upper"), (F.col("odd_length"), "length"), (F.col("semantic_gap"), "gap"), (F.col("sensational_tone"), "tone"), (F.col("teaser"), "teaser"), (F.col("synergy_points") > 0, "synergy")):
        texts.append(F.when(c, SIGNALS[k]))
    none = F.col("t_norm") == ""
    fixed = {"gap_points": 20, "sentiment_points": 0, "hook_points": 45, "synergy_points": 0}
    d = d.withColumns({
        "score": F.when(none, W["none"]).otherwise(T.clamp(F.col("hook_points") + F.col("gap_points") + F.col("sentiment_points") + F.col("synergy_points"))),
        "signals": F.when(none, F.array(F.lit(SIGNALS["none"]))).otherwise(F.slice(F.array_compact(F.array(*texts)), 1, 6)),
        **{k: F.when(none, v).otherwise(F.col(k)) for k, v in fixed.items()}, "similarity": F.when(none, 0.0).otherwise(F.col("similarity")),
        "polarity": F.when(none, 0.0).otherwise(F.col("polarity")), "semantic_gap": none | F.col("semantic_gap"), "sensational_tone": ~none & F.col("sensational_tone"),
    })
    d = d.withColumns({"verdict": verdict(F.col("score")), "summary": summary(F.col("score")), "confidence": T.clamp(100 - F.col("score"))})
    made = ["score", "verdict", "bucket", "confidence", "summary", "gap_points", "sentiment_points", "hook_points", "synergy_points", "signals", "similarity", "polarity", "semantic_gap", "sensational_tone"]
    return d.withColumn("bucket", bucket(F.col("verdict"))).select(*df.columns, *made)


def similarity_join(df: DataFrame, key: str, title: str = "title", body: str = "body") -> DataFrame:
    """similarity as a semi-join of distinct (id, token) rows: for bodies too large for one array."""
    sets = lambda c: df.select(key, F.explode(T.content_set(T.tokens(F.col(c)))).alias("tok"))
    head, text = sets(title), sets(body)
    n = head.groupBy(key).agg(F.count("*").alias("n"))
    both = head.join(text, [key, "tok"], "left_semi").groupBy(key).agg(F.count("*").alias("m"))
    return df.select(key).join(n, key, "left").join(both, key, "left").select(key, F.coalesce(F.col("m") / F.col("n"), F.lit(0.0)).alias("similarity"))
