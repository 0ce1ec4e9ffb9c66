"""End-to-end analysis of pages, the union of both engines, and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headlight.functions import text as T
from headlight.functions.urls import domain, host
from headlight.operators import enrich, lexical, semantic
from headlight.sources.acquire import via_label
from headlight.sources.html import articles, body_error, second_articles


PARTS = ["semantic_gap_points", "sentiment_points", "hook_points", "synergy_points"]


def _breakdown(parts: list[str], kind: str) -> Column:
    return F.struct(*[F.col(p).cast(kind).alias(k) for p, k in zip(parts, PARTS, strict=True)])


def analyze(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The first engine's record per page, by the contract's names. Two Arrow passes (html and key phrases), no shuffle."""
    title, body = F.col("title"), F.col("body")
    # Key phrases come first: above native columns, an Arrow pass would have them all written out into one another.
    d = lexical.score(articles(pages, html, url).withColumn("key_phrases", enrich.key_phrases(F.concat(title, F.lit(" "), body))))
    d = d.withColumns({
        "headline": title, "headline_extracted": title != "", "composite_sensationalism_score": F.col("score"), "legitimacy_confidence_score": F.col("confidence"),
        "signals": F.slice("signals", 1, 6), "source_domain": host(F.col(url)), "body_snippet": T.snippet(body), "extraction_method": F.col("method"),
        "headline_word_count": F.size(T.tokens(title)), "word_count": F.size(T.tokens(body)), "numeric_claim_count": T.numeric_claims(body),
        "named_entities": enrich.proper_nouns(title, body), "supporting_sentences": enrich.supporting_sentences(body),
        "score_breakdown": _breakdown(["gap_points", "sentiment_points", "hook_points", "synergy_points"], "int"),
        "cosine_similarity_score": F.col("similarity"), "sentiment_polarity": F.col("polarity"), "engine": F.lit("node-heuristic"), "fetch_via": F.lit("direct fetch"),
    })
    d = d.withColumns({"estimated_read_time_minutes": T.read_minutes(F.col("word_count")), "entity_groups": enrich.entity_groups(F.col("named_entities"))})
    return d.drop("method", "confidence", "similarity", "polarity", "gap_points", "sentiment_points", "hook_points", "synergy_points", "amp_url", "feeds")


def score_semantic(df: DataFrame, title: str = "title", body: str = "body", cosine: Column | None = None, polarity: Column | None = None) -> DataFrame:
    """The second engine's score. cosine and polarity: of the caller's models; without them hashed embeddings and the lexicon."""
    d = lexical.with_polarity(df.withColumn("cosine", semantic.hash_cosine(F.col(title), F.col(body)) if cosine is None else cosine), title)
    return semantic.composite(d if polarity is None else d.withColumn("polarity", polarity), title, "cosine", "polarity")


def analyze_semantic(pages: DataFrame, url: str = "url", html: str = "html", first: Column | None = None, cosine: Column | None = None, polarity: Column | None = None, entities: Column | None = None) -> DataFrame:
    """The second engine's record per page, by the contract's names, and `error` where the body is too short.

    first, cosine, polarity and entities are hooks for models: another scraper's struct, a similarity, a headline polarity and an
    array of (text, label) of the body. Without entities there are none.
    """
    d = second_articles(pages, html, first)
    fallback = F.concat(F.lit("Article from "), F.coalesce(F.nullif(F.trim(domain(F.col(url))), F.lit("")), F.lit("source")))
    d = d.withColumns({"headline_extracted": F.col("headline") != "", "headline": F.coalesce(F.nullif("headline", F.lit("")), fallback), "error": body_error(F.col("body"))})
    d = score_semantic(d, "headline", "body", cosine, polarity)
    headline, body = F.col("headline"), F.col("body")
    found = F.array().cast("array<struct<text:string,label:string>>") if entities is None else entities
    d = d.withColumns({
        "engine": F.lit("python-nlp (hash)"), "body_snippet": T.snippet_dots(body), "source_domain": domain(F.col(url)), "extraction_method": F.col("method"),
        "word_count": T.word_count(body), "headline_word_count": T.word_count(headline), "numeric_claim_count": T.numeric_claims_both(headline, body),
        "key_phrases": enrich.body_phrases(body), "named_entities": enrich.entity_highlights(found), "entity_groups": enrich.grouped_entities(found),
        "supporting_sentences": enrich.overlap_list(headline, body), "cosine_similarity_score": F.round("cosine", 4), "sentiment_polarity": F.round("polarity", 4),
        "composite_sensationalism_score": F.col("score"), "legitimacy_confidence_score": 100 - F.col("score"),
        "score_breakdown": _breakdown(["gap_part", "sentiment_part", "hook_part", "synergy_part"], "double"),
    })
    d = d.withColumn("estimated_read_time_minutes", T.read_minutes(F.col("word_count"), even=True))
    return d.drop("method", "score", "cosine", "polarity", "gap_part", "sentiment_part", "hook_part", "synergy_part")


def normalize(records: DataFrame) -> DataFrame:
    """Either engine's records in one form: what one lacks is filled from what it has, as a reader of both needs."""
    have = lambda c, other: F.coalesce(*[F.col(x) for x in (c, other) if x in records.columns])
    filled = {"title": have("title", "headline"), "score": have("score", "composite_sensationalism_score"), "bucket": lexical.bucket(F.col("verdict"))}
    if "fetch_via" not in records.columns:
        filled["fetch_via"] = F.lit("direct fetch")
    filled |= {"score_breakdown": F.col("score_breakdown").cast("struct<" + ",".join(f"{k}:double" for k in PARTS) + ">"), "published_at": F.coalesce(F.nullif("published_at", F.lit("")), F.lit("Not available"))}
    filled |= {"meta_description": F.coalesce(F.nullif("meta_description", F.lit("")), F.lit("Not available")), "cosine_similarity_score": F.col("cosine_similarity_score").cast("double")}
    return records.withColumns(filled).withColumn("fetch_label", via_label(F.col("fetch_via")))


def union_records(first: DataFrame, second: DataFrame) -> DataFrame:
    """The records of analyze and analyze_semantic in one table of one schema."""
    return normalize(first).unionByName(normalize(second), allowMissingColumns=True)


def union_engines(df: DataFrame, key: str) -> DataFrame:
    """key, engine, score, verdict, bucket, summary and signals of both engines over titles and bodies."""
    a = lexical.score(df).select(key, F.lit("node-heuristic").alias("engine"), "score", "verdict", "signals", "summary")
    b = score_semantic(df).select(key, F.lit("python-nlp (hash)").alias("engine"), "score", "verdict", "signals", "summary")
    return a.unionByName(b).withColumn("bucket", lexical.bucket(F.col("verdict")))


def display(records: DataFrame) -> DataFrame:
    """Records as texts to show: numbers with three places, yes and no, lists with commas, the gauge's open part."""
    yes = lambda c: T.yes_no(F.col(c)).alias(c)
    return records.select(
        T.fixed(F.col("cosine_similarity_score")).alias("cosine_similarity"), T.fixed(F.col("sentiment_polarity")).alias("sentiment_polarity"), yes("semantic_gap"), yes("sensational_tone"),
        F.coalesce(F.nullif("source_domain", F.lit("")), F.lit("Unknown")).alias("source"), F.coalesce(F.nullif(F.array_join("authors", ", "), F.lit("")), F.lit("Unknown")).alias("authors"),
        F.concat(F.col("estimated_read_time_minutes").cast("string"), F.lit(" min")).alias("read_time"), F.round(T.gauge_offset(F.col("composite_sensationalism_score")), 6).alias("gauge_offset"),
    )


def breakdown_bars(parts: list[str]) -> list:
    most = F.greatest(F.lit(1), *parts)
    return [(F.col(p) / most * 100).alias(f"{p}_pct") for p in parts]


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))
