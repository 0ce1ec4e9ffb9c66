from pyspark.sql import functions as F

from headlight.functions import text as T
from headlight.functions.lexicons import BAIT, DECEPTION, TEASERS
from headlight.operators import enrich, lexical

BODY = "Officials said on Tuesday that several perfectly ordinary items were reviewed at the council building. " * 6


def one(spark, title, body):
    return lexical.score(spark.createDataFrame([(title, body)], "title string, body string")).first()


def test_scores_of_fixed_pairs(spark):
    r = one(spark, "You won't believe this SHOCKING secret doctors hate!", "A neutral short body about something else entirely.")
    assert (r.score, r.verdict, r.bucket, r.hook_points, r.gap_points, r.sentiment_points, r.synergy_points) == (100, "Clickbait", "risky", 74, 18, 12, 6)
    r = one(spark, "Council approves water budget report", "The council approves the water budget report today after a vote.")
    assert (r.score, r.verdict, r.similarity) == (0, "Likely Legit", 1.0)
    for empty in ("", None, "   "):
        r = one(spark, empty, "body")
        assert (r.score, r.semantic_gap, r.gap_points, r.hook_points, list(r.signals)) == (65, True, 20, 45, ["Could not extract a reliable headline from the page."])
    r = one(spark, "SHOCKING miracle cure: 100% proof!!! you won't believe what happened next???", None)
    assert r.score == 100 and r.hook_points + r.gap_points + r.sentiment_points + r.synergy_points > 100 and len(r.signals) == 6


def test_cutoffs(spark):
    d = spark.createDataFrame([(70,), (69,), (40,), (39,)], "s int")
    assert [r[0] for r in d.select(lexical.verdict(F.col("s"))).collect()] == ["Clickbait", "Borderline", "Borderline", "Likely Legit"]


def test_similarity_and_polarity(spark):
    assert one(spark, "water budget report", "water budget report today").similarity == 1.0
    assert one(spark, "alpha bravo charlie", "delta echo foxtrot").similarity == 0.0
    assert one(spark, "great success safe benefit", "x").polarity > 0 > one(spark, "scam fraud danger crisis", "x").polarity
    assert one(spark, "the a of to", "x").polarity == 0.0
    words = [f"w{i}" for i in range(20)]
    assert not one(spark, " ".join(words), " ".join(words[:7])).semantic_gap and one(spark, " ".join(words), " ".join(words[:6])).semantic_gap


def test_every_pattern_alone(spark):
    say = lambda p: p.replace(".?", "-").replace("[0-9]+", "7").replace("(top|best|worst)", "best").replace(r"\b", "").replace(r"\s+", " ")
    titles = [say(p) for p, _ in BAIT + DECEPTION] + ["you won’t believe", "bestow 5", "secure"]
    got = lexical.prepare(spark.createDataFrame([(t, "") for t in titles], "title string, body string")).select(lexical.hit_count(BAIT).alias("b"), lexical.hit_count(DECEPTION).alias("d")).collect()
    n = len(BAIT)
    assert [r.b for r in got[:n]] == [2, *[1] * (n - 1)] and [r.d for r in got[n : n + len(DECEPTION)]] == [1] * len(DECEPTION)
    assert [(r.b, r.d) for r in got[-3:]] == [(0, 0), (0, 0), (0, 1)]


def test_teaser_and_uppercase_gates(spark):
    for n, hit in ((200, False), (201, True)):
        assert one(spark, "the truth here now", "x" * n).gap_points == 18 + 12 * hit
    assert one(spark, "the truth here now", "truth " + "x" * 300).gap_points == 18
    for t, hit in (("ABCDEFGHIJ KLMNO", False), ("ABCDEFGHIJ KLMNOP", True)):
        assert ("Headline has excessive uppercase emphasis." in one(spark, t, "x").signals) == hit
    assert all(w in TEASERS for w in ("truth", "must"))


def test_text_scalars(spark):
    d = spark.createDataFrame([("a ﻿ b c ",), ("Thé Élan won't 42% 3.5",), (None,)], "t string")
    got = d.select(T.normalize_space(F.col("t")).alias("n"), T.tokens(F.col("t")).alias("k"), T.numeric_claims(F.coalesce("t", F.lit(""))).alias("c")).collect()
    assert got[0].n == "a b c" and list(got[1].k) == ["th", "lan", "won", "t", "42", "3", "5"] and got[1].c == 2 and (got[2].n, list(got[2].k)) == ("", [])
    r = spark.range(2).select(T.read_minutes(F.lit(550)).alias("a"), T.read_minutes(F.lit(550), True).alias("b"), T.read_minutes(F.lit(0)).alias("c"), T.escape_html(F.lit('<a & "b">')).alias("e")).first()
    assert (r.a, r.b, r.c, r.e) == (3, 2, 1, "&lt;a &amp; &quot;b&quot;&gt;")


def test_enrichment(spark):
    d = spark.createDataFrame([(1, "Great Council meets", "The Mayor of New York said so. " + BODY), (2, "", "")], "id int, title string, body string")
    r = d.select(enrich.proper_nouns(F.col("title"), F.col("body")).alias("e"), enrich.supporting_sentences(F.col("body")).alias("s")).collect()
    assert list(r[0].e)[:3] == ["Great Council", "The Mayor", "New York"] and "The" not in r[0].e and 1 <= len(r[0].s) <= 4 and list(r[1].e) == []
    k = {r["id"]: list(r["key_phrases"]) for r in d.select("id", enrich.key_phrases(F.col("body")).alias("key_phrases")).collect()}
    assert k[2] == [] and k[1][0] == "said" and len(k[1]) == 8


def test_numbers_with_fixed_places(spark):
    """By the exact binary value, against Python's and, for ties, rounding up."""
    values = [0.0375, 0.5625, 0.0625, -0.0625, 0.1235, 2.0005, 1.0, -0.0001, 0.0, 0.9995, 1 / 3, 0.0125, 0.4375]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select(T.fixed(F.col("x")).alias("up"), T.fixed(F.col("x"), even=True).alias("even")).collect()
    from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

    for x, r in zip(values, got, strict=True):
        assert (r.up, r.even) == tuple(str(Decimal(x).quantize(Decimal("0.001"), how)) for how in (ROUND_HALF_UP, ROUND_HALF_EVEN))


def test_overlap_sentences_in_the_row(spark):
    body = "The town council met on Tuesday and said so. Nothing else of note happened in the whole long week! The budget of the council was approved by all of them? Short. The council and the budget were in the news again and again."
    d = spark.createDataFrame([(1, "Council approves budget", body), (2, "", None)], "id int, title string, body string")
    rows = {}
    for r in enrich.overlap_sentences(d, "id", "title", "body").orderBy("id", F.desc("points"), "pos").collect():
        rows.setdefault(r.id, []).append(r.sentence)
    got = {r.id: list(r.s or []) for r in d.select("id", enrich.overlap_list(F.col("title"), F.coalesce("body", F.lit(""))).alias("s")).collect()}
    assert got == {1: rows[1], 2: []} and len(rows[1]) == 3


def test_cosine_of_rows_and_columns(spark):
    """The vectors as rows give the same cosine."""
    from headlight.operators import semantic

    d = spark.createDataFrame([(1, "water budget council", "the council voted on the water budget today"), (2, "water", "fire"), (3, "", "x"), (4, "same words", "same words")], "id int, title string, body string")
    got = {r.id: r.c for r in d.select("id", semantic.hash_cosine(F.col("title"), F.col("body")).alias("c")).collect()}
    a, b = semantic.hash_embedding(d, "id", "title"), semantic.hash_embedding(d, "id", "body").withColumnRenamed("weight", "other")
    want = {r.id: r.c for r in a.join(b, ["id", "dim"]).groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("other")), 6).alias("c")).collect()}
    assert got == {1: want[1], 2: want.get(2, 0.0), 3: 0.0, 4: 1.0}
