"""Key phrases, proper nouns and sentences: frequency, top-k and ordered distinct."""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headlight.functions import text as T
from headlight.functions.lexicons import CUES, ENTITY_LABELS, STOPWORDS


_word, _stop = re.compile("[a-z0-9]+"), frozenset(STOPWORDS)


def key_phrases(text: Column, k: int = 8, least: int = 4, letters: bool = False) -> Column:
    """The k most frequent content tokens of at least `least` characters, ties by first place; counted in the row, no shuffle.

    letters: only tokens of letters, as the second engine takes them.
    """

    @F.pandas_udf("array<string>")
    def top(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            found = Counter(_word.findall((x or "").lower()))  # by first place
            keep = [(w, n) for w, n in found.items() if len(w) >= least and w not in _stop and not (letters and not w.isalpha())]
            return [w for w, _ in heapq.nsmallest(k, keep, key=lambda x: -x[1])]

        return texts.map(one, na_action=None)

    return top(text)


def body_phrases(body: Column) -> Column:
    """The second engine's key phrases."""
    return key_phrases(F.substring(body, 1, 6000), letters=True)


def proper_nouns(title: Column, body: Column, k: int = 12) -> Column:
    pattern = rf"{T.EDGE_L}([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}){T.EDGE_R}"
    found = F.transform(F.regexp_extract_all(F.concat(title, F.lit(". "), F.substring(body, 1, 2200)), F.lit(pattern), 1), T.normalize_space)
    return F.slice(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~x.rlike("^The$|This$|That$|And$|But$"))), 1, k)


def entity_groups(entities: Column) -> Column:
    return F.when(F.size(entities) > 0, F.create_map(F.lit("Proper Nouns"), entities)).otherwise(F.create_map().cast("map<string,array<string>>"))


def entity_highlights(found: Column, k: int = 6) -> Column:
    """found: array of structs (text, label) by any recogniser. `text (LABEL)`, distinct in order, texts of three characters or more."""
    named = F.filter(F.transform(found, lambda e: F.struct(T.normalize_space(e["text"]).alias("text"), e["label"].alias("label"))), lambda e: F.length(e["text"]) >= 3)
    return F.slice(F.array_distinct(F.transform(named, lambda e: F.concat(e["text"], F.lit(" ("), e["label"], F.lit(")")))), 1, k)


def grouped_entities(found: Column, k: int = 6) -> Column:
    """A map of the labels that have entities, in fixed order, to at most k distinct texts each."""

    def group(label: str) -> Column:
        texts = F.transform(F.filter(found, lambda e: e["label"] == label), lambda e: T.normalize_space(e["text"]))
        return F.struct(F.lit(label).alias("key"), F.slice(F.array_distinct(F.filter(texts, lambda x: F.length(x) >= 3)), 1, k).alias("value"))

    return F.map_from_entries(F.filter(F.array(*map(group, ENTITY_LABELS)), lambda g: F.size(g["value"]) > 0))


def sentences(body: Column, least: int = 31) -> Column:
    return F.filter(F.transform(F.split(body, r"(?<=[.!?])\s+"), T.normalize_space), lambda s: F.length(s) >= least)


def supporting_sentences(body: Column, k: int = 4) -> Column:
    """The first sentences with a cue; without any, the first sentences."""
    first = lambda good: T.bind(F.filter(good, lambda s: F.lower(s).rlike(CUES)), lambda cued: F.slice(F.when(F.size(cued) > 0, cued).otherwise(good), 1, k))
    return T.bind(F.filter(sentences(body), lambda s: ~T.is_noisy(s)), first)


def overlap_sentences(df: DataFrame, key: str, title: str, body: str, k: int = 3) -> DataFrame:
    """(key, pos, sentence, points): sentences by shared content tokens with the title plus length, k per key."""
    rows = df.select(key, T.content_set(T.tokens(F.col(title))).alias("t"), F.posexplode(sentences(F.substring(body, 1, 5000), 30)).alias("pos", "sentence"))
    points = F.size(F.array_intersect("t", T.content_set(T.tokens(F.col("sentence"))))) + F.least(F.lit(2.0), F.length("sentence") / 160)
    rows = rows.select(key, "pos", "sentence", points.alias("points"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("points"), "pos"))).where(F.col("r") <= k).drop("r")


def overlap_list(title: Column, body: Column, k: int = 3) -> Column:
    """The sentences of overlap_sentences as an array, in the row."""

    def points(terms: Column, s: Column) -> Column:
        return F.size(F.array_intersect(terms, T.content_set(T.tokens(s)))) + F.least(F.lit(2.0), F.length(s) / 160)

    found = lambda terms: F.transform(sentences(F.substring(body, 1, 5000), 30), lambda s, i: F.struct((-points(terms, s)).alias("p"), i.alias("i"), s.alias("s")))
    return T.bind(T.content_set(T.tokens(title)), lambda terms: F.transform(F.slice(F.array_sort(found(terms)), 1, k), lambda x: x["s"]))
