"""Language ID by word-first backoff.

Known words score by per-language log frequency; an unseen word falls back to its 4-, then 3-, 2- and 1-letter character
n-grams, the first length of which any is known. Word and n-gram counts cover every training row; only the sizes of the
broadcast tables are bounded (max_words, max_grams and CELLS, items by languages: model parameters). They keep the items with
the largest share of any language's tokens, so that a small language keeps its words. Null texts and texts without a letter
(category L) give `und` and score 0; ties go to the language that sorts first; no training rows give `und` throughout; more than
MOST_LANGS different languages raise an error. Extra columns are ignored, repeated rows are scored alike, an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headlight.llm.common import annotate, most_frequent, ready, table, trim

#: Runs of letters and of numerals that are no digits; `letters` parts them.
WORD = re.compile(r"[^\W\d_]+")
CELLS, MOST_LANGS = 8_000_000, 10_000
LONGEST = 4
FLUSH = 120_000
COUNTS = "lang string, item string, n long"
COUNTS_ARROW = {"lang": pa.string(), "item": pa.string(), "n": pa.int64()}


def letters(text: str) -> list[str]:
    """Runs of letters (category L) of the lower-cased text."""
    found = WORD.findall(text.lower())
    if "".join(found).isalpha():
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def _emit(counts: dict) -> pa.RecordBatch:
    rows = [(lang, item, n) for lang, c in counts.items() for item, n in c.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(COUNTS_ARROW.values())], names=list(COUNTS_ARROW))


def _count_words(batches):
    counts: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            if lang not in counts:
                counts.setdefault(lang.as_py(), Counter())
            counts[lang.as_py()].update(letters(text.as_py()))
        if sum(map(len, counts.values())) > FLUSH:
            yield _emit(counts)
            counts = {}
    yield _emit(counts)


def grams(word: str, n: int) -> list[str]:
    padded = word if n == 1 else f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_grams(batches):
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c = counts.setdefault(lang, Counter())
            for k in range(1, LONGEST + 1):
                for g in grams(word, k):
                    c[g] += n
        if sum(map(len, counts.values())) > FLUSH:
            yield _emit(counts)
            counts = {}
    yield _emit(counts)


class Model:
    """langs, their log prior, and tables item -> row of per-language log frequencies.

    Rows of unseen words are remembered behind the known words' rows, up to BOUND of them, then forgotten.
    """

    BOUND = 200_000

    def __init__(self, langs: list[str], prior: np.ndarray, words: dict[str, int], word_rows: np.ndarray, gram_ids: dict[str, int], gram_rows: np.ndarray) -> None:
        self.langs, self.prior, self.words, self.word_rows, self.gram_ids, self.gram_rows = langs, prior, words, word_rows, gram_ids, gram_rows
        self._forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.at, self.rows = dict(self.words), self.word_rows

    def backoff(self, word: str) -> np.ndarray:
        for k in range(LONGEST, 0, -1):
            found = [i for g in grams(word, k) if (i := self.gram_ids.get(g)) is not None]
            if found:
                return self.gram_rows[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def _learn(self, words: list[str]) -> None:
        if len(self.at) > len(self.words) + self.BOUND:
            self._forget()
        for w in words:
            i = self.at.get(w)
            if i is None:
                i = self.at[w] = len(self.at)
                if i >= len(self.rows):
                    more = np.empty((max(2 * len(self.rows), 1024), len(self.langs)), np.float32)
                    more[: len(self.rows)] = self.rows
                    self.rows = more
                self.rows[i] = self.backoff(w)

    def score(self, word: str) -> np.ndarray:
        self._learn([word])
        return self.rows[self.at[word]]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letters(text) if text else []
        if not found or not self.langs:
            return "und", 0.0
        try:
            at = [self.at[w] for w in found]
        except KeyError:
            self._learn(found)
            at = [self.at[w] for w in found]
        total = self.prior + self.rows[at].sum(axis=0, dtype=np.float64)
        p = np.exp(total - total.max())
        return self.langs[int(total.argmax())], float(1 / p.sum())


def _rows(counts: pa.Table, total: dict[str, int], langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """counts: lang, item, n; log frequency with 0.1 added to each count."""
    items = counts.column("item").combine_chunks().dictionary_encode()
    n = np.full((max(1, len(items.dictionary)), len(langs)), 0.1)
    at = {x: i for i, x in enumerate(langs)}
    lang = counts.column("lang").combine_chunks().dictionary_encode()
    column = np.array([at[x] for x in lang.dictionary.to_pylist()], np.int64)[np.asarray(lang.indices)] if len(lang) else np.zeros(0, np.int64)
    np.add.at(n, (np.asarray(items.indices), column), np.asarray(counts.column("n"), np.float64))
    totals = np.array([total.get(x, 1) for x in langs], float)
    rows = np.log(n / (totals + 0.1 * len(items.dictionary)))
    return {x: i for i, x in enumerate(items.dictionary.to_pylist())}, (rows - rows.max(axis=1, keepdims=True)).astype(np.float32)


def _kept(counts: DataFrame, limit: int) -> tuple[pa.Table, dict[str, int]]:
    """Counts (in order of language and item) and totals by language of at most `limit` items, those with the largest share of a language, so bounded for the driver and the broadcast."""
    totals = table(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    weighed = counts.join(F.broadcast(totals), "lang").withColumn("weight", F.ceil(F.col("n") * F.lit(2.0**40) / F.col("total")).cast("long"))
    items = table(weighed.groupBy("item").agg(F.max("weight").alias("weight"), F.collect_list(F.struct("lang", "n")).alias("by")))
    rows = most_frequent(items, "weight", "item", limit).select("item", F.inline("by")).toArrow()
    return rows.sort_by([("lang", "ascending"), ("item", "ascending")]), {r["lang"]: r["total"] for r in totals.collect()}


def fit(docs: DataFrame, max_words: int = 80_000, max_grams: int = 60_000) -> Model:
    """docs: text and lang of the training rows; rows with a null in either are not used."""
    ready(docs.sparkSession)
    use = docs.select("text", "lang").where("text is not null and lang is not null")
    per_lang = {r["lang"]: r["n"] for r in use.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    langs = sorted(per_lang)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not langs:
        return Model([], np.zeros(0), {}, np.zeros((1, 0)), {}, np.zeros((1, 0)))
    counted = table(use.mapInArrow(_count_words, COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n")))
    gram_counts = table(counted.mapInArrow(_count_grams, COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n")))
    words, word_rows = _rows(*_kept(counted, min(max_words, CELLS // len(langs))), langs)
    ids, gram_rows = _rows(*_kept(gram_counts, min(max_grams, CELLS // len(langs))), langs)
    n = np.array([per_lang[x] for x in langs], float)
    trim()
    return Model(langs, np.log(n / n.sum()), words, word_rows, ids, gram_rows)


def predict(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns lang_pred and score added; no shuffle."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        out = [shared.value.predict(x) for x in texts]
        return [[x[0] for x in out], [x[1] for x in out]]

    return annotate(docs, "text", {label: pa.string(), score: pa.float64()}, run)


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a predicted language of at least this score."""
    found = predict(docs, model, "headlight_lang", "headlight_score")
    return found.where((F.col("headlight_lang") != "und") & (F.col("headlight_score") >= least)).drop("headlight_lang", "headlight_score")
