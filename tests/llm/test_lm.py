from collections import Counter
from math import log

import numpy as np
from pyspark.sql import functions as F

from headlight.llm import lm
from tests.llm import fixtures


def test_against_brute_force(spark):
    docs = fixtures.clashing(fixtures.docs(spark)).withColumn("flag", F.when(F.col("source") == "src0", True)).repartition(3)
    rows = [(r["doc_id"], r["text"], bool(r["flag"])) for r in docs.select("doc_id", "text", "flag").collect()]
    size = 200
    model = lm.fit(docs, "flag", size)
    vocab = set(model[0])
    n = Counter(w for _, t, _ in rows for w in (t or "").encode().lower().split())
    assert len(vocab) == size - 1 and min(n[w] for w in vocab) >= max(c for w, c in n.items() if w not in vocab)
    known = lambda t: [w if w in vocab else b"" for w in (t or "").encode().lower().split()]
    pairs = [Counter(), Counter()]
    flags = {d: flag for d, _, flag in rows}
    for _, t, flag in rows:
        w = known(t)
        pairs[0 if flag else 1].update(zip([None, *w[:-1]], w, strict=True) if w else ())
    got = {}
    for r in lm.score(docs, model).collect():
        got.setdefault(r["doc_id"], r)
    for d, t, _ in rows:
        w = known(t)
        if not w:
            assert (got[d]["n_tokens"], got[d]["target_loss"], got[d]["score"]) == (0, None, 0.0)
            continue
        if len(w) > 3000:
            continue
        loss = []
        for k, c in enumerate(pairs):
            if k == (0 if flags[d] else 1):
                c = c - Counter(zip([None, *w[:-1]], w, strict=True))
            total, before, word = sum(c.values()), Counter(), Counter()
            for (a, b), k in c.items():
                before[a] += k
                word[b] += k
            loss.append(sum(-log((c[a, b] + 32 * (word[b] + 1) / (total + size)) / (before[a] + 32)) for a, b in zip([None, *w[:-1]], w, strict=True)) / len(w))
        assert np.allclose([got[d]["target_loss"], got[d]["background_loss"], got[d]["score"]], [*loss, loss[0] - loss[1]], atol=1e-4)


def test_separates_a_target(spark):
    docs = spark.read.parquet(f"{fixtures.SF}/documents.parquet").withColumn("flag", F.col("lang") == "en")
    got = lm.score(docs, lm.fit(docs, "flag")).toPandas()
    right = (got.score < 0) == (got.lang == "en")
    assert right[got.n_tokens > 20].mean() > 0.97


def test_empty(spark):
    docs = fixtures.docs(spark).withColumn("flag", F.lit(None).cast("boolean"))
    none = fixtures.empty(docs)
    assert lm.score(docs, lm.fit(none, "flag")).count() == docs.count()
    assert lm.score(none, lm.fit(docs, "flag")).count() == 0


def test_no_word_is_unknown(spark):
    """Texts that differ only in rare words differ in loss, as a brute-force model of all words says; unseen words score too."""
    common = [(i, " ".join(f"w{j}" for j in range(1100)), i == 0) for i in range(2)]
    rare = [(2, "w1 rare w2", True), (3, "w1 other w2", False), (4, "w1 third w2", False), (5, "w1 third w2", None)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, flag boolean")
    model = lm.fit(docs, "flag")
    counts, starts = [Counter(), Counter()], [Counter(), Counter()]
    word, vocab = [Counter(), Counter()], set()
    for _, t, flag in common + rare:
        w, k = t.split(), 0 if flag else 1
        vocab.update(w)
        counts[k].update(zip([None, *w[:-1]], w, strict=True))
        starts[k].update([None, *w[:-1]])
        word[k].update(w)
    size = len(vocab) + 1

    def brute(t, k, own=False):
        w = t.split()
        pairs = list(zip([None, *w[:-1]], w, strict=True))
        c, s, x = (n[k] - Counter(y) if own else n[k] for n, y in ((counts, pairs), (starts, [None, *w[:-1]]), (word, w)))
        one = lambda b: (x[b] + 1) / (sum(x.values()) + size)
        return sum(-log((c[a, b] + 32 * one(b)) / (s[a] + 32)) for a, b in pairs) / len(w)

    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    for i, t, flag in common + rare:
        assert np.allclose([got[i]["target_loss"], got[i]["background_loss"]], [brute(t, 0, bool(flag)), brute(t, 1, not flag)], atol=1e-9)
    assert len({got[i]["background_loss"] for i in (2, 3, 4)}) == 3 and got[4]["score"] == got[5]["score"]
    fresh = spark.createDataFrame([(9, "w1 unseen w2"), (10, "w1 rare w2")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(fresh, model).collect()}
    for i, t in [(9, "w1 unseen w2"), (10, "w1 rare w2")]:
        assert np.allclose([got[i]["target_loss"], got[i]["background_loss"]], [brute(t, 0), brute(t, 1)], atol=1e-9)


def test_members_are_as_flags(spark):
    """Marked keys give what a flag column gives: null keys and texts, repeated keys in several chunks, unknown and repeated members."""
    docs = fixtures.clashing(fixtures.docs(spark)).drop("target").repartition(3)
    ids = [i for i in range(0, 60, 3)] + [9001, 9002, 9005, 9007, 123456789]
    members = spark.createDataFrame([(i,) for i in [*ids, None, *ids]], "doc_id long")
    flagged = docs.withColumn("flag", F.col("doc_id").isin(ids))
    small, lm.CHUNK = lm.CHUNK, 50_000
    try:
        got = lm.score(docs, lm.fit(docs, "doc_id", members=members)).toPandas()
        want = lm.score(flagged, lm.fit(flagged, "flag")).toPandas()
        fresh = [lm.score(docs.select("doc_id", "text"), m).toPandas() for m in (lm.fit(docs, "doc_id", members=members), lm.fit(flagged, "flag"))]
        none = lm.score(docs, lm.fit(docs, "doc_id", members=members.where("false")))
        assert none.where("target").isEmpty() and none.count() == docs.count()
        assert lm.score(fixtures.empty(docs), lm.fit(docs, "doc_id", members=members)).count() == 0
    finally:
        lm.CHUNK = small
    order = ["doc_id", "text"]
    got, want = got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True)
    assert got.target.tolist() == [i in ids for i in got.doc_id] and got.columns.tolist().count("target") == 1
    assert got.target.sum() > 20
    fresh = [x.sort_values(order, ignore_index=True) for x in fresh]
    for a, b in ((got, want), fresh):
        for c in ("n_tokens", "target_loss", "background_loss", "score"):
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c
