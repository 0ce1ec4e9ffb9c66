import re
import sys
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from headlight.llm import langid, quality, queries
from headlight.llm.common import most_frequent
from tests.llm import fixtures

SF = "/root/testdata/sf0.01"


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = rng.integers(0, 4, 12).astype(float)
        y = np.array([rng.integers(0, k + 1) for k in n], float)
        if not n.sum():
            continue
        out = quality.isotonic(y, n)
        assert (np.diff(out) >= -1e-12).all()
        for i in np.flatnonzero(n):  # the min-max formula
            best = max(min(y[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 12) if n[a : b + 1].sum()) for a in range(i + 1) if n[a])
            assert abs(out[i] - best) < 1e-9


def test_quality_held_out(spark):
    got = queries.op8_quality_rff(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_odd_inputs(spark):
    docs = fixtures.clashing(fixtures.docs(spark))
    feats = quality.features(docs)
    assert feats.count() == docs.count()
    for label in (None, 1, 0):
        model = quality.fit(feats.withColumn("label", F.lit(label).cast("int")))
        assert {r["score"] for r in quality.score(feats, model).collect()} == {0.5 if label is None else float(label)}
    assert quality.accept(fixtures.empty(docs), model).count() == 0
    assert quality.accept(docs, model, 0.0).columns == docs.columns


def test_language_held_out(spark):
    got = queries.op10_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    m = got[got.held_out].merge(docs, on="doc_id")
    assert (m.lang_pred == m.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd_inputs(spark):
    docs = fixtures.clashing(fixtures.docs(spark))
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9001]["score"] == 0
    assert got[9004]["lang_pred"] in model.langs
    assert langid.predict(fixtures.empty(docs), model).count() == 0
    none = langid.fit(fixtures.empty(docs))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.accept(docs, model).columns == docs.columns


def test_backoff_uses_the_longest_known_grams():
    m = langid.Model(["a", "b"], np.zeros(2), {"known": 0}, np.array([[0.0, -1.0]], np.float32), {"_xyz": 0, "q": 1}, np.array([[-3.0, 0.0], [0.0, -2.0]], np.float32))
    assert m.score("known").tolist() == [0, -1]
    assert m.score("xyzq").tolist() == [-3, 0]
    assert m.score("qq").tolist() == [0, -2]
    assert m.score("w").tolist() == [0, 0]


def test_numerals_are_no_letters():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    assert "".join(langid.letters(every)) == "".join(c for c in every.lower() if unicodedata.category(c).startswith("L"))
    assert langid.letters("½x y²z ①") == ["x", "y", "z"] and langid.letters("") == []
    m = langid.Model(["a"], np.zeros(1), {}, np.zeros((1, 1), np.float32), {}, np.zeros((1, 1), np.float32))
    assert [m.predict(x)[0] for x in ("½ ² ① Ⅷ 12 _", "½x", "ª", "二")] == ["und", "a", "a", "a"]


def test_most_frequent_is_exact_with_ties(spark):
    """Also where more rows are equally frequent than there is room for."""
    rng = np.random.default_rng(8)
    for n, high in ((1023, 2), (1024, 2), (3000, 2), (3000, 40), (500, 10**9)):
        rows = [(f"w{i}", int(c)) for i, c in enumerate(rng.integers(1, high, n))]
        df = spark.createDataFrame(rows, "item string, n long").withColumn("h", F.xxhash64("item")).cache()
        order = [r["item"] for r in df.orderBy(F.desc("n"), F.expr("shiftrightunsigned(h, 1)").asc()).collect()]
        for limit in (0, 1, 100, 1023, 5000):
            got = {r["item"] for r in most_frequent(df, "n", "item", limit).collect()}
            least = min([c for i, c in rows if i in got], default=10**12)
            assert len(got) == min(limit, n) and all(i in got for i, c in rows if c > least)
            if high == 2 and 0 < limit < n:
                assert got == set(order[:limit])


def test_language_counts_against_brute_force(spark):
    rows = [("en", "The cat the"), ("de", "die Katze, die"), ("de", "x½y"), ("fr", None), (None, "lost words"), ("fr", "le chat noir")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string").repartition(2))
    words, grams = {}, {}
    for lang, text in rows:
        for w in re.findall(r"[a-z]+", (text or "").lower()) if lang else ():
            words.setdefault(lang, Counter())[w] += 1
            grams.setdefault(lang, Counter()).update(g for k in range(1, 5) for g in langid.grams(w, k))
    assert model.langs == sorted(words) and np.allclose(np.exp(model.prior) * 4, [2, 1, 1])
    for counts, ids, table in ((words, model.words, model.word_rows), (grams, model.gram_ids, model.gram_rows)):
        items = {x for c in counts.values() for x in c}
        assert set(ids) == items
        for x in items:
            row = np.array([np.log((counts[k][x] + 0.1) / (sum(counts[k].values()) + 0.1 * len(items))) for k in model.langs])
            assert np.allclose(table[ids[x]], row - row.max(), atol=1e-5)


def test_a_small_language_keeps_its_words(spark):
    big = [("en", " ".join(f"w{i}" for i in range(300)) + " same" * 50)] * 20
    docs = spark.createDataFrame([*big, ("is", "fallegur dagur")], "lang string, text string")
    assert {"fallegur", "dagur"} <= set(langid.fit(docs, max_words=10).words)


def test_ridge_against_numpy(spark):
    """Normal equations and scores by one plain least-squares solution."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, quality.N_STATS))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    train = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], "stats array<float>, label int").repartition(4)
    model = quality.fit(train)
    x = x.astype(np.float32).astype(float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    z = model.expand(x)
    d = z.shape[1]
    want = np.linalg.lstsq(np.vstack([z, np.sqrt(1e-3 * 300 / d) * np.eye(d)]), np.concatenate([y, np.zeros(d)]), rcond=None)[0]
    assert np.allclose(model.raw(x), z @ want, atol=1e-6)
    assert (np.diff(model.knots) >= 0).all() and ((model.predict(x) >= 0.5) == y).mean() > 0.9
