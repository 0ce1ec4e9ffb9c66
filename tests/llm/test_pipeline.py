import corpus_pipeline
from headlight.llm import decontam, jaccard, langid, quality
from headlight.llm.common import remainder
from pyspark.sql import functions as F
from tests.llm import fixtures, test_decontam, test_jaccard


def test_stages_against_brute_force(spark):
    """Each stage keeps whole rows of its input; near copies and passages go as a brute-force version says."""
    docs = spark.read.parquet(f"{fixtures.SF}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    assert len(named) == 5
    kept, before = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, fixtures.SF).cache()
        assert kept.columns == docs.columns and kept.schema == docs.schema
        assert kept.exceptAll(before).isEmpty() and 0 < kept.count() <= before.count()
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        if name == "n-gram Jaccard join":
            assert ids == {int(x.split(",")[0][1:]) for x in test_jaccard.brute(rows) if x.split(", ")[0][1:] == x.split(", ")[2][:-1]}
        if name == "benchmark decontamination":
            items = {r["item_id"]: " ".join(w[0] for w in test_decontam.brute_words(r["text"])[1:]) for r in spark.read.parquet(f"{fixtures.SF}/benchmark.parquet").collect()}
            held = {d for d, t in rows if any(i in " ".join(w[0] for w in test_decontam.brute_words(t)) for i in items.values())}
            assert held and ids == {d for d, _ in rows} - held
    packed = corpus_pipeline.run(spark, fixtures.SF).collect()
    assert {r["doc_id"] for r in packed} == ids and max(r["offset"] + r["length"] for r in packed) <= 2048


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = docs.join(labels, "doc_id").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.keep_quality(spark, docs, sf).select("doc_id")
    assert good.exceptAll(kept.join(good, "doc_id")).count() <= 0.01 * good.count()
    bad = docs.join(labels, "doc_id").where("quality = 0").select("doc_id")
    assert bad.join(kept, "doc_id").count() <= 0.1 * bad.count()
    assert corpus_pipeline.keep_language(spark, docs, sf).count() >= 0.99 * docs.count()


def test_odd_rows(spark):
    docs = fixtures.docs(spark)
    assert {r["doc_id"] for r in jaccard.accept(docs).collect()} >= {9001, 9002, 9003, 9004, None}
    assert jaccard.accept(docs).where("doc_id = 9007").count() == 1
    assert jaccard.accept(fixtures.empty(docs)).count() == 0
    assert decontam.accept(docs, spark.read.parquet(f"{fixtures.SF}/benchmark.parquet")).columns == docs.columns
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    assert {r["doc_id"] for r in langid.accept(docs, model).collect()}.isdisjoint({9001, 9002, 9003})
    assert quality.accept(docs, quality.fit(quality.features(docs).withColumn("label", F.lit(1)))).count() == docs.count()


def test_null_and_repeated_ids_are_decided_by_row(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, text("a")), (None, text("a")), (None, text("b")), (7, text("a")), (7, text("c")), (7, text("d")), (7, text("d") + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"].removesuffix(" end")) for r in jaccard.accept(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, text("a")), (None, text("b")), (7, text("c")), (7, text("d"))]))
    item = spark.read.parquet(f"{fixtures.SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, item), (None, text("b")), (7, item), (7, text("c"))], "doc_id long, text string")
    kept = decontam.accept(docs, spark.read.parquet(f"{fixtures.SF}/benchmark.parquet")).collect()
    assert sorted(r["text"] for r in kept) == [text("b"), text("c")]
