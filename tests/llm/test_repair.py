import zlib

import numpy as np

from headlight.llm import common, repair
from tests.llm import fixtures
from tests.llm.test_packing import brute_ids


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0, int), np.zeros(1, int), np.zeros(1001, int), rng.integers(0, 5, 20_000), np.tile(rng.integers(0, 49_408, 97), 200)):
        symbols, rules, lengths = repair.compress(ids)
        g = repair.Grammar(rules, lengths)
        assert (g.expand(symbols) == ids).all()
        assert len(symbols) <= len(ids)
        ends = np.cumsum(g.length[symbols])
        for _ in range(50):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert (g.range(symbols, ends, a, b) == ids[a:b]).all()
    assert len(symbols) < len(ids) / 3


def test_files_of_documents(spark):
    docs = fixtures.clashing(fixtures.docs(spark)).repartition(6)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    want, start = [], 0
    for r, ids in zip(rows, brute_ids([r["text"] for r in rows]), strict=True):
        data = np.array([*ids, 1], "<u4")
        want.append((r["doc_id"], start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    for shard in (500, 1 << 20):
        got = repair.read(spark, repair.write(docs, shard=shard)).collect()
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"])) for r in got)
    assert repair.read(spark, repair.write(fixtures.empty(docs))).count() == 0


def test_goes_on_until_no_pair_is_worth_a_rule():
    rng = np.random.default_rng(6)
    for ids in (rng.zipf(1.3, 200_000) % 3_000, np.tile(rng.integers(0, 49_408, 97), 200), np.repeat(rng.integers(0, 49_408, 4_000), 5)):
        symbols, rules, lengths = repair.compress(ids)
        assert (repair.Grammar(rules, lengths).expand(symbols) == ids).all()
        pairs = np.unique(symbols[:-1].astype(np.int64) << 16 | symbols[1:], return_counts=True)[1]
        assert len(rules) == repair.SYMBOLS - repair.FIRST_RULE or pairs.max(initial=0) < 4


def test_one_document_from_the_files(spark):
    docs = fixtures.docs(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    path = repair.write(docs, shard=700)
    for i in (9006, 9002, 9005, 7):
        ids = [*brute_ids([texts[i]])[0], 1]
        assert [r["ids"] for r in repair.fetch(spark, path, i).collect()] == [ids]
        for a, b in ((0, 1), (1, 3), (2, 10**9), (5, 5), (len(ids), len(ids) + 3)):
            assert [r["ids"] for r in repair.fetch(spark, path, i, a, b).collect()] == [ids[a:b]]
    assert repair.fetch(spark, path, 9007).count() == 2 and repair.fetch(spark, path, 10**12).count() == 0


def test_another_vocabulary(spark):
    from tokenizers import Tokenizer

    path = common.public_vocabulary("byte_bpe_50k.json")
    docs = fixtures.docs(spark).where("doc_id > 8000 or doc_id < 20")
    t = Tokenizer.from_file(path)
    want = sorted((r["doc_id"], zlib.crc32(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in docs.collect())
    got = repair.read(spark, repair.write(docs, path)).collect()
    assert want == sorted((r["doc_id"], r["ids_crc32"]) for r in got)
    assert not common._splits_at_words(path) and common._splits_at_words(common.public_vocabulary())


def test_a_hot_id_is_spread(spark):
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, id, null) as doc_id", "cast(id * 7919 as string) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = repair.write(docs, shard=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["n"] for r in spark.read.parquet(path).selectExpr("part", "size(doc_ids) as n").groupBy("part").sum("n").withColumnRenamed("sum(n)", "n").collect()]
    assert max(parts) < 2000 and sum(parts) == 4000
