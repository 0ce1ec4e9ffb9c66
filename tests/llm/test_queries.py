"""The registered queries on whole small tables against plain Python."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from headlight.llm import lm, queries
from tests.llm import fixtures, test_decontam, test_jaccard, test_urlfilter, test_warc
from tests.llm.test_packing import brute_ids

SF = fixtures.SF


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_query_of_warc(spark):
    pages = table(spark, "pages", "page_id", "html")
    first = {}
    for i, t in pages:
        first[t or ""] = min(i, first.get(t or "", i))
    want = [(i, len((t or "").encode()), test_warc.sha(t), "response" if first[t or ""] == i else "revisit", None if first[t or ""] == i else first[t or ""]) for i, t in pages]
    got = queries.op1_warc_chunks(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_query_of_templates(spark):
    docs, items = table(spark, "documents", "doc_id", "text"), table(spark, "benchmark", "item_id", "text")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_benchmark_templates(spark, SF).collect()}
    bare = lambda t: " ".join(x[2] for x in test_decontam.brute_words(t or ""))
    texts = [(d, bare(t)) for d, t in docs]
    whole = {(d, i) for i, b in items for d, t in texts if f" {bare(b)} " in f" {t} "}
    assert whole and whole <= got


def test_query_of_language_models_join_labels(spark):
    good = {d for d, q in table(spark, "labels", "doc_id", "quality") if q == 1}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("flag", F.col("doc_id").isin(sorted(good)))
    want = {r["doc_id"]: r for r in lm.score(docs, lm.fit(docs, "flag")).collect()}
    got = queries.op3_lm_difference(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert r["target"] == w["flag"] and r["n_tokens"] == w["n_tokens"] and np.isclose(r["score"], w["score"])


def test_query_of_urls(spark):
    want = [(i, *test_urlfilter.brute(u, queries.RULES)) for i, u in table(spark, "pages", "page_id", "url")]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op4_url_filters(spark, SF).collect())


def test_query_of_jaccard_components(spark):
    got = queries.op5_ngram_jaccard(spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == test_jaccard.brute(table(spark, "documents", "doc_id", "text"))


def test_query_of_media(spark):
    got = {r["doc_id"]: r for r in queries.op6_media_columns(spark, SF).collect()}
    docs = table(spark, "documents", "doc_id", "text")
    assert len(got) == len(docs)
    for i, t in docs:
        p = (t or "").encode()
        n, p = len(p), p + b" " * (max(1, -(-len(p) // 192)) * 192 - len(p))
        media = b"P6\n8 %d\n255\n" % (len(p) // 24) + p
        want = n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest()
        assert tuple(got[i][k] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want


def test_query_of_packing_and_ids(spark):
    docs = sorted(table(spark, "documents", "doc_id", "text"))
    encoded = brute_ids([t for _, t in docs])
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want, start = [], 0
    for (d, _), ids in zip(docs, encoded, strict=True):
        want.append((d, start, len(ids) + 1, crc([*ids, 1])))
        start += len(ids) + 1
    assert want == sorted(tuple(r) for r in queries.op9_repair_ids(spark, SF).collect())
    want = [(d, i // 2048, i, len(x[i : i + 2048]), crc(x[i : i + 2048])) for (d, _), ids in zip(docs, encoded, strict=True) for x in [[*ids, 0]] for i in range(0, len(x), 2048)]
    got = queries.op7_pattern_packing(spark, SF).collect()
    assert sorted(want) == sorted(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for x in map(sorted, places.values()):
        assert x[0][0] == 0 and x[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(x, x[1:]))
