import base64
import hashlib
import io

from pyspark.sql import functions as F

from headlight.llm import warc
from tests.llm import fixtures

#: The fields of WARC/1.1 that a record here may have.
FIELDS = ["WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Profile"]
SCHEMA = "page_id long, url string, html string"
PAGES = [(5, "http://a/ä b", "same"), (3, "http://b/", "same"), (4, None, "same"), (1, "http://c/", None), (2, "http://d/", ""), (None, "http://e/", "same"), (7, "u", "z" * 1000), (8, "u", "WARC/1.1\r\n\r\nx" * 3), (3, "http://b/", "same")]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_records_and_revisits(spark, monkeypatch):
    pages = fixtures.clashing(spark.createDataFrame(PAGES, SCHEMA)).repartition(3)
    for chunk in (7, 100, 65536):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", 0 if chunk == 100 else 100_000)
        path = warc.write(pages, chunk=chunk)
        got = warc.read(spark, path).collect()
        assert len(got) == len(PAGES) and all(r["valid"] for r in got)
        want = []
        for i, _, t in PAGES:
            same = [j for j, _, u in PAGES if (u or "") == (t or "") and j is not None]
            revisit = i is not None and min(same) != i
            want.append((i, len((t or "").encode()), sha(t), "revisit" if revisit else "response", min(same) if revisit else None))
        assert sorted(map(str, want)) == sorted(str(tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in got)
        payloads = {}
        for a in {r["archive"] for r in got}:
            for head, n, digest in warc.parse(io.BytesIO(b"".join(warc.export(spark, path, a)))):
                if head["WARC-Type"] == "response":
                    assert head["WARC-Payload-Digest"] == f"sha1:{digest}"
                else:
                    assert n == 0 and {"WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Profile"} <= set(head)
                assert head["WARC-Target-URI"] and not any(k.startswith("WARC-") and k not in FIELDS for k in head)
                payloads[head["WARC-Record-ID"]] = n
        assert len(payloads) == len(PAGES)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    got = warc.read(spark, warc.write(pages, least=5)).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_records_cut_by_splits_are_whole(spark):
    pages = spark.createDataFrame([(i, "u", f"{i}" * 5000) for i in range(40)], SCHEMA).repartition(1)
    path = warc.write(pages, chunk=64)
    rows = spark.read.schema(warc.CHUNKS).parquet(path)
    cut = warc.scratch(spark)  # the same rows in many files, cut anywhere
    rows.withColumn("f", F.col("record") * 1000 + F.col("chunk")).repartitionByRange(7, "f").sortWithinPartitions("f").drop("f").write.parquet(cut)
    got = warc.read(spark, cut).collect()
    assert len(got) == 40 and all(r["valid"] for r in got)
    assert {r["payload_digest"] for r in got} == {sha(f"{i}" * 5000) for i in range(40)}


def test_empty_and_damaged(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    assert warc.read(spark, warc.write(fixtures.empty(pages))).count() == 0
    bad = warc.scratch(spark)
    rows = spark.read.schema(warc.CHUNKS).parquet(warc.write(pages.where("page_id = 7"), chunk=100))
    rows.withColumn("bytes", F.when(F.col("chunk") == 3, F.lit(b"y" * 100)).otherwise(F.col("bytes"))).coalesce(1).sortWithinPartitions("record", "chunk").write.parquet(bad)
    assert [r["valid"] for r in warc.read(spark, bad).collect()] == [False]
