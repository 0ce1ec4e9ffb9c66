import hashlib
import zlib

import numpy as np
import pytest

from headlight.llm import media
from tests.llm import fixtures


def test_formats_round_trip():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(x)) == x).all()
    assert (media.decode(media.encode_bmp(x)) == x).all()
    assert (media.decode(media.encode_ppm(x[:, :, 0])) == x[:, :, 0]).all()
    assert media.decode(b"P2 # c\n2 1\n# d\n255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize_is_the_mean_of_areas():
    x = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.allclose(media.area_resize(x, 3, 4), x.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(x, 4, 3).mean(), x.mean())
    up = np.repeat(np.repeat(x, 5, axis=0), 7, axis=1)
    assert np.allclose(media.area_resize(x, 5, 7), media.area_resize(up, 5, 7))


def test_stored_documents(spark):
    docs = fixtures.clashing(fixtures.docs(spark))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    for kind in ("ppm", "bmp"):
        path = media.store(docs, "doc_id", "text", kind)
        got = {}
        for r in media.digests(spark.read.parquet(path), "doc_id").collect():
            got.setdefault(r["doc_id"], []).append(r)
        for i, t in texts:
            p = t.encode()
            p += b" " * (-len(p) % 192 or (0 if p else 192))
            r = got[i][0]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
            assert len(r["feature"]) == 16 and r["media_bytes"] > r["payload_bytes"]
        assert sum(map(len, got.values())) == len(texts) and got[9007][0] == got[9007][1]
    tile = np.lib.format.read_array(__import__("io").BytesIO(bytes(spark.read.parquet(path).first()["tile"])))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8
    assert media.digests(spark.read.parquet(media.store(fixtures.empty(docs), "doc_id", "text")), "doc_id").count() == 0


def brute_means(x, height, width):
    """Area means by splitting each sample into height x width parts."""
    big = np.repeat(np.repeat(x.astype(float), height, axis=0), width, axis=1)
    return big.reshape(height, x.shape[0], width, x.shape[1]).mean(axis=(1, 3))


def test_feature_against_brute_force(spark):
    docs = fixtures.docs(spark).where("doc_id is not null and coalesce(length(text), 0) < 4000")
    got = {r["doc_id"]: r for r in media.digests(spark.read.parquet(media.store(docs, "doc_id", "text")), "doc_id").collect()}
    for r in docs.select("doc_id", "text").collect()[::7]:
        p = (r["text"] or "").encode()
        p += b" " * (-len(p) % 192 or (0 if p else 192))
        x = np.frombuffer(p, np.uint8).reshape(-1, 8, 3).astype(int)
        x = (x @ [77, 150, 29]) >> 8
        small = np.round(brute_means(x, 8, 9), 6)
        bits = "".join("1" if b > a else "0" for row in small for a, b in zip(row, row[1:]))
        assert got[r["doc_id"]]["feature"] == f"{int(bits, 2):016x}"


def test_media_that_cannot_be_decoded(spark):
    good = media.encode_bmp(np.arange(24, dtype=np.uint8).reshape(2, 4, 3))
    rows = [(1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, good[:40]), (6, b"P6 9 9 255\n123"), (7, b"P5"), (8, b"P2 1 1 255 x"), (9, b"BM"), (10, b"P1 2 2 1")]
    path = media.store(spark.createDataFrame(rows, "k int, m binary"), "k", "m", "as_is")
    stored = spark.read.parquet(path)
    assert {r["k"] for r in stored.where("tile is not null and hash is not null").collect()} == {1}
    got = {r["k"]: r for r in media.digests(stored, "k").collect()}
    assert len(got) == 10 and [k for k, r in got.items() if r["payload_sha256"]] == [1] and got[2]["media_bytes"] is None and got[4]["media_bytes"] == 6
    x = {r["k"]: r for r in media.load(stored, "k").collect()}
    assert (x[1]["height"], x[1]["width"], x[1]["depth"], bytes(x[1]["samples"])) == (2, 4, 3, bytes(range(24))) and x[6]["samples"] is None
