"""Shared helpers of the training-data operators: scratch tables, word and shingle scanning, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
import tempfile
import uuid
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

ROOT = str(Path(__file__).resolve().parents[2])


BATCH_ROWS = 2000


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver was not started in its folder, and bounds their batches for the session."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    # Whole texts go to Python in batches: fewer rows than Spark's default of 10,000 keep executors' memory low.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all nodes share; a temporary folder only where that is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        base = "file://" + tempfile.mkdtemp(prefix="headlight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/headlight-{uuid.uuid4().hex}"


def table(df: DataFrame, compression: str = "lz4") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.headlight_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what table() wrote; nothing may be computed from it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.headlight_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of up to this many rows of a few numbers each are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 300_000


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; df should be cheap to count."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


DIGIT = 12


def most_frequent(df: DataFrame, column: str, item: str, limit: int) -> DataFrame:
    """The `limit` rows of df (or all) with the largest whole `column` of at least 1, ties by the item's 64-bit hash.

    The boundary is found by radix descent: each pass counts at most 4,096 bins of the digits that follow the boundary's.
    Rows that are equal in count and hash stay or go together, so that at most `limit` rows stay.
    """
    if limit < 1:
        return df.where("false")
    rows = df.where(F.col(column) >= 1)
    top = rows.agg(F.max(column)).first()[0]
    if top is None:
        return rows
    count, hashed = F.col(column).cast("long"), F.xxhash64(item)
    kept, inside, room = F.lit(False), F.lit(True), limit
    # First the digits of the count, the largest first, then those of the hash, the smallest first.
    for key, bits, largest in ((count, int(top).bit_length(), True), (hashed, 64, False)):
        while bits:
            bits = max(0, bits - DIGIT)
            digit = F.shiftrightunsigned(key, bits)
            bins = rows.where(inside).groupBy(digit.alias("d")).count().collect()
            edge = None
            for d, n in sorted(map(tuple, bins), reverse=largest):
                if n > room:
                    edge = d
                    break
                room -= n
            if edge is None:
                return rows.where(kept | inside)
            kept = kept | inside & (digit > F.lit(edge) if largest else digit < F.lit(edge))
            inside = inside & (digit == F.lit(edge))
    return rows.where(kept)


def trim() -> None:
    """Gives memory that an earlier stage left in this reused Python worker back to the system; some milliseconds, once a partition."""
    _words.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def annotate(docs: DataFrame, column: str, fields: dict[str, pa.DataType], of) -> DataFrame:
    """docs with columns added: of(list of values) gives one sequence per field. Fields replace columns of their names."""
    ready(docs.sparkSession)
    docs = docs.drop(*fields)
    at = docs.columns.index(column)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, from_arrow_type(t)) for k, t in fields.items())])

    def run(batches):
        trim()
        for batch in batches:
            added = of(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(added, fields.values(), strict=True))], names=[*batch.schema.names, *fields])

    return docs.mapInArrow(run, schema)


# ---- words and shingles -------------------------------------------------------------------------------------------

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    BOUND = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = WordHashes()


def words(text: str | None) -> list[bytes]:
    """ASCII lower-cased words; only bytes 32 and 9 to 13 separate them."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle; no words, none."""
    found = words(text)
    n = len(found)
    if _tokenizers:
        _tokenizers.clear()
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, n)
    if n < k:
        out = np.full(1, n, np.uint64)
        for i in range(n):
            out = mix(out * np.uint64(ODD[0]) ^ h[i : i + 1])
        return out
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(ODD[i % 5]) + h[i : n - k + 1 + i])
    return np.unique(total)


# ---- tokenizer ----------------------------------------------------------------------------------------------------

_tokenizers: dict[str, "WordTokenizer"] = {}


#: Byte-level vocabularies write bytes that are no visible character as the characters from 256 on, in order.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


#: ASCII marks that end a run of letters; not the apostrophe, which may begin a piece with letters.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


#: The normalizers and the split pattern of the vocabulary whose texts may be encoded word by word.
BY_WORD = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_at_words(path: str) -> bool:
    """Whether a vocabulary file normalises and splits as WordTokenizer takes for granted."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    normal, split = ((found[k] or {}).get(v) or [{}] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    return (
        ([x.get("type") for x in normal], split[0].get("pattern", {}).get("Regex")) == BY_WORD
        and [x.get("type") for x in split] == ["Split", "ByteLevel"]
        and all(x["content"].startswith("<|") for x in found["added_tokens"])
        and found["model"].get("end_of_word_suffix") == "</w>"
    )


class WordTokenizer(dict):
    """ids of a text as little-endian unsigned 32-bit bytes.

    A vocabulary that is lower case, whose pre-tokenizer never joins across ASCII white space and whose normalizer has no context
    there (`_splits_at_words` reads its file) gives a text its lower-cased words' ids in order; words are remembered up to a bound.
    Words of Latin-1 letters go straight to the BPE model, letters with marks behind them are two such parts, others go through the
    whole tokenizer; so does a text that may hold a special token, and every text with any other vocabulary.
    """

    BOUND = 600_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = _splits_at_words(path)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.BOUND:
            self.clear()
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            plain = stem.decode()
        elif (plain := stem.decode()).isalpha() and max(plain) <= "\xff":
            plain = plain.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
        else:
            plain = ""
        if not plain:
            ids = self._ids(word.decode())
        elif len(stem) < len(word):
            ids = self[stem] + self[word[len(stem) :]]
        else:
            ids = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        self[word] = ids
        return ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or "<|" in text:
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.encode().lower().split()))


def tokenizer(path: str) -> WordTokenizer:
    if _words or path not in _tokenizers:
        trim()  # a reused worker holds one kind of word memory at a time
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def encoded(tok: WordTokenizer, batch: pa.RecordBatch):
    """(first column, ids as bytes) of each row."""
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield key, tok(text.as_py())


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


# ---- connected components -----------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b); ids without an edge are not in the result.

    Smallest-label spreading with pointer jumping. Each round is written to the shared folder and moves one label per
    edge, aggregated before the shuffle; both sides of each join are written tables, so hot ids can be split.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).where("id is not null and other is not null and id <> other")
    both = table(both.union(both.select(F.col("other"), F.col("id"))).distinct())
    labels = last = table(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("m"))
        near = table(labels.join(near, "id").select("id", F.least("component", "m").alias("m"), F.col("component").alias("old")))
        up = near.select(F.col("id").alias("m"), F.col("m").alias("top"))
        drop(last)
        last = table(near.join(up, "m").select("id", F.least("m", "top").alias("component"), (F.least("m", "top") < F.col("old")).alias("moved")))
        drop(near)
        labels = last.select("id", "component")
        if last.where("moved").isEmpty():
            drop(both)
            return labels
    raise RuntimeError("components did not settle; raise rounds")
