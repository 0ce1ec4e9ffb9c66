"""Token-ID files by Re-Pair grammar compression.

Documents in ascending id order are encoded into shards of about `shard` ids. In each shard, frequent adjacent id pairs
are replaced by nonterminals again and again; a shard stores its rules, their expansion lengths and its symbols, so that any
range of ids can be decoded without the rest (`fetch`). A pair is chosen with its exact count in the shard; each pass replaces the
most frequent pairs together, left to right, until no pair is worth a rule or rule numbers run out. Symbols end at 65,535, so with a
vocabulary of 49,408 ids a shard has at most 16,128 rules; a vocabulary of 65,536 ids or more raises an error.

A null text is empty (its end id only); null ids come first; repeated ids are written each, in the order of a hash of their texts,
so that a hot id is spread over tasks; a document longer than a shard makes a longer shard; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headlight.llm.common import crc, encoded, public_vocabulary, ready, scratch, table, tokenizer

END_ID, FIRST_RULE, SYMBOLS = 1, 49_408, 65_536
SHARD = 1 << 20
#: low and high: the least and the greatest id that is not null; first: the number of the first rule.
FILE = "part int, shard int, low long, high long, first int, doc_ids array<long>, lengths array<int>, rules binary, expansion binary, symbols binary"


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint32(2654435761)) >> np.uint32(14)


def _frequent(keys: np.ndarray, slots: np.ndarray, least: int, most: int) -> np.ndarray:
    """The most frequent pairs as 32-bit keys, ascending."""
    found = np.sort(keys[(np.bincount(slots, minlength=1 << 18) >= least)[slots]])
    cuts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    counts = np.diff(np.append(cuts, len(found)))
    big = counts >= least
    found, counts = found[cuts[big]], counts[big]
    if len(found) > most:
        found = np.sort(found[np.argsort(-counts, kind="stable")[:most]])
    return found


def compress(ids: np.ndarray, least: int = 4, first: int = FIRST_RULE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (below `first`) to (symbols, rules as pairs, expansion length of each rule).

    Goes on until no pair occurs `least` times or rule numbers run out: a rule takes 8 bytes, each use saves 2.
    """
    seq = ids.astype(np.uint16)
    rules = np.zeros((0, 2), np.uint16)
    lengths = np.zeros(0, np.int64)
    while len(seq) > 1 and (room := SYMBOLS - first - len(rules)) > 0:
        keys = seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:]
        slots = _slot(keys)
        found = _frequent(keys, slots, least, room * 2 // 3 if room > 1024 else room)
        if not len(found):
            break
        slot = np.full(1 << 18, -1, np.int32)  # of two pairs in one slot the other waits for a later pass
        slot[_slot(found)] = np.arange(len(found), dtype=np.int32)
        rank = slot[slots]
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        same = found[rank] == keys[at]
        at, rank = at[same], rank[same]
        # Of a run of overlapping pairs every second one counts, from its first.
        near = np.flatnonzero(np.diff(at) == 1) + 1
        if len(near):
            run = np.concatenate(([True], np.diff(near) > 1))  # where runs of places that follow another begin
            begins = near[run] - 1
            step = near - np.repeat(begins, np.diff(np.append(np.flatnonzero(run), len(near))))
            keep = np.ones(len(at), bool)
            keep[near[step & 1 == 1]] = False
            at, rank = at[keep], rank[keep]
        is_used = np.bincount(rank, minlength=len(found)) > 0
        used = np.flatnonzero(is_used)
        number = (np.cumsum(is_used) - 1 + first + len(rules)).astype(np.uint16)
        pairs = np.stack([found[used] >> np.uint32(16), found[used] & np.uint32(0xFFFF)], axis=1)
        size = np.concatenate([np.ones(first, np.int64), lengths])
        seq[at] = number[rank]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        lengths = np.concatenate([lengths, size[pairs].sum(axis=1)])
        rules = np.concatenate([rules, pairs.astype(np.uint16)])
    return seq, rules, lengths


class Grammar:
    """Expands symbols; rules only refer to rules before them."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first: int = FIRST_RULE) -> None:
        self.first, self.length = first, np.concatenate([np.ones(first, np.int64), lengths])
        self.start = np.concatenate([np.arange(first, dtype=np.int64), first + np.cumsum(lengths) - lengths])
        self.flat = np.empty(first + int(lengths.sum()), np.uint16)
        self.flat[:first] = np.arange(first)
        done, last = 0, rules.max(axis=1).astype(np.int64) if len(rules) else np.zeros(0, np.int64)
        while done < len(rules):  # all rules that refer to finished ones alone, which are those of one pass at least
            open_ = np.flatnonzero(last[done:] >= first + done)
            until = done + int(open_[0]) if len(open_) else len(rules)
            at = int(self.start[first + done])
            out = self.expand(rules[done:until].reshape(-1))
            self.flat[at : at + len(out)] = out
            done = until

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[symbols] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def range(self, symbols: np.ndarray, ends: np.ndarray, start: int, stop: int) -> np.ndarray:
        """ids start to stop of the sequence; ends: running sums of the symbols' lengths. Only symbols in reach are expanded."""
        if stop <= start:
            return np.zeros(0, np.uint16)
        i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        skip = start - (int(ends[i - 1]) if i else 0)
        return self.expand(symbols[i : j + 1])[skip : skip + stop - start]


def _grammar(first: int, rules: bytes, lengths: bytes) -> Grammar:
    return Grammar(np.frombuffer(rules, "<u2").reshape(-1, 2), np.frombuffer(lengths, "<u4").astype(np.int64), first)


def write(docs: DataFrame, vocabulary: str | None = None, path: str | None = None, end_id: int = END_ID, shard: int = SHARD) -> str:
    """Writes the files of all documents in ascending doc_id order and returns their folder."""
    spark = docs.sparkSession
    ready(spark)
    path, names = path or scratch(spark), vocabulary or public_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def row(part: int, number: int, first: int, ids: list, sizes: list[int], data: list[bytes]) -> pa.RecordBatch:
        symbols, rules, lengths = compress(np.frombuffer(b"".join(data), "<u4"), first=first)
        some = [x for x in ids if x is not None]
        values = [part, number, min(some, default=None), max(some, default=None), first, ids, sizes, rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in FILE.split(", ")])

    def run(batches):
        encode, part, number, total = tokenizer(names), TaskContext.get().partitionId(), 0, 0
        ids, sizes, data = [], [], []
        first = max(end_id + 1, encode.tokenizer.get_vocab_size())
        if first >= SYMBOLS:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        for batch in batches:
            for doc_id, text in encoded(encode, batch):
                x = text + end
                ids.append(doc_id)
                sizes.append(len(x) // 4)
                data.append(x)
                total += len(x) // 4
                if total >= shard:
                    yield row(part, number, first, ids, sizes, data)
                    number, total, ids, sizes, data = number + 1, 0, [], [], []
        if ids:
            yield row(part, number, first, ids, sizes, data)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, FILE).write.option("compression", "zstd").option("parquet.page.size.row.check.min", "1").option("parquet.block.size.row.check.min", "1").parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    ready(spark)
    files = spark.read.schema(FILE).parquet(path).drop("low", "high")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                part, number, first, ids, sizes, rules, lengths, symbols = (batch.column(i)[r].as_py() for i in range(8))
                grammar = _grammar(first, rules, lengths)
                out = grammar.expand(np.frombuffer(symbols, "<u2")).astype("<u4").tobytes()
                ends = np.cumsum(np.array(sizes, np.int64)) * 4
                starts = ends - np.array(sizes, np.int64) * 4
                sums = [crc(out[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([part] * n, pa.int32()), ([number] * n, pa.int32()), (ids, pa.int64()), (starts // 4, pa.int64()), (sizes, pa.int64()), (sums, pa.int64()))], names=["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = table(files.mapInArrow(run, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long"))
    # Totals: of parts (one row each), and of the shards before one in its part.
    shards = found.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = table(shards.withColumn("inside", F.coalesce(inside, F.lit(0))))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    outside = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outside"))
    base = shards.join(outside, "part").select("part", "shard", (F.col("inside") + F.col("outside")).alias("base"))
    return found.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_id: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id and ids (its ids from start to stop, the end id among them) of each document with this id.

    Only row groups whose ids may hold it are read, and only symbols in reach are expanded.
    """
    ready(spark)
    files = spark.read.schema(FILE).parquet(path).where((F.col("low") <= doc_id) & (F.col("high") >= doc_id))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                first, ids, sizes, rules, lengths, symbols = (batch.column(i)[r].as_py() for i in range(6))
                if doc_id not in ids:
                    continue
                grammar, packed = _grammar(first, rules, lengths), np.frombuffer(symbols, "<u2")
                reach, ends = np.cumsum(grammar.length[packed]), np.cumsum(sizes)
                found = []
                for i in (i for i, x in enumerate(ids) if x == doc_id):
                    low = int(ends[i]) - sizes[i]
                    found.append(grammar.range(packed, reach, low + min(start, sizes[i]), low + min(sizes[i] if stop is None else stop, sizes[i])).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return files.select("first", "doc_ids", "lengths", "rules", "expansion", "symbols").mapInArrow(run, "doc_id long, ids array<int>")
