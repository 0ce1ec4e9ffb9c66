"""Best-fit packing with patterns fitted by non-negative least squares.

Pieces are counted by length (a histogram of at most `size` bins, bounded whatever the input). Few-piece length patterns
that fill a sequence exactly are enumerated, repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and the residual histogram is packed best-fit decreasing, many equal sequences at a time. The plan is a list
of intervals of ranks within a length; pieces get their rank from their partition's count plus the counts before it, so no
length, however hot, is gathered in one task.

Null texts are empty: one piece with the end id only. Repeated rows are packed each; a null doc_id is kept as null; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headlight.llm.common import crc, encoded, public_vocabulary, ready, table, tokenizer

SIZE, END_ID = 2048, 0
_kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, its partition and its place among that partition's pieces of its length."""
    ready(docs.sparkSession)
    path = vocabulary or public_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, seen, part = tokenizer(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in encoded(encode, batch):
                data = text + end
                for i, at in enumerate(range(0, len(data), 4 * size)):
                    ids = data[at : at + 4 * size]
                    n = len(ids) // 4
                    rows.append((doc_id, i, at // 4, n, crc(ids), part, seen[n], *([ids] * with_ids)))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * (7 + with_ids)
            kinds, names = _kinds + [pa.binary()] * with_ids, _names + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids)


def patterns(histogram: np.ndarray, size: int, partners: int = 4) -> list[tuple[int, ...]]:
    """Length patterns of one to three pieces that fill a sequence: all pairs, and for each length the triples with its most frequent partners."""
    have = [int(x) for x in np.flatnonzero(histogram)]
    present = set(have)
    out = {(size,)} & {(x,) for x in have}
    out |= {(size - x, x) for x in have if size - x in present and x <= size - x}
    common = sorted(have, key=lambda x: (-histogram[x], x))
    for a in have:
        found = 0
        for b in common:
            c = size - a - b
            if c > 0 and c in present:
                out.add(tuple(sorted((a, b, c), reverse=True)))
                found += 1
                if found == partners:
                    break
    return sorted(out, reverse=True)


def fit_repeats(histogram: np.ndarray, found: list[tuple[int, ...]], sweeps: int = 30) -> np.ndarray:
    """Repeat counts >= 0 that minimise the squared difference to the histogram, by coordinate descent."""
    left = histogram.astype(float).tolist()
    x = [0.0] * len(found)
    use = [list(Counter(p).items()) for p in found]
    norm = [sum(n * n for _, n in u) for u in use]
    for _ in range(sweeps):
        moved = 0.0
        for j, u in enumerate(use):
            step = max(-x[j], sum(n * left[v] for v, n in u) / norm[j])
            if step:
                x[j] += step
                moved += abs(step)
                for v, n in u:
                    left[v] -= n * step
        if moved < 1e-3 * max(1.0, float(histogram.sum())):
            break
    return np.array(x)


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, past rank, sequence of the first, offset): piece of rank r goes to sequence + r - first."""
    left, used = histogram.astype(np.int64).copy(), np.zeros(size + 1, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        out.append((length, int(used[length]), int(used[length]) + n, sequence, offset))
        used[length] += n
        left[length] -= n

    found = patterns(left, size)
    for p, x in zip(found, fit_repeats(left, found), strict=True):
        need = Counter(p)
        n = min(int(x), *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            at = 0
            for v in p:
                take(v, n, sequences, at)
                at += v
            sequences += n
    # Best fit decreasing over groups of equally filled sequences: room -> [(first sequence, how many)].
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        room = length
        while left[length]:
            while room <= size and not rooms[room]:
                room += 1
            if room > size:
                fits = size // length
                n = -(-int(left[length]) // fits)
                rooms[size].append((sequences, n))
                sequences += n
                room = size
            first, n = rooms[room].pop()
            k = min(n, -(-int(left[length]) // (room // length)))
            if k < n:
                rooms[room].append((first + k, n - k))
            take(length, k, first, size - room)
            rooms[room - length].append((first, k))
            room = length if room - length >= length else room
    return out


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset."""
    spark = docs.sparkSession
    found = table(pieces(docs, size, vocabulary, end_id, with_ids))
    per_part = table(found.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(size + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    intervals = np.array(plan(histogram, size) or np.zeros((0, 5)), np.int64)
    intervals = intervals[np.lexsort((intervals[:, 1], intervals[:, 0]))]
    shared = spark.sparkContext.broadcast((intervals, intervals[:, 0] * (1 << 48) + intervals[:, 1]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    before = table(before.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before")))
    # At most one row per partition of `pieces`, each of at most `size` entries.
    ranked = found.join(F.broadcast(before), "part") if per_part.count() <= 1_000_000 else found.join(before, "part")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)]
    ranked = ranked.select(*keep, (F.col("place") + F.col("before")[F.col("length")]).alias("rank"))

    def assign(batches):
        table_, keys = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(k))) for k in ("length", "rank"))
            row = table_[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1] if len(rank) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long")
