"""Cross-entropy difference: how much better a target model than a background model predicts each document.

Two interpolated bigram models share one vocabulary (all words of the documents they are fitted to, and one unknown word for
others), order and smoothing. Words and pairs are counted over all target documents for one model and over all others for the
other. Nothing of the models is collected: counts go by blocks of the key range, and each chunk of documents asks the blocks
for the counts of its distinct words and pairs. `size` (a model parameter, by default unset) would keep only the most frequent
words. The target is a flag column, or the rows whose key is among `members`: then only keys and chunk numbers are joined, at every
size alike, never texts, and each chunk is given its marked keys. A document that a model was fitted to is scored by it without its own counts (its copies' counts stay), so that both losses
are those of a text that the model has not seen. score = target loss - background loss per token: the lower, the closer to the target.

Null and empty texts have no tokens, null losses and score 0; a null flag or key counts as background; without target or background
documents that model is uniform over the vocabulary; repeated rows count as often as they occur; extra columns are ignored; an
empty table gives an empty result. Words and pairs are compared by 62-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headlight.llm.common import ODD, mix, most_frequent, ready, table, trim, words

STRENGTH, FLUSH = 32.0, 150_000
#: Bytes of text by chunk of documents and by block of keys.
CHUNK, BLOCK = 8 << 20, 6 << 20
#: The low two bits of a key.
PAIR, WORD, BEFORE = map(np.uint64, range(3))
START = np.uint64(0x2545F4914F6CDD1D)
ASKED = "block long, chunk long, keys binary, t binary, b binary"
TOLD = "block long, chunk long, t binary, b binary, words long, t_total long, b_total long"
FIELDS = {"n_tokens": "long", "target_loss": "double", "background_loss": "double", "score": "double"}


def _count_words(batches):
    counts: Counter = Counter()

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(words(text.as_py()))
            if len(counts) > FLUSH:
                yield emit()
                counts.clear()
    yield emit()


def vocabulary(docs: DataFrame, size: int) -> list[bytes]:
    """The size - 1 most frequent words, ties by hash."""
    ready(docs.sparkSession)
    counted = table(docs.select("text").where("text is not null").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    return sorted(bytes(r["word"]) for r in most_frequent(counted, "n", "word", size - 1).select("word").collect())


class Numbers(dict):
    """word -> number in order of appearance; with a vocabulary, all other words are the empty word."""

    def __init__(self, vocab: frozenset[bytes] | None) -> None:
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if self.vocab is not None and word and word not in self.vocab:
            return self[b""]
        self[word] = i = len(self)
        return i


def _planes(x: np.ndarray) -> bytes:
    """Little-endian bytes, all first ones first: small numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _plain(data: bytes | memoryview, kind: type | np.dtype) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(n, -1).T).reshape(-1).view(kind)


def _packed(counts: np.ndarray) -> bytes:
    """Their width in bytes, the least that holds them all, and their planes."""
    most = int(counts.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + _planes(counts.astype(kind))


def _unpacked(data: pa.Scalar) -> np.ndarray:
    view = memoryview(data.as_buffer())
    return _plain(view[1:], np.dtype(f"u{view[0]}"))


def _key(x: np.ndarray, kind: np.uint64) -> np.ndarray:
    return x & ~np.uint64(3) | kind


class Chunk:
    """Some texts as numbered words and pairs, and the sorted keys of what occurs in them."""

    def __init__(self, texts: pa.ChunkedArray, vocab: frozenset[bytes] | None) -> None:
        import xxhash

        numbers, found = Numbers(vocab), []
        for text in texts:
            w = words(text.as_py())
            found.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
        self.lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.word = np.concatenate([*found, np.zeros(0, np.int32)])
        del found
        n = self.n_words = len(numbers)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, n)
        hashes = np.append(hashes, START)
        self.before = np.concatenate((np.array([n], np.int32), self.word[:-1])) if len(self.word) else self.word
        ends = np.cumsum(self.lengths)
        self.starts = (ends - self.lengths)[self.lengths > 0]
        self.before[self.starts] = n
        codes, self.pair = np.unique(self.before.astype(np.int64) * (n + 1) + self.word, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.of = codes // (n + 1), codes % (n + 1)
        pairs = mix(mix(hashes[self.of[0]]) * np.uint64(ODD[0]) + hashes[self.of[1]])
        keys = np.concatenate([_key(pairs, PAIR), _key(mix(hashes[:n]), WORD), _key(mix(hashes), BEFORE)])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, used: np.ndarray) -> np.ndarray:
        """Of each key over the documents that are used."""
        at = np.repeat(used, self.lengths)
        n = self.n_words
        parts = [(self.pair, len(self.of[0])), (self.word, n), (self.before, n + 1)]
        return np.concatenate([np.bincount(x[at], minlength=m) for x, m in parts])[self.order].astype(np.uint32)

    def parts(self, most: int = 150_000):
        """(first text, past text) of runs of texts with about so many tokens."""
        ends = np.cumsum(self.lengths)
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
            yield i, j
            i = j

    def means(self, told: list[np.ndarray], totals: list[int], size: int, flags: np.ndarray | None, strength: float = STRENGTH) -> list[np.ndarray]:
        """Mean -log p of each text's tokens by each model: pair counts with a prior of `strength` on one-word shares; 0 without tokens.

        flags: which texts the first model counted; the second counted the others. Each text's own counts are taken off the model that has them.
        """
        n, m = self.n_words, len(self.of[0])
        out, models = [], []
        for counts, total in zip(told, totals, strict=True):
            c = np.empty(len(self.order))
            c[self.order] = counts
            pair, word, before = c[:m], c[m : m + n], c[m + n :]
            models.append((pair, word, before, total + size, -np.log((pair + strength * (word[self.of[1]] + 1.0) / (total + size)) / (before[self.of[0]] + strength))))
            out.append(np.zeros(len(self.lengths)))
        ends = np.cumsum(self.lengths)
        for i, j in self.parts():  # the arrays below are as long as a part's tokens
            a, b, lengths = int(ends[i] - self.lengths[i]), int(ends[j - 1]), self.lengths[i:j]
            if a == b:
                continue
            p, w, f = self.pair[a:b], self.word[a:b], self.before[a:b]
            text = np.repeat(np.arange(j - i), lengths)
            if flags is not None:
                own = [_own(text, x, k) for x, k in ((p, m), (w, n + 1), (f, n + 1))]
                first = np.repeat(flags[i:j], lengths)
            for k, (pair, word, before, total, known) in enumerate(models):
                losses = known[p]
                if flags is not None and (at := np.flatnonzero(first if k == 0 else ~first)).size:
                    less = total - lengths[text[at]]
                    one = (word[w[at]] - own[1][at] + 1.0) / less
                    losses[at] = -np.log((pair[p[at]] - own[0][at] + strength * one) / (before[f[at]] - own[2][at] + strength))
                out[k][i:j] = np.bincount(text, losses, j - i) / np.maximum(1, lengths)
        return out


def _own(text: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """How often each x occurs in its own text."""
    _, at, n = np.unique(text * most + x, return_inverse=True, return_counts=True)
    return n[at]


class Model(NamedTuple):
    vocab: list[bytes] | None
    docs: DataFrame
    target: str
    size: int | None
    members: DataFrame | None


def fit(docs: DataFrame, target: str, size: int | None = None, members: DataFrame | None = None) -> Model:
    """docs: text and the flag column `target`; with members, `target` is a key column of both and members' keys are the target.

    Counts are made when texts are scored, by all executors.
    """
    return Model(None if size is None else vocabulary(docs, size), docs, target, size, members)


def _marks(chunked: DataFrame, model: Model) -> DataFrame | None:
    """The target's keys in each chunk, at most one for each of its rows; a key whose rows are in many chunks is once in each."""
    if model.members is None:
        return None
    key = F.col(f"`{model.target}`")
    keys = chunked.select("headlight_chunk", key.alias("key")).distinct().join(model.members.select(key.alias("key")).distinct(), "key", "left_semi")
    return table(keys.groupBy(F.col("headlight_chunk").alias("chunk")).agg(F.collect_list("key").alias("marked")))


def _flags(values: pa.ChunkedArray, marks: pa.Table | None) -> np.ndarray:
    """Which rows are the target's: those with a true flag, or with a marked key."""
    if marks is None:
        return np.array([x is True for x in values.to_pylist()], bool)
    return np.array(pc.is_in(values, value_set=pc.list_flatten(marks.column("marked")).combine_chunks()).to_pylist(), bool)


def _asked(docs: DataFrame, bits: int, vocab, model: Model | None, marks: DataFrame | None, asks: bool) -> DataFrame:
    """The distinct keys of each chunk by block: with counts if there is a model, and with the chunk if it asks for them."""
    counts = model is not None

    def run(key, group, marked=None):
        trim()
        chunk = Chunk(group.column("text"), vocab.value)
        block = (chunk.keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        t = b = None
        if counts:
            flags = _flags(group.column("target"), marked)
            t, b = chunk.counts(flags), chunk.counts(~flags)
        rows = []
        for i, j in zip(cuts, cuts[1:]):
            deltas = np.diff(chunk.keys[i:j], prepend=np.uint64(0))
            rows.append((int(block[i]), key[0].as_py() if asks else None, _planes(deltas), *(None if x is None else _packed(x[i:j]) for x in (t, b))))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.binary()] * 3, strict=True)], names=["block", "chunk", "keys", "t", "b"])

    few = docs.where("text is not null").select("headlight_chunk", "text", *([] if model is None else [F.col(f"`{model.target}`").alias("target")]))
    groups = few.groupBy("headlight_chunk")
    if marks is None:
        return groups.applyInArrow(lambda key, group: run(key, group), ASKED)
    return groups.cogroup(marks.groupBy("chunk")).applyInArrow(run, ASKED)


def _tell(key, group):
    """The counts of one block's keys summed over all chunks and told to each that asks; and the block's totals."""
    trim()
    asks = group.column("chunk").to_pylist()
    keys = [np.cumsum(_plain(x.as_py(), np.uint64), dtype=np.uint64) for x in group.column("keys")]
    sizes = [len(x) for x in keys]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    at, ends = at.astype(np.int32), np.cumsum(sizes)
    del keys
    sums = np.zeros((2, len(found)), np.int64)
    for i, end in enumerate(ends):
        where = at[end - sizes[i] : end]
        for k, name in enumerate(("t", "b")):
            if (x := group.column(name)[i]).is_valid:
                sums[k, where] += _unpacked(x).astype(np.int64)  # the keys of one chunk are distinct
    counted = sums.any(axis=0) & (found & np.uint64(3) == WORD)
    block, rows = key[0].as_py(), []
    for i, end in enumerate(ends):
        if asks[i] is not None:
            where = at[end - sizes[i] : end]
            rows.append((block, asks[i], _packed(sums[0, where]), _packed(sums[1, where]), None, None, None))
    rows.append((block, None, None, None, int(counted.sum()), int(sums[0, counted].sum()), int(sums[1, counted].sum())))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TOLD.split(", ")])


def _chunked(docs: DataFrame, size: int) -> DataFrame:
    """docs with headlight_chunk, drawn by the row's values, so that a second scan gives the same chunks."""
    values = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return docs.withColumn("headlight_chunk", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in values)), F.lit(max(1, ceil(size / CHUNK)))))


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, target_loss, background_loss (per token) and score added; and the flag target, if the model has members and was fitted to docs."""
    ready(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(None if model.vocab is None else frozenset(model.vocab))
    own, n = model.docs is docs, _bytes(docs)
    n_fit = n if own else _bytes(model.docs)
    bits = max(1, ceil(log2(max(1, max(n, n_fit) / BLOCK))))
    chunked = _chunked(docs, n)
    marks = _marks(chunked, model) if own else None
    asked = _asked(chunked, bits, vocab, model if own else None, marks, True)
    if not own:
        fitted = _chunked(model.docs, n_fit)
        asked = asked.union(_asked(fitted, bits, vocab, model, _marks(fitted, model), False))
    told = table(asked.groupBy("block").applyInArrow(_tell, TOLD), "zstd")
    sums = told.agg(F.sum("words"), F.sum("t_total"), F.sum("b_total")).first()
    n_words, *totals = (x or 0 for x in sums)
    size = n_words + 1 if model.size is None else model.size

    by_key = marks is not None
    fields = {"target": "boolean"} | FIELDS if by_key else FIELDS
    flag = F.col(f"`{model.target}`") if own else F.lit(None).cast("boolean")
    rest = chunked.withColumn("headlight_target", flag).drop(*fields)
    names = [c for c in rest.columns if c not in ("headlight_chunk", "headlight_target")]

    def run(group, replies):
        trim()
        chunk = Chunk(group.column("text"), vocab.value)
        some = chunk.lengths > 0
        marked = replies.filter(pc.is_null(replies.column("block"))) if by_key else None
        replies = replies.filter(pc.is_valid(replies.column("block"))).sort_by("block")
        flags = _flags(group.column("headlight_target"), marked) if own else None
        counts = [np.concatenate([*(_unpacked(x).astype(np.int64) for x in replies.column(k)), np.zeros(0, np.int64)]) for k in ("t", "b")]
        cols = chunk.means(counts, totals, size, flags) if some.any() else [np.zeros(len(group))] * 2
        added = [pa.array(chunk.lengths), *(pa.array(x, mask=~some) for x in cols), pa.array(cols[0] - cols[1])]
        return pa.table([*(group.column(c) for c in names), *([] if marked is None else [pa.array(flags)]), *added], names=[*names, *fields])

    schema = T.StructType([*rest.select(*(f"`{c}`" for c in names)).schema.fields, *(T.StructField(k, T.DataType.fromDDL(t)) for k, t in fields.items())])
    replies = told.where("chunk is not null").select("chunk", "block", "t", "b")
    if by_key:
        replies = replies.unionByName(marks, allowMissingColumns=True)
    return rest.groupBy("headlight_chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)
