"""N-gram Jaccard join by vertical partitioning.

Documents with equal shingle sets form one class. Shingles have a global order: by the number of classes that hold them,
then by hash. The hash range is cut into blocks of about a million entries to count shingles; what occurs in one class only
is dropped there. The order is cut into fragments; a candidate pair's overlap is counted fragment by fragment and summed.

Candidates come from prefixes: classes A and B, |A| <= |B|, with Jaccard >= t share one of A's first |A| - ceil(2t/(1+t)|A|) + 1
and one of B's first |B| - ceil(t|B|) + 1 shingles. A class with fewer than t|A| shared shingles has no partner. So that a
large group of near copies does not make all its pairs, some rounds first compare each class with one member per shingle;
after them the join pairs only classes that are not yet connected, all of them, so no connection is lost.

Each class carries the parities of its shared shingles by 1,024 places of their hashes. The places where two classes differ are at
most the shingles they differ in, so most pairs that share much but too little (pages of the same blocks, say) are turned down within
the join, before any pair is written or verified. A shingle of many classes is dealt to several tasks (`FEW` members each).

The most frequent shingles (at most HOT, a bounded broadcast list) do not go through the blocks, so that no block holds
more than its share; they stay part of the order, of prefixes and of overlaps.

Null and empty texts and texts without words have an empty set, link with nothing, and are their own component; null ids keep
their row, with the smallest other id of the component, or null; repeated rows are copies of one another; rows that share an id
but not a text are documents of their own. Extra columns are ignored; an empty table gives an empty result. Shingles are compared
by 64-bit hashes; classes by 64 bits, with 64 more to detect a clash and avoid it by another seed (eight clashes in a row raise).
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headlight.llm.common import annotate, components, drop, most_frequent, ready, shingles, small, table, trim

SEEDS = 8
HOT, HOT_LEAST, FLUSH, BLOCK = 100_000, 64, 1_000_000, 1_000_000
#: Fragments of the order: up to which number of classes a shingle belongs to each.
EDGES = np.array([2, 4, 16, 128, 2**31 - 2])
HOT_COUNT = 2**31 - 1
PLACES, FEW = 1024, 2048
SKETCH = "doc_id long, n long, sig long, proof long, hot array<long>, hot_n array<int>"
_sketch_kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _signature(found: np.ndarray, seed: int) -> tuple[int, int]:
    import xxhash

    x = xxhash.xxh3_128_intdigest(found.tobytes(), seed=seed)
    return x & (2**64 - 1), x >> 64


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _batch(kinds: list, names: str, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in names.split(", ")])


def sketch(docs: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """A row per document, and rows without n for shingles that are frequent within some flush of a partition."""

    def run(batches):
        trim()
        held: dict[int, np.ndarray] = {}
        size = 0

        def frequent() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate([*held.values(), np.empty(0, np.uint64)]), return_counts=True)
            big = counts >= 3
            return _batch(_sketch_kinds, SKETCH, [(None, None, None, None, found[big].view(np.int64), counts[big].astype(np.int32))])

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py(), k)
                sig, proof = _signature(found, seed)
                rows.append((doc_id, len(found), _signed(sig), _signed(proof), None, None))
                if sig not in held:
                    held[sig] = found
                    size += len(found)
                    if size > FLUSH:
                        yield frequent()
                        held.clear()
                        size = 0
            yield _batch(_sketch_kinds, SKETCH, rows)
        yield frequent()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of sorted 64-bit values by significance, which compress better."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


BLOCKS = "block int, sigs binary, at binary, toks binary"
_block_kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _entries(sigs: np.ndarray, at: np.ndarray, toks: np.ndarray, blocks: np.ndarray, sign: int) -> list[tuple]:
    """Rows of entries (toks[i] in sigs[at[i]]) by block; blocks is ascending."""
    out = []
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
        if b > a:
            used, inner = np.unique(at[a:b], return_inverse=True)
            out.append((int(blocks[a]) if sign > 0 else -1 - int(blocks[a]), sigs[used].tobytes(), inner.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), _planes(toks[a:b])))
    return out


def block_entries(docs: DataFrame, bits: int, hot, k: int, seed: int) -> DataFrame:
    """(block, entries) of each class once per flush; entries of hot shingles go by class, to negative blocks."""

    def run(batches):
        trim()
        held: dict[int, np.ndarray] = {}
        size, shift = 0, np.uint64(64 - bits)

        def rows() -> pa.RecordBatch:
            sigs = np.fromiter(held.keys(), np.uint64, len(held))
            toks = np.concatenate([*held.values(), np.empty(0, np.uint64)])
            at = np.repeat(np.arange(len(held)), [len(x) for x in held.values()])
            listed = hot.value
            is_hot = listed[np.minimum(np.searchsorted(listed, toks), len(listed) - 1)] == toks if len(listed) else np.zeros(len(toks), bool)
            order = np.argsort(toks[~is_hot])
            cold, at_cold = toks[~is_hot][order], at[~is_hot][order]
            out = _entries(sigs, at_cold, cold, cold >> shift, 1)
            order = np.argsort(sigs[at[is_hot]], kind="stable")
            warm, at_warm = toks[is_hot][order], at[is_hot][order]
            return _batch(_block_kinds, BLOCKS, out + _entries(sigs, at_warm, warm, sigs[at_warm] >> shift, -1))

        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), k)
                sig = _signature(found, seed)[0]
                if len(found) and sig not in held:
                    held[sig] = found
                    size += len(found)
                    if size > FLUSH:
                        yield rows()
                        held.clear()
                        size = 0
        yield rows()

    return docs.select("text").mapInArrow(run, BLOCKS)


SHARED = "bucket int, sigs binary, counts binary, toks binary, dfs binary"
_shared_kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _count(bits: int):
    """Of one block: the entries of shingles that several classes have, by bucket of their class."""

    def run(block: pa.Table) -> pa.Table:
        sigs, toks = [], []
        for s, a, t in zip(*(block.column(c).to_pylist() for c in ("sigs", "at", "toks")), strict=True):
            t = _unplanes(t)
            sigs.append(np.frombuffer(s, np.uint64)[np.frombuffer(a, np.uint16 if len(a) == 2 * len(t) else np.uint32)])
            toks.append(t)
        sig, tok = np.concatenate(sigs), np.concatenate(toks)
        order = np.lexsort((sig, tok))
        sig, tok = sig[order], tok[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])
        sig, tok = sig[new], tok[new]
        if block.column("block")[0].as_py() < 0:
            df = np.full(len(tok), HOT_COUNT, np.uint32)
        else:
            starts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            size = np.diff(np.append(starts, len(tok)))
            df = np.repeat(size, size).astype(np.uint32)
        keep = df > 1
        sig, tok, df = sig[keep], tok[keep], df[keep]
        order = np.argsort(sig, kind="stable")
        sig, tok, df = sig[order], tok[order], df[order]
        bucket = sig >> np.uint64(64 - bits)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sig)], strict=True):
            if b > a:
                used, n = np.unique(sig[a:b], return_counts=True)
                out.append((int(bucket[a]), used.tobytes(), n.astype(np.uint32).tobytes(), tok[a:b].tobytes(), df[a:b].tobytes()))
        return pa.Table.from_batches([_batch(_shared_kinds, SHARED, out)])

    return run


#: `odd`, the parities as 64-bit numbers, is null but in a class's first fragment.
SEGMENTS = "sig long, n long, fragment int, toks binary, prefix array<long>, places array<int>, shared long, odd array<long>"
_segment_kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64())]


def _parities(toks: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount((toks & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES) & 1).astype(np.uint8)).view(np.int64)


def _segments(t: Fraction):
    """Of one bucket of classes: those that may have a partner, with their shared shingles by fragment and their prefix."""

    def run(entries: pa.Table, classes: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([_batch(_segment_kinds, SEGMENTS, [])])
        if not entries.num_rows or not classes.num_rows:
            return empty
        both = [entries.column(c).to_pylist() for c in ("sigs", "counts", "toks", "dfs")]
        sig = np.concatenate([np.repeat(np.frombuffer(s, np.uint64), np.frombuffer(c, np.uint32)) for s, c in zip(both[0], both[1], strict=True)])
        tok, df = (np.concatenate([np.frombuffer(x, k) for x in col]) for col, k in ((both[2], np.uint64), (both[3], np.uint32)))
        ids, total = (classes.column(c).to_numpy() for c in ("sig", "n"))
        order = np.argsort(ids.view(np.uint64))
        ids, total = ids.view(np.uint64)[order], total[order]
        order = np.lexsort((tok, df, sig))
        sig, tok, df = sig[order], tok[order], df[order]
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        ends = np.append(starts[1:], len(sig))
        rows = []
        for a, b, n in zip(starts.tolist(), ends.tolist(), total[np.searchsorted(ids, sig[starts])].tolist(), strict=True):
            if b - a < ceil(t * n):
                continue
            reach = n - ceil(t * n) + 1 - (n - (b - a))  # shared shingles within the prefix; those of one class come before
            fragment = np.searchsorted(EDGES, df[a:b])
            odd = _parities(tok[a:b])
            for f in np.unique(fragment).tolist():
                here = np.flatnonzero(fragment == f)
                lead = here[here < reach]
                rows.append((int(sig[a].view(np.int64)), n, f, np.sort(tok[a:b][here]).tobytes(), tok[a:b][lead].view(np.int64), (lead + n - (b - a)).astype(np.int32), b - a, odd))
                odd = None
        return pa.Table.from_batches([_batch(_segment_kinds, SEGMENTS, rows)])

    return run


def _overlaps(batches):
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        n = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["a", "b", "common"])


def _may_link(t: Fraction, a: str, b: str):
    """Whether classes with the columns n, s (shared shingles) and o (parities), each with suffix a or b, may have Jaccard >= t."""
    differ = sum((F.bit_count(F.col(f"o{a}")[i].bitwiseXOR(F.col(f"o{b}")[i])) for i in range(PLACES // 64)), F.lit(0))
    return (F.col(f"s{a}") + F.col(f"s{b}") - differ) * (t.numerator + t.denominator) >= (F.col(f"n{a}") + F.col(f"n{b}")) * (2 * t.numerator)


def verify(pairs: DataFrame, segments: DataFrame, marks: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b, na, nb) with Jaccard >= t: overlaps are counted by fragment and summed by pair."""
    left = segments.select(F.col("sig").alias("a"), "fragment", F.col("toks").alias("ta"))
    right = segments.select(F.col("sig").alias("b"), "fragment", F.col("toks").alias("tb"))
    mark = lambda x: marks.select(F.col("sig").alias(x), F.col("s").alias(f"s{x}"), F.col("o").alias(f"o{x}"))
    pairs = table(pairs.join(mark("a"), "a").join(mark("b"), "b").where(_may_link(t, "a", "b")).select("a", "b", "na", "nb"))
    first = table(pairs.select("a", "b").join(left, "a"))
    joined = first.join(right, ["b", "fragment"]).select("a", "b", "ta", "tb")
    sums = joined.mapInArrow(_overlaps, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    out = table(sums.join(pairs, ["a", "b"]).where(F.col("common") * t.denominator >= (F.col("na") + F.col("nb") - F.col("common")) * t.numerator).select("a", "b"))
    drop(first, pairs)
    return out


def _fits(t: Fraction, small: str, large: str):
    return F.col(small) * t.denominator >= F.col(large) * t.numerator


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("a") > F.col("b")
    cols = (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))
    return pairs.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in cols]).distinct()


def links(segments: DataFrame, t: Fraction, rounds: int = 4, lead: int = 2, share: int = 16) -> DataFrame:
    """(class, component) over links of classes that have one; see the module's docstring.

    In each round some shingles of each prefix have a leader: one in `share`, drawn anew by hash, the last `lead` of a prefix
    and the first that others have. The leader is first the class with the fewest shingles before this one, which is the
    nearest to what a group shares, and then one at random by shingle and round.
    """
    prefix = segments.select("sig", "n", "shared", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("sig", "n", "shared", F.col("p.prefix").alias("tok"), F.col("p.places").alias("place"), (F.col("p.places") - F.col("n") + F.col("shared")).alias("nth"))
    whole = F.floor((F.col("n") * t.numerator + (t.denominator - 1)) / t.denominator).cast("long")
    prefix = table(prefix.withColumn("behind", F.col("shared") - whole - F.col("nth")).drop("shared"))
    marks = table(segments.where("odd is not null").select("sig", F.col("shared").alias("s"), F.col("odd").alias("o")))
    groups, found = None, None
    for r in range(rounds):
        drawn = F.pmod(F.xxhash64("tok", F.lit(r)), F.lit(share)) == 0
        some = _with_groups(prefix.where(drawn | (F.col("nth") < 1) | (F.col("behind") < lead)), groups)
        leaders = some.groupBy("tok").agg(F.min_by(F.struct("sig", "n", "group"), F.struct(F.col("place") if r == 0 else F.lit(0), F.xxhash64("sig", "tok", F.lit(r)))).alias("l"), F.min("group").alias("low"), F.max("group").alias("high"))
        leaders = table(leaders.where("low <> high").select("tok", F.col("l.sig").alias("b"), F.col("l.n").alias("nb"), F.col("l.group").alias("gb")))
        pairs = some.join(leaders, "tok").where((F.col("group") != F.col("gb")) & (F.least("n", "nb") * t.denominator >= F.greatest("n", "nb") * t.numerator))
        new = verify(_ordered(pairs.select(F.col("sig").alias("a"), "b", F.col("n").alias("na"), "nb")), segments, marks, t)
        drop(leaders, *([] if groups is None else [some]))
        found = new if found is None else found.union(new)
        groups = components(found)
    rest = _with_groups(prefix, groups)
    mixed = rest.groupBy("tok").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.ceil(F.count("*") / FEW).cast("int").alias("parts"))
    mixed = table(mixed.where("low <> high").select("tok", "parts"))
    # Shared shingles left when this one is the first in common bound the partner's size, as does the overlap that t asks for.
    most = F.floor((F.col("n") - F.col("place")) * (t.denominator + t.numerator) / F.lit(float(t.numerator)) + 1e-9) - F.col("n")
    rest = rest.join(mixed, "tok").select("tok", "parts", "sig", "n", "group", most.cast("long").alias("most"))
    rest = table(rest.join(marks, "sig"))
    # Members of a shingle go to its parts by hash, and to all of them for the other side.
    side = lambda x: [F.col(c).alias(c[0] + x) for c in ("group", "n", "s", "o", "most")]
    x = rest.where(F.col("most") >= F.col("n")).select("tok", F.pmod(F.xxhash64("sig"), "parts").cast("int").alias("part"), F.col("sig").alias("a"), *side("a"))
    y = rest.select("tok", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("sig").alias("b"), *side("b"))
    near = (F.col("ga") != F.col("gb")) & (F.col("na") <= F.col("nb")) & _fits(t, "na", "nb") & (F.col("nb") <= F.col("ma")) & (F.col("na") <= F.col("mb")) & _may_link(t, "a", "b")
    x, y = x.alias("x"), y.alias("y")
    pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.part") == F.col("y.part")) & near)
    new = verify(_ordered(pairs.select("a", "b", "na", "nb")), segments, marks, t)
    drop(prefix, rest, mixed)
    return components(found.union(new))


def _with_groups(prefix: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return prefix.withColumn("group", F.col("sig"))
    return table(prefix.join(groups.withColumnRenamed("id", "sig"), "sig", "left").withColumn("group", F.coalesce("component", "sig")).drop("component"))


def join(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    return _join(docs, k, threshold)[0].drop("sig", "group")


def _join(docs: DataFrame, k: int, threshold: Fraction) -> tuple[DataFrame, int]:
    """The join with the class and its group of linked classes, and the seed of the classes."""
    spark = docs.sparkSession
    ready(spark)
    for seed in range(SEEDS):
        sketched = table(sketch(docs, k, seed))
        rows = sketched.where("n is not null").select("doc_id", "n", "sig", "proof")
        classes = table(rows.groupBy("sig").agg(F.first("n").alias("n"), F.min("doc_id").alias("first_id"), F.min("proof").alias("p"), F.max("proof").alias("q")))
        if classes.where("p <> q").isEmpty():
            break
    else:
        raise RuntimeError("classes clash with every seed")
    total = classes.agg(F.sum("n")).first()[0] or 0
    counts = table(sketched.where("hot is not null").select(F.explode(F.arrays_zip("hot", "hot_n")).alias("h")).groupBy(F.col("h.hot").alias("tok")).agg(F.sum("h.hot_n").alias("n")))

    hot = np.sort(np.array([r["tok"] for r in most_frequent(counts.where(F.col("n") >= HOT_LEAST), "n", "tok", HOT).select("tok").collect()], np.int64).view(np.uint64))
    bits = max(7, ceil(log2(max(1, total / BLOCK))))
    entries = block_entries(docs, bits, spark.sparkContext.broadcast(hot), k, seed)
    shared = entries.groupBy("block").applyInArrow(_count(bits), SHARED)
    sized = classes.where("n > 0").select(F.shiftrightunsigned("sig", 64 - bits).cast("int").alias("bucket"), "sig", "n")
    segments = table(shared.groupBy("bucket").cogroup(sized.groupBy("bucket")).applyInArrow(_segments(threshold), SEGMENTS))
    groups = links(segments, threshold)
    grouped = table(classes.join(groups.withColumnRenamed("id", "sig"), "sig").select("sig", "component", "first_id"))
    smallest = table(grouped.groupBy("component").agg(F.min("first_id").alias("smallest")))
    linked = grouped.join(smallest, "component").select("sig", "smallest", "component")
    final = table(classes.join(linked, "sig", "left").select("sig", F.coalesce("smallest", "first_id").alias("component_id"), F.coalesce("component", "sig").alias("group")))
    out = rows.join(final, "sig").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "sig", "group")
    return out, seed


def accept(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """The rows of docs, all columns, that are the smallest id of their component; one row where such a row repeats.

    Rows without an id stay unless they are linked to one with an id. Rows with a null or repeated id are decided one by one.
    """
    found, seed = _join(docs, k, threshold)
    found = table(found)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    again = table(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("headlight_again")))
    repeats = F.col("doc_id") == F.col("headlight_again")
    gone = table(found.where(~stays & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("headlight_gone")).distinct())
    none, nulls = again.isEmpty(), not found.where("doc_id is null").isEmpty()
    once = docs.where("doc_id is not null") if none else docs.where("doc_id is not null").join(small(again), repeats, "left_anti")
    kept = once.join(small(gone), F.col("doc_id") == F.col("headlight_gone"), "left_anti")
    if none and not nulls:
        return kept
    odd = docs.where("doc_id is null")
    if not none:
        odd = odd.unionByName(docs.join(small(again), repeats, "left_semi"))
    odd = annotate(odd, "text", {"headlight_sig": pa.int64()}, lambda texts: [[_signed(_signature(shingles(x, k), seed)[0]) for x in texts]])
    stay = found.where(stays).select(F.col("doc_id").alias("headlight_id"), F.col("sig").alias("headlight_of"), F.col("group").alias("headlight_group"), (F.col("n_shingles") > 0).alias("headlight_any")).distinct()
    odd = odd.join(stay, F.col("headlight_id").eqNullSafe(F.col("doc_id")) & (F.col("headlight_of") == F.col("headlight_sig")))
    odd = odd.withColumn("headlight_text", F.when(~F.col("headlight_any"), F.col("text")))
    one = odd.where("doc_id is not null").dropDuplicates(["doc_id", "headlight_group", "headlight_text"])
    return kept.unionByName(odd.where("doc_id is null").unionByName(one).select(*(F.col(f"`{c}`") for c in docs.columns)))
