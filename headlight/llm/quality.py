"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are standardised, mapped by cos(xW + b) to approximate a Gaussian kernel, and partitions sum their normal
equations by fold; the sums of one matrix row meet in one group of at most one row per partition. The score uses all folds; for
the calibration each row is scored by the ridge of the other folds, binned (1,024 bins, all rows), and pool-adjacent-violators
fits the bins. Null and empty texts have all-zero statistics and a score like any other;
without training rows, or with one class only, every score is that class's share (0.5 without rows). Null labels are not
used; repeated rows count as often as they occur; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headlight.llm.common import annotate, ready, table

_groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"#$%&*@^~`<>=+{}[]\\/_", b"|", b"!", b" \t", b"\n\r", bytes(range(128, 256))]
CLASSES = np.zeros((256, len(_groups)), np.float32)
for _i, _g in enumerate(_groups):
    CLASSES[list(_g), _i] = 1
N_STATS = len(_groups) + 10
BINS, LOW, HIGH, FOLDS = 1024, -0.5, 1.5, 5


def _one(text: str | None) -> tuple[np.ndarray, list[float]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    found = data.lower().split()
    lines = [x for x in data.split(b"\n") if x]
    n = max(1, len(found))
    size = np.fromiter(map(len, found), np.int64, len(found))
    tails = b"".join([w[-1:] for w in found])
    odd = sum(map(tails.count, (b"#", b"$", b"%", b"&", b"*", b"|", b"!")))
    return counts, [
        np.log1p(len(data)), np.log1p(len(found)), len(data) / n, len(set(found)) / n, float(size.std()) if len(found) else 0.0,
        float((size <= 3).sum()) / n, odd / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(found) / max(1, len(lines))),
        sum(map(bytes.__eq__, found, found[1:])) / n,
    ]


def statistics(texts: list[str | None]) -> np.ndarray:
    both = [_one(x) for x in texts]
    if not both:
        return np.zeros((0, N_STATS), np.float32)
    counts = np.stack([x[0] for x in both]).astype(np.float32)
    share = counts @ CLASSES / np.maximum(1, counts.sum(axis=1, keepdims=True))
    return np.hstack([np.sqrt(share), np.array([x[1] for x in both], np.float32)]).astype(np.float32)


def _features(batches):
    for batch in batches:
        x = statistics(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel()))], names=["doc_id", "stats"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the array of statistics of the whole text, written to the shared folder."""
    ready(docs.sparkSession)
    return table(docs.select("doc_id", "text").mapInArrow(_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<float>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), N_STATS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    share: float
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.beta

    @staticmethod
    def bins(raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)

    def predict(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), self.share)
        return self.knots[self.bins(self.raw(stats))]


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins by pool-adjacent-violators; empty bins are interpolated between their neighbours."""
    pools: list[list[float]] = []
    used = np.flatnonzero(counts)
    for i in used:
        pools.append([sums[i], counts[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, c, k = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + c, pools[-1][2] + k]
    means = np.repeat([s / c for s, c, _ in pools], [k for _, _, k in pools])
    return np.interp(np.arange(len(counts)), used, means)


def fit(train: DataFrame, width: int = 160, ridge: float = 1e-3, spread: float = 2.0, seed: int = 7) -> Model:
    """train: stats and label (0 or 1) of every labelled training row."""
    spark = train.sparkSession
    ready(spark)
    fold = F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int")  # equal rows share a fold
    train = table(train.select("stats", F.col("label").cast("double").alias("label"), fold.alias("fold")).where("label is not null and stats is not null"))
    moments = train.select(*[F.struct(F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i])).alias(f"s{i}") for i in range(N_STATS)], F.avg("label").alias("share"), F.count("*").alias("n")).first()
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(N_STATS, width)) / np.sqrt(N_STATS) / spread, rng.uniform(0, 2 * np.pi, width)
    share = 0.5 if moments["share"] is None else float(moments["share"])
    model = Model(np.array([moments[f"s{i}"][0] or 0.0 for i in range(N_STATS)]), np.array([(moments[f"s{i}"][1] or 0.0) + 1e-6 for i in range(N_STATS)]), w, b, np.zeros(width + 1), share)
    if share in (0.0, 1.0) or not moments["n"]:
        return model
    d = width + 1

    def sums(batches):
        total = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            x, y, at = model.expand(_matrix(batch.column(0))), np.asarray(batch.column(1), np.float64)[:, None], np.asarray(batch.column(2))
            for k in range(FOLDS):
                mine = x[at == k]
                total[k] += mine.T @ np.hstack([mine, y[at == k]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOLDS * d), pa.int32()), pa.array(list(total.reshape(FOLDS * d, d + 1)))], names=["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, d + 1).sum(axis=0)
        return pa.table({"i": pa.array([t.column("i")[0].as_py()], pa.int32()), "v": pa.array([v])})

    kind = "i int, v array<double>"
    rows = train.mapInArrow(sums, kind).groupBy("i").applyInArrow(add, kind).collect()
    folds = np.array([r["v"] for r in sorted(rows)]).reshape(FOLDS, d, d + 1)
    solve = lambda t: np.linalg.solve(t[:, :d] + ridge * max(1.0, t[d - 1, d - 1]) * np.eye(d) / d, t[:, d])  # noqa: E731  the last diagonal element is the rows' number
    total = folds.sum(axis=0)
    model.beta = solve(total)
    without = np.array([solve(total - x) for x in folds])

    def binned(batches):
        out = np.zeros((2, BINS))
        for batch in batches:
            raw = np.einsum("ij,ij->i", model.expand(_matrix(batch.column(0))), without[np.asarray(batch.column(2))])
            at = model.bins(raw)
            np.add.at(out[0], at, np.asarray(batch.column(1), np.float64))
            np.add.at(out[1], at, 1)
        used = np.flatnonzero(out[1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[0][used]), pa.array(out[1][used])], names=["bin", "y", "n"])

    got = train.mapInArrow(binned, "bin int, y double, n double").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect()
    y, n = np.zeros(BINS), np.zeros(BINS)
    for r in got:
        y[r["bin"]], n[r["bin"]] = r["y"], r["n"]
    model.knots = np.clip(isotonic(y, n), 0, 1)
    return model


def score(feats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of features()."""
    spark = feats.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.predict(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return feats.select("doc_id", "stats").mapInArrow(run, f"doc_id {feats.schema['doc_id'].dataType.simpleString()}, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `least`; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = annotate(docs, "text", {"headlight_score": pa.float64()}, lambda texts: [shared.value.predict(statistics(texts))])
    return scored.where(F.col("headlight_score") >= least).drop("headlight_score")
