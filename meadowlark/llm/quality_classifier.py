"""A quality classifier: kernel ridge regression on document statistics, calibrated.

Twenty-odd statistics of a text are standardized and mapped to random Fourier features,
cosines of fixed random projections, whose products approximate a Gaussian kernel. The
normal equations are summed by partition in whole numbers (cosines are rounded to 1/4096),
so the model does not depend on how rows are dealt. Labelled rows fall into two folds; a
model of each fold scores the other, those scores and labels give the isotonic calibration,
and the model of both folds scores documents.

Defined results: null and empty texts have the statistics of no words and are scored like
any text; the label of a document is the mean of its labels, null labels are ignored, and a
document that repeats counts each time. Without labels, every score is 0.5. Extra columns
pass through; one named as a result is replaced; an empty table stays empty. Keys are whole numbers, or texts
of such; other texts are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.llm import words as W
from meadowlark.llm.batches import append_columns, bound_batches, written

FEATURES = 128
GAMMA = 0.05  # of the Gaussian kernel, on standardized statistics
RIDGE = 1.0
SCALE = 4096
BINS = 2048  # of the scores that are calibrated
SEED = 7
_CLASS = np.zeros((7, 256), bool)  # upper case, digit, mark, symbol, exclamation, bar, beyond ASCII
for _row, _set in enumerate((range(65, 91), range(48, 58), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#*$%&<>", b"!", b"|", range(128, 256))):
    _CLASS[_row, list(_set)] = True
STATISTICS = 7 + 12


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    data, at = W.utf8(texts)
    n = len(at) - 1
    begin, end, offsets = W.word_spans(data, at)
    h = W.span_hashes(data, begin, end)
    row = np.repeat(np.arange(n), np.diff(offsets))
    words, size = np.diff(offsets).astype(float), np.diff(at).astype(float)
    some, bytes_ = np.maximum(words, 1), np.maximum(size, 1)
    length = (end - begin).astype(float)
    mean = np.bincount(row, length, n) / some
    spread = np.sqrt(np.bincount(row, (length - mean[row]) ** 2, n) / some)
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shingles, pos = W.windows(h, offsets, 5)
    repeats = W.repeated(shingles, row[pos]) if len(pos) else np.zeros(0, bool)
    twice = W.repeated(h, row) if len(h) else again
    share = lambda flags: np.bincount(row, flags, n) / some
    first, last = (data[begin], data[end - 1]) if len(begin) else (data[:0], data[:0])
    columns = [np.sqrt(W.per_row(c[data], at) / bytes_) for c in _CLASS]
    columns += [np.log1p(words), np.log1p(mean), np.log1p(spread), np.sqrt(W.per_row(data == 10, at) / some),
                share(again), share(twice), np.bincount(row[pos], repeats, n) / some,
                share(_CLASS[0][first]), share(_CLASS[2][last]), share(_CLASS[2][first]),
                share(length <= 3), share(length > 16)]
    return np.stack(columns, 1)


class Model:
    """Scores statistics; ``calibrate`` maps raw scores to shares of good documents."""

    def __init__(self, centre, width, weights=None, knots=None):
        self.centre, self.width, self.weights, self.knots = centre, width, weights, knots
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((len(centre), FEATURES)) * np.sqrt(2 * GAMMA)
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    @property
    def state(self) -> tuple:
        """Plain arrays from which ``Model(*state)`` is made again; this is what is sent to tasks."""
        return self.centre, self.width, self.weights, self.knots

    def features(self, x: np.ndarray) -> np.ndarray:
        """Rounded cosines and a constant, as whole numbers."""
        z = np.clip((x - self.centre) / self.width, -8, 8)
        cosines = np.rint(np.cos(z @ self.directions + self.phases) * SCALE)
        return np.concatenate([cosines, np.full((len(x), 1), float(SCALE))], 1)

    def raw(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return (self.features(x) * weights).sum(1) / SCALE

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x, self.weights), *self.knots)


def solve(sums: np.ndarray) -> np.ndarray:
    """Ridge weights from [A | b], summed over rows in units of SCALE squared."""
    a, b = sums[:, :-1] / SCALE**2, sums[:, -1] / SCALE**2
    return np.linalg.solve(a + RIDGE * np.eye(len(a)), b)


def isotonic(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x: pool centres and their shares, pulled
    towards one half by half a row of each label."""
    pools: list[list[float]] = []
    for xi, ni, gi in zip(x, n, good):
        pools.append([xi * ni, ni, gi])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    centres = np.array([p[0] / p[1] for p in pools])
    return centres, np.maximum.accumulate(np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools]))


def _summed(rows: DataFrame, n: int) -> np.ndarray:
    """Sum over partitions of (block, line, values): blocks of n lines, each at most a few KB.
    Lines are dealt by key, so a task adds up only its own."""
    def add(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, i, v in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2)):
                v = v.values.to_numpy()
                held[b, i] = held[b, i] + v if (b, i) in held else v.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()),
                                              pa.array([v for v in held.values()], pa.list_(pa.int64()))], ["block", "line", "v"])

    out = np.zeros((2, n, n + 1))
    for r in rows.repartition("block", "line").mapInArrow(add, _LINES).toLocalIterator():
        out[r["block"], r["line"]] += r["v"]
    return out


_LINES = "block int, line int, v array<long>"


def _matrix(batch, i: int) -> np.ndarray:
    v = batch.column(i)
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), STATISTICS).astype(float)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """The model from documents and labels (key, label in 0 to 1). Statistics, some 80 bytes a
    document, are written once; texts are not moved."""
    bound_batches(docs.sparkSession)

    def stats(texts):
        return pa.array(list(np.concatenate([statistics(texts[a:b]) for a, b in W.slices(texts)]).astype(np.float32)), pa.list_(pa.float32())) \
            if len(texts) else pa.array([], pa.list_(pa.float32()))

    taken = F.arrow_udf(stats, "array<float>")
    facts = written(docs.select(F.col(f"`{key}`").cast("long").alias("key"), taken(F.col(f"`{text}`").cast("string")).alias("x")),
                    "document-statistics")
    given = labels.toDF("key", "y").where("key IS NOT NULL AND y IS NOT NULL").groupBy("key").agg(F.avg("y").alias("y"))
    fold = (F.xxhash64("key") % 2 != 0).cast("int")
    rows = written(facts.join(given, "key").select("x", F.rint(F.col("y") * SCALE).cast("long").alias("y"), fold.alias("fold")),
                   "labelled-statistics")
    aggregated = rows.select(*[F.round(f, 6) for i in range(STATISTICS)
                               for f in (F.avg(F.col("x")[i].cast("double")), F.stddev_pop(F.col("x")[i].cast("double")))]).first()
    if aggregated[0] is None:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    moments = np.array(aggregated, float).reshape(STATISTICS, 2)
    model = Model(moments[:, 0], np.maximum(moments[:, 1], 1e-3))
    held = docs.sparkSession.sparkContext.broadcast(model.state)

    def equations(batches):
        model, sums = Model(*held.value), np.zeros((2, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(_matrix(batch, 0))
            y, part = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in (0, 1):
                mine = z[part == f]
                sums[f] += np.concatenate([mine.T @ mine, (mine.T @ y[part == f].astype(float))[:, None]], 1)
        lines = [(f, i) for f in (0, 1) for i in range(FEATURES + 1) if sums[f].any()]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in lines], pa.int32()), pa.array([i for _, i in lines], pa.int32()),
                                              pa.array([sums[x].astype(np.int64) for x in lines], pa.list_(pa.int64()))],
                                             ["block", "line", "v"])

    sums = _summed(rows.mapInArrow(equations, _LINES), FEATURES + 1)
    weights = solve(sums.sum(0))
    crossed = [solve(sums[1]), solve(sums[0])]  # each fold is scored by the other's model

    def tally(batches):
        model, n, good = Model(*held.value), np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            x, part = _matrix(batch, 0), batch.column(2).to_numpy()
            raw = np.where(part == 0, model.raw(x, crossed[0]), model.raw(x, crossed[1]))
            bins = np.clip((raw + 1) * BINS / 3, 0, BINS - 1).astype(int)
            n += np.bincount(bins, minlength=BINS)
            np.add.at(good, bins, batch.column(1).to_numpy())
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(good[at])], ["bin", "n", "good"])

    counted = rows.mapInArrow(tally, "bin long, n long, good long").groupBy("bin").agg(F.sum("n"), F.sum("good"))
    bins = np.array(sorted(map(tuple, counted.collect())), float)  # at most BINS rows
    knots = isotonic((bins[:, 0] + 0.5) * 3 / BINS - 1, bins[:, 1], bins[:, 2] / SCALE)
    return Model(model.centre, model.width, weights, knots)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model.state)

    def scores(texts):
        model = Model(*held.value)
        return [np.concatenate([model.scores(statistics(texts[a:b])) for a, b in W.slices(texts)] or [np.zeros(0)])]

    return append_columns(docs, text, scores, {"score": "double"}).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key: Column) -> Column:
    """Whether a document's label must not be learned."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
