"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are shares of byte classes, of repeated words and lines, word lengths and entropy, each brought to mean 0 and
deviation 1 over the training rows. FEATURES random cosines of them approximate a Gaussian kernel. Every partition sums
its part of the normal equations, and only those sums (of fixed size) are added up and solved. Scores are calibrated
by isotonic regression over BINS equal steps of the raw score, with straight lines between the middles of its levels.

Texts: null is empty, and is scored like any other. Labels: several labels of a doc_id are averaged; a null label, or a
label without document, teaches nothing. All labelled rows of the training split are used. Without any, or if all agree,
the score is the mean label (0.5 without labels). Repeated rows are scored each for itself. A very long text is measured
whole. An empty table gives no rows. Only doc_id and text are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm import common as c

FEATURES = 256
WIDTH = 0.18
RIDGE = 1e-3
BINS = 1000
SEED = 7
#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".?!", "comma": b",;:",
    "bang": b"!", "bar": b"|", "sign": b"#$%&*+/<=>@\\^_`~", "bracket": b"()[]{}", "quote": b"\"'", "wide": bytes(range(128, 256)),
}
NAMES = [*CLASSES, "log_bytes", "log_words", "word_mean", "word_dev", "word_long", "word_short", "distinct", "top_word", "log_lines", "line_distinct", "line_mean", "entropy"]
MEMBER = np.stack([np.isin(np.arange(256), list(v)) for v in CLASSES.values()]).astype(np.float64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys of each owner, and the count of its most frequent one."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    most = np.zeros(n)
    np.maximum.at(most, owner[at], np.diff(np.append(at, len(keys))))
    return np.bincount(owner[at], minlength=n).astype(float), most


def statistics(column) -> np.ndarray:
    """One row of statistics for each text."""
    data, offsets = c.flat(column)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    size = np.maximum(1.0, counts.sum(axis=1))
    share = counts / size[:, None]
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    starts, ends, own = c.runs(c.NOT_SPACE[data], offsets)
    long = (ends - starts).astype(float)
    words = np.diff(own).astype(float)
    some = np.maximum(1.0, words)
    mean = _sums(long, own) / some
    dev = np.sqrt(np.maximum(0, _sums(long * long, own) / some - mean * mean))
    distinct, most = _distinct(c.span_hashes(data, starts, ends), np.repeat(np.arange(n), np.diff(own)), n)
    l_starts, l_ends, l_own = c.runs(data != 10, offsets)
    lines = np.diff(l_own).astype(float)
    l_distinct, _ = _distinct(c.span_hashes(data, l_starts, l_ends), np.repeat(np.arange(n), np.diff(l_own)), n)
    some_lines = np.maximum(1.0, lines)
    return np.column_stack(
        [
            share @ MEMBER.T, np.log1p(size), np.log1p(words), mean, dev, _sums(long > 12, own) / some, _sums(long <= 3, own) / some, distinct / some, most / some,
            np.log1p(lines), l_distinct / some_lines, np.log1p(size / some_lines), entropy,
        ]
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and stats, for every row."""

    def run(batches):
        for piece in c.pieces(batches):
            found = statistics(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, stats array<double>")


class Model:
    def __init__(self, mean: np.ndarray, dev: np.ndarray):
        self.mean, self.dev = mean, np.where(dev > 1e-9, dev, 1.0)
        random = np.random.default_rng(SEED)
        self.turn = random.normal(0.0, WIDTH, (len(mean), FEATURES))
        self.phase = random.uniform(0.0, 2 * np.pi, FEATURES)
        self.weights, self.xs, self.ys = None, np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.dev, -6, 6)
        return np.column_stack([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / FEATURES), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.ys[0])
        return np.clip(np.interp(self.raw(stats), self.xs, self.ys), 0.0, 1.0)


def _stats(batch) -> np.ndarray:
    column = batch.column("stats")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: middles (by weight) and values of the levels."""
    levels: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        levels.append([a * w, b * w, w])
        while len(levels) > 1 and levels[-2][1] * levels[-1][2] >= levels[-1][1] * levels[-2][2]:
            last = levels.pop()
            levels[-1] = [p + q for p, q in zip(levels[-1], last)]
    return np.array([p[0] / p[2] for p in levels]), np.array([p[1] / p[2] for p in levels])


def learn(train: DataFrame) -> Model:
    """train: stats, label (0 to 1)."""
    n_stats = len(NAMES)
    row = train.agg(F.count("*"), F.avg("label"), F.min("label"), F.max("label"), *(g(F.col("stats")[i]) for g in (F.avg, F.stddev_pop) for i in range(n_stats))).first()
    count, mean_label, low, high = row[:4]
    if not count:
        return Model(np.zeros(n_stats), np.ones(n_stats))
    model = Model(np.array(row[4 : 4 + n_stats], float), np.array(row[4 + n_stats :], float))
    model.ys = np.array([mean_label])
    if low == high:
        return model
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(model)
    size = FEATURES + 2  # features, 1 and the label

    def add_up(batches):
        total = np.zeros((size, size))
        for batch in batches:
            stats = _stats(batch)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for k in range(0, len(label), 4096):
                f = np.column_stack([shared.value.features(stats[k : k + 4096]), label[k : k + 4096]])
                total += f.T @ f
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    parts = train.select("stats", F.col("label").cast("double")).mapInArrow(add_up, "i bigint, sums array<double>")
    rows = parts.select("i", F.posexplode("sums").alias("j", "v")).where("j >= i").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((size, size))
    for i, j, v in rows.toLocalIterator():
        total[i, j] = total[j, i] = v
    a, b = total[:-1, :-1], total[:-1, -1]
    model.weights = np.linalg.solve(a + RIDGE * count * np.diag(np.append(np.full(FEATURES, 1 / FEATURES), 0.0)) + 1e-9 * np.eye(size - 1), b)
    shared = spark.sparkContext.broadcast(model)

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.raw(_stats(batch))), batch.column("label")], ["raw", "label"])

    at = F.least(F.greatest(F.floor(F.col("raw") * BINS / 2 + BINS / 4), F.lit(0)), F.lit(BINS))
    bins = sorted(train.select("stats", F.col("label").cast("double")).mapInArrow(raw, "raw double, label double").groupBy(at.alias("at")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n")).collect())
    model.xs, model.ys = isotonic(*(np.array([r[k] for r in bins], float) for k in (1, 2, 3)))
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_stats(batch)))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, teaches, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every document; labels (doc_id, label) of the rows where `teaches` holds are learned."""
    stats = c.written(measured(docs), "statistics")
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("label").alias("label"))
    train = c.written(stats.where(teaches).join(known, "doc_id").select("stats", "label"), "training")
    return scored(stats, learn(train)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
