"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words and runs of signs hash into ``BUCKETS``; each bucket has a sparse random
index vector, and its word vector sums the index vectors of itself and its
neighbours over all documents. A document is the mean of its word vectors. The
network is fitted on a bounded sample of labelled rows, and its probabilities
are calibrated by a temperature on rows that it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, stored, text_of
from .tokens import LONGEST_RUN, RUN_CLASS, Step, runs, span_hashes, steps, sums_by_row

BUCKETS, DIMS, NONZERO = 1 << 14, 64, 4
WIDTH = DIMS + 2
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: Labelled rows that the network is fitted and calibrated on, at most.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 30, 2e-3, 1e-4
THRESHOLD = 0.3

_rng = np.random.default_rng(7)
INDEX_DIM = _rng.integers(0, DIMS, (BUCKETS, NONZERO))
INDEX_SIGN = _rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _bucket_steps(column: pa.Array) -> Iterator[tuple[Step, np.ndarray, np.ndarray]]:
    """Each step with the bucket of each token, and its row."""
    for step in steps(column, RUN_CLASS, LONGEST_RUN):
        starts, ends, row = runs(step.data, step.offsets, RUN_CLASS, LONGEST_RUN)
        yield step, (span_hashes(step.data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), row


def context_sums(texts: DataFrame) -> DataFrame:
    """(bucket, v0 ...): the sum of index vectors around each bucket's tokens, over all rows of ``text``.

    A task sends one row a bucket; the sums are whole numbers, so their order doesn't matter.
    """
    names = [f"v{d}" for d in range(DIMS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMS)
        before = np.zeros(0, np.int64)
        for batch in batches:
            for step, bucket, row in _bucket_steps(batch.column(0)):
                if not step.begins and len(before) and len(bucket):  # neighbours across a cut
                    for own, other in ((before, bucket[:1]), (bucket[:1], before)):
                        total[own[0] * DIMS : (own[0] + 1) * DIMS] += np.bincount(INDEX_DIM[other].ravel(), INDEX_SIGN[other].ravel(), DIMS)
                before = bucket[-1:] if len(bucket) or step.begins else before
                pairs = [(bucket, bucket)]
                near = row[1:] == row[:-1]
                pairs += [(bucket[1:][near], bucket[:-1][near]), (bucket[:-1][near], bucket[1:][near])]
                for own, other in pairs:
                    at = own[:, None] * DIMS + INDEX_DIM[other]
                    total += np.bincount(at.ravel(), INDEX_SIGN[other].ravel(), BUCKETS * DIMS)
        table = total.reshape(BUCKETS, DIMS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(table[used, d]) for d in range(DIMS))], ["bucket", *names])

    parts = texts.select("text").mapInArrow(work, "bucket int, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(sums: DataFrame) -> np.ndarray:
    """BUCKETS unit vectors (float32, 4 MB): logarithms damp frequent neighbours."""
    found = sums.toPandas()  # at most BUCKETS rows
    table = np.zeros((BUCKETS, DIMS))
    table[found["bucket"].to_numpy()] = found.drop(columns="bucket").to_numpy()
    table = np.sign(table) * np.log1p(np.abs(table))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean word vector, the logarithm of the number of tokens, the share of distinct ones."""
    out = np.zeros((len(column), WIDTH), np.float32)
    total, tokens, seen = np.zeros((1, DIMS)), np.zeros(1, np.int64), np.zeros(BUCKETS, bool)
    for step, bucket, row in _bucket_steps(column):
        n = step.rows
        sums, count = sums_by_row(vectors[bucket], row, n), np.bincount(row, minlength=n)
        if step.begins and step.ends:
            distinct = np.bincount(np.unique(row * BUCKETS + bucket) // BUCKETS, minlength=n)
        else:
            if step.begins:
                total[:], tokens[:], seen[:] = 0, 0, False
            total += sums
            tokens += count
            seen[bucket] = True
            if not step.ends:
                continue
            sums, count, distinct = total, tokens, seen.sum(keepdims=True)
        own = slice(step.first, step.first + n)
        out[own, :DIMS] = sums / np.maximum(count, 1)[:, None]
        out[own, DIMS] = np.log1p(count)
        out[own, DIMS + 1] = distinct / np.maximum(count, 1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Two layers by Adam on the log loss; without both labels, their share is the score."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    d = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(d)
    scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(d)
    net = Network(mean, scale, rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    net.b2 = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return net
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array(net.b2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 128):
            t += 1
            rows = order[at : at + 128]
            hidden = z[rows] @ params[0] + params[1]
            active = np.maximum(hidden, 0)
            error = (1 / (1 + np.exp(-np.clip(active @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (hidden > 0)
            slopes = [z[rows].T @ back + DECAY * params[0], back.sum(axis=0), active.T @ error + DECAY * params[2], error.sum()]
            for k, (p, g) in enumerate(zip(params, slopes)):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    return net


def fit_temperature(net: Network, x: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, between 0.25 and 8."""
    if len(np.unique(y)) < 2:
        return 1.0
    logit = net.logits(x)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    return float(min(grid, key=lambda t: np.mean(np.logaddexp(0, -(2 * y - 1) * logit / t))))


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, bound: int) -> DataFrame:
    """(doc_id, label, fold) of at most ``bound`` labelled ids outside the held-out fold, the first by hash.

    An id that is labelled more than once has its largest label; null ids and labels don't count.
    """
    fold = fold_of(id_col, FOLDS)
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).withColumn("fold", fold)
    known = rows.where(F.col("fold") != HELD_OUT).groupBy(F.col(id_col).alias("doc_id"), "fold").agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    label_id_col: str = "doc_id", sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Only texts go into a score. Rows with crc32(id as text) mod 5 = 0 are held
    out: their labels are never read. A null text counts as empty and is scored
    like any text without words; rows that repeat come out as often; a null id
    counts as empty text for the fold. An id that stands on several
    labelled rows trains once, by the text with the smallest features. Runs over 256 bytes count as
    several tokens. Without labels of both kinds every score is the share of label 1, smoothed. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    vectors = word_vectors(context_sums(rows))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vectors)  # BUCKETS x DIMS
    chosen = stored(labelled_sample(labels, label_col, label_id_col, sample), "labelled")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(3), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "fold", "label", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    known = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "fold", "label", "text").mapInArrow(  # at most `sample` rows
        features, f"doc_id {kind}, fold long, label int, x binary"
    ).groupBy("doc_id").agg(F.min(F.struct("x", "fold", "label")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(known["x"]), np.float32).reshape(-1, WIDTH)
    y, fit = known["label"].to_numpy(np.float64), (known["fold"] != CALIBRATION).to_numpy(bool)
    net = fit_network(x[fit], y[fit])
    net.temperature = fit_temperature(net, x[~fit], y[~fit])
    model = sc.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.scores(pooled(batch.column(1), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
