"""Quality classifier: random-indexing word vectors and a two-layer network.

Words are hashed into a fixed number of rows; each row has a random index
vector, sparse and ternary. A row's context vector is the sum of the index
vectors of the words next to it in the training sample (random indexing).
Beside its spelling, a word has a shape (letters, digits and signs, runs
folded) with rows of its own, so unseen words still carry meaning. A document
pools the context vectors of its words and shapes, the spread of its index
vectors (which shows repetition), and its length. A two-layer network scores
the pooled vector; its logits are divided by a temperature chosen on rows kept
back from training.

Fitted on a bounded sample of labelled rows (``sample``), so the tables sent
to the tasks have a fixed size. Scores read whole texts, row by row and without
a shuffle.

Defined results: a null text reads as empty; empty texts get the score of an
empty vector; labels that are null or belong to no document are left out; of
several labels for a document each counts as a row; with fewer than two classes
in the sample every score is the share of label 1 (0.5 with none); repeated rows
get the same score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, SIZE = 4096, 24
BLOCK = 1 << 20
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWERED = np.arange(256, dtype=np.uint64)
LOWERED[65:91] += np.uint64(32)
KIND = np.select(
    [(np.arange(256) >= 97) & (np.arange(256) <= 122) | (np.arange(256) >= 128), (np.arange(256) >= 65) & (np.arange(256) <= 90), (np.arange(256) >= 48) & (np.arange(256) <= 57)],
    [1, 2, 3], np.arange(256) + 4,
).astype(np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, four places set in each row."""
    rng = np.random.default_rng(20)
    out = np.zeros((2 * ROWS, SIZE), dtype=np.float32)
    for row in out:
        row[rng.choice(SIZE, 4, replace=False)] = rng.choice([-1.0, 1.0], 4)
    return out


INDEX = index_vectors()


def rows_of(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words in a block of bytes, by spelling and by shape."""
    gap = SPACE[octets]
    inner = ~gap
    first = inner & np.concatenate([[True], gap[:-1]])
    starts = np.nonzero(first)[0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(octets)) - np.repeat(starts, np.diff(np.append(starts, len(octets))).astype(np.int64))[: len(octets)] if starts[0] == 0 else None
    if place is None:
        own = np.zeros(len(octets), dtype=np.int64)
        own[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, len(octets))))
        place = np.arange(len(octets)) - own
    kinds = KIND[octets]
    fresh = inner & (first | np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    step = np.add.reduceat(np.where(inner, (LOWERED[octets] + np.uint64(1)) * (MIX ** (place % 32 + 1).astype(np.uint64)), np.uint64(0)), starts)
    turn = np.cumsum(fresh)
    rank = (turn - turn[np.maximum(place * 0 + np.arange(len(octets)) - place, 0)] + 1).astype(np.uint64)
    shape = np.add.reduceat(np.where(fresh, kinds * (MIX ** (rank % np.uint64(32) + np.uint64(1))), np.uint64(0)), starts)
    fold = lambda h: ((h ^ h >> np.uint64(29)) * MIX >> np.uint64(52)).astype(np.int64)
    return fold(step), ROWS + fold(shape)


def blocks(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of a whole text, in blocks that end between words."""
    octets = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    at = 0
    while at < len(octets):
        z = at + BLOCK
        if z < len(octets):
            later = np.nonzero(SPACE[octets[z:]])[0]
            z = z + int(later[0]) if len(later) else len(octets)
        yield rows_of(octets[at:z])
        at = z


def pooled(text: str | None, context: np.ndarray) -> np.ndarray:
    """The vector of one document."""
    total, spread, n = np.zeros((2, SIZE)), np.zeros((2, SIZE)), 0
    for words, shapes in blocks(text or ""):
        n += len(words)
        for i, rows in enumerate((words, shapes)):
            counts = np.bincount(rows, minlength=2 * ROWS)
            used = np.nonzero(counts)[0]
            total[i] += counts[used] @ context[used]
            spread[i] += counts[used] @ INDEX[used]
    mean = spread / max(n, 1)
    extra = [np.log1p(n), np.log1p(n) ** 2 / 10, *np.linalg.norm(mean, axis=1), float(n == 0)]
    return np.concatenate([total.ravel() / max(n, 1), mean.ravel(), extra])


@dataclass
class Model:
    context: np.ndarray
    layers: tuple | None
    constant: float
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(logits(self.layers, x) / self.temperature, -30, 30)))


def logits(layers: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = layers
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> tuple:
    """Full-batch Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y) / len(y)
        dh = np.outer(d, p[2]) * (1 - h * h)
        grads = [z.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return mean, scale, *p


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least logistic loss."""
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * z / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000) -> Model:
    """A model of labelled rows; ``usable`` is a condition on the label table. At most ``sample`` rows are read with their texts."""
    spark = docs.sparkSession
    marks = labels.filter(usable).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("y"))
    n = marks.count()
    if not n:
        return Model(INDEX, None, 0.5, 1.0)
    drawn = marks.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) < int(900_000 * min(1.0, sample / n)) + (100_000 if n <= sample else 0)).limit(sample)
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "key").select("key", "y", "text")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2 * ROWS, SIZE))
        for batch in batches:
            for text in batch.column(0):
                for found in blocks(text.as_py() or ""):
                    for r in found:
                        np.add.at(table, r[1:], INDEX[r[:-1]])
                        np.add.at(table, r[:-1], INDEX[r[1:]])
        used = np.nonzero(table.any(axis=1))[0]
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(list(table[used]), pa.list_(pa.float64()))], names=["row", "v"])

    sums = rows.select("text").mapInArrow(contexts, "row int, v array<double>").groupBy("row").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(SIZE)])
    context = INDEX.astype(np.float64).copy()
    for r in sums.collect():  # at most 2 * ROWS rows
        own = np.array(r[1:])
        context[r["row"]] = own / max(np.linalg.norm(own), 1e-9)
    sent = spark.sparkContext.broadcast(context)

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([pooled(t, sent.value) for t in texts])

    got = rows.select("key", "y", vector("text").alias("x")).limit(2 * sample).collect()  # bounded by the sample
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    if len(got) == 0 or len(set(y.tolist())) < 2:
        return Model(context, None, float(y.mean()) if len(got) else 0.5, 1.0)
    order = np.argsort([hash_of(r["key"]) for r in got], kind="stable")
    x, y = x[order], y[order]
    back = len(x) // 5
    temperature = calibrate(logits(train(x[back:], y[back:]), x[:back]), y[:back]) if back >= 20 and len(set(y[back:].tolist())) > 1 else 1.0
    return Model(context, train(x, y), 0.5, temperature)


def hash_of(key: int) -> int:
    return (int(key) * 2654435761 + 97) % 2**32


def scorer(docs: DataFrame, model: Model) -> Callable[[Column], Column]:
    """A function of a text column: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series(m.scores(np.array([pooled(t, m.context) for t in texts])) if len(texts) else [], dtype="float64")

    return score


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    return docs.select(F.col(id_col).alias("doc_id"), scorer(docs, model)(F.col(text_col)).alias("score"))
