"""A classifier chosen by validation accuracy and kept as an artefact.

Candidates are class-weighted softmax regressions: one path for each strength of
regularisation, along which the number of passes grows until the validation part
stops improving. A path goes on from where it stands instead of starting anew,
and one reading of the training rows serves all paths. What is kept is a few
numbers per feature and class. They enter a plan as constants, so a saved
classifier is applied inside the scan.
"""

from __future__ import annotations

import json
from collections.abc import Generator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions.numeric import is_missing
from songloom.operators import statistics as S
from songloom.session import cut_lineage

REGULARISATION = (0.001, 0.01, 0.1)
PASSES = (8, 16, 32, 64)
#: Rows in one block of training rows, so that 10,000 blocks, which Arrow moves at once, are some MB; blocks measured at once, so that their scores fit a core's cache.
BLOCK, TOGETHER = 64, 32
#: Of the descent: steps remembered, when to stop, tries at one step, and the two conditions on a step.
MEMORY, TOLERANCE, WINDOW, TRIES = 10, 1e-6, 20, 10
FALL, BEND = 1e-4, 0.9

Measured = tuple[float, np.ndarray]


@dataclass(frozen=True)
class Classifier:
    """Weights by class over z-scored features, and how they were chosen."""

    features: list[str]
    means: list[float]
    stds: list[float]
    labels: list[str]
    weights: list[list[float]]
    intercepts: list[float]
    regularisation: float
    passes: int
    accuracy: float | None

    def predict(self, df: DataFrame) -> DataFrame:
        """The table with ``predicted`` and its ``confidence``; null where a feature is missing or infinite.

        Equal scores go to the first label in order of the text.
        """
        z = {f"_z{i}": (F.col(f).cast("double") - m) / (s + fixed.EPSILON) for i, (f, m, s) in enumerate(zip(self.features, self.means, self.stds))}
        scores = F.array(*[_line(list(z), w, b) for w, b in zip(self.weights, self.intercepts)])
        rows = df.withColumns(z).withColumn("_scores", F.when(_complete(self.features), scores))
        top = F.array_max("_scores")
        mass = F.aggregate("_scores", F.lit(0.0), lambda total, x: total + F.exp(x - top))
        names = F.array(*[F.lit(x) for x in self.labels])
        best = F.when(F.col("_scores").isNotNull(), F.element_at(names, F.array_position("_scores", top).cast("int")))
        return rows.withColumns({"predicted": best, "confidence": 1.0 / mass}).drop("_scores", *z)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Write the classifier as one line of JSON; one that is there already is never overwritten."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.text(folder)


def load(spark: SparkSession, folder: str) -> Classifier:
    return Classifier(**json.loads(spark.read.text(folder).first()["value"]))


def _line(columns: list[str], weights: list[float], start: float) -> Column:
    out = F.lit(float(start))
    for c, w in zip(columns, weights):
        out = out + F.col(c) * F.lit(float(w))
    return out


def _complete(features: list[str]) -> Column:
    ok = F.lit(True)
    for f in features:
        x = F.col(f).cast("double")
        ok = ok & ~is_missing(x) & (F.abs(x) < float("inf"))
    return ok


def accuracy(df: DataFrame, label: str) -> float | None:
    """Share of rows whose prediction is their label, over rows with both; none without such a row.

    The average leaves out rows without either; a filter on the prediction would work out all scores a second time.
    """
    return df.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


@dataclass
class _Path:
    """One strength of regularisation: the points reached so far, one per pass, and where to measure next (none at the end)."""

    regularisation: float
    points: list[np.ndarray] = field(default_factory=list)
    walk: Generator[np.ndarray, Measured, None] | None = None
    asked: np.ndarray | None = None

    def begin(self, start: np.ndarray) -> None:
        self.walk = _descend(self.points, start)
        self.asked = next(self.walk)

    def told(self, loss: float, slope: np.ndarray) -> None:
        try:
            self.asked = self.walk.send((loss, slope))
        except StopIteration:
            self.asked = None

    def wants(self, steps: int) -> bool:
        return self.asked is not None and len(self.points) <= steps


def _descend(points: list[np.ndarray], x: np.ndarray) -> Generator[np.ndarray, Measured, None]:
    """Limited-memory BFGS: yields where to measure, is sent loss and slope there, and adds each point it reaches.

    Steps and stops are those of Spark's ``LogisticRegression``, so after k
    passes it stands where a fit of its own with k passes would.
    """
    loss, slope = yield x
    points.append(x)
    first, losses, kept = loss, [], []
    while np.linalg.norm(slope) > max(TOLERANCE * abs(loss), 1e-8):
        way = _direction(slope, kept)
        found = yield from _step(x, loss, slope, way, 1.0 / np.linalg.norm(way) if len(points) == 1 else 1.0)
        if found is None and not kept:
            return
        if found is None:  # once more, straight downhill
            kept = []
            continue
        moved, loss, steeper = found
        kept = [(moved - x, steeper - slope), *kept][:MEMORY]
        x, slope = moved, steeper
        points.append(x)
        losses = [*losses, loss][-WINDOW:]
        if len(losses) == WINDOW and abs(loss - max(losses)) <= TOLERANCE * abs(first):
            return


def _direction(slope: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill, bent by the last steps and the changes of slope along them (newest first)."""
    way, shares = slope.copy(), []
    for step, change in kept:
        shares.append(step @ way / (step @ change))
        way -= shares[-1] * change
    if kept:
        step, change = kept[0]
        way *= step @ change / (change @ change)
    for (step, change), share in zip(reversed(kept), reversed(shares)):
        way += (share - change @ way / (step @ change)) * step
    return -way


def _step(x: np.ndarray, loss: float, slope: np.ndarray, way: np.ndarray, t: float) -> Generator[np.ndarray, Measured, tuple | None]:
    """The point, loss and slope of a step that meets the strong Wolfe conditions; none if a few tries find none.

    A try is (length, loss, slope along the way, point, slope there).
    """
    fall = slope @ way
    if not fall < 0:
        return None
    start = low = (0.0, loss, fall, x, slope)
    high = None
    for i in range(TRIES):
        point = x + t * way
        at, there = yield point
        tried = (t, at, there @ way, point, there)
        if not np.isfinite(at):
            t /= 2
            continue
        if at > loss + FALL * t * fall or (at >= low[1] and i > 0):
            high = tried
            break
        if abs(tried[2]) <= BEND * abs(fall):
            return _long_enough(tried, start)
        if tried[2] >= 0:
            low, high = tried, low
            break
        low, t = tried, t * 1.5
    for _ in range(TRIES if high else 0):
        t = _between(*sorted((low, high), key=lambda b: b[0]))
        point = x + t * way
        at, there = yield point
        tried = (t, at, there @ way, point, there)
        if at > loss + FALL * t * fall or at >= low[1]:
            high = tried
            continue
        if abs(tried[2]) <= BEND * abs(fall):
            return _long_enough(tried, start)
        if tried[2] * (high[0] - low[0]) >= 0:
            high = low
        low = tried
    return None


def _long_enough(tried: tuple, start: tuple) -> tuple | None:
    return tried[3:4] + tried[1:2] + tried[4:5] if tried[0] * np.linalg.norm(start[4]) >= 1e-10 else None


def _between(left: tuple, right: tuple) -> float:
    """Where the cubic through two tries is lowest, away from both ends."""
    width = right[0] - left[0]
    d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
    with np.errstate(invalid="ignore"):
        d2 = np.sqrt(d1 * d1 - left[2] * right[2])
    t = right[0] - width * (right[2] + d2 - d1) / (right[2] - left[2] + 2 * d2)
    return float(np.clip(t, left[0] + 0.1 * width, left[0] + 0.9 * width)) if np.isfinite(t) else left[0] + 0.5 * width


def _packed(train: DataFrame, features: list[str], labels: list[str], shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Blocks of training rows; a row is its scaled features and the place of its label."""
    place = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(float(i)))])
    moved, times = np.append(shift, 0.0), np.append(scale, 1.0)

    def pack(batches):
        for batch in batches:
            rows = (np.column_stack([c.to_numpy() for c in batch.columns]) - moved) * times
            yield pa.RecordBatch.from_pydict({"block": [rows[i : i + BLOCK].tobytes() for i in range(0, len(rows), BLOCK)]}, pa.schema([("block", pa.binary())]))

    return train.select(*features, place[F.col("label")].alias("_place")).mapInArrow(pack, "block binary")


def _losses(blocks: DataFrame, points: list[np.ndarray], by_class: np.ndarray) -> np.ndarray:
    """The weighted loss at each point over all rows, then the slopes, in one reading.

    Each task returns one short row of sums, added in order of the tasks.
    """
    n, k = len(points), len(by_class)
    weights = np.concatenate([p.reshape(k, -1) for p in points])

    def measure(batches):
        loss, slope = np.zeros(n), np.zeros_like(weights)
        for batch in batches:
            for i in range(0, len(batch), TOGETHER):
                rows = np.frombuffer(b"".join(batch.column(0)[i : i + TOGETHER].to_pylist())).reshape(-1, weights.shape[1])
                x, y, each = rows[:, :-1], rows[:, -1].astype(int), np.arange(len(rows))
                w = by_class[y]
                scores = (weights[:, :-1] @ x.T + weights[:, -1:]).reshape(n, k, -1)
                scores -= scores.max(axis=1, keepdims=True)
                own = scores[:, y, each]
                np.exp(scores, out=scores)
                mass = scores.sum(axis=1)
                loss += (np.log(mass) - own) @ w
                scores *= (w / mass)[:, None]
                scores[:, y, each] -= w
                off = scores.reshape(n * k, -1)
                slope[:, :-1] += off @ x
                slope[:, -1] += off.sum(axis=1)
        yield pa.RecordBatch.from_pydict({"sums": [np.append(loss, slope).tolist()]})

    parts = blocks.mapInArrow(measure, "sums array<double>").collect()
    return np.sum([r["sums"] for r in parts], axis=0)


def choose(
    rows: DataFrame,
    label: str,
    split: str = "split",
    features: list[str] = fixed.FEATURES,
    regularisation: tuple[float, ...] = REGULARISATION,
    passes: tuple[int, ...] = PASSES,
    patience: int = 1,
    min_gain: float = 1e-4,
) -> tuple[Classifier, list[Classifier]]:
    """The best candidate on the ``val`` rows, and every candidate tried.

    Learns from ``train`` rows alone, each weighted by the inverse frequency of
    its class. A path ends after ``patience`` numbers of passes in a row that
    gain less than ``min_gain``. Ties go to the candidate listed first: the
    weaker regularisation, then fewer passes. Without a usable validation row
    the accuracy is none and the first candidate is taken.

    A candidate of more passes goes on from the one before, and all paths share
    each reading of the training rows.

    Rows without a label, or with a missing or infinite feature, neither train
    nor count; ``train`` rows must hold two classes or more, or it is an error.
    The list of classes is driver-sized by nature; rows never leave the tasks.
    """
    spark = rows.sparkSession
    usable = rows.filter(F.col(label).isNotNull() & _complete(features)).select(
        F.col(label).cast("string").alias("label"), F.col(split).alias("split"), *[F.col(f).cast("double").alias(f) for f in features]
    )
    # written once: every pass of every candidate reads it
    usable = cut_lineage(usable.filter(F.col("split").isin("train", "val")), "classifier-rows")
    train, val = usable.filter("split = 'train'"), usable.filter("split = 'val'")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}
    if len(counts) < 2:
        raise ValueError(f"training rows hold {len(counts)} classes; two are needed")
    facts = S.column_facts(train, features, population=True)
    means, stds = [facts[f]["mean"] for f in features], [facts[f]["std"] for f in features]
    labels, total = list(counts), sum(counts.values())
    by_class = np.array([total / (len(counts) * n) for n in counts.values()])
    scaled = [(F.col(f) - m) / (s + fixed.EPSILON) for f, m, s in zip(features, means, stds)]
    weight = F.create_map(*[x for name, w in zip(labels, by_class) for x in (F.lit(name), F.lit(float(w)))])
    # the descent runs over features scaled by their weighted spread
    ready = train.select(array_to_vector(F.array(*scaled)).alias("x"), weight[F.col("label")].alias("w"))
    spread = ready.agg(Summarizer.metrics("mean", "std").summary(F.col("x"), F.col("w")).alias("s")).first()["s"]
    middle, std = spread["mean"].toArray(), spread["std"].toArray()
    narrow = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
    unit = np.array(stds) + fixed.EPSILON
    # kept between readings, as they are read many times; what is lost is packed again from the written rows
    blocks = _packed(train, features, labels, np.array(means) + middle * unit, narrow / unit).persist()

    def measure(paths: list[_Path]) -> None:
        sums = _losses(blocks, [p.asked for p in paths], by_class) / (by_class @ list(counts.values()))
        for p, loss, slope in zip(paths, sums[: len(paths)], np.split(sums[len(paths) :], len(paths))):
            free = np.hstack([p.asked.reshape(len(labels), -1)[:, :-1] * narrow, np.zeros((len(labels), 1))])
            p.told(loss + p.regularisation / 2 * (free**2).sum(), slope + p.regularisation * (free * np.append(narrow, 0.0)).ravel())

    def candidate(path: _Path, steps: int) -> Classifier:
        at = path.points[min(steps, len(path.points) - 1)].reshape(len(labels), -1)
        weights = at[:, :-1] * narrow
        starts = at[:, -1] - weights @ middle
        return Classifier(features, means, stds, labels, weights.tolist(), (starts - starts.mean()).tolist(), path.regularisation, steps, None)

    paths = [_Path(reg) for reg in regularisation]
    tried: list[list[Classifier]] = [[] for _ in paths]
    best, waited = [None] * len(paths), [0] * len(paths)
    try:
        for p in paths:
            p.begin(np.zeros(len(labels) * (len(features) + 1)))
        for steps in passes:
            live = [i for i in range(len(paths)) if not tried[i] or waited[i] < patience]
            while going := [paths[i] for i in live if paths[i].wants(steps)]:
                measure(going)
            for i in live:
                made = candidate(paths[i], steps)
                made = replace(made, accuracy=accuracy(made.predict(val), "label"))
                tried[i].append(made)
                gained = best[i] is None or (made.accuracy or 0.0) >= best[i] + min_gain
                best[i], waited[i] = max(best[i] or 0.0, made.accuracy or 0.0), 0 if gained else waited[i] + 1
    finally:
        blocks.unpersist()
    listed = [c for path in tried for c in path]
    return max(listed, key=lambda c: c.accuracy or 0.0), listed
