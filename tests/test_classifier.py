"""The classifier chosen by validation accuracy."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from songloom.operators import classifier

FEATURES = ["a", "b"]
SCHEMA = "id int, label string, split string, a double, b double"


def rows(n=400):
    """Three classes on a ring, one of them rare, and rows that no model can use."""
    rng = random.Random(3)
    centres = {"north": (0.0, 4.0), "east": (4.0, -2.0), "west": (-4.0, -2.0)}
    out = []
    for i in range(n):
        label = "west" if i % 20 == 0 else "north" if i % 2 else "east"
        x, y = centres[label]
        out.append((i, label, ("train", "train", "val", "test")[(i // 20) % 4], rng.gauss(x, 0.8), rng.gauss(y, 0.8)))
    odd = [(n, None, "train", 0.0, 0.0), (n + 1, "north", "train", None, 1.0), (n + 2, "north", "val", float("nan"), 1.0),
           (n + 3, "east", "test", float("inf"), 1.0), (n + 4, "unseen", "val", 0.0, 4.0), (n + 5, "north", None, 0.0, 4.0)]
    return out + odd


@pytest.fixture(scope="module")
def chosen(spark):
    return classifier.choose(spark.createDataFrame(rows(), SCHEMA), "label", features=FEATURES, regularisation=(0.01, 10.0), passes=(2, 4, 8, 16))


def test_best_on_validation_is_kept(chosen):
    best, tried = chosen
    assert best.labels == ["east", "north", "west"]
    assert best.accuracy == max(c.accuracy for c in tried) and best in tried
    # the unseen class counts against the model; it is one of 101 usable rows
    usable = [r for r in rows() if r[2] == "val" and r[3] is not None and r[3] == r[3]]
    assert 0.9 < best.accuracy <= 1 - 1 / len(usable)


def test_a_path_ends_once_it_gains_nothing(chosen):
    _, tried = chosen
    for reg in (0.01, 10.0):
        path = [c.accuracy for c in tried if c.regularisation == reg]
        assert 2 <= len(path) <= 4
        gains = [b >= max(path[: i + 1]) + 1e-4 for i, b in enumerate(path[1:])]
        assert all(gains[:-1])


def test_kept_classifier_predicts_like_plain_arithmetic(spark, chosen, tmp_path):
    best, _ = chosen
    folder = str(tmp_path / "model")
    best.save(spark, folder)
    kept = classifier.load(spark, folder)
    assert kept == best
    with pytest.raises(Exception, match="(?i)exists"):
        best.save(spark, folder)
    got = {r.id: r for r in kept.predict(spark.createDataFrame(rows(), SCHEMA).withColumn("rank", F.lit(1))).collect()}
    for i, _, _, a, b in rows():
        if a is None or not np.isfinite(a):
            assert got[i].predicted is None and got[i].confidence is None
            continue
        z = (np.array([a, b]) - best.means) / (np.array(best.stds) + 1e-8)
        score = np.array(best.weights) @ z + best.intercepts
        assert got[i].predicted == best.labels[int(score.argmax())]
        assert got[i].confidence == pytest.approx(1 / np.exp(score - score.max()).sum(), rel=1e-5)


def test_rare_class_is_not_lost(spark, chosen):
    found = chosen[0].predict(spark.createDataFrame(rows(), SCHEMA)).filter("label = 'west' AND split = 'test'")
    assert found.count() > 0 and found.filter("predicted <> 'west'").count() == 0


def test_no_validation_rows_and_too_few_classes(spark):
    table = spark.createDataFrame(rows(), SCHEMA)
    best, tried = classifier.choose(table.filter("split = 'train'"), "label", features=FEATURES, regularisation=(0.01,), passes=(2, 4))
    assert best == tried[0] and best.accuracy is None
    with pytest.raises(ValueError, match="1 classes"):
        classifier.choose(table.filter("label = 'north'"), "label", features=FEATURES)
    with pytest.raises(ValueError, match="0 classes"):
        classifier.choose(table.limit(0), "label", features=FEATURES)
    assert best.predict(table.limit(0)).count() == 0


STRENGTHS, PASSES = (0.0001, 0.01, 1.0), (3, 6, 12, 24)


@pytest.fixture(scope="module")
def every(spark):
    """All candidates, none left out for want of gain, and the jobs they took."""
    table = spark.createDataFrame(mixed(), SCHEMA)
    spark.sparkContext.setJobGroup("classifier-choice", "")
    _, tried = classifier.choose(table, "label", features=FEATURES, regularisation=STRENGTHS, passes=PASSES, patience=9)
    spark.sparkContext.setJobGroup("other", "")
    return table, tried, len(spark.sparkContext.statusTracker().getJobIdsForGroup("classifier-choice"))


def mixed(n=600):
    """Classes that overlap, so that a descent is long; one feature spread far wider than the other."""
    rng = random.Random(11)
    out = []
    for i in range(n):
        label = "west" if i % 9 == 0 else "north" if i % 2 else "east"
        x = {"north": 0.0, "east": 1.0, "west": 2.0}[label] + rng.gauss(0, 1)
        out.append((i, label, ("train", "train", "val")[i // 20 % 3], x, 300 * (rng.random() - x * x)))
    return out


def test_candidates_share_readings_of_the_training_rows(every):
    _, tried, jobs = every
    assert [(c.regularisation, c.passes) for c in tried] == [(r, p) for r in STRENGTHS for p in PASSES]
    # up to 135 passes if each candidate starts anew, each a job: 167 jobs then; two jobs measure each of the twelve
    assert jobs < 24 + 60


def test_a_candidate_is_what_a_fit_of_its_own_gives(every):
    table, tried, _ = every
    train = [r for r in mixed() if r[2] == "train"]
    counts = {x: sum(r[1] == x for r in train) for x in tried[0].labels}
    weight = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, len(train) / (len(counts) * n))])
    place = F.create_map(*[F.lit(x) for i, name in enumerate(counts) for x in (name, float(i))])
    z = F.array(*[(F.col(f) - m) / (s + 1e-8) for f, m, s in zip(FEATURES, tried[0].means, tried[0].stds)])
    rows = table.filter("split = 'train'").select(array_to_vector(z).alias("x"), place[F.col("label")].alias("y"), weight[F.col("label")].alias("w"))
    for c in tried:
        fit = LogisticRegression(
            featuresCol="x", labelCol="y", weightCol="w", family="multinomial", regParam=c.regularisation, maxIter=c.passes, standardization=False
        ).fit(rows)
        assert np.allclose(c.weights, fit.coefficientMatrix.toArray(), rtol=1e-5, atol=1e-7)
        assert np.allclose(c.intercepts, fit.interceptVector.toArray(), rtol=1e-5, atol=1e-7)


def test_a_feature_of_one_value_gets_no_weight(spark):
    table = spark.createDataFrame(mixed(), SCHEMA).withColumn("c", F.lit(4.0))
    with_it, _ = classifier.choose(table, "label", features=[*FEATURES, "c"], regularisation=(0.01,), passes=(4,))
    without, _ = classifier.choose(table, "label", features=FEATURES, regularisation=(0.01,), passes=(4,))
    assert all(w[2] == 0 for w in with_it.weights) and with_it.accuracy == without.accuracy
    assert np.allclose([w[:2] for w in with_it.weights], without.weights)
