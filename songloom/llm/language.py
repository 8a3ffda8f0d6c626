"""Language identification by nearest centroids.

A text becomes a vector of hashed byte n-grams (2 to 4, lower case, signs as
spaces), weighted by log(1 + tf) times idf and scaled to length 1. Each language
has several centroids, found by spherical k-means over its sample. A text takes
the language of the centroid with the greatest cosine; it is rejected when even
that one is far: below a share of what nearly all training texts reach.

The model is fitted on a bounded sample of labelled rows (``sample`` rows in
all, the same number for each language, chosen by a hash of the id); its size
is fixed and it is sent to the tasks. Predictions read whole texts, row by row
and without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; with no labelled row everything is ``und``; repeated rows get the
same answer; ties between languages go to the first in alphabetical order; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 4096
BLOCK = 1 << 20
FOLD = np.frombuffer(bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)), dtype=np.uint8)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    floor: float


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole text."""
    octets = FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    counts = np.zeros(DIMS, dtype=np.int64)
    for at in range(0, len(octets), BLOCK):
        b = octets[at : at + BLOCK + 3].astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        four = three[:-1] << np.uint32(8) | b[3:]
        for n, code in ((2, two), (3, three), (4, four)):
            code = code[:BLOCK]
            counts += np.bincount((code * np.uint32(2654435761) ^ np.uint32(n * 40503)) >> np.uint32(20), minlength=DIMS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of unit vectors, started far from each other."""
    centers = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centers.append(x[np.argmin(np.max(x @ np.array(centers).T, axis=1))])
    c = np.array(centers)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def build(counts: dict[str, np.ndarray], centroids: int = 4, quantile: float = 0.01, slack: float = 0.5) -> Model:
    """The model of sampled n-gram counts by language."""
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(0, int), np.ones(DIMS), np.zeros((0, DIMS)), 0.0)
    every = np.concatenate([counts[lang] for lang in languages])
    idf = (np.log((1 + len(every)) / (1 + (every > 0).sum(axis=0))) + 1).astype(np.float32)
    sets = [spherical_means(weighted(counts[lang], idf), centroids) for lang in languages]
    owner = np.repeat(np.arange(len(languages)), [len(s) for s in sets])
    c = np.concatenate(sets)
    best = (weighted(every, idf) @ c.T).max(axis=1)
    return Model(languages, owner, idf, c.astype(np.float32), slack * float(np.quantile(best, quantile)))


def fit(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 2400, centroids: int = 4) -> Model:
    """A model of the usable rows. Every language is learnt and gets the same share of ``sample`` rows, eight at least.

    So at most ``sample`` rows are taken, or eight a language if that is more.
    The distinct labels, and a few centroids of each, are held by the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), usable.alias("ok")).filter("ok and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not sizes:
        return build({})
    sample = max(sample, 8 * len(sizes))
    share = sample / len(sizes)
    chances = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 0.9 * share / n)))])
    chance = F.try_element_at(chances, F.col("lang"))

    @F.pandas_udf("binary")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([gram_counts(t).astype(np.uint32).tobytes() for t in texts])

    drawn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < chance * 1_000_000
    got: dict[str, list] = {}
    for r in rows.filter(drawn).limit(sample).select("lang", counted("text").alias("c")).collect():  # bounded by sample
        got.setdefault(r["lang"], []).append(np.frombuffer(bytes(r["c"]), dtype=np.uint32))
    return build({lang: np.array(c, dtype=np.float32) for lang, c in got.items()}, centroids)


def classifier(docs: DataFrame, model: Model) -> Callable[[Column], Column]:
    """A function of a text column: struct(lang_pred, score, rejected)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        m = sent.value
        names, scores = [], []
        for text, ok in zip(texts, letters):
            if not ok or not m.languages:
                names.append("und")
                scores.append(0.0)
                continue
            near = m.centroids @ weighted(gram_counts(text), m.idf)
            by_lang = np.array([near[m.owner == i].max() for i in range(len(m.languages))])
            best = int(np.argmax(by_lang))
            names.append(m.languages[best])
            scores.append(float(min(max(by_lang[best], 0.0), 1.0)))
        far = [n == "und" or s < m.floor for n, s in zip(names, scores)]
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": far})

    return lambda text: predict(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row."""
    found = docs.select(F.col(id_col).alias("doc_id"), classifier(docs, model)(F.col(text_col)).alias("p"))
    return found.select("doc_id", "p.lang_pred", "p.score", "p.rejected")
