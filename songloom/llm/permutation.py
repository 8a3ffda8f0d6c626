"""Approximate nearest neighbours with a permutation index.

A vector is represented by its ``length`` nearest pivots, in order. Within each
block the index is a set of inverted files: a pivot's list holds the vectors
that name it and the place they give it. A query reads the lists of its own
pivots and adds up, for each vector, how much a shared pivot takes off the
footrule distance (pivots that one side lacks stand behind the last place).
The ``share`` of a block with the least distance is ranked again by the exact
inner product of the original vectors.

Pivots are a bounded sample (``pivots`` vectors, chosen by a hash of the id);
every row is indexed. The share, not a number, is fixed, so recall does not
fall as the table grows. Measured recall at 20 on the given tables is in the
README and tests hold it above 0.9.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component take no part, nor do rows with a null id; repeated rows are
rows of their own; vectors of different lengths do not meet; ties go to the
smaller id; a query with fewer than k others gets all; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.grid import best_pairs, keep_best, prepared, usable


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length]


def search(pivots: dict[int, np.ndarray], k: int, length: int, share: float):
    def run(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, _: np.ndarray):
        own = pivots.get(q.shape[1], np.zeros((0, q.shape[1])))
        m, n = min(length, len(own)), len(x)
        order = nearest_pivots(x, own, m)
        flat = np.argsort(order.ravel(), kind="stable")
        ends = np.searchsorted(order.ravel()[flat], np.arange(len(own) + 1))
        who, worth = flat // max(m, 1), (m - flat % max(m, 1)).astype(np.int32)
        take = min(n, max(4 * k, math.ceil(share * n)))
        found: list[tuple] = []
        for i, (vector, near) in enumerate(zip(q, nearest_pivots(q, own, m))):
            shared = np.zeros(n, dtype=np.int32)
            for place, p in enumerate(near.tolist()):
                a, z = ends[p], ends[p + 1]
                shared[who[a:z]] += np.minimum(worth[a:z], m - place)
            j = np.argpartition(-shared, take - 1)[:take] if take < n else np.arange(n)
            j = j[x_row[j] != q_row[i]]
            score = (x[j] * vector).sum(axis=1)
            if len(j) > k:
                edge = np.partition(score, -k)[-k]
                j, score = j[score >= edge], score[score >= edge]
            found.append(keep_best(np.full(len(j), i), j, score, k))
        return tuple(np.concatenate(c) for c in zip(*found))

    return run


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 256, length: int = 64, share: float = 0.25) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by inner product."""
    vector = F.col(vector_col)
    nonzero = F.exists(vector, lambda x: x != 0)
    rows = prepared(vectors.filter(usable(vector) & nonzero), id_col, vector, is_query)
    chosen: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "row").limit(pivots).select("v", "dim").collect():  # bounded by pivots
        v = np.array(r["v"])
        chosen.setdefault(r["dim"], []).append(v / max(float(np.linalg.norm(v)), 1e-300))
    return best_pairs(rows, k, search({d: np.array(v) for d, v in chosen.items()}, k, length, share), "double")
