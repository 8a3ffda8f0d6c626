"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments, few and long on the coarse level, more and
shorter on the fine one; each keeps its mean and deviation. For two vectors

    distance^2 >= sum over segments of length * ((mean - mean')^2 + (dev - dev')^2)

so a bound on the inner product follows from the norms. Block by block, pairs
whose bound cannot reach the k-th best found so far are left out, coarse level
first; survivors get their exact score. Nothing is left out that could count: a
pair is kept when its bound equals the k-th best, and bounds have a slack for
rounding.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows with a null id; repeated rows are rows of
their own; vectors of different lengths do not meet; ties go to the smaller id;
a query with fewer than k others gets all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.grid import best_pairs, keep_best, prepared, usable

LEVELS = (2, 8)
ROWS, COLUMNS = 512, 2048
EXACT = 2.0**52


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled by the root of its length: the bound is a distance of these."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    return np.concatenate([f(p, axis=1)[:, None] * np.sqrt(p.shape[1]) for p in parts for f in (np.mean, np.std)], axis=1)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    return np.rint(q @ x.T).astype(np.int64) if most < EXACT else q.astype(np.int64) @ x.astype(np.int64).T


def search(k: int):
    def run(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, _: np.ndarray):
        out: list[tuple] = []
        levels = [(statistics(q, s), statistics(x, s)) for s in LEVELS]
        for a in range(0, len(q), ROWS):
            qa, rows = q[a : a + ROWS], q_row[a : a + ROWS]
            least = np.full(len(qa), -np.inf)
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for b in range(0, len(x), COLUMNS):
                xb = x[b : b + COLUMNS]
                alive = rows[:, None] != x_row[None, b : b + COLUMNS]
                for of_q, of_x in levels:
                    bound = of_q[a : a + ROWS] @ of_x[b : b + COLUMNS].T
                    alive &= bound + 1e-6 * (1 + np.abs(bound)) >= least[:, None]
                use_q, use_x = np.nonzero(alive.any(axis=1))[0], np.nonzero(alive.any(axis=0))[0]
                if not len(use_q):
                    continue
                score = inner(qa[use_q], xb[use_x])
                good = alive[np.ix_(use_q, use_x)] & (score >= least[use_q][:, None])
                if not np.isfinite(least).all() and score.shape[1] > k:
                    edge = np.partition(np.where(good, score, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
                    good &= score >= edge[:, None]
                i, j = np.nonzero(good)
                best = keep_best(np.concatenate([best[0], use_q[i]]), np.concatenate([best[1], b + use_x[j]]), np.concatenate([best[2], score[i, j]]), k)
                count = np.bincount(best[0], minlength=len(qa))
                full = count >= k
                least[full] = best[2][np.cumsum(count)[full] - 1]
            out.append((a + best[0], best[1], best[2]))
        return tuple(np.concatenate(c) for c in zip(*out))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k others of greatest inner product of floor(scale * component)."""
    good = vectors.filter(usable(F.col(vector_col)))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(scale)))
    return best_pairs(prepared(good, id_col, whole, is_query), k, search(k), "bigint")
