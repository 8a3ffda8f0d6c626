"""Query vectors against all vectors, in blocks.

Vectors and queries are dealt by row number into blocks of bounded size, and
every block of one meets every block of the other in a task of its own. A task
returns the best of its block for each query; a window picks the best of all.
The numbers of blocks grow with the tables, so memory does not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.llm.common import cut_lineage

BLOCK, QUERY_BLOCK = 8192, 8192
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    value = lambda x: x.cast("double")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound, F.lit(False))


def prepared(vectors: DataFrame, id_col: str, vector: Column, is_query: Column) -> DataFrame:
    """(row, vec_id, v, dim, query) written once; row numbers every row apart, whatever its id."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"), vector.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    return cut_lineage(rows.filter("vec_id is not null").withColumn("dim", F.size("v")), "grid-vectors")


def best_pairs(rows: DataFrame, k: int, search: Search, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row.

    search gets query vectors, query rows, vectors, their rows and their ids of one block pair, and returns query
    places, vector places and scores: at least the k best of each query, its own row left out. Vectors meet only
    those of their own length. Ties go to the smaller vec_id, then to the earlier row.
    """
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col("query").cast("bigint")).alias("q")).first()
    blocks, query_blocks = max(1, -(-counts["n"] // BLOCK)), max(1, -(-(counts["q"] or 0) // QUERY_BLOCK))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.withColumn("b", part(blocks)).withColumn("g", every(query_blocks)).select("dim", "b", "g", "row", "vec_id", "v")
    asked = rows.filter("query").withColumn("g", part(query_blocks)).withColumn("b", every(blocks)).select("dim", "b", "g", "row", "vec_id", "v")

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64").astype({"score": "float64"})
        queries, block = queries.sort_values("row", ignore_index=True), block.sort_values(["vec_id", "row"], ignore_index=True)
        q, x = np.stack(queries["v"].to_numpy()), np.stack(block["v"].to_numpy())
        i, j, score = search(q, queries["row"].to_numpy(), x, block["row"].to_numpy(), block["vec_id"].to_numpy())
        return pd.DataFrame({"query_row": queries["row"].to_numpy()[i], "query_id": queries["vec_id"].to_numpy()[i], "row": block["row"].to_numpy()[j], "vec_id": block["vec_id"].to_numpy()[j], "score": score})

    key = ["dim", "b", "g"]
    pairs = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(meet, f"query_row bigint, query_id bigint, row bigint, vec_id bigint, score {score_type}")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def keep_best(i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query place i; ties to the smaller vector place j."""
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i, side="left")
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep], score[keep]
