"""Nearest neighbours: exact for any query count, and approximate by cells.

A small query set is sent to every task as one matrix. Each task keeps the
best k per query over all its batches, so at most k rows per query and task
are shuffled. A larger query set is dealt into blocks, as is the corpus, and
every pair of blocks is one group. A row is sent once for each block of the
other side; a table searched with its own rows is dealt once, and a pair of its
blocks searched both ways. The blocks are as many as the cluster keeps busy, more
only where they would outgrow a task. The approximate search groups vectors by their
nearest pivot, and a query visits the nearest cells.

Matrix products only pick candidates, on data moved near the origin and with
the rounding error that its lengths allow; the distances of candidates are then
summed from differences. So results do not depend on where the data lies. A
product covers a piece of the corpus at a time; the k-th distance found so far
is the limit for the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.functions.vectors import is_sound
from songloom.operators.ranking import top_per_key
from songloom.session import cut_lineage

BROADCAST_BYTES = 64 << 20
QUERY_ROWS = 512  # query rows multiplied at a time
CORPUS_ROWS = 4096  # corpus rows multiplied at a time
PIVOTS = (64, 1024)  # least and most; in between the root of the corpus size
BLOCK_ROWS = 100_000  # most rows of a block, in as many bytes as below
BLOCK_BYTES = 64 << 20
FULL_ROWS = 1000  # blocks are not made smaller to keep more cores busy
MANY = 64  # candidates, as a multiple of k, beyond which a product is made in double precision
TINY = 1e-30  # what single precision takes for nothing, where the longest row has length one
PAIRS = 100_000  # candidate pairs measured at a time
RESULT_BYTES = 48
RESULT = "query_id {q}, neighbour_id {c}, distance double"


def matrix(column: pa.Array, unit: bool = False) -> np.ndarray:
    """An Arrow list column as one matrix, rows of length one if asked."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = out.reshape(len(column), -1) if len(column) else out.reshape(0, 1)
    if unit:
        length = np.sqrt((out * out).sum(1, keepdims=True))
        out = out / np.where(length == 0, 1.0, length)
    return out


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def list_array(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def distance_bounds(a: np.ndarray, b: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible squared distances of two sets of rows, from one matrix product."""
    a, b = a - centre, b - centre
    lengths = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    d = lengths - 2.0 * (a @ b.T)
    error = lengths * (8 * (a.shape[1] + 8) * np.finfo(np.float64).eps)
    return np.maximum(d - error, 0.0), np.maximum(d + error, 0.0)


def measured(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (a[i], b[j])."""
    parts = [((a[i[s : s + PAIRS]] - b[j[s : s + PAIRS]]) ** 2).sum(1) for s in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def best_k(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Nearest k rows per query, ties by neighbour id."""
    rows = rows.sort_values(["query_id", "distance", "neighbour_id"])
    return rows[rows.groupby("query_id", sort=False).cumcount() < k]


def without_copies(ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows by id, with at most the k least ids of equal vectors, as ties go to the least id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], np.ascontiguousarray(rows[order])
    whole = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, same = np.unique(whole, return_inverse=True)
    by_value = np.argsort(same, kind="stable")
    grouped = same[by_value]
    keep = np.sort(by_value[np.arange(len(ids)) - np.searchsorted(grouped, grouped, side="left") < k])
    return ids[keep], rows[keep]


def block_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, known: np.ndarray | None = None) -> pd.DataFrame:
    """Best k corpus rows for each query of one block pair; none that are farther than a known k-th distance."""
    c_ids, c = without_copies(c_ids, c, k)
    screen = Screen(c)
    found = []
    for start in range(0, len(q), QUERY_ROWS):
        part = slice(start, start + QUERY_ROWS)
        i, j, d = nearest_rows(q[part], screen, k, np.full(len(q[part]), np.inf) if known is None else known[part].copy())
        found.append(pd.DataFrame({"query_id": q_ids[start + i], "neighbour_id": c_ids[j], "distance": d}))
    return pd.concat(found, ignore_index=True)


class Screen:
    """Corpus rows ready for matrix products, moved to their mean and scaled so that the longest has length one."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.centre = rows, rows.mean(axis=0)
        moved = rows - self.centre
        self.scale = np.sqrt((moved * moved).sum(1).max()) or 1.0
        self.moved = moved / self.scale
        self.lengths = (self.moved * self.moved).sum(1)
        self.sides: dict[type, np.ndarray] = {}
        self.buffers: dict[type, np.ndarray] = {}

    def error(self, kind: type) -> float:
        """Rounding error of a squared distance, as a share of the two squared lengths."""
        return 8 * (self.rows.shape[1] + 8) * float(np.finfo(kind).eps)

    def least(self, left: np.ndarray, start: int) -> np.ndarray:
        """Least possible squared distances to a piece of the rows, less what the query alone adds; kept until the next call."""
        kind = left.dtype.type
        if kind not in self.sides:
            self.sides[kind] = np.ascontiguousarray(np.column_stack([self.moved, self.lengths * (1 - self.error(kind))]).T.astype(kind))
            self.buffers[kind] = np.empty(QUERY_ROWS * CORPUS_ROWS, kind)
        piece = self.sides[kind][:, start : start + CORPUS_ROWS]
        return np.matmul(left, piece, out=self.buffers[kind][: len(left) * piece.shape[1]].reshape(len(left), -1))


def nearest_rows(q: np.ndarray, screen: Screen, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of the k nearest rows j of each q[i] within its limit, with their squared distances; ties to the smaller j.

    Products are of single precision first, and of double where that leaves too many candidates.
    """
    a = (q - screen.centre) / screen.scale
    own = (a * a).sum(1)
    left = np.column_stack([-2.0 * a, np.ones(len(a))])
    # beyond what a precision can hold it rules nothing out
    kinds = [kind for kind, most in ((np.float32, 1e30), (np.float64, 1e300)) if own.max() < most]
    area = screen.scale**2
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for start in range(0, len(screen.rows), CORPUS_ROWS):
        width = min(CORPUS_ROWS, len(screen.rows) - start)
        near = np.arange(0 if kinds else len(q) * width)
        for kind in kinds:
            error = screen.error(kind)
            least = screen.least(left.astype(kind), start)
            scaled = limit / area
            if width > k and np.isinf(limit).any():
                most = least + (screen.lengths[start : start + CORPUS_ROWS] * (2 * error)).astype(kind)
                edge = np.partition(most, k - 1, axis=1)[:, k - 1]
                scaled = np.minimum(scaled, np.maximum(edge + own * (1 + error), 0.0) + TINY)
            near = np.flatnonzero(least <= (scaled - own * (1 - error) + TINY).astype(kind)[:, None])
            if len(near) <= MANY * k * len(q):
                break
        if not len(near):
            continue
        i, j = np.divmod(near, width)
        j += start
        i, j, d = (np.concatenate(x) for x in zip(best, (i, j, measured(q, screen.rows, i, j))))
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        limit[i[place == k - 1]] = np.minimum(limit[i[place == k - 1]], d[place == k - 1])
        best = tuple(x[place < k] for x in (i, j, d))
    inside = best[2] <= limit[best[0]]
    return tuple(x[inside] for x in best)


def kth_distances(best: pd.DataFrame, q_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th distance found so far for each query; infinite while there are fewer."""
    last = best.groupby("query_id")["distance"].agg(["size", "max"])
    return last["max"].where(last["size"] >= k, np.inf).reindex(q_ids).fillna(np.inf).to_numpy()


def usable(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, embedding) of both sides whose vectors can be compared."""
    sizes = corpus.filter(is_sound(F.col("embedding"))).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "dim"))["dim"]).first()[0] or 0
    keep = is_sound(F.col("embedding")) & (F.size("embedding") == most)
    return queries.select("id", "embedding").filter(keep), corpus.select("id", "embedding").filter(keep)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "l2",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest corpus vectors of every query, both as (id, embedding).

    ``l2`` gives the squared distance; ``cosine`` the inner product of the
    normalised vectors, best first. Columns: query_id, neighbour_id, distance
    or similarity, rank. Vectors that are null, empty, hold a null or
    non-finite component, or are not of the corpus's most frequent length take
    no part.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    unit = metric == "cosine"
    alike = queries is corpus
    queries, corpus = usable(queries, corpus)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    # a task holds the queries, and k results for each
    if size["n"] * ((size["dim"] or 0) * 8 + k * RESULT_BYTES) <= broadcast_bytes:
        found = _scan_all(queries, corpus, k, unit)
    else:
        # written once: the rows are counted and dealt out, and one side may be drawn from the other
        corpus = cut_lineage(corpus, "knn-corpus")
        found = _scan_own_blocks(corpus, k, unit) if alike else _scan_blocks(cut_lineage(queries, "knn-queries"), corpus, k, unit)
    ranked = _ranked(found, k)
    if metric == "cosine":
        return ranked.select(
            "query_id", "neighbour_id", (F.lit(1.0) - F.col("distance") / 2).alias("similarity"), "rank"
        )
    return ranked


def knn_approx(queries: DataFrame, corpus: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """Approximate squared-L2 neighbours: only the nearest cells, ``probes`` of every 64.

    The share of cells is fixed, so recall does not fall as their number grows with the corpus.
    """
    queries, corpus = usable(queries, corpus)
    found = _scan_cells(queries, corpus, k, probes)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_per_key(found, ["query_id"], [F.col("distance"), F.col("neighbour_id")], k)


def _result_schema(queries: DataFrame, corpus: DataFrame) -> str:
    return RESULT.format(
        q=queries.schema["id"].dataType.simpleString(), c=corpus.schema["id"].dataType.simpleString()
    )


def _scan_all(queries: DataFrame, corpus: DataFrame, k: int, unit: bool) -> DataFrame:
    """One pass over the corpus with the whole (size-checked) query set."""
    spark = corpus.sparkSession
    local = queries.toArrow()
    sent = spark.sparkContext.broadcast((ids_of(local["id"]), matrix(local["embedding"], unit)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = sent.value
        best = None
        for batch in batches:
            if batch.num_rows == 0 or len(q) == 0:
                continue
            known = None if best is None else kth_distances(best, q_ids, k)
            part = block_best(q_ids, q, ids_of(batch.column("id")), matrix(batch.column("embedding"), unit), k, known)
            best = part if best is None else best_k(pd.concat([best, part], ignore_index=True), k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return corpus.mapInArrow(scan, _result_schema(queries, corpus))


def _blocks(rows: DataFrame) -> int:
    """Blocks to deal the rows into: no more than keep the cores busy, unless they would outgrow a task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * (size["dim"] or 1))))
    return max(1, -(-size["n"] // most), min(size["n"] // FULL_ROWS, int(np.ceil((4 * cores) ** 0.5))))


def _dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Each row in its own block, once for each block of the other side."""
    # by the vector too, so that rows of one id can be dealt out
    placed = rows.withColumn(own, F.pmod(F.xxhash64("id", "embedding"), F.lit(n_own)).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _scan_blocks(queries: DataFrame, corpus: DataFrame, k: int, unit: bool) -> DataFrame:
    """Every block of queries with every block of the corpus, each pair in one group."""
    q_blocks, c_blocks = _blocks(queries), _blocks(corpus)
    left = _dealt(queries, "q_block", q_blocks, "c_block", c_blocks)
    right = _dealt(corpus, "c_block", c_blocks, "q_block", q_blocks)
    keys = ["q_block", "c_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pair(k, unit), _result_schema(queries, corpus))


def own_pairs(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows of each pair of blocks (low, high) of one table; a row comes once for each block."""
    dealt = _dealt(rows, "block", blocks, "other", blocks)
    return dealt.select(
        "id", "embedding", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") <= F.col("other")).alias("is_low")
    )


def _scan_own_blocks(rows: DataFrame, k: int, unit: bool) -> DataFrame:
    """A table's blocks with each other: the two of a pair meet in one group and are searched both ways."""
    pair = _pair(k, unit)

    def both(group: pa.Table) -> pa.Table:
        low, high = group.filter(group["is_low"]), group.filter(pc.invert(group["is_low"]))
        if len(group) == len(low) and group["low"][0] == group["high"][0]:
            return pair(low, low)
        return pa.concat_tables([pair(low, high), pair(high, low)])

    return own_pairs(rows, _blocks(rows)).groupBy("low", "high").applyInArrow(both, _result_schema(rows, rows))


def _pair(k: int, unit: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best of one group of queries and corpus rows."""

    def pair(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows and c.num_rows:
            best = block_best(ids_of(q["id"]), matrix(q["embedding"], unit), ids_of(c["id"]), matrix(c["embedding"], unit), k)
            return pa.Table.from_pandas(best, preserve_index=False)
        return pa.table({"query_id": q["id"].slice(0, 0), "neighbour_id": c["id"].slice(0, 0), "distance": pa.array([], pa.float64())})

    return pair


def _scan_cells(queries: DataFrame, corpus: DataFrame, k: int, probes: int) -> DataFrame:
    """Join queries with the blocks of the cells nearest to them."""
    spark = corpus.sparkSession
    number = int(min(max(PIVOTS[0], corpus.count() ** 0.5), PIVOTS[1]))
    some = corpus.orderBy(F.md5(F.col("id").cast("string")), "id").limit(number).toArrow()
    pivots = matrix(some["embedding"])
    sent_pivots = spark.sparkContext.broadcast(pivots)
    id_type = corpus.schema["id"].dataType.simpleString()

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column("embedding"))
                _, most = distance_bounds(rows, sent_pivots.value, sent_pivots.value.mean(axis=0))
                yield pa.RecordBatch.from_arrays([batch.column("id"), list_array(rows), pa.array(most.argmin(1).astype(np.int32))], ["id", "embedding", "cell"])

    # kept once: the cells are read for their sizes and again for the join
    celled = cut_lineage(corpus.mapInArrow(to_cells, f"id {id_type}, embedding array<double>, cell int"))
    facts = celled.groupBy("cell").agg(F.count("*").alias("rows")).orderBy("cell").toPandas()  # one row per pivot
    cells = facts["cell"].to_numpy()
    blocks = np.maximum(1, -(-facts["rows"].to_numpy() // BLOCK_ROWS))
    sent = spark.sparkContext.broadcast((pivots[cells], cells, blocks))

    q_type = queries.schema["id"].dataType.simpleString()

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, names, n_blocks = sent.value
        for batch in batches if len(centres) else ():
            for start in range(0, batch.num_rows, QUERY_ROWS):
                piece = batch.slice(start, QUERY_ROWS)
                rows = matrix(piece.column("embedding"))
                _, most = distance_bounds(rows, centres, pivots.mean(axis=0))
                i, j = np.nonzero(most.argsort(1).argsort(1) < -(-len(centres) * probes // PIVOTS[0]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id").take(pa.array(i)), list_array(rows[i]), pa.array(names[j].astype(np.int32)), pa.array(n_blocks[j].astype(np.int32))],
                    ["id", "embedding", "cell", "n_blocks"],
                )

    visits = cut_lineage(
        queries.mapInArrow(to_visits, f"id {q_type}, embedding array<double>, cell int, n_blocks int")
    )
    # both sides of a cell are cut into blocks; each block pair is one group
    asked = visits.groupBy("cell").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("q_blocks"), F.max("n_blocks").alias("c_blocks")
    )
    counts = {r["cell"]: (r["q_blocks"], r["c_blocks"]) for r in asked.collect()}
    if not counts:
        return spark.createDataFrame([], _result_schema(queries, corpus))
    per_cell = spark.createDataFrame([(c, q, b) for c, (q, b) in counts.items()], "cell int, q_blocks int, c_blocks int")

    def own_block(count: str):
        return F.pmod(F.xxhash64(F.col("id")), F.col(count)).cast("int")

    def other_blocks(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = (
        visits.join(F.broadcast(per_cell), "cell")
        .withColumn("q_block", own_block("q_blocks"))
        .withColumn("c_block", other_blocks("c_blocks"))
        .select("cell", "q_block", "c_block", "id", "embedding")
    )
    right = (
        celled.join(F.broadcast(per_cell), "cell")
        .withColumn("c_block", own_block("c_blocks"))
        .withColumn("q_block", other_blocks("q_blocks"))
        .select("cell", "q_block", "c_block", "id", "embedding")
    )
    keys = ["cell", "q_block", "c_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pair(k, False), _result_schema(queries, corpus))


def recall(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    hit = approx.select("query_id", "neighbour_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "neighbour_id"], "left").agg(
        F.lit(k).alias("k"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")
    )
