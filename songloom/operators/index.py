"""A vector index that is saved, reread, searched and appended to.

Vectors are grouped by nearest centroid into cells; a table of the vectors,
partitioned by cell, lies in a folder beside small tables of centroids and code
books. Next to each vector lies its product-quantised code: the residual to the
centroid, cut into parts, each replaced by the number of its nearest code word.

* ``search`` is exact. A query first meets the cell nearest to it; the k-th
  distance found there travels with it, and only blocks that the triangle
  inequality cannot rule out under that distance are visited.
* ``search_codes`` takes distances to what the codes stand for, in the nearest
  cells, and measures a fixed number of vectors exactly, those with the least.
* ``append`` assigns cells and codes by the stored centroids and books, and adds
  rows for ids the index lacks. Nothing that is there is written again.

Blocks, at most ``BLOCK`` vectors of a cell each, are gathered into bundles. A
query that visits blocks of a bundle is sent there once, whatever their number;
a task holds one bundle, and a part of the queries streams past in Arrow
batches. Only visited blocks are read: with few queries their cells are named in
the scan's partition filter.

Vectors that are null, empty, of another length than the index (the greatest when built), or hold
a null or non-finite component are left out, of an index as of the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songloom.functions.vectors import is_sound, squared_l2
from songloom.operators.neighbours import QUERY_ROWS, Screen, distance_bounds, nearest_rows
from songloom.operators.prepare import pending
from songloom.session import cut_lineage

BLOCK = 20_000
BUNDLE = 100_000  # wanted vectors of a bundle
FULL_BUNDLE = 1000  # bundles are not made smaller to keep more cores busy
SAMPLE = 20_000  # rows that centroids and code books are fitted on
CELL_ROWS = 1000  # wanted size of a cell
PARTS, WORDS = 16, 256  # parts of a code, words of a code book
NAMED_CELLS = 2000  # most cells a scan names in its filter
FOUND = "query_id {q}, neighbour_id {c}, distance double, measured bigint"


def clean(rows: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, vector) of the rows (id, embedding) that can be searched."""
    rows = rows.filter(is_sound(F.col("embedding")))
    return (rows if dim is None else rows.filter(F.size("embedding") == dim)).select("id", F.col("embedding").cast("array<double>").alias("vector"))


def stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row."""
    return ((centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)).argmin(1)


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Up to k centres of the rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[np.sort(rng.permutation(len(distinct))[:k])]
    for _ in range(rounds):
        own = nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


class Coder:
    """Centroids and code books, small enough for every task."""

    def __init__(self, centroids: np.ndarray, books: list[np.ndarray]):
        self.centroids, self.books = centroids, books
        self.bounds = np.cumsum([0, *[b.shape[1] for b in books]])

    @classmethod
    def fit(cls, x: np.ndarray, cells: int) -> Coder:
        centroids = lloyd(x, cells)
        rest = x - centroids[nearest(x, centroids)]
        return cls(centroids, [lloyd(part, WORDS, seed=4 + i) for i, part in enumerate(np.array_split(rest, min(PARTS, x.shape[1]), axis=1))])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, distances to their centroids, and codes."""
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        codes = np.stack([nearest(part, book) for part, book in zip(self.parts(rest), self.books)], axis=1)
        return cell.astype(np.int32), np.sqrt((rest * rest).sum(1)), codes.astype(np.uint8)

    def decode(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1) + self.centroids[cells]


class Layout:
    """The blocks of an index: cells, ranges of the distances to the centroids, and bundles."""

    def __init__(self, blocks: list, cores: int):
        blocks = sorted(blocks, key=lambda r: (r["cell"], r["block"]))
        self.cell, self.block, self.inner, self.outer = (np.array([r[c] for r in blocks]) for c in ("cell", "block", "inner", "outer"))
        rows = np.array([r["rows"] for r in blocks], dtype=np.int64)
        self.parts = bundles(int(rows.sum()), cores)
        self.bundle = ((np.cumsum(rows) - rows) // max(1, -(-int(rows.sum()) // self.parts))).astype(np.int32)
        self.number = {(int(c), int(b)): i for i, (c, b) in enumerate(zip(self.cell, self.block))}


def bundles(rows: int, cores: int) -> int:
    """Bundles of so many rows: as many as keep the cores busy with as many parts of queries, more where they would outgrow a task."""
    return max(1, -(-rows // BUNDLE), min(rows // FULL_BUNDLE, int(np.ceil((4 * cores) ** 0.5))))


class VectorIndex:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.schema("part int, word int, centre array<double>").parquet(f"{folder}/books").orderBy("part", "word").collect()  # PARTS x WORDS and the centroids
        grouped: dict[int, list] = {}
        for r in rows:
            grouped.setdefault(r["part"], []).append(r["centre"])
        centroids = np.array(grouped.pop(-1, np.zeros((0, 0))), dtype=np.float64)
        self.coder = Coder(centroids, [np.array(grouped[p]) for p in sorted(grouped)])
        self.dim = centroids.shape[1]
        self.id_type = spark.read.parquet(f"{folder}/ids").schema["id"].dataType.simpleString()

    @property
    def vectors(self) -> DataFrame:
        """The stored rows (id, vector, to_centroid, code, block, cell)."""
        shape = f"id {self.id_type}, vector array<double>, to_centroid double, code binary, block int, cell int"
        return self.spark.read.schema(shape).parquet(f"{self.folder}/vectors")

    @classmethod
    def build(cls, rows: DataFrame, folder: str, cells: int | None = None) -> VectorIndex:
        """A new index of the rows (id, embedding).

        Centroids and books are fitted on at most SAMPLE rows, chosen by a hash of the id; every row is indexed. There
        is a cell for every CELL_ROWS rows, and at least eight.
        """
        spark = rows.sparkSession
        first = rows.filter(is_sound(F.col("embedding"))).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        usable = clean(rows, first["dim"] or 0)
        some = usable.orderBy(F.md5(F.col("id").cast("string")), "id").limit(SAMPLE).toArrow()  # bounded by SAMPLE
        x = stacked(some["vector"].combine_chunks()) if some.num_rows else np.zeros((0, 1))
        wanted = cells or max(8, first["n"] // CELL_ROWS)
        coder = Coder.fit(x, min(wanted, max(8, len(x) // 8))) if len(x) else Coder(np.zeros((0, 1)), [])
        kept = [(-1, i, c.tolist()) for i, c in enumerate(coder.centroids)]
        kept += [(p, i, w.tolist()) for p, book in enumerate(coder.books) for i, w in enumerate(book)]
        spark.createDataFrame(kept, "part int, word int, centre array<double>").coalesce(1).write.parquet(f"{folder}/books")
        usable.select("id").limit(0).write.parquet(f"{folder}/ids")  # only the type of the ids
        _coded(usable, coder).repartition("cell", "block").write.partitionBy("cell").parquet(f"{folder}/vectors")
        return cls(spark, folder)

    def append(self, rows: DataFrame) -> None:
        """Add the rows (id, embedding) whose id the index lacks; of repeated new ids one row."""
        new = pending(clean(rows, self.dim), self.vectors.select("id"), "id").dropDuplicates(["id"])
        # written apart first: a table cannot be read and appended to in one job
        coded = cut_lineage(_coded(new, self.coder, self.blocks().agg(F.max("block")).first()[0]), "index-new")
        coded.repartition("cell", "block").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/vectors")

    def blocks(self) -> DataFrame:
        """Size and range of distances to the centroid of every block."""
        return self.vectors.groupBy("cell", "block").agg(F.count("*").alias("rows"), F.min("to_centroid").alias("inner"), F.max("to_centroid").alias("outer"))

    def in_cells(self, visits: DataFrame) -> DataFrame:
        """Stored vectors of the visited cells; where these are few, the scan's partition filter names them."""
        cells = [r["cell"] for r in visits.select("cell").distinct().limit(NAMED_CELLS + 1).collect()]
        return self.vectors.filter(F.col("cell").isin(cells)) if len(cells) <= NAMED_CELLS else self.vectors

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, neighbour_id, distance, rank, measured): the exact k nearest by squared distance.

        Ties go to the smaller id. measured is the number of stored vectors a query was compared with.
        """
        layout = Layout(self.blocks().collect(), self.spark.sparkContext.defaultParallelism)  # one row for each block
        asked = cut_lineage(clean(queries, self.dim).withColumn("limit", F.lit(float("inf"))), "index-queries")
        near = cut_lineage(self._visit(asked, layout, _own_cell, k)[0], "index-near")
        known = _best(near, k).groupBy("query_id").agg(F.max("distance").alias("edge"), F.count("*").alias("n"))
        limit = F.coalesce(F.when(F.col("n") >= k, F.col("edge")), F.lit(float("inf")))
        told = asked.drop("limit").join(known, F.col("id").eqNullSafe(F.col("query_id")), "left").select("id", "vector", limit.alias("limit"))
        return _ranked(self._visit(cut_lineage(told, "index-told"), layout, _within_limit, k)[0], k)

    def search_codes(self, queries: DataFrame, k: int, cells: float = 0.5, rerank: int = 40) -> DataFrame:
        """(query_id, neighbour_id, distance, rank, measured): the k nearest found by codes.

        A query visits the given share of the cells, nearest first, takes the distances to what all codes there stand
        for, and measures the ``rerank`` vectors with the least.
        """
        layout = Layout(self.blocks().collect(), self.spark.sparkContext.defaultParallelism)  # one row for each block
        asked = cut_lineage(clean(queries, self.dim).withColumn("limit", F.lit(float("inf"))), "index-queries")
        take = max(1, round(cells * len(self.coder.centroids)))
        near, held = self._visit(asked, layout, lambda *x: _nearest_cells(take, *x), rerank, by_codes=True)
        rough = cut_lineage(_best(near, rerank).select("query_id", "neighbour_id"), "index-rough")
        stored = held.select(F.col("id").alias("neighbour_id"), F.col("vector").alias("_v"))
        pairs = rough.join(stored, "neighbour_id").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("_q")), "query_id")
        measured = F.count("*").over(Window.partitionBy("query_id"))
        return _ranked(pairs.select("query_id", "neighbour_id", squared_l2(F.col("_q"), F.col("_v")).alias("distance")).withColumn("measured", measured), k)

    def _visit(self, asked: DataFrame, layout: Layout, choose: Callable, k: int, by_codes: bool = False) -> tuple[DataFrame, DataFrame]:
        """The k nearest of every bundle to each query (id, vector, limit), in the blocks that ``choose`` lets it visit; and the vectors of the visited cells."""
        q_type = asked.schema["id"].dataType.simpleString()
        shape = FOUND.format(q=q_type, c=self.id_type)
        if not len(layout.cell):
            return self.spark.createDataFrame([], shape), self.vectors
        sent = self.spark.sparkContext.broadcast((layout, self.coder))
        count, cores = layout.parts, self.spark.sparkContext.defaultParallelism

        def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            plan, coder = sent.value
            for batch in batches:
                for start in range(0, batch.num_rows, QUERY_ROWS):
                    piece = batch.slice(start, QUERY_ROWS)
                    yield piece, choose(stacked(piece.column(1)), piece.column(2).to_numpy(), plan, coder, slice(None))

        def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, mask in masks(batches):
                yield pa.record_batch([pa.array(np.flatnonzero(mask.any(axis=0)))], names=["number"])

        def sending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, mask in masks(batches):
                for bundle in np.unique(sent.value[0].bundle):
                    some = piece.filter(pa.array(mask[:, sent.value[0].bundle == bundle].any(axis=1)))
                    yield pa.record_batch([pa.array(np.full(some.num_rows, bundle, dtype=np.int32)), *some.columns], names=["bundle", "id", "vector", "limit"])

        numbers = [r["number"] for r in asked.mapInArrow(touched, "number bigint").distinct().collect()]  # blocks, at most all
        if not numbers:
            return self.spark.createDataFrame([], shape), self.vectors
        visited = self.spark.createDataFrame([(int(layout.cell[i]), int(layout.block[i]), int(layout.bundle[i])) for i in numbers], "cell int, block int, bundle int")
        parts = bundles(asked.count(), cores)
        columns = ["bundle", "part", "kind", "cell", "block", "id", "vector", "limit", "query_id", "code"]
        none = lambda kind: F.lit(None).cast(kind)
        held_rows = self.in_cells(visited)
        stored = held_rows.join(F.broadcast(visited), ["cell", "block"]).select(
            "bundle", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "cell", "block", "id", "vector",
            none("double").alias("limit"), none(q_type).alias("query_id"), "code",
        )
        queries = asked.mapInArrow(sending, f"bundle int, id {q_type}, vector array<double>, limit double").select(
            "bundle", F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(0).alias("cell"), F.lit(0).alias("block"),
            none(self.id_type).alias("id"), "vector", "limit", F.col("id").alias("query_id"), none("binary").alias("code"),
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plan, coder = sent.value
            key, held, bundle = None, [], None
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
                edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for a, z in zip(edges[:-1], edges[1:]):
                    part = batch.slice(a, z - a)
                    if a == z:
                        continue
                    if key is None or tuple(keys[a][:2]) != key:
                        key, held, bundle = tuple(keys[a][:2]), [], None
                    if keys[a][2] == 0:
                        held.append(part.select(["cell", "block", "id", "vector", "code"]))
                    elif held:
                        bundle = bundle or Bundle(held, plan, coder, by_codes)
                        for start in range(0, part.num_rows, QUERY_ROWS):
                            piece = part.slice(start, QUERY_ROWS)
                            q, limit = stacked(piece.column("vector")), piece.column("limit").to_numpy()
                            mask = choose(q, limit, plan, coder, bundle.numbers)
                            i, j, d, n = bundle.nearest(q, mask, k, limit.copy())
                            yield pa.record_batch([piece.column("query_id").take(pa.array(i)), bundle.ids.take(pa.array(j)), pa.array(d), pa.array(n[i])], names=["query_id", "neighbour_id", "distance", "measured"])

        rows = stored.select(*columns).unionByName(queries.select(*columns))
        return rows.repartition(max(cores, count * parts), "bundle", "part").sortWithinPartitions("bundle", "part", "kind", "id").mapInArrow(run, shape), held_rows


class Bundle:
    """The stored vectors of some blocks, by id, as a task holds them."""

    def __init__(self, held: list[pa.RecordBatch], layout: Layout, coder: Coder, by_codes: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        self.ids = table["id"].combine_chunks()
        cells = table["cell"].to_numpy()
        if not by_codes:
            self.compared = stacked(table["vector"].combine_chunks())
        else:
            codes = np.frombuffer(b"".join(table["code"].to_pylist()), dtype=np.uint8).reshape(len(cells), -1)
            self.compared = coder.decode(codes, cells)
        number = np.array([layout.number[c, b] for c, b in zip(cells.tolist(), table["block"].to_pylist())])
        self.numbers, of = np.unique(number, return_inverse=True)
        self.members = [np.flatnonzero(of == i) for i in range(len(self.numbers))]
        self.loose = not by_codes  # more than what was chosen may be compared
        self.screens: dict[int, Screen] = {}

    def screen(self, block: int) -> Screen:
        """The rows of one block, or of all."""
        if block not in self.screens:
            self.screens[block] = Screen(self.compared if block < 0 else self.compared[self.members[block]])
        return self.screens[block]

    def nearest(self, q: np.ndarray, mask: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs (i, j) of the k nearest rows to each query under its limit, their distances, and how many a query was compared with."""
        if mask.all() or (self.loose and mask.mean() > 0.5):
            return *nearest_rows(q, self.screen(-1), k, limit), np.full(len(q), len(self.compared))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for block, own in enumerate(self.members):
            asks = np.flatnonzero(mask[:, block])
            if not len(asks):
                continue
            i, j, d = nearest_rows(q[asks], self.screen(block), k, limit[asks])
            i, j, d = (np.concatenate(x) for x in zip(best, (asks[i], own[j], d)))
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            limit[i[place == k - 1]] = np.minimum(limit[i[place == k - 1]], d[place == k - 1])
            best = tuple(x[place < k] for x in (i, j, d))
        return *best, mask @ np.array([len(m) for m in self.members])


def _to_centroids(q: np.ndarray, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible distances to all centroids."""
    return tuple(np.sqrt(d) for d in distance_bounds(q, coder.centroids, coder.centroids.mean(axis=0)))


def _own_cell(q: np.ndarray, limit: np.ndarray, layout: Layout, coder: Coder, blocks) -> np.ndarray:
    """The blocks of the nearest cell that holds any."""
    filled = np.unique(layout.cell)
    return layout.cell[blocks][None, :] == filled[_to_centroids(q, coder)[1][:, filled].argmin(1)][:, None]


def _within_limit(q: np.ndarray, limit: np.ndarray, layout: Layout, coder: Coder, blocks) -> np.ndarray:
    """The blocks that the triangle inequality does not rule out under the limit."""
    least, most = (d[:, layout.cell[blocks]] for d in _to_centroids(q, coder))
    gap = np.maximum(least - layout.outer[blocks], layout.inner[blocks] - most) * (1 - 1e-9) - 1e-9
    return (gap <= 0) | (gap * gap <= limit[:, None])


def _nearest_cells(take: int, q: np.ndarray, limit: np.ndarray, layout: Layout, coder: Coder, blocks) -> np.ndarray:
    """The blocks of the ``take`` nearest cells."""
    place = _to_centroids(q, coder)[1].argsort(axis=1, kind="stable").argsort(axis=1)
    return place[:, layout.cell[blocks]] < take


def _coded(rows: DataFrame, coder: Coder, last_block: int | None = None) -> DataFrame:
    """Rows with cell, distance to its centroid, code and block. Blocks of appended rows follow those there are."""
    sent = rows.sparkSession.sparkContext.broadcast(coder)
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far, codes = sent.value.encode(stacked(batch.column(1)))
                yield pa.record_batch([*batch.columns, pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell)], names=["id", "vector", "to_centroid", "code", "cell"])

    placed = cut_lineage(rows.select("id", "vector").mapInArrow(encode, f"id {id_type}, vector array<double>, to_centroid double, code binary, cell int"), "index-coded")
    # blocks of a cell are rings around its centroid: ranges of the distance that hold about BLOCK rows each
    size = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n"), F.percentile_approx("to_centroid", [i / 64 for i in range(1, 64)], 1000).alias("steps"))
    step = F.size(F.filter("steps", lambda s: s < F.col("to_centroid")))
    ring = F.floor(step * F.col("n") / 64).cast("int") * F.lit(1 << 10) + F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 64)).cast("int")
    start = 0 if last_block is None else last_block + 1
    return placed.join(F.broadcast(size), "cell").select("id", "vector", "to_centroid", "code", (ring + F.lit(start)).cast("int").alias("block"), "cell")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return _best(found, k).select("query_id", "neighbour_id", "distance", "rank", "measured")
