"""Hard negatives by coordinate pruning in length buckets.

Vectors of whole numbers are sorted by length into buckets. A bucket keeps, for
every coordinate, the list of its unit vectors sorted by that coordinate. For an
anchor with threshold ``t`` a bucket is passed over when the product of the
anchor's length and the bucket's greatest length is below ``t``. Otherwise the
angle between the two may be at most arccos(t / that product), which leaves a
range of feasible values for each coordinate: the anchor's few largest
coordinates, its focus, are looked up in the sorted lists, and only vectors that
lie in every range remain. The products over the focus plus the lengths of the
rest bound the score of these; what is still above the threshold is verified by
its exact product.

Thresholds travel. An anchor first meets its own bucket alone; the k-th best
score found there is its threshold for all others. Positives come first; the
least and greatest score a negative may have follow from them.

A bucket stays in one place: a task reads it once and lets the anchors stream
past in Arrow batches. Anchors are copied to the buckets their threshold leaves,
which, buckets being sorted, is a range of bucket numbers.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows with a null label; repeated rows and ids are
rows of their own, and a null id sorts before all others; vectors of different
lengths of array do not meet; ties go to the smaller id, then to the earlier
row; an anchor with fewer positives or negatives gets all; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.llm.common import cut_lineage, parts_of
from songloom.llm.grid import usable

BUCKET, FOCUS = 4096, 6
EXACT = 2.0**52
NONE = np.iinfo(np.int64).min


@dataclass
class Bucket:
    """Vectors of one length range with their sorted coordinate lists."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    def __post_init__(self) -> None:
        self.sizes = np.linalg.norm(self.x.astype(float), axis=1)
        unit = self.x / np.maximum(self.sizes, 1e-300)[:, None]
        self.lists = np.argsort(unit, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(unit.T, self.lists, axis=1)
        self.largest = float(self.sizes.max(initial=0.0))
        self.products = self.verified = 0

    def inner(self, q: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Exact products; floats are exact below 2**52."""
        most = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, len(q))
        part = self.x[chosen]
        return np.rint(part.astype(float) @ q.astype(float)).astype(np.int64) if most < EXACT else part @ q

    def candidates(self, q: np.ndarray, size: float, least: float) -> np.ndarray:
        """Places whose product with q could reach ``least``."""
        everything = np.arange(len(self.rows))
        if size * self.largest * (1 + 1e-9) < least:
            return everything[:0]
        if least <= 0 or size == 0:
            return everything
        cosine = min(1.0, least / (size * self.largest))
        reach = np.arccos(cosine) + 1e-7
        unit = q / size
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        inside = np.zeros(len(self.rows), dtype=np.int8)
        for f in focus:
            angle = np.arccos(np.clip(unit[f], -1.0, 1.0))
            low, high = np.cos(min(np.pi, angle + reach)) - 1e-9, np.cos(max(0.0, angle - reach)) + 1e-9
            a, z = np.searchsorted(self.values[f], low, side="left"), np.searchsorted(self.values[f], high, side="right")
            inside[self.lists[f][a:z]] += 1
        chosen = np.nonzero(inside == len(focus))[0]
        known = self.x[chosen][:, focus].astype(float)
        rest = np.sqrt(np.maximum(self.sizes[chosen] ** 2 - (known**2).sum(axis=1), 0.0)) * np.sqrt(max(size**2 - float((q[focus].astype(float) ** 2).sum()), 0.0))
        bound = known @ q[focus].astype(float) + rest
        return chosen[bound * (1 + 1e-9) + 1e-6 >= least]

    def first(self, score: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k best, ties to the smaller id, then the earlier row."""
        if len(score) > 4 * k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            keep = np.nonzero(score >= edge)[0]
        else:
            keep = np.arange(len(score))
        return keep[np.lexsort((self.rows[places[keep]], self.ids[places[keep]], -score[keep]))[:k]]


HELD = "dim int, bucket bigint, kind int, row bigint, vec_id bigint, label bigint, v array<bigint>, scores array<bigint>, least array<double>"
FOUND = "row bigint, slot int, other bigint, other_id bigint, score bigint"
Ask = Callable[[Bucket, int, int, int, np.ndarray, list, list], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def positives(k: int) -> Ask:
    """The k best others of the anchor's label."""

    def ask(b: Bucket, row: int, vec_id: int, label: int, q: np.ndarray, _: list, least: list):
        places = b.candidates(q, float(np.linalg.norm(q.astype(float))), least[0])
        b.products += len(b.rows)
        places = places[(b.labels[places] == label) & (b.rows[places] != row)]
        b.verified += len(places)
        score = b.inner(q, places)
        good = score >= least[0]
        places, score = places[good], score[good]
        best = b.first(score, places, k)
        yield 0, places[best], score[best]

    return ask


def negatives(k: int) -> Ask:
    """For each score of a positive, the k best of other labels at or below it and not under its least."""

    def ask(b: Bucket, row: int, vec_id: int, label: int, q: np.ndarray, scores: list, least: list):
        places = b.candidates(q, float(np.linalg.norm(q.astype(float))), min(least))
        b.products += len(b.rows)
        places = places[b.labels[places] != label]
        b.verified += len(places)
        score = b.inner(q, places)
        for slot, (top, low) in enumerate(zip(scores, least)):
            good = np.nonzero((score <= top) & (score >= low))[0]
            best = good[b.first(score[good], places[good], k)]
            yield slot, places[best], score[best]

    return ask


def visit(held: DataFrame, asked: DataFrame, ask: Ask, parts: int) -> DataFrame:
    """(row, slot, other, other_id, score): what ask finds for each anchor in each bucket it visits.

    held: vectors of kind 0; asked: anchors of kind 1, with the bucket each is to visit.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts_of_bucket, bucket = None, [], None
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]], len(keys)]
            found: list[list] = [[], [], [], [], []]
            for a, z in zip(edges[:-1], edges[1:]):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                if keys[a] != key:
                    key, parts_of_bucket, bucket = keys[a], [], None
                flat = part.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(z - a, -1)
                ids = np.array([NONE if i is None else i for i in part.column(4).to_pylist()], dtype=np.int64)
                columns = (part.column(3).to_numpy(), ids, part.column(5).to_numpy(), flat)
                if kinds[a] == 0:
                    parts_of_bucket.append(columns)
                    continue
                if bucket is None:
                    if not parts_of_bucket:
                        continue
                    bucket = Bucket(*(np.concatenate(c) for c in zip(*parts_of_bucket)))
                for row, vec_id, label, q, scores, least in zip(*columns, part.column(7).to_pylist(), part.column(8).to_pylist()):
                    for slot, places, score in ask(bucket, row, vec_id, label, q, scores, least):
                        for store, values in zip(found, ([row] * len(places), [slot] * len(places), bucket.rows[places].tolist(), bucket.ids[places].tolist(), score.tolist())):
                            store.extend(values)
            if found[0]:
                found[3] = [None if i == NONE else i for i in found[3]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)

    columns = [c.split()[0] for c in HELD.split(", ")]
    rows = held.select(*columns).unionByName(asked.select(*columns))
    order = ["dim", "bucket", "kind", "row"]
    return rows.repartition(parts, "dim", "bucket").sortWithinPartitions(*order).mapInArrow(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Miner:
    """Buckets of a table of vectors, and the passes over them."""

    def __init__(self, vectors: DataFrame, label: Column, is_anchor: Column, id_col: str, vector_col: str, scale: float, bucket: int):
        v = F.col(vector_col)
        whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("bigint"))
        rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.coalesce(usable(v), F.lit(False)).alias("sound"))
        rows = rows.filter("sound and label is not null").select("vec_id", "label", "v", "anchor", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"))
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        rows = cut_lineage(rows.withColumn("size", size), "lemp-vectors")
        self.parts = parts_of(vectors)
        # a bucket is a stretch of the order by length within a sorted part, cut after so many rows
        split = max(1, -(-rows.count() // bucket))
        placed = rows.repartitionByRange(split, "dim", F.desc("size"), "row").sortWithinPartitions("dim", F.desc("size"), "row")
        number = F.monotonically_increasing_id()
        piece = F.shiftright(number, 33) * (1 << 20) + F.floor(number.bitwiseAND((1 << 33) - 1) / F.lit(bucket))
        self.rows = cut_lineage(placed.withColumn("bucket", piece.cast("bigint")), "lemp-buckets")
        self.held = self.rows.select("dim", "bucket", F.lit(0).alias("kind"), "row", "vec_id", "label", "v", F.lit(None).cast("array<bigint>").alias("scores"), F.lit(None).cast("array<double>").alias("least"))
        summary = self.rows.groupBy("dim", "bucket").agg(F.max("size").alias("largest"))
        per_dim = summary.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("bucket", "largest"))).alias("buckets"))
        self.map = per_dim.select(F.map_from_entries(F.collect_list(F.struct("dim", "buckets"))))  # 16 bytes for each bucket
        self.anchors = self.rows.filter("anchor")

    def others(self, asked: DataFrame) -> DataFrame:
        """Anchors copied to the buckets, but their own, whose lengths allow their threshold."""
        every = F.element_at(F.col("every"), F.col("dim"))
        low = F.array_min("least")
        fits = lambda b: (b["bucket"] != F.col("own")) & ((low <= 0) | (F.col("size") * b["largest"] * (1 + 1e-9) >= low))
        asked = asked.withColumn("every", self.map.scalar())
        return asked.withColumn("bucket", F.explode(F.transform(F.filter(every, fits), lambda b: b["bucket"]))).drop("every")

    def search(self, asked: DataFrame, ask: Ask, k: int) -> DataFrame:
        """The k best of every slot: the own bucket first, then the others with what is known by then.

        asked: (dim, bucket, row, vec_id, label, v, size, scores, least).
        """
        near = cut_lineage(visit(self.held, asked.withColumn("kind", F.lit(1)), ask, self.parts), "lemp-own")
        known = best(near, k).groupBy("row", "slot").agg(F.min("score").alias("edge"), F.count("*").alias("n")).filter(F.col("n") >= k)
        known = known.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "edge"))).alias("edges"))
        told = asked.join(known, "row", "left").withColumn("own", F.col("bucket"))
        raised = F.transform("least", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at(F.col("edges"), i).cast("double"), low)))
        far = self.others(told.withColumn("least", raised)).withColumn("kind", F.lit(1))
        return best(near.unionByName(visit(self.held, far, ask, self.parts)), k)


def mine(
    vectors: DataFrame, label: Column, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, share: tuple[int, int] = (80, 100),
    id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, bucket: int = BUCKET,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score is at most the positive's and at least share of it.
    """
    m = Miner(vectors, label, is_anchor, id_col, vector_col, scale, bucket)
    columns = ["dim", "bucket", "row", "vec_id", "label", "v", "size"]
    nothing = F.array(F.lit(float("-inf")))
    asked = m.anchors.select(*columns, F.lit(None).cast("array<bigint>").alias("scores"), nothing.alias("least"))
    near = cut_lineage(m.search(asked, positives(k_positive), k_positive), "lemp-positives")
    listed = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("p"))
    num, den = share
    low = F.transform("p", lambda p: F.ceil(p["positive_score"] * num / F.lit(float(den))).cast("double"))
    asked = m.anchors.select(*columns).join(listed, "row").withColumn("scores", F.transform("p", lambda p: p["positive_score"])).withColumn("least", low)
    asked = cut_lineage(asked, "lemp-asked")
    far = cut_lineage(m.search(asked.drop("p"), negatives(k_negative), k_negative), "lemp-negatives")
    pair = asked.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("slot", "p")).select("row", "slot", "anchor_id", "p.positive_id", "p.positive_score")
    out = pair.join(far, ["row", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
