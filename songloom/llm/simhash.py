"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majority votes over hashed word shingles. Two are
linked when they differ in at most ``max_bits`` bits. To find all links
without comparing all pairs:

* the 64 bits are cut into ``blocks``; of ``max_bits`` differing bits, some
  block holds at most ``max_bits // blocks``;
* the anchors of a block are the words of a covering code of radius 1: a
  Hamming code on its first bits, times all values of the bits left over;
* a fingerprint is replicated to every anchor within 1 + max_bits // blocks,
  so both ends of a link meet at the anchor next to either of them;
* fingerprints are compared per anchor. An anchor sends on one star per local
  cluster, never its pairs. Anchors with very many fingerprints are cut into
  cells that are compared two by two, in different tasks.

Components come from alternating large-star and small-star steps, each a
grouping and a join, written to the shared folder.

Defined results: a null text reads as empty; a text without words has
fingerprint zero and is linked like any other; copies share a fingerprint and
are folded before anything is compared; rows with a null id get a component
but never name one (null only where a component has no other id); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import cut_lineage, drop_folder, parts_of, scratch_path

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
SEED = 42
CELL = 20_000
ROUND = 1 << 20


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words_per_shingle, len(words))
    first, last = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros((8, 8), dtype=np.int64)
    for a in range(0, len(first), ROUND):
        raw = b"".join([digest(joined[i:j], SEED) for i, j in zip(first[a : a + ROUND], last[a : a + ROUND])])
        octets = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
        if len(octets) < 64:
            counts += BITS[octets].sum(axis=0)
        else:
            for place in range(8):
                counts[place] += np.bincount(octets[:, place], minlength=256) @ BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(first)).tobytes(), "big", signed=True)


def fingerprint_of(text: str | Column, words_per_shingle: int = 4) -> Column:
    """The fingerprint as a column, worked out in Arrow batches."""

    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return prints(text)


def hex_of(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Cover:
    """Anchors of one block: a Hamming code times the left-over bits."""

    def __init__(self, width: int, reach: int):
        checks = 1
        while 2 ** (checks + 1) - 1 <= width:
            checks += 1
        self.width = width
        self.syndrome = np.zeros(1 << min(width, 16), dtype=np.uint8)
        self.coded = 2**checks - 1
        masks = [0]
        for _ in range(reach):
            masks = sorted({m | 1 << b for m in masks for b in range(width)} | set(masks))
        self.masks = np.array(masks, dtype=np.uint64)
        self.mask_syndrome = self.syndromes(self.masks)

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.uint8)
        for b in range(self.coded):
            out ^= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) * np.uint8(b + 1)
        return out

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and code words of all anchors within reach of each value."""
        hit_rows, hit_words = [], []
        found = self.syndromes(values)
        order = np.argsort(self.mask_syndrome, kind="stable")
        bounds = np.searchsorted(self.mask_syndrome[order], np.arange(self.coded + 2))
        for s in np.unique(found):
            rows, masks = np.nonzero(found == s)[0], self.masks[order[bounds[s] : bounds[s + 1]]]
            hit_rows.append(np.repeat(rows, len(masks)))
            hit_words.append((values[rows][:, None] ^ masks[None, :]).ravel())
        if not hit_rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return np.concatenate(hit_rows), np.concatenate(hit_words)


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def anchor_rows(prints: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """One row (anchor, fp) for each anchor that a fingerprint is replicated to."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = block_bounds(blocks)
        covers = [Cover(b - a, 1 + max_bits // blocks) for a, b in spans]
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 2000):
                part = fps[i : i + 2000]
                for block, ((a, b), cover) in enumerate(zip(spans, covers)):
                    rows, words = cover.anchors((part >> np.uint64(a)) & np.uint64(2 ** (b - a) - 1))
                    anchors = words.astype(np.int64) | np.int64(block) << np.int64(40)
                    yield pa.record_batch([pa.array(anchors), pa.array(part[rows].view(np.int64))], names=["anchor", "fp"])

    return prints.mapInArrow(replicate, "anchor bigint, fp bigint")


def stars(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, int]]:
    """Clusters of linked fingerprints: members and the one they hang on."""
    if len(fps) <= 64:
        close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
        if close.sum() == len(fps):
            return []
    found, rest = [], fps
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        todo, members = [seed], []
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= max_bits
            if near.any():
                hit = rest[near]
                members.append(hit)
                todo.extend(hit)
                rest = rest[~near]
        if members:
            found.append((np.concatenate(members), seed))
    return found


def links(prints: DataFrame, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (a, b), a > b, that join exactly the fingerprints of a component.

    prints: distinct fingerprints in a column fp.
    """
    spark = prints.sparkSession
    if blocks is None:  # both ways find all links; wider anchors keep groups small when there are many fingerprints
        blocks = 3 if prints.count() < 20_000_000 else 2
    parts = parts_of(prints)
    reps = anchor_rows(prints.select("fp"), max_bits, blocks)
    large = reps.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
    cells = F.ceil(F.col("n") / CELL).cast("int")
    mine = F.pmod(F.xxhash64("fp"), cells).cast("int")
    placed = (
        reps.join(large, "anchor", "left")
        .withColumn("own", F.coalesce(mine, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(cells - 1, F.lit(0)))))
        .select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(groups: list) -> pa.RecordBatch:
            left = np.concatenate([m for m, _ in groups]) if groups else np.zeros(0, np.uint64)
            right = np.concatenate([np.full(len(m), s) for m, s in groups]) if groups else left
            left, right = left.view(np.int64), right.view(np.int64)
            pairs = np.unique(np.stack([np.maximum(left, right), np.minimum(left, right)], axis=1), axis=0)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: list[np.ndarray] = []
        open_key = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            fps = batch.column(3).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            found = []
            for a, b in zip([0, *cuts], [*cuts, len(fps)]):
                key = tuple(keys[a])
                if key != open_key:
                    if held and sum(map(len, held)) > 1:
                        found += stars(np.unique(np.concatenate(held)), max_bits)
                    held, open_key = [], key
                held.append(fps[a:b])
            if found:
                yield out(found)
        if held:
            yield out(stars(np.unique(np.concatenate(held)), max_bits))

    key = ["anchor", "i", "j"]
    met = placed.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(compare, "a bigint, b bigint")
    return cut_lineage(met.distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the smallest node reachable over edges (a, b)."""
    spark = edges.sparkSession
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    seen, path = None, None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.select("a", F.col("m").alias("b")).union(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")).distinct()
        target = scratch_path(spark, "simhash-star")
        small.write.parquet(target)
        current = spark.read.schema("a bigint, b bigint").parquet(target)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if path:
            drop_folder(spark, path)
        path = target
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, max_bits: int = 4, blocks: int | None = None) -> DataFrame:
    """Each row's id, text hash, fingerprint and component.

    Columns: doc_id, text_hash (null for a null text), fp, component_id (the smallest id reachable, its own
    included), root (the fingerprint that names the component).
    """
    prints = cut_lineage(
        docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("text_hash"), fingerprint_of(F.col(text_col), words_per_shingle).alias("fp")),
        "simhash-prints",
    )
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    edges = links(nodes.select("fp"), max_bits, blocks)
    rooted = nodes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut_lineage(rooted, "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")
