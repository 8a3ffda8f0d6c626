"""Jaccard join of word n-gram sets by vertical partitioning.

A document is the set of its distinct word n-grams, as 64-bit hashes. Two link
when intersection / union reaches a threshold. Nothing is approximate: every
filter below only removes what cannot link.

1. **Sharing.** Of two sets that link, the grams with the smallest hashes agree:
   among the first 2p - 1 of n (p = n - ceil(t n) + 1) a known number must occur
   in another row. Only these grams are shuffled, packed, to buckets of the hash;
   a bucket answers how many grams of a row it saw in some other row. Rows with
   too few shared grams link with nothing but their copies.
2. **Order.** Grams of the rows left, one row for each distinct set, are counted
   and ordered by frequency, rarest first. The order is cut into fragments that
   hold about the same number of entries; a set falls into segments. The sizes
   of its segments bound the overlap of a pair: the sum of the smaller ones.
3. **Candidates.** Linked sets share a gram of their first p. In the list of
   such a gram, the set with the fewest grams of its own leads and is paired with
   all that pass the bounds. Two rounds of this join a group of near copies, with
   one pair a member instead of all. What is left in a list, the sets outside its
   largest component, is then paired with everything in the list that belongs to
   another component. So every pair that could link is verified or already joined
   by others.
4. **Verification.** Overlaps are counted apart for each fragment, summed for
   each pair and compared with the threshold.

Defined results: a text with fewer words than a gram is one gram; a null text or
one without words has the empty set and links with nothing; copies of a set
share a component; rows with a null id get a component but never name one;
repeated rows are rows of their own; an empty table gives an empty result; other
columns are not read. Sets are equal when their 64-bit hashes are. The table is
read twice and must hold the same rows both times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import cut_lineage, parts_of
from songloom.llm.simhash import components

FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
MIX = np.uint64(0x9E3779B97F4A7C15)
HELD_WORDS, BLOCK, FLUSH = 200_000, 4_000_000, 1_500_000
FRAGMENTS, ROUNDS, MARKS = 16, 2, 1 << 26


class Grams:
    """Sets of hashed n-grams, with a bounded memory of words seen."""

    def __init__(self, words: int):
        rng = np.random.default_rng(12)
        self.words = words
        self.factors = rng.integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.held: dict[bytes, int] = {}

    def word_hashes(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass").translate(FOLDED)
        out, at = [np.zeros(0, np.uint64)], 0
        while at < len(raw):  # blocks end at a space
            end = raw.find(b" ", at + BLOCK)
            words = raw[at : len(raw) if end < 0 else end].split()
            at = len(raw) if end < 0 else end
            if len(self.held) > HELD_WORDS:
                self.held.clear()
            held = self.held
            for w in set(words).difference(held):
                held[w] = xxhash.xxh64_intdigest(w)
            out.append(np.fromiter(map(held.__getitem__, words), dtype=np.uint64, count=len(words)))
        return np.concatenate(out)

    def of(self, text: str | None) -> np.ndarray:
        """Distinct grams of a text, ascending."""
        h = self.word_hashes(text or "")
        if not len(h):
            return h
        k = min(self.words, len(h))
        n = len(h) - k + 1
        g = np.full(n, 0 if k == self.words else k, dtype=np.uint64)
        for i in range(k):
            g += h[i : i + n] * self.factors[i]
        g ^= g >> np.uint64(29)
        g *= MIX
        return np.unique(g ^ g >> np.uint64(32))


def prefix(n, num: int, den: int):
    """Grams of n of which one at least is shared by any linked set: n - ceil(t n) + 1."""
    return n - -(-n * num // den) + 1


def packed(owners: np.ndarray, sets: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, grams, owners, counts): the grams of many sets dealt to buckets; counts has the number of grams of each owner in turn."""
    grams = np.concatenate(sets)
    whose = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    yield from dealt((grams % np.uint64(buckets)).astype(np.int64), owners, whose, grams)


def dealt(place: np.ndarray, owners: np.ndarray, whose: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(place, values..., owners, counts) for every place; whose ascends."""
    order = np.argsort(place, kind="stable")
    place, whose, values = place[order], whose[order], [v[order] for v in values]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]) if len(place) else np.zeros(1, np.int64)
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(whose[a:z])) + 1])
        yield int(place[a]), *[v[a:z].tobytes() for v in values], owners[whose[a:z][starts]].tobytes(), np.diff(np.append(starts, z - a)).astype(np.int32).tobytes()


def by_bucket(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[tuple[pa.RecordBatch | None, list]]:
    """Every batch as it comes, and the columns of each bucket once it is complete. Columns from ``first``: bucket, then bytes."""
    key, held = None, []
    for batch in batches:
        yield batch, []
        for bucket, *part in zip(*batch.columns[first:]):
            if part[0].is_valid:
                if bucket.as_py() != key:
                    if held:
                        yield None, [b"".join(c) for c in zip(*held)]
                    key, held = bucket.as_py(), []
                held.append(tuple(x.as_py() for x in part))
    if held:
        yield None, [b"".join(c) for c in zip(*held)]


def counted(bucket: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of a bucket, owners, whose each gram is, and in how many sets it occurs."""
    grams = np.frombuffer(bucket[0], dtype=np.uint64)
    owners = np.frombuffer(bucket[1], dtype=np.int64).reshape(-1, width)
    whose = np.repeat(np.arange(len(owners)), np.frombuffer(bucket[2], dtype=np.int32))
    _, of, counts = np.unique(grams, return_inverse=True, return_counts=True)
    return grams, owners, whose, counts[of]


def sharing(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(row, doc_id, text_hash, n, key, shared) from (row, doc_id, text_hash, text): size and content key of each row's set, and how many of its first grams other rows have."""
    parts = parts_of(docs)
    buckets = 2 * parts
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blobs = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["row", "doc_id", "text_hash", "n", "key", "bucket", "grams", "owners", "counts"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, id_kind = Grams(words), None
        rows, sets, size = [], [], 0

        def told() -> pa.RecordBatch:
            columns = list(zip(*packed(np.array(rows, dtype=np.int64), sets, buckets)))
            none = [pa.nulls(len(columns[0]), t) for t in (pa.int64(), id_kind, pa.int64(), pa.int64(), pa.binary())]
            return pa.record_batch([*none, *[pa.array(list(c), t) for c, t in zip(columns, blobs)]], names=names)

        for batch in batches:
            id_kind = batch.column(1).type
            ns, keys = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(3)):
                grams = maker.of(text.as_py())
                ns.append(len(grams))
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                if len(grams):
                    sets.append(grams[: 2 * prefix(len(grams), num, den) - 1].copy())
                    rows.append(row)
                    size += len(sets[-1])
                if size > FLUSH:
                    yield told()
                    rows, sets, size = [], [], 0
            if ns:
                dealt = pa.array([r % buckets for r in batch.column(0).to_pylist()], pa.int64())
                none = [pa.nulls(len(ns), t) for t in blobs[1:]]
                yield pa.record_batch([*batch.columns[:3], pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), dealt, *none], names=names)
        if rows:
            yield told()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, id_kind = [*names[:5], "shared"], None
        for batch, bucket in by_bucket(batches, 5):
            if batch is not None:
                id_kind = batch.column(1).type
                docs = batch.filter(batch.column(0).is_valid())
                yield pa.record_batch([*docs.columns[:5], pa.array(np.zeros(docs.num_rows, np.int64))], names=out)
                continue
            _, owners, whose, often = counted(bucket, 1)
            rows, shared = np.unique(owners[whose[often > 1], 0], return_counts=True)
            none = [pa.nulls(len(rows), t) for t in (id_kind, pa.int64(), pa.int64(), pa.binary())]
            yield pa.record_batch([pa.array(rows), *none, pa.array(shared.astype(np.int64))], names=out)

    asked = docs.mapInArrow(tell, f"row bigint, doc_id {id_type}, text_hash bigint, n bigint, key binary, bucket bigint, grams binary, owners binary, counts binary")
    met = asked.repartition(parts, "bucket").sortWithinPartitions("bucket")
    seen = met.mapInArrow(answer, f"row bigint, doc_id {id_type}, text_hash bigint, n bigint, key binary, shared bigint")
    seen = cut_lineage(seen, "ngram-sharing")
    shared = seen.filter("n is null").groupBy("row").agg(F.sum("shared").alias("shared"))
    return seen.filter("n is not null").drop("shared").join(shared, "row", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def only(texts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of texts whose key, a hash, may be among the wanted ones.

    The wanted keys are marked in a bitmap of MARKS bits, a table of a fixed size that is sent to the tasks. It spares
    the shuffle of most other rows; those that slip through are for a join to drop.
    """
    bit = lambda: F.pmod(F.col(key), F.lit(MARKS)) + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(bit()).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit())).alias("bits"))
    place = F.bitmap_bit_position(bit())
    octet = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = texts.withColumn("page", F.bitmap_bucket_number(bit()))
    marked = F.pmod(F.floor(octet / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1
    return rows.join(F.broadcast(marks), "page").filter(marked).drop("page", "bits")


def gram_sets(texts: DataFrame, words: int) -> DataFrame:
    """(row, grams) of (row, text); grams as little-endian 64-bit numbers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Grams(words)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                yield pa.record_batch([part.column(0), pa.array([maker.of(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["row", "grams"])

    return texts.select("row", "text").mapInArrow(make, "row bigint, grams binary")


def ordered(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(row, n, grams, dfs): the grams of each set that other sets have, by frequency, rarest first; sets with too few of them go."""
    parts = parts_of(sets)
    buckets = 2 * parts
    names, kinds = ["bucket", "grams", "owners", "counts"], (pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, held, size = [], [], 0

        def told() -> pa.RecordBatch:
            columns = zip(*packed(np.array(owners, dtype=np.int64), held, buckets))
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for row, n, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                owners.append((row, n))
                held.append(np.frombuffer(grams.as_py(), dtype=np.uint64))
                size += n
                if size > FLUSH:
                    yield told()
                    owners, held, size = [], [], 0
        if owners:
            yield told()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a bucket knows of its grams, packed by the part that gathers their rows."""
        for _, bucket in by_bucket(batches, 0):
            if not bucket:
                continue
            grams, owners, whose, often = counted(bucket, 2)
            use = often > 1
            columns = list(zip(*dealt(owners[whose[use], 0] % parts, owners, whose[use], grams[use], often[use].astype(np.int64))))
            if columns:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 4))], names=["part", "grams", "dfs", "owners", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in by_bucket(batches, 0):
            if not part:
                continue
            grams, dfs = np.frombuffer(part[0], dtype=np.uint64), np.frombuffer(part[1], dtype=np.int64)
            owner = np.repeat(np.frombuffer(part[2], dtype=np.int64).reshape(-1, 2), np.frombuffer(part[3], dtype=np.int32), axis=0)
            order = np.lexsort((grams, dfs, owner[:, 0]))
            grams, dfs, owner = grams[order], dfs[order], owner[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(owner[:, 0])) + 1, [len(owner)]])
            spans = [(a, z) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()) if (z - a) * den >= owner[a, 1] * num]
            found = [[int(owner[a, 0]) for a, _ in spans], [int(owner[a, 1]) for a, _ in spans], [grams[a:z].tobytes() for a, z in spans], [dfs[a:z].tobytes() for a, z in spans]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["row", "n", "grams", "dfs"])

    asked = sets.select("row", "n", "grams").mapInArrow(tell, "bucket bigint, grams binary, owners binary, counts binary")
    met = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "part bigint, grams binary, dfs binary, owners binary, counts binary")
    of_row = met.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(gather, "row bigint, n bigint, grams binary, dfs binary")
    return cut_lineage(of_row, "ngram-order")


def place_of(grams: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    """Place in the global order: by frequency, then by hash."""
    return dfs + grams.astype(np.float64) * 2.0**-64 * 0.999


class Fragments:
    """Sets in the global order, cut into segments: the segments, their sizes, and the lists of rare grams."""

    def __init__(self, sets: DataFrame, num: int, den: int, fragments: int = FRAGMENTS):
        self.num, self.den, self.fragments = num, den, fragments
        order = ordered(sets, num, den)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [place_of(np.frombuffer(g.as_py(), dtype=np.uint64), np.frombuffer(d.as_py(), dtype=np.int64)) for g, d in zip(batch.column(0), batch.column(1))]
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(found))], names=["place"])

        shares = [i / fragments for i in range(1, fragments)]
        cuts = order.select("grams", "dfs").mapInArrow(places, "place double").agg(F.percentile_approx("place", shares, 2000)).first()[0] or []

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for n, g, d in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                    grams, dfs = np.frombuffer(g.as_py(), dtype=np.uint64), np.frombuffer(d.as_py(), dtype=np.int64)
                    ends = np.searchsorted(place_of(grams, dfs), cuts, side="left")
                    segments = np.split(grams.view(np.int64), ends)
                    rare = grams.view(np.int64)[: max(0, prefix(n, num, den) - (n - len(grams)))]
                    for store, value in zip(out, (len(grams), [len(s) for s in segments], segments, rare)):
                        store.append(value)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=["row", "n", "m", "sizes", "segments", "rare"])

        whole = order.mapInArrow(cut, "row bigint, n bigint, m bigint, sizes array<bigint>, segments array<array<bigint>>, rare array<bigint>")
        whole = cut_lineage(whole, "ngram-segments")
        self.segments = whole.select("row", F.posexplode("segments").alias("f", "grams"))
        self.sizes = whole.select("row", *[F.coalesce(F.get("sizes", F.lit(i)), F.lit(0)).alias(f"c{i}") for i in range(fragments)])
        self.rows = whole.select("row", "n", ((F.col("n") - F.col("m")) / F.col("n")).alias("own"))
        self.lists = whole.select("row", F.explode("rare").alias("gram"))

    def listed(self, roots: DataFrame | None) -> DataFrame:
        """Lists of rare grams with size, share of own grams, and component of their rows."""
        rows = self.rows.withColumn("comp", F.col("row"))
        if roots is not None:
            rows = self.rows.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("root", "row")).drop("root")
        return self.lists.join(rows, "row")

    def may_link(self, a: str, b: str) -> Column:
        """Whether the sizes of segments allow the threshold."""
        most = reduce(lambda x, y: x + y, [F.least(f"{a}.c{i}", f"{b}.c{i}") for i in range(self.fragments)])
        return most * (self.num + self.den) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * self.num

    def alike(self, a: str, b: str) -> Column:
        """Whether different components and the sizes of sets allow a link."""
        small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
        return (F.col(f"{a}.comp") != F.col(f"{b}.comp")) & (small * self.den >= large * self.num)

    def led(self, listed: DataFrame) -> DataFrame:
        """Pairs of each list's leader, the set with the smallest share of grams of its own, with the others."""
        lead = listed.groupBy("gram").agg(F.min(F.struct("own", "row", "n", "comp")).alias("l"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("gram", "l.row", "l.n", "l.comp")
        met = listed.alias("x").join(lead.alias("y"), F.col("x.gram") == F.col("y.gram")).filter(self.alike("x", "y"))
        pairs = met.select(F.col("x.row").alias("a"), F.col("x.n").alias("n_a"), F.col("y.row").alias("b"), F.col("y.n").alias("n_b")).distinct()
        one = self.sizes.withColumnRenamed("row", "a")
        two = self.sizes.withColumnRenamed("row", "b")
        sized = pairs.join(one, "a").select("a", "b", "n_b", F.struct(F.col("n_a").alias("n"), *[f"c{i}" for i in range(self.fragments)]).alias("x"))
        sized = sized.join(two, "b").select("a", "b", "x", F.struct(F.col("n_b").alias("n"), *[f"c{i}" for i in range(self.fragments)]).alias("y"))
        return sized.filter(self.may_link("x", "y")).select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n"))

    def left(self, listed: DataFrame) -> DataFrame:
        """Pairs of different components in a list: every set outside the largest one with all others."""
        comps = listed.groupBy("gram", "comp").agg(F.count("*").alias("k"))
        largest = comps.groupBy("gram").agg(F.max(F.struct("k", "comp")).alias("most"), F.count("*").alias("comps")).filter("comps > 1")
        open_lists = listed.join(largest.select("gram", F.col("most.comp").alias("major")), "gram").join(self.sizes, "row")
        open_lists = cut_lineage(open_lists, "ngram-open")
        minor = open_lists.filter("comp <> major")
        met = open_lists.alias("x").join(minor.alias("y"), F.col("x.gram") == F.col("y.gram"))
        once = (F.col("x.comp") == F.col("x.major")) | (F.col("x.row") < F.col("y.row"))
        good = met.filter(self.alike("x", "y") & once & self.may_link("x", "y"))
        return good.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b"), (F.col("x.n") + F.col("y.n")).alias("n")).distinct()

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that reach the threshold: overlaps by fragment, summed by pair."""
        asked = pairs.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(self.fragments - 1))))
        a = self.segments.select(F.col("row").alias("a"), "f", F.col("grams").alias("of_a"))
        b = self.segments.select(F.col("row").alias("b"), "f", F.col("grams").alias("of_b"))
        partial = asked.join(a, ["a", "f"]).join(b, ["b", "f"]).select("a", "b", "n", F.size(F.array_intersect("of_a", "of_b")).alias("o"))
        whole = partial.groupBy("a", "b").agg(F.max("n").alias("n"), F.sum("o").alias("o"))
        return whole.filter(F.col("o") * (self.num + self.den) >= F.col("n") * self.num).select("a", "b")


def links(sets: DataFrame, num: int = 80, den: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) between rows (row, n, grams) of different sets that join exactly the rows of a component."""
    parts = Fragments(sets, num, den)
    found, roots = None, None
    for turn in range(rounds + 1):
        listed = parts.listed(roots)
        pairs = parts.led(listed) if turn < rounds else parts.left(listed)
        new = cut_lineage(parts.linked(cut_lineage(pairs, "ngram-pairs")), "ngram-links")
        found = new if found is None else found.union(new)
        if turn < rounds:
            roots = components(found)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_key) for every row. The threshold num / den is at least a half."""
    own = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), own.alias("text_hash"), F.col(text_col).alias("text"))
    seen = cut_lineage(sharing(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "text"), words, num, den), "ngram-rows")
    least = F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9)
    enough = least - F.ceil(least * num / F.lit(float(den)) - 1e-9) + 1
    kept = seen.filter("key is not null").filter(F.col("shared") >= enough).groupBy("key").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.min("text_hash").alias("text_hash"))
    kept = cut_lineage(kept.drop("key"), "ngram-kept")
    once = only(texts.select("text_hash", "text"), kept, "text_hash").groupBy("text_hash").agg(F.first("text").alias("text"))
    some = once.join(kept, "text_hash")
    sets = cut_lineage(gram_sets(some, words).withColumn("n", (F.octet_length("grams") / 8).cast("bigint")), "ngram-sets")
    roots = components(links(sets, num, den))

    classes = seen.filter("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"))
    rooted = cut_lineage(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "ngram-roots")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_key = rooted.join(named, "root").select("key", "component_id")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("set_key")]
    held = seen.filter("key is not null").join(of_key, "key").select(*columns)
    empty = seen.filter("key is null").withColumn("component_id", F.col("doc_id")).select(*columns)
    return held.unionByName(empty)
