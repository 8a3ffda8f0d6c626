"""Language-model scoring with a probabilistic suffix tree.

Symbols of the tree are the most frequent words, each alone; the end of a text,
which also stands before its first word; and for all other words a class by
their last two characters.

* Word counts are taken over all training texts by the word exchange: a chunk
  tells its counts, a bucket adds them up and answers with count and symbol.
* Contexts hold up to ``DEPTH`` symbols. Those of none and one are counted in one
  table of fixed size. Longer ones are as many as the corpus has: each chunk of
  texts tells its distinct windows (context and next symbol, with counts) to
  buckets by the last two symbols of the context, and a bucket holds all that is
  known of the contexts that end with them.
* A context is kept if it is frequent enough and its next-symbol distribution
  diverges from that of its suffix (count times Kullback-Leibler divergence).
  Distributions are smoothed with the one of the suffix:
  (count + prior * P of the suffix) / (all + prior).
* A word is scored by its symbol, from the longest kept suffix of what came
  before, times its share of the class: (count + 1) / (class tokens + class
  words + 1). Buckets answer in steps of 1/2048 of log10, down to -15.9.
* A context of two symbols or more that holds more than a bucket's share of the
  tokens is kept, its next symbols are counted apart, and its windows go to
  buckets by one symbol more. There are no more of them than buckets, so no
  bucket gets a common passage whole.

Defined results: a null text reads as empty and holds the end token alone; a
null id is neither held out nor null-scored, it trains; repeated rows count as
often as they occur; with no training text every score is that of an empty
model; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm import words as wx
from songloom.llm.common import cut_lineage, parts_of, stable_hash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
BITS, DEPTH = 10, 4
TOP, ENDINGS = 500, 523
K = 1 << BITS  # TOP + ENDINGS + the end
END = K - 1
STEPS = 2048


def split(text: str) -> list[str]:
    """Lower-cased words of a text; only the six ASCII white-space characters divide."""
    return [w for w in text.encode().translate(LOWER).decode().split(" ") if w]


def trains(ids: np.ndarray, no_id: np.ndarray, modulus: int, held: int) -> np.ndarray:
    keep = np.fromiter((zlib.crc32(str(i).encode()) % modulus != held for i in ids.tolist()), dtype=bool, count=len(ids))
    return keep | no_id


def endings(words: list[str]) -> np.ndarray:
    return TOP + (stable_hash([w[-2:] for w in words]) % np.uint32(ENDINGS)).astype(np.int64)


def short_contexts(counts: np.ndarray, min_count: int, divergence: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """For [before, next]: log10 P from the longest kept context of at most one symbol, and P smoothed at one."""
    two = counts.astype(float)
    one, n = two.sum(axis=0), two.sum(axis=1)
    root = (one + 1) / (one.sum() + K)
    p = (two + prior * root) / (n[:, None] + prior)
    share = two / np.maximum(n, 1)[:, None]
    gain = (two * np.log(np.where(two > 0, share, 1) / np.where(two > 0, root, 1))).sum(axis=1)
    kept = (n >= min_count) & (gain >= divergence)
    return np.log10(np.where(kept[:, None], p, root)), p


def low(windows: np.ndarray, symbols: int) -> np.ndarray:
    """The last symbols of windows."""
    return windows & np.int64((1 << BITS * symbols) - 1)


def windows_of(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each symbol of some texts, the DEPTH symbols before it and itself as one number; the end stands before a text."""
    at = np.arange(len(symbols))
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = symbols.astype(np.int64)
    for j in range(1, DEPTH + 1):
        before = np.where(at - j >= start, symbols[np.maximum(at - j, 0)], END).astype(np.int64)
        out |= before << np.int64(BITS * j)
    return out


@dataclass
class Head:
    """What is known of the texts of a chunk beside their symbols."""

    ids: np.ndarray
    no_id: np.ndarray
    sizes: np.ndarray
    known: np.ndarray
    base: np.ndarray
    inner: np.ndarray


def pack_head(ids: list, sizes: np.ndarray, known: np.ndarray, base: np.ndarray, inner: np.ndarray) -> bytes:
    keys = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    none = np.array([i is None for i in ids], dtype=np.int64)
    return wx.squeeze(*[x.astype(np.int64).tobytes() for x in (keys, none, sizes, known)], base.astype(float).tobytes(), inner.astype(float).tobytes())


def open_head(raw: bytes) -> Head:
    whole = np.frombuffer(wx.expand(raw), dtype=np.int64).reshape(6, -1)
    return Head(whole[0], whole[1].astype(bool), whole[2], whole[3], whole[4].view(float), whole[5].view(float))


@dataclass
class Tree:
    """What every task knows: short contexts, and the common longer ones by length (sorted contexts, counts of next)."""

    logs: np.ndarray
    one: np.ndarray
    common: dict[int, tuple[np.ndarray, np.ndarray]]

    def place(self, contexts: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether contexts of d symbols are common, and their row."""
        known = self.common[d][0] if d in self.common else np.zeros(0, np.int64)
        if not len(known):
            return np.zeros(len(contexts), bool), np.zeros(len(contexts), np.int64)
        row = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        return known[row] == contexts, row

    def bucket(self, windows: np.ndarray, buckets: int) -> np.ndarray:
        """By the last two symbols of the context; by one more as long as those are common."""
        route = low(windows >> BITS, 2)
        for d in range(2, DEPTH):
            common, _ = self.place(low(windows >> BITS, d), d)
            if not common.any():
                break
            route = np.where(common, low(windows >> BITS, d + 1) | np.int64(d << 58), route)
        mixed = route.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

    def log_probability(self, windows: np.ndarray, counts: np.ndarray, min_count: int, divergence: float, prior: float) -> np.ndarray:
        """log10 P of the last symbol of each window, given all windows of its bucket with their training counts."""
        out = self.logs[low(windows, 2)].astype(float)
        below = self.one[low(windows, 2)].astype(float)
        for d in range(2, DEPTH + 1):
            pairs, back = np.unique(low(windows, d + 1), return_inverse=True)
            seen = np.bincount(back, counts, len(pairs))
            p = np.empty(len(pairs))
            p[back] = below
            contexts, of = np.unique(pairs >> BITS, return_inverse=True)
            total = np.bincount(of, seen, len(contexts))
            share = seen / np.maximum(total[of], 1)
            gain = np.bincount(of, np.where(seen > 0, seen * np.log(np.where(seen > 0, share, 1) / p), 0), len(contexts))
            common, row = self.place(contexts, d)
            if common.any():  # this bucket may hold a part of them only
                next_counts = self.common[d][1]
                total = np.where(common, next_counts.sum(axis=1)[row], total)
                seen = np.where(common[of], next_counts[row[of], low(pairs, 1)], seen)
            kept = (total >= min_count) & (gain >= divergence) | common
            p = (seen + prior * p) / (total[of] + prior)
            below = p[back]
            out = np.where(kept[of][back], np.log10(below), out)
        return out


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2,
    min_count: int = 2, divergence: float = 2.0, prior: float = 50.0,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = parts_of(docs)

    def counted(c: wx.Chunk) -> np.ndarray:
        use = np.repeat(trains(c.ids, c.no_id, modulus, held), c.sizes)
        return np.bincount(c.numbers[use], minlength=len(c.words))

    asked = cut_lineage(wx.questions(source, split, buckets, counted), "tree-questions")

    def totals(asked_words: list[list[str]], told: list[np.ndarray]) -> dict[str, int]:
        total: dict[str, int] = {}
        get = total.get
        for words, counts in zip(asked_words, told):
            for w, n in zip(words, counts.tolist()):
                if n:
                    total[w] = get(w, 0) + n
        return total

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        total = totals([wx.unpack_words(w, n) for w, n in zip(pdf["words"], pdf["n"])], [np.frombuffer(wx.expand(x), dtype=np.int64) for x in pdf["extra"]])
        words, counts = list(total), np.fromiter(total.values(), dtype=np.int64)
        group = endings(words)
        first = np.argsort(-counts, kind="stable")[:TOP]
        return pd.DataFrame({
            "word": [*[None] * ENDINGS, *[words[i] for i in first]], "group": [*range(TOP, END), *group[first].tolist()],
            "tokens": [*np.bincount(group, counts, END)[TOP:].astype(np.int64).tolist(), *counts[first].tolist()],
            "kinds": [*np.bincount(group, minlength=END)[TOP:].tolist(), *[1] * len(first)],
        })

    found = asked.groupBy("bucket").applyInPandas(summary, "word string, group int, tokens bigint, kinds bigint")
    found = cut_lineage(found, "tree-summary")
    top = found.filter("word is not null").orderBy(F.desc("tokens"), "word").limit(TOP).collect()
    sums = found.filter("word is null").groupBy("group").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect()
    no_id = F.col("doc_id").isNull()
    ends = source.filter(no_id | (F.crc32(F.col("doc_id").cast("string")) % modulus != held)).count()
    tokens, kinds = np.zeros(K), np.zeros(K)
    for r in sums:
        tokens[r["group"]], kinds[r["group"]] = r["tokens"], r["kinds"]
    n_train = int(tokens.sum()) + ends
    bottom = n_train + int(kinds.sum()) + (ends > 0) + 1
    for r in top:
        tokens[r["group"]] -= r["tokens"]
        kinds[r["group"]] -= 1
    alone = {r["word"]: i for i, r in enumerate(top)}
    inside = np.log10(tokens + kinds + 1)

    def serve(asked_words: list[list[str]], told: list[np.ndarray]) -> list[bytes]:
        total, out = totals(asked_words, told), []
        for words in asked_words:
            counts = np.fromiter((total.get(w, 0) for w in words), dtype=np.int64, count=len(words))
            group = endings(words)
            for i, w in enumerate(words):
                if w in alone:
                    group[i] = alone[w]
            out.append(wx.squeeze(counts.tobytes(), group.astype(np.uint16).tobytes()))
        return out

    fields = "head binary, symbols binary"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_base = np.log10((ends + 1) / bottom)
        for batch in batches:
            for body, told in zip(batch.column(0), batch.column(1)):
                ids, bounds, numbers = wx.open_body(body.as_py())
                counts, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
                for one in told.as_py():
                    raw = wx.expand(one)
                    n = len(raw) // 10
                    counts.append(np.frombuffer(raw, dtype=np.int64, count=n))
                    groups.append(np.frombuffer(raw, dtype=np.uint16, offset=8 * n))
                count, group = np.concatenate(counts), np.concatenate(groups)
                base = np.log10((count + 1) / bottom)
                inner = np.where(group < TOP, 0.0, np.log10(count + 1) - inside[group])
                sizes = np.diff(bounds)
                of = np.repeat(np.arange(len(ids)), sizes)
                symbols = np.insert(group[numbers], bounds[1:], END).astype(np.uint16)  # each text's end behind its words
                yield pa.record_batch([
                    pa.array([pack_head(
                        ids, sizes + 1, np.bincount(of, count[numbers] > 0, len(ids)).astype(np.int64) + (ends > 0),
                        np.bincount(of, base[numbers], len(ids)) + end_base, np.bincount(of, inner[numbers], len(ids)),
                    )], pa.binary()),
                    pa.array([wx.squeeze(symbols.tobytes())], pa.binary()),
                ], names=["head", "symbols"])

    rows = wx.meet(wx.numbered(source, split, buckets), wx.answers(asked, serve)).mapInArrow(code, fields)
    coded = cut_lineage(rows.select(F.monotonically_increasing_id().alias("chunk"), "head", "symbols"), "tree-coded")

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Head, np.ndarray, np.ndarray]]:
        """(chunk, head, windows, whether each trains) of coded rows."""
        for key, raw, symbols in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            head = open_head(raw.as_py())
            windows = windows_of(np.frombuffer(wx.expand(symbols.as_py()), dtype=np.uint16), head.sizes)
            yield key, head, windows, np.repeat(trains(head.ids, head.no_id, modulus, held), head.sizes)

    def added(per_task: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray:
        """K rows of counts that tasks make of training windows, added up; tasks send them packed."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = per_task(w[use] for batch in batches for _, _, w, use in opened(batch))
            if table.any():
                yield pa.record_batch([pa.array(range(K), pa.int32()), pa.array([wx.squeeze(r.tobytes()) for r in table], pa.binary())], names=["older", "counts"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    sums[key] = sums.get(key, 0) + np.frombuffer(wx.expand(raw.as_py()), dtype=np.int64)
            if sums:
                yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([wx.squeeze(x.tobytes()) for x in sums.values()], pa.binary())], names=["older", "counts"])

        shape = "older int, counts binary"
        out = per_task(iter(()))
        for r in coded.mapInArrow(count, shape).repartition(min(K, buckets), "older").mapInArrow(add_up, shape).collect():  # K rows
            out[r["older"]] = np.frombuffer(wx.expand(bytes(r["counts"])), dtype=np.int64)
        return out

    def of_two(parts: Iterator[np.ndarray]) -> np.ndarray:
        counts = np.zeros(K * K, dtype=np.int64)
        for w in parts:
            counts += np.bincount(low(w, 2), minlength=K * K)
        return counts.reshape(K, K)

    two = added(of_two)
    logs, one = short_contexts(two, min_count, divergence, prior)
    tree = Tree(logs.ravel().astype(np.float32), one.ravel().astype(np.float32), {})
    share = max(int(two.sum()) // buckets, min_count)
    common = np.flatnonzero(two.ravel() > share)  # fewer than buckets: each holds more than their share
    for d in range(2, DEPTH):
        if not len(common):
            break
        tree.common[d] = (common, np.zeros((len(common), K), dtype=np.int64))

        def around(parts: Iterator[np.ndarray], d: int = d, tree: Tree = tree) -> np.ndarray:
            """[symbol, context]: how often a symbol comes next, and behind that, how often it stands before."""
            n = len(tree.common[d][0])
            counts = np.zeros((2, n, K), dtype=np.int64)
            for w in parts:
                hit, row = tree.place(low(w >> BITS, d), d)
                for side, symbol in enumerate((low(w, 1), low(w >> BITS * (d + 1), 1))):
                    counts[side] += np.bincount(row[hit] * K + symbol[hit], minlength=n * K).reshape(n, K)
            return np.concatenate([counts[0].T, counts[1].T], axis=1)

        table = added(around)
        tree.common[d] = (common, table[:, : len(common)].T.copy())
        longer = table[:, len(common) :]
        symbol, row = np.nonzero(longer > share)
        common = np.sort(symbol.astype(np.int64) << np.int64(BITS * d) | common[row])
    sent = spark.sparkContext.broadcast(tree)

    def ordered(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows by bucket, where each bucket starts, and the place of every window among them."""
        distinct, back = np.unique(windows, return_inverse=True)
        bucket = sent.value.bucket(distinct, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return distinct[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[back]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, _, windows, use in opened(batch):
                distinct, starts, place = ordered(windows)
                counts = np.bincount(place[use], minlength=len(distinct)).astype(np.int32)
                some = np.nonzero(np.diff(starts))[0]
                cuts = [(int(starts[b]), int(starts[b + 1])) for b in some]
                yield pa.record_batch([
                    pa.array([key] * len(some), pa.int64()), pa.array(some, pa.int32()),
                    pa.array([wx.squeeze(np.diff(distinct[a:z], prepend=0).tobytes()) for a, z in cuts], pa.binary()),
                    pa.array([wx.squeeze(counts[a:z].tobytes()) for a, z in cuts], pa.binary()),
                ], names=["chunk", "bucket", "windows", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(np.frombuffer(wx.expand(x), dtype=np.int64)) for x in pdf["windows"]]
        windows, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = 64  # rows merged at a time
        for a in range(0, len(own), step):
            told = [np.frombuffer(wx.expand(x), dtype=np.int32) for x in pdf["counts"].iloc[a : a + step]]
            merged, back = np.unique(np.concatenate([windows, *own[a : a + step]]), return_inverse=True)
            windows, counts = merged, np.bincount(back, np.concatenate([counts, *told]), len(merged)).astype(np.int64)
        logs = sent.value.log_probability(windows, counts, min_count, divergence, prior)
        found = np.rint(np.maximum(logs, -15.9) * STEPS).astype(np.int16)
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "told": [wx.squeeze(found[np.searchsorted(windows, w)].tobytes()) for w in own]})

    told = coded.mapInArrow(tell, "chunk bigint, bucket int, windows binary, counts binary").groupBy("bucket").applyInPandas(answer, "chunk bigint, bucket int, told binary")
    by_chunk = told.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "told"))), lambda x: x["told"]).alias("told"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, head, windows, _), told in zip(opened(batch), batch.column(3).to_pylist()):
                _, _, place = ordered(windows)
                values = np.concatenate([np.frombuffer(wx.expand(x), dtype=np.int16) for x in told]) / STEPS
                of = np.repeat(np.arange(len(head.ids)), head.sizes)
                total = np.bincount(of, values[place], len(head.ids)) + head.inner
                yield pa.record_batch([
                    pa.array(head.ids, pa.int64(), mask=head.no_id), pa.array(head.sizes), pa.array(head.known), pa.array(head.base), pa.array(total),
                ], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = coded.join(by_chunk, "chunk").select("chunk", "head", "symbols", "told").mapInArrow(scored, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")
