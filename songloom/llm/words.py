"""Word exchange: ask a table of all distinct words, once for each word and chunk.

Texts are cut into words and taken in chunks of some million characters.
Within a chunk every word gets a number, so a text is an array of numbers and
a chunk asks for each of its distinct words once, whatever their frequency.
Questions travel packed: one row for each chunk and word bucket. A bucket sees
all questions for its words, works each distinct word out once, and answers
each chunk in the order asked. Joined back by chunk, the answers are looked up
by number.

Nothing is written in between: texts are cut twice, in the same chunks, which
needs an input that reads the same way twice (a table, not a random sample).
Each question carries a checksum of its chunk, and the join compares it, so a
changed input fails instead of giving wrong answers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import stable_hash

CHUNK_CHARS = 6_000_000
Split = Callable[[str], list[str]]


@dataclass
class Chunk:
    """Texts as word numbers. words are ordered by bucket; numbers follow that order."""

    key: int
    ids: np.ndarray
    no_id: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray
    words: list[str]
    starts: np.ndarray
    check: int


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(bytes(a) for a in arrays))


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_words(words: list[str]) -> bytes:
    coded = [w.encode() for w in words]
    return squeeze(np.fromiter(map(len, coded), dtype=np.uint32, count=len(coded)).tobytes(), *coded)


def unpack_words(raw: bytes, n: int) -> list[str]:
    body = expand(raw)
    ends = np.cumsum(np.frombuffer(body, dtype=np.uint32, count=n), dtype=np.int64) + 4 * n
    cuts = [4 * n, *ends.tolist()]
    return [body[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])]


class _Numbers(dict):
    """Numbers words as they are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def cut(batches: Iterator[pa.RecordBatch], split: Split, buckets: int) -> Iterator[Chunk]:
    """Chunks of (id, text) batches, the same at every reading."""
    part, seq = TaskContext.get().partitionId(), 0
    numbers, docs, ids, chars = _Numbers(), [], [], 0

    def close() -> Chunk:
        words = list(numbers)
        bucket = stable_hash(words) % np.uint32(buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), dtype=np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        words = [words[i] for i in order.tolist()]
        flat = np.concatenate([np.zeros(0, np.uint32), *docs])
        return Chunk(
            part << 32 | seq, np.array([0 if i is None else i for i in ids], dtype=np.int64), np.array([i is None for i in ids], dtype=bool),
            np.fromiter(map(len, docs), dtype=np.int64, count=len(docs)), place[flat] if len(words) else flat, words,
            np.searchsorted(bucket[order], np.arange(buckets + 1)), zlib.crc32("\n".join(words).encode()),
        )

    for batch in batches:
        keys = batch.column(0).to_pylist()
        texts = batch.column(1)
        for i, key in enumerate(keys):
            text = texts[i].as_py() or ""
            docs.append(np.array(list(map(numbers.__getitem__, split(text))), dtype=np.uint32))
            ids.append(key)
            chars += len(text)
            if chars >= CHUNK_CHARS:
                yield close()
                seq += 1
                numbers, docs, ids, chars = _Numbers(), [], [], 0
    if docs:
        yield close()


def questions(docs: DataFrame, split: Split, buckets: int, extra: Callable[[Chunk], np.ndarray] | None = None) -> DataFrame:
    """(chunk, bucket, check, n, words, extra): what each chunk asks of each bucket.

    extra gives one 64-bit number for each word of a chunk, to travel along.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in cut(batches, split, buckets):
            told = extra(c) if extra else None
            rows = []
            for b in np.nonzero(np.diff(c.starts))[0].tolist():
                a, z = int(c.starts[b]), int(c.starts[b + 1])
                rows.append((c.key, b, c.check, z - a, pack_words(c.words[a:z]), b"" if told is None else squeeze(told[a:z].astype(np.int64).tobytes())))
            if not rows:  # texts without a word still need their row
                rows = [(c.key, 0, c.check, 0, pack_words([]), b"" if told is None else squeeze(b""))]
            yield pa.record_batch(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                names=["chunk", "bucket", "check", "n", "words", "extra"],
            )

    return docs.mapInArrow(ask, "chunk bigint, bucket int, check bigint, n int, words binary, extra binary")


def answers(asked: DataFrame, serve: Callable[[list[list[str]], list[np.ndarray]], list[bytes]]) -> DataFrame:
    """(chunk, check, told): for each chunk the answers of all buckets, in bucket order.

    serve gets all questions of a bucket (words, extra numbers) and returns one answer for each.
    """

    def reply(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [unpack_words(w, n) for w, n in zip(pdf["words"], pdf["n"])]
        extra = [np.frombuffer(expand(x), dtype=np.int64) if x else np.zeros(0, np.int64) for x in pdf["extra"]]
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "check": pdf["check"], "told": serve(words, extra)})

    told = asked.groupBy("bucket").applyInPandas(reply, "chunk bigint, bucket int, check bigint, told binary")
    return told.groupBy("chunk").agg(F.first("check").alias("check"), F.transform(F.array_sort(F.collect_list(F.struct("bucket", "told"))), lambda x: x["told"]).alias("told"))


def numbered(docs: DataFrame, split: Split, buckets: int) -> DataFrame:
    """(chunk, check, body): the texts of a chunk as word numbers, packed."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in cut(batches, split, buckets):
            head = np.array([len(c.ids), len(c.numbers)], dtype=np.int64)
            raw = squeeze(head.tobytes(), c.ids.tobytes(), c.no_id.tobytes(), c.sizes.tobytes(), c.numbers.tobytes())
            yield pa.record_batch([pa.array([c.key], pa.int64()), pa.array([c.check], pa.int64()), pa.array([raw], pa.binary())], names=["chunk", "check", "body"])

    return docs.mapInArrow(body, "chunk bigint, check bigint, body binary")


def open_body(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, bounds of the texts, and word numbers of a packed chunk."""
    body = expand(raw)
    d, n = np.frombuffer(body, dtype=np.int64, count=2).tolist()
    ids = np.frombuffer(body, dtype=np.int64, count=d, offset=16).tolist()
    none = np.frombuffer(body, dtype=bool, count=d, offset=16 + 8 * d).tolist()
    sizes = np.frombuffer(body, dtype=np.int64, count=d, offset=16 + 9 * d)
    numbers = np.frombuffer(body, dtype=np.uint32, count=n, offset=16 + 17 * d)
    return [None if x else i for i, x in zip(ids, none)], np.concatenate([[0], np.cumsum(sizes)]), numbers


def meet(bodies: DataFrame, told: DataFrame) -> DataFrame:
    """Chunks with their answers: (body, told). Fails if the input changed between its two readings."""
    same = F.when(F.col("b.check") == F.col("t.check"), F.col("b.body")).otherwise(F.raise_error(F.lit("the input did not read the same way twice")).cast("binary"))
    return bodies.alias("b").join(told.alias("t"), F.col("b.chunk") == F.col("t.chunk"), "left").select(same.alias("body"), F.col("t.told").alias("told"))
