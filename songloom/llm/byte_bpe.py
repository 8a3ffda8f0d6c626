"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

A text is cut before every single space that stands between two characters
that are no white space. Such a space always begins a new pre-token and never
changes the ones before it, so each word (its space included) is a run of whole
pre-tokens and can be encoded apart from its text. Words travel with positions
through the word exchange (songloom.llm.words): each distinct word is encoded
once, ids are joined back by chunk and put together by position.

Decoding joins ids with the token-byte table, which is as large as the
vocabulary and so has a fixed bound, and concatenates by position.

Defined results: a null text encodes to no ids, as an empty one does; null ids
decode to null; ids outside the table raise an error; copies and repeated rows
are encoded alike; texts of any length are taken whole; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm import words as wx
from songloom.llm.common import parts_of

CROWDED = re.compile(r"\s\s")
BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")


def space_words(text: str) -> list[str]:
    """The words of a text without the space before them; the first one, which has none, is marked by a space."""
    if not text:
        return []
    if CROWDED.search(text) is None:
        found = text.split(" ")
    else:
        first, *rest = BEFORE_WORD.split(text)
        found = [first, *[w[1:] for w in rest]]
    found[0] = " " + found[0]
    return found


def literal(word: str) -> str:
    return word[1:] if word.startswith(" ") else " " + word


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(ranks: bytes) -> list[bytes | None]:
    pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines())]
    table: list[bytes | None] = [None] * (1 + max(i for i, _ in pairs))
    for i, token in pairs:
        table[i] = token
    return table


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<int>): the token ids of every text, one row for each row read."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    buckets = parts_of(docs)

    def serve(asked: list[list[str]], _: list[np.ndarray]) -> list[bytes]:
        enc, known = encoder(sent.value, pattern), {}
        out = []
        for words in asked:
            got = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    known[w] = ids = np.array(enc.encode_ordinary(literal(w)), dtype=np.uint32).tobytes()
                got.append(ids)
            sizes = np.fromiter(map(len, got), dtype=np.uint32, count=len(got))
            out.append(wx.squeeze(np.array([len(got)], dtype=np.uint32).tobytes(), sizes.tobytes(), *got))
        return out

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, told in zip(batch.column(0), batch.column(1)):
                ids, bounds, numbers = wx.open_body(body.as_py())
                sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
                for one in told.as_py():
                    got = np.frombuffer(wx.expand(one), dtype=np.uint32)
                    sizes.append(got[1 : 1 + got[0]].astype(np.int64) // 4)
                    flat.append(got[1 + got[0] :])
                size, tokens = np.concatenate(sizes), np.concatenate(flat)
                start = np.concatenate([[0], np.cumsum(size)])
                for a in range(0, len(ids), 256):
                    z = min(a + 256, len(ids))
                    own = numbers[bounds[a] : bounds[z]]
                    count = size[own]
                    ends = np.concatenate([[0], np.cumsum(count)])
                    place = np.arange(ends[-1]) - np.repeat(ends[:-1], count) + np.repeat(start[own], count)
                    offsets = ends[bounds[a : z + 1] - bounds[a]].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[place].astype(np.int32)))
                    yield pa.record_batch([pa.array(ids[a:z], pa.int64()), lists], names=["doc_id", "ids"])

    told = wx.answers(wx.questions(source, space_words, buckets), serve)
    return wx.meet(wx.numbered(source, space_words, buckets), told).mapInArrow(assemble, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The rows with a column decoded (binary): the bytes of their ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    kept = [c for c in encoded.columns if c != "decoded"]
    at = kept.index(ids_col)
    schema = encoded.select(*kept).schema.add("decoded", "binary")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(sent.value)
        for batch in batches:
            rows = []
            for one in batch.column(at):
                ids = None if not one.is_valid else one.values.to_numpy(zero_copy_only=False).tolist()
                rows.append(None if ids is None else b"".join(map(table.__getitem__, ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(look_up, schema)
