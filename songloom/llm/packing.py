"""Vector best-fit packing of documents into sequences.

Documents become pieces: their token ids with the end id, cut only where they
are longer than a sequence. Every piece uses three capacities of a sequence:
tokens, documents, and attention cost (the sum of squared lengths). Pieces are
placed longest first into the open sequence that keeps every capacity and
scores best: by the least weighted norm of what would be left, or by the
greatest weighted dot product of need and residual.

Pieces are dealt at random into groups of some ten thousand, packed apart, so
the work spreads and no task holds more than a group. A group wastes about a
sequence. Only lengths are shuffled, never ids. Full pieces need no packing.

Tokens: a text is cut at spaces and line breaks, which the tokenizer drops and
which keep words apart, and each distinct word is encoded once per worker. Plain
Latin words take a short cut: the merges, ranked by their order, are run by a
byte-pair merger, with the byte 0, which plain words lack, as the end-of-word
mark. It gives the tokenizer's ids because every entry of the vocabulary encodes
to itself (tests check this); any other word goes to the tokenizer.

Defined results: a null text reads as empty and gives one piece, the end id
alone; repeated rows and null ids are packed like others; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from songloom.llm.common import cut_lineage

PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
TOKEN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")
BREAKS = "\n\t\r\x0b\x0c"
MARK = b"\0"
HELD_WORDS = 200_000
BATCH_CHARS = 2_000_000
GROUP = 12_000


class _Numbers(dict):
    """Numbers words as they are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordTokenizer:
    """Ids of texts, word by word, with a bounded memory of words seen."""

    def __init__(self, definition: str):
        self.whole = Tokenizer.from_str(definition)
        self.held: dict[str, bytes] = {}
        model = json.loads(definition)["model"]
        octet = {c: bytes([b]) for b, c in byte_letters().items()}

        def raw(token: str) -> bytes:
            ended = token.endswith("</w>")
            return b"".join(octet[c] for c in (token[:-4] if ended else token)) + (MARK if ended else b"")

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        entries = [bytes([b]) for b in range(256)] + [bytes([b]) + MARK for b in range(1, 256)]
        entries += [raw(a + b) for a, b in merges]
        ranks = {entry: i for i, entry in reversed(list(enumerate(entries)))}
        ids = {raw(t): i for t, i in model["vocab"].items() if not (t.startswith("<|") and t.endswith("|>"))}
        self.id_of = np.array([ids.get(entry, 0) for entry in entries], dtype=np.uint32)
        self.ends = np.array([entry.endswith(MARK) for entry in entries])
        self.merger = tiktoken.Encoding("merges", pat_str=r"[^\x00\n]+\x00", mergeable_ranks=ranks, special_tokens={})

    def plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters and signs, all in one go."""
        marked = TOKEN_PARTS.sub("\\g<0>\0", "\n".join(words).lower())
        ranks = np.array(self.merger.encode_ordinary(marked), dtype=np.int64)
        parts = np.cumsum([w.count("\0") for w in marked.split("\n")])
        cuts = 4 * (np.nonzero(self.ends[ranks])[0][parts - 1] + 1)
        raw = self.id_of[ranks].tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist())]

    def learn(self, words: list[str]) -> None:
        """Put the ids of words that are not held into the memory."""
        if len(self.held) > HELD_WORDS:
            self.held = {}
        plain = [w for w in words if PLAIN.fullmatch(w) and "<|" not in w]
        if plain:
            self.held.update(zip(plain, self.plain_words(plain)))
        if len(plain) < len(words):
            done = set(plain)
            for w in words:
                if w not in done:
                    self.held[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of texts."""
        numbers = _Numbers()
        docs = []
        for text in texts:
            for c in BREAKS:
                if c in text:
                    text = text.replace(c, " ")
            docs.append(list(map(numbers.__getitem__, text.split(" "))))
        ids = list(map(self.held.get, numbers))
        missing = [w for w, i in zip(numbers, ids) if i is None]
        if missing:
            self.learn([w for w in missing if w])
            ids = [self.held.get(w, b"") if i is None else i for w, i in zip(numbers, ids)]
        return [b"".join(map(ids.__getitem__, d)) for d in docs]


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def tokenizer(definition: str) -> WordTokenizer:
    return WordTokenizer(definition)


def encoded(tok: WordTokenizer, column: pa.Array) -> Iterator[bytes]:
    held, chars = [], 0
    for text in column:
        held.append(text.as_py() or "")
        chars += len(held[-1])
        if chars > BATCH_CHARS:
            yield from tok.encode(held)
            held, chars = [], 0
    yield from tok.encode(held)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): documents as pieces of at most ``capacity`` tokens. ids is null unless kept."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype=np.uint32).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(sent.value)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for key, raw in zip(batch.column(0).to_pylist(), encoded(tok, batch.column(1))):
                raw += end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    ids = np.frombuffer(own, dtype=np.int32) if keep_ids else None
                    for column, value in zip(rows, (key, n, at // 4, len(own) // 4, zlib.crc32(own), ids)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        tok.held = {}  # workers outlive a task

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>")


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, longest first."""
    limit = np.array([capacity, max_docs, max_cost], dtype=float)
    w = np.array(weights)[:, None]
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    left = np.ones((3, n))
    filled = np.zeros(n, dtype=np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        need = np.array([[size], [1], [float(size) * size]]) / limit[:, None]
        after = left[:, :opened] - need
        fits = np.nonzero((after > -1e-12).all(axis=0) & (filled[:opened] + size <= capacity))[0]
        if len(fits):
            score = (w * after[:, fits] ** 2).sum(axis=0) if rule == "norm" else -(w * need * left[:, fits]).sum(axis=0)
            b = int(fits[np.argmin(score)])
        else:
            b, opened = opened, opened + 1
        bins[i], offsets[i] = b, filled[b]
        left[:, b] -= need[:, 0]
        filled[b] += size
    return bins, offsets


def pack(cut: DataFrame, capacity: int = 4096, max_docs: int = 4096, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm") -> DataFrame:
    """The pieces with sequence_id and offset.

    A sequence never holds more than ``capacity`` tokens, ``max_docs`` pieces or ``max_cost`` attention cost
    (capacity squared unless given, which one full piece uses up). A piece that breaks a limit alone gets a
    sequence of its own.
    """
    cost = float(capacity) ** 2 if max_cost is None else max_cost
    rows = cut_lineage(cut.withColumn("piece_row", F.monotonically_increasing_id()), "packing-pieces")
    part = F.col("length") < capacity
    groups = max(1, -(-rows.filter(part).count() // GROUP))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece_row", ignore_index=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity, max_docs, cost, weights, rule)
        return pd.DataFrame({"piece_row": pdf["piece_row"], "sequence_id": (pdf["pack_group"] * GROUP * 2 + bins) * 2, "offset": offsets})

    small = rows.filter(part).select("piece_row", "length", F.pmod(F.xxhash64("piece_row"), F.lit(groups)).alias("pack_group"))
    placed = small.groupBy("pack_group").applyInPandas(place, "piece_row bigint, sequence_id bigint, offset bigint")
    full = rows.filter(~part).withColumns({"sequence_id": F.col("piece_row") * 2 + 1, "offset": F.lit(0).cast("bigint")})
    return rows.filter(part).join(placed, "piece_row").unionByName(full).drop("piece_row")
