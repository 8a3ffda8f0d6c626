"""Structured Streaming forms of history ingestion, requests and the cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from songloom.operators.cache import MICROS, NEVER, replay_part
from songloom.operators.moods import resolve_context, resolve_mood
from songloom.operators.users import known_users, with_defaults
from songloom.session import scratch_path


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A given Parquet table as a file stream; new files are new rows."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{name}.parque[t]")  # a pattern, as a path to one file is refused; it fits this name alone
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
TIMERS_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUCKETS = 256  # states that the keys of a cache share


def run_to_table(stream: DataFrame, path: str, state_store: str | None = None) -> DataFrame:
    """Process what is there, appending to a Parquet table; then read it.

    A stream with timers needs TIMERS_STORE as its state store; the session's own setting is put back afterwards.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    if state_store:
        conf.set(STATE_STORE, state_store)
    try:
        return _run_to_table(stream, path)
    finally:
        if state_store:
            conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def _run_to_table(stream: DataFrame, path: str) -> DataFrame:
    writer: DataStreamWriter = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-progress")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    query: StreamingQuery = writer.start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def history_stream(events: DataFrame, users: DataFrame, user_key: str) -> DataFrame:
    """History rows of known users with defaults filled (stream-static)."""
    return known_users(with_defaults(events), users, user_key)


def request_stream(requests: DataFrame) -> DataFrame:
    """Each mood or context request with the mood rule it resolves to."""
    mood = F.when(F.col("kind") == "context", resolve_context(F.col("label"))).otherwise(resolve_mood(F.col("label")))
    return requests.withColumn("mood", mood)


class CacheReplay(StatefulProcessor):
    """The caches of the keys of one bucket in event time.

    Lookups wait until the watermark has passed them, so that none can still arrive before them; then they are replayed
    in time order, key by key. Of a replayed lookup nothing is kept but the expiry of its key's entry, and that goes
    when the watermark passes it: a later lookup misses either way. Rows wait as Arrow tables, one for each part that
    came, so state is read and written by the bucket, not by the key. One timer is set, at the first lookup or expiry.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.entry = handle.getValueState("entry", "entries binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _due(self, micros: int | None) -> None:
        """Set the bucket's timer, or take it away."""
        before = self.timer.get()[0] if self.timer.exists() else None
        at = None if micros is None else micros // 1000 + 1
        if at == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part.loc[part["key"].notna(), ["key", "at", "id", "ttl"]]
            if len(part):
                self.waiting.appendList([(_packed(part),)])
                early = int(part["at"].min())
                first = early if first is None else min(first, early)
        if first is not None and (not self.timer.exists() or first // 1000 + 1 < self.timer.get()[0]):
            self._due(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()  # this one has gone off
        entries = _unpacked(self.entry.get()[0]) if self.entry.exists() else pd.DataFrame({"key": [], "expires": []})
        expiry = dict(zip(entries["key"], entries["expires"]))
        parts = [_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat(parts, ignore_index=True) if parts else None
        if rows is not None and (rows["at"] < passed).any():
            left = rows[rows["at"] >= passed]
            if len(left):
                self.waiting.put([(_packed(left),)])
            else:
                self.waiting.clear()
            rows, waits = rows[rows["at"] < passed].sort_values(["key", "at", "id"], ignore_index=True), left
            hits = np.empty(len(rows), dtype=bool)
            keys, at, ttl = rows["key"].to_numpy(), rows["at"].to_numpy(), rows["ttl"].to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(rows)]
            for a, b in zip(edges[:-1], edges[1:]):
                hits[a:b], expiry[keys[a]] = replay_part(at[a:b], ttl[a:b], expiry.get(keys[a], NEVER))
            yield pd.DataFrame({"key": keys, "id": rows["id"], "is_hit": hits})
        else:
            waits = rows
        kept = {k: int(e) for k, e in expiry.items() if e >= passed}
        if kept:
            self.entry.update((_packed(pd.DataFrame({"key": list(kept), "expires": list(kept.values())})),))
        elif self.entry.exists():
            self.entry.clear()
        ahead = [*kept.values(), *([int(waits["at"].min())] if waits is not None and len(waits) else [])]
        self._due(min(ahead, default=None))

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow table in bytes."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(rows)).read_pandas()


def cache_stream(lookups: DataFrame, lateness: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Hit or miss of each lookup (key, ts, id, ttl), in event time.

    The same for any way in which lookups are spread over batches, as long as none comes more than ``lateness`` after
    a later one; Spark drops those. An outcome appears once the watermark has passed its lookup. A lookup without a
    key has no outcome; it only moves time on, which lets the last ones of a closed source out. Keys share ``buckets``
    states by their hash: a batch costs a call for each bucket, and not one for each key.
    """
    key_type = lookups.schema["key"].dataType.simpleString()
    # microseconds, as in the batch form; the watermark stays on the time itself
    timed = lookups.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"),
        "key", "id", "ts", F.unix_micros("ts").alias("at"), (F.col("ttl").cast("bigint") * MICROS).alias("ttl"),
    )
    return timed.groupBy("bucket").transformWithStateInPandas(CacheReplay(), f"key {key_type}, id bigint, is_hit boolean", "Append", "EventTime")


def stream_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
