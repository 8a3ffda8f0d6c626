"""The lookup cache: entry lifetimes, statistics, and the hit / miss replay."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.session import cut_lineage, scratch_path

MICROS = 1_000_000
SLOT_ROWS = 5_000_000
MAX_SLOTS = 512
NEVER = -(1 << 62)  # before any time


def lifetime(outcome: Column) -> Column:
    """Seconds an answer is kept: found, not found (or timeout), other error."""
    return (
        F.when(outcome == "found", fixed.TTL_FOUND)
        .when(outcome == "error", fixed.TTL_ERROR)
        .otherwise(fixed.TTL_NOT_FOUND)
    )


def live(entries: DataFrame, as_of: Column) -> DataFrame:
    return entries.filter(F.col("expires_at") > as_of)


def stats(entries: DataFrame, as_of: Column) -> DataFrame:
    return entries.agg(
        F.count("*").alias("total_keys"), F.count_if(F.col("expires_at") > as_of).alias("alive_keys")
    )


def replay_part(ts: np.ndarray, ttl: np.ndarray, expires: int) -> tuple[np.ndarray, int]:
    """Hits of time-ordered lookups of one key, and the expiry afterwards.

    A lookup at or after the expiry misses and fills the entry anew, so the
    replay jumps from miss to miss.
    """
    hit = np.ones(len(ts), dtype=bool)
    at = int(np.searchsorted(ts, expires, "left"))
    while at < len(ts):
        hit[at] = False
        expires = int(ts[at] + ttl[at])
        at = int(np.searchsorted(ts, expires, "left"))
    return hit, expires


def exits_of(ts: np.ndarray, ttl: np.ndarray) -> np.ndarray:
    """For each lookup: the expiry after the last one, were it a miss."""
    ends = ts + ttl
    after = np.searchsorted(ts, ends, "left")
    while (after < len(ts)).any():
        more = after < len(ts)
        ends[more], after[more] = ends[after[more]], after[after[more]]
    return ends


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches regrouped so that no group is cut in two."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = (rows[by] == rows[by].iloc[-1]).all(axis=1).to_numpy()
        held = rows[last]
        if not last.all():
            yield rows[~last]
    if held is not None:
        yield held


def replay(lookups: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Hit or miss of every lookup (key, ts, id, ttl) as (key, id, is_hit).

    Each key is replayed in time order by a pass that keeps one number. A key
    with more than ``slot_rows`` lookups is cut into time slots first; once it
    is known with which expiry each slot begins, slots are replayed apart.
    """
    timed = lookups.select(
        "key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("ttl").cast("bigint") * MICROS).alias("ttl")
    )
    counts = timed.groupBy("key").agg(F.count("*").alias("rows"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    hot = counts.filter(F.col("rows") > slot_rows)
    largest = hot.agg(F.max("rows")).first()[0]
    if largest is None:
        slotted = timed.select("*", F.lit(0).alias("slot"), F.lit(NEVER).alias("entry"))
    else:
        # at most (all rows / slot_rows) keys
        slots = min(MAX_SLOTS, -(-largest // slot_rows))
        cuts = cut_lineage(hot.select("key", "lo", (F.floor((F.col("hi") - F.col("lo")) / slots) + 1).alias("width")), "hot-keys")
        slot = F.floor((F.col("at") - F.col("lo")) / F.col("width")).cast("int")
        entries = _slot_entries(timed.join(cuts, "key").withColumn("slot", slot), slots)
        slotted = (
            timed.join(cuts, "key", "left")
            .withColumn("slot", F.coalesce(slot, F.lit(0)))
            .join(entries, ["key", "slot"], "left")
            .withColumn("entry", F.coalesce("entry", F.lit(NEVER)))
        )
    ordered = slotted.select("key", "slot", "entry", "at", "id", "ttl").repartition("key", "slot").sortWithinPartitions("key", "slot", "at", "id")
    key_type = lookups.schema["key"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, expires = None, NEVER
        for batch in batches:
            if not len(batch):
                continue
            keys, slots_, entry = batch["key"].to_numpy(), batch["slot"].to_numpy(), batch["entry"].to_numpy()
            ts, ttl = batch["at"].to_numpy(), batch["ttl"].to_numpy()
            changed = (keys[1:] != keys[:-1]) | (slots_[1:] != slots_[:-1])
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
            hits = np.empty(len(batch), dtype=bool)
            for a, b in zip(edges[:-1], edges[1:]):
                if (keys[a], slots_[a]) != current:
                    current, expires = (keys[a], slots_[a]), entry[a]
                hits[a:b], expires = replay_part(ts[a:b], ttl[a:b], expires)
            yield pd.DataFrame({"key": keys, "id": batch["id"].to_numpy(), "is_hit": hits})

    return ordered.mapInPandas(fold, f"key {key_type}, id bigint, is_hit boolean")


def _slot_entries(rows: DataFrame, slots: int) -> DataFrame:
    """Expiry with which each slot of each hot key begins (key, slot, entry).

    All slots are first worked out at once: what expiry every lookup would
    lead to, were it the slot's first miss. Then the slots are taken in order;
    each step only finds the first lookup at or after the expiry so far.
    """
    spark = rows.sparkSession
    key_type = rows.schema["key"].dataType.simpleString()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ["key", "slot"]):
            for _, group in part.groupby(["key", "slot"], sort=False):
                leads_to = exits_of(group["at"].to_numpy(), group["ttl"].to_numpy())
                yield pd.DataFrame({"key": group["key"], "slot": group["slot"], "at": group["at"], "id": group["id"], "leads_to": leads_to})

    sorted_rows = rows.select("key", "slot", "at", "id", "ttl").repartition("key", "slot").sortWithinPartitions("key", "slot", "at", "id")
    path = scratch_path(spark, "slot-exits")
    schema = f"key {key_type}, slot int, at bigint, id bigint, leads_to bigint"
    sorted_rows.mapInPandas(ends, schema).write.partitionBy("slot").parquet(path)
    exits = spark.read.schema(schema).parquet(path)

    state = spark.createDataFrame([], f"key {key_type}, entry bigint")
    entries = []
    for number in range(slots):
        entries.append(state.withColumn("slot", F.lit(number)))
        first = (
            exits.filter(F.col("slot") == number)
            .join(state, "key", "left")
            .filter(F.col("at") >= F.coalesce("entry", F.lit(NEVER)))
            .groupBy("key")
            .agg(F.min_by("leads_to", F.struct("at", "id")).alias("leads_to"))
        )
        moved = state.join(first, "key", "full").select("key", F.coalesce("leads_to", "entry").alias("entry"))
        state = cut_lineage(moved, "slot-state")
    return reduce(DataFrame.unionByName, entries)
