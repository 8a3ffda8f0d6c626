"""Song lookup by stored lists of grams: built once, appended to, opened by any session.

``exact``: for each folded name, blocks of (artist, pos). ``grams``: for each
substring of one to three characters, blocks of names that hold it, in folders
by a hash of the gram. ``sizes``: entries per gram. A block holds at most
``BLOCK`` entries, so a common gram is many rows, which joins deal out by salt.
Substrings of one or two characters, which most names hold, keep only the first
song of each artist: no lookup needs another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songloom.operators.search import artist_matches
from songloom.session import cut_lineage

BLOCK = 4096
SALTS = 8
SHARDS = 64
EXACT = "name string, salt int, entries array<struct<pos: bigint, artist: string>>"
GRAMS = "gram string, salt int, entries array<struct<pos: bigint, name: string, artist: string>>, shard int"
SIZES = "gram string, entries bigint"


def substrings(text: Column, size: int) -> Column:
    """The distinct substrings of one size; none for shorter or missing text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    found = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, found).otherwise(F.array().cast("array<string>"))


def blocks(entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, salt, entries): lists of at most ``BLOCK`` entries in order of pos.

    Entries are dealt out by ranges of key and pos first, so that the entries
    of a common key stay apart and no window holds them all.
    """
    dealt = entries.repartitionByRange(key, "pos").withColumn("_part", F.spark_partition_id())
    order = Window.partitionBy("_part", key).orderBy("pos")
    numbered = dealt.withColumn("_block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    listed = numbered.groupBy("_part", key, "_block").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("entries"))
    return listed.select(key, F.pmod(F.xxhash64("_part", "_block"), F.lit(SALTS)).cast("int").alias("salt"), "entries")


def shard(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHARDS)).cast("int")


class NameIndex:
    """A stored index. ``pos`` numbers songs; of equal names by one artist the first counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, songs: DataFrame, folder: str) -> NameIndex:
        """Write the index of (pos, song, artist); one that is there already is never overwritten."""
        index = cls(songs.sparkSession, folder)
        index._write(songs, "error")
        return index

    def append(self, songs: DataFrame) -> None:
        """Add songs. Lists that are there stay as they are; a song added twice is found once."""
        self._write(songs, "append")

    def _write(self, songs: DataFrame, mode: str) -> None:
        named = songs.filter("song IS NOT NULL AND pos IS NOT NULL")
        names = cut_lineage(named.groupBy(F.lower("song").alias("name"), F.lower("artist").alias("artist")).agg(F.min(F.col("pos").cast("bigint")).alias("pos")), "names")
        blocks(names, "name", ["artist"]).write.mode(mode).parquet(f"{self.folder}/exact")
        long = names.select(F.explode(substrings(F.col("name"), 3)).alias("gram"), "pos", "name", "artist")
        short = names.select(F.explode(F.concat(substrings(F.col("name"), 1), substrings(F.col("name"), 2))).alias("gram"), "pos", "artist")
        first = short.groupBy("gram", "artist").agg(F.min("pos").alias("pos")).withColumn("name", F.col("gram"))
        entries = cut_lineage(long.unionByName(first), "grams")
        entries.groupBy("gram").agg(F.count("*").alias("entries")).write.mode(mode).parquet(f"{self.folder}/sizes")
        listed = blocks(entries, "gram", ["name", "artist"]).withColumn("shard", shard(F.col("gram")))
        listed.write.mode(mode).partitionBy("shard").parquet(f"{self.folder}/grams")

    def find(self, requests: DataFrame, strict: bool = False) -> DataFrame:
        """(request_id, pos, is_exact) of each request (request_id, name, artist) that finds a song.

        First an exact name whose artist fits, else the first name that holds
        the request; in the strict form the artist must fit there as well. Equal
        requests are looked up once. Blank or null names find nothing. A block
        answers each lookup with one position, inside the join's own task.
        """
        wanted = requests.select("request_id", F.lower("name").alias("asked"), F.lower("artist").alias("asked_artist")).filter(F.trim("asked") != "")
        asked = cut_lineage(wanted.select("asked", "asked_artist").distinct(), "asked")
        key = ["asked", "asked_artist"]
        salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

        def first_fit(joined: DataFrame, holds: bool, by_artist: bool, name: str) -> DataFrame:
            def fits(e: Column) -> Column:
                ok = F.lit(True)
                if holds:
                    ok = ok & F.contains(e["name"], F.col("asked"))
                if by_artist:
                    ok = ok & F.coalesce(artist_matches(e["artist"], F.col("asked_artist")), F.lit(False))
                return ok

            best = F.array_min(F.transform(F.filter("entries", fits), lambda e: e["pos"]))
            return joined.select(*key, best.alias("best")).filter("best IS NOT NULL").groupBy(*key).agg(F.min("best").alias(name))

        stored = self.spark.read.schema(EXACT).parquet(f"{self.folder}/exact").withColumnRenamed("name", "asked")
        exact = first_fit(asked.select(*key, salted).join(stored, ["asked", "salt"]), False, True, "exact_pos")

        sizes = self.spark.read.schema(SIZES).parquet(f"{self.folder}/sizes").groupBy("gram").agg(F.sum("entries").alias("entries"))
        own = F.when(F.length("asked") < 3, F.array("asked")).otherwise(substrings(F.col("asked"), 3))
        # a gram that no name holds ends a request here
        met = asked.select(*key, F.explode(own).alias("gram")).join(sizes, "gram", "left")
        rare = met.groupBy(*key).agg(F.min_by("gram", F.struct(F.coalesce("entries", F.lit(0)), F.col("gram"))).alias("gram"), F.min(F.coalesce("entries", F.lit(0))).alias("least"))
        rare = cut_lineage(rare.filter("least > 0").select(*key, "gram", shard(F.col("gram")).alias("shard")), "rarest")
        shards = [r["shard"] for r in rare.select("shard").distinct().collect()]  # at most SHARDS
        lists = self.spark.read.schema(GRAMS).parquet(f"{self.folder}/grams").filter(F.col("shard").isin(shards))
        partial = first_fit(rare.select(*key, "gram", "shard", salted).join(lists, ["shard", "gram", "salt"]), True, strict, "part_pos")

        def same(side: str) -> Column:
            return F.col("w.asked").eqNullSafe(F.col(f"{side}.asked")) & F.col("w.asked_artist").eqNullSafe(F.col(f"{side}.asked_artist"))

        found = wanted.alias("w").join(exact.alias("e"), same("e"), "left").join(partial.alias("p"), same("p"), "left")
        told = found.select("request_id", F.coalesce("exact_pos", "part_pos").alias("pos"), F.col("exact_pos").isNotNull().alias("is_exact"))
        return told.filter("pos IS NOT NULL")
