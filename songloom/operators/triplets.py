"""Training triplets: anchor, similar song, song of another genre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions import vectors as V
from songloom.functions.text import merge_key
from songloom.operators.ranking import global_rank, hash_rank
from songloom.session import cut_lineage


def draw(id_col: str, seed: int) -> Column:
    """A reproducible non-negative integer per id."""
    digits = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint")


def positives(songs: DataFrame) -> DataFrame:
    """First listed similar song that the catalogue holds (id, positive_id).

    Of songs with an equal artist and name the last one counts.
    """
    known = songs.groupBy(merge_key(F.col("artist"), F.col("song")).alias("key")).agg(F.max("id").alias("positive_id"))
    listed = songs.select("id", F.posexplode(F.slice("similar", 1, 3)).alias("place", "other")).select(
        "id", "place", merge_key(F.col("other.artist"), F.col("other.song")).alias("key")
    )
    return listed.join(known, "key").groupBy("id").agg(F.min_by("positive_id", "place").alias("positive_id"))


def genre_ranks(songs: DataFrame) -> DataFrame:
    named = songs.filter(F.col("genre").isNotNull()).select("id", F.lower("genre").alias("genre"))
    return hash_rank(named, ["genre"], "id", "place")


def aimed_same(ranks: DataFrame, seed: int) -> DataFrame:
    """(id, genre, place) of another song of the same genre; none where a song is alone."""
    step = F.col("place") + 1 + F.pmod(draw("id", seed), F.col("group_size") - 1)
    return ranks.filter(F.col("group_size") > 1).select("id", "genre", F.pmod(step, F.col("group_size")).alias("place"))


def aimed_other(ranks: DataFrame, seed: int) -> DataFrame:
    """(id, genre, place) of a song of another genre: genre first, then song."""
    sizes = ranks.groupBy("genre").agg(F.count("*").alias("rows"))
    genres = cut_lineage(global_rank(sizes, ["genre"], "number").withColumn("number", F.col("number") - 1), "genres")
    total = genres.agg(F.count("*")).scalar()
    own = ranks.select("id", "genre").join(genres.select("genre", "number"), "genre").withColumn("genres", total)
    step = F.col("number") + 1 + F.pmod(draw("id", seed), F.col("genres") - 1)
    chosen = own.filter(F.col("genres") > 1).select("id", F.pmod(step, F.col("genres")).alias("number"))
    return chosen.join(genres.withColumnRenamed("genre", "other"), "number").select(
        "id", F.col("other").alias("genre"), F.pmod(draw("id", seed + 1), F.col("rows")).alias("place")
    )


def drawn(aimed: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    return aimed.join(ranks.select("genre", "place", F.col("id").alias(name)), ["genre", "place"]).drop("genre", "place")


def same_genre(songs: DataFrame, seed: int = 1) -> DataFrame:
    """Another song of the same genre, drawn by hash (id, positive_id)."""
    ranks = cut_lineage(genre_ranks(songs), "genre-ranks")
    return drawn(aimed_same(ranks, seed), ranks, "positive_id")


def other_genre(songs: DataFrame, seed: int = 2) -> DataFrame:
    """A song of another genre (id, negative_id)."""
    ranks = cut_lineage(genre_ranks(songs), "genre-ranks")
    return drawn(aimed_other(ranks, seed), ranks, "negative_id")


def mine(songs: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, negative_id); anchors with no positive drop out.

    Songs with their similar ones are written once, and so are the ranks within
    genres; both draws of a song meet the ranks in one join.
    """
    table = cut_lineage(songs.select("id", "artist", "song", "genre", "similar"), "triplet-songs")
    ranks = cut_lineage(genre_ranks(table), "genre-ranks")
    aimed = aimed_same(ranks, 1).withColumn("side", F.lit("same")).unionByName(aimed_other(ranks, 2).withColumn("side", F.lit("other")))
    met = drawn(aimed, ranks, "met_id").unionByName(positives(table).select("id", F.lit("listed").alias("side"), F.col("positive_id").alias("met_id")))
    sides = {side: F.max(F.when(F.col("side") == side, F.col("met_id"))).alias(side) for side in ("same", "other", "listed")}
    found = met.groupBy("id").agg(*sides.values()).select(
        F.col("id").alias("anchor_id"), F.coalesce("listed", "same").alias("positive_id"), F.col("other").alias("negative_id")
    )
    return found.filter(F.col("positive_id").isNotNull() & F.col("negative_id").isNotNull())


def margin_loss(triplets: DataFrame, vectors: DataFrame, margin: float = fixed.TRIPLET_MARGIN) -> DataFrame:
    """Mean of max(0, d(a,p) - d(a,n) + margin) over the triplets."""

    def side(name: str) -> DataFrame:
        return vectors.select(F.col("id").alias(f"{name}_id"), F.col("embedding").alias(name))

    rows = triplets
    for name in ("anchor", "positive", "negative"):
        rows = rows.join(side(name), f"{name}_id")
    gap = F.sqrt(V.squared_l2(F.col("anchor"), F.col("positive"))) - F.sqrt(V.squared_l2(F.col("anchor"), F.col("negative")))
    return rows.agg(F.count("*").alias("triplets"), F.avg(F.greatest(F.lit(0.0), gap + margin)).alias("loss"))
