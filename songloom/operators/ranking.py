"""Exact ranks, splits and samples that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.session import cut_lineage

HEX_DIGITS = 4  # 16**4 hash buckets


def hash_of(id_col: str, seed: int = 42) -> Column:
    """A reproducible shuffle key: md5 of the id and a seed."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def holdout_sizes(test: float, val: float) -> Callable[[Column], tuple[Column, Column]]:
    """Test part first, rounded up, then the validation part of what is left."""

    def sizes(n: Column) -> tuple[Column, Column]:
        n_test = F.ceil(n * F.lit(test))
        n_val = F.ceil((n - n_test) * F.lit(val / (1 - test)))
        return n - n_test - n_val, n_val

    return sizes


def halved_tail_sizes(tail: float) -> Callable[[Column], tuple[Column, Column]]:
    """A held-out tail, rounded up, shared between validation and test."""

    def sizes(n: Column) -> tuple[Column, Column]:
        n_tail = F.ceil(n * F.lit(tail))
        n_test = F.ceil(n_tail * F.lit(0.5))
        return n - n_tail, n_tail - n_test

    return sizes


def exact_split(
    df: DataFrame,
    id_col: str,
    sizes: Callable[[Column], tuple[Column, Column]],
    strata: list[str] | None = None,
    seed: int = 42,
    kept: bool = False,
) -> DataFrame:
    """Add a ``split`` column (train, val, test) of exact size.

    Rows are ordered by ``hash_of`` the unique id. Counting rows per hash prefix
    finds the two prefixes in which the cuts fall; only their rows are ranked.
    The hashes at the cuts then label every row by comparison, so the table
    itself is never shuffled or sorted, however large one stratum is. Strata are
    few: their cuts travel as one map. ``kept`` works the cuts out now, for
    plans that read the parts several times.
    """
    strata = strata or []
    keyed = df.select(*strata, hash_of(id_col, seed).alias("_hash")).withColumn(
        "_prefix", F.substring("_hash", 1, HEX_DIGITS)
    )
    whole = Window.partitionBy(*strata)
    running = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    counts = (
        keyed.groupBy(*strata, "_prefix")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_total", F.sum("_rows").over(whole))
        .withColumn("_end", F.sum("_rows").over(running))
    )
    n_train, n_val = sizes(F.col("_total"))
    cuts = (
        counts.withColumn("_cut1", n_train)
        .withColumn("_cut2", n_train + n_val)
        .withColumn("_start", F.col("_end") - F.col("_rows"))
        .filter(
            ((F.col("_start") < F.col("_cut1")) & (F.col("_cut1") <= F.col("_end")))
            | ((F.col("_start") < F.col("_cut2")) & (F.col("_cut2") <= F.col("_end")))
        )
        .select(*strata, "_prefix", "_start", "_cut1", "_cut2")
    )
    inner = Window.partitionBy(*strata, "_prefix").orderBy("_hash")
    of = cuts.select(*[F.col(c).alias(f"_of_{c}") for c in [*strata, "_prefix"]], "_start", "_cut1", "_cut2")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*strata, "_prefix"]]  # null is a stratum
    # one or two prefixes for each stratum: sent to the rows, which a join by key would move to find these few
    ranked = keyed.join(F.broadcast(of), same).withColumn("_rank", F.row_number().over(inner) + F.col("_start"))
    at_cut = ranked.groupBy(*strata).agg(
        F.max(F.when(F.col("_rank") == F.col("_cut1"), F.col("_hash"))).alias("_hash1"),
        F.max(F.when(F.col("_rank") == F.col("_cut2"), F.col("_hash"))).alias("_hash2"),
    )
    at_cut = cut_lineage(at_cut, "cuts") if kept else at_cut
    hashed = df.withColumn("_hash", hash_of(id_col, seed))
    if strata:
        # one row per stratum: a scalar map, so rows of a large stratum never meet in a join
        entry = F.struct(F.struct(*strata), F.struct("_hash1", "_hash2"))
        cut_of = at_cut.select(F.map_from_entries(F.collect_list(entry))).scalar()
        hashed = hashed.withColumn("_cuts", cut_of).withColumn("_at", F.element_at("_cuts", F.struct(*strata)))
        hashed = hashed.select("*", "_at.*").drop("_cuts", "_at")
    else:
        hashed = hashed.withColumn("_at", at_cut.select(F.struct("_hash1", "_hash2")).scalar()).select("*", "_at.*").drop("_at")
    split = (
        F.when(F.col("_hash") <= F.col("_hash1"), F.lit("train"))
        .when(F.col("_hash") <= F.col("_hash2"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return hashed.withColumn("split", split).drop("_hash", "_hash1", "_hash2")


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same ones every time."""
    return df.orderBy(hash_of(id_col, seed), id_col).limit(n)


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Row number over the whole table, ascending by unique ``order`` columns.

    Spark sorts by range; each part is numbered by itself and written, then
    shifted by the sizes of the parts before it. No task sees the whole table.
    """
    number = F.monotonically_increasing_id()
    placed = df.sort(*order).select("*", F.shiftright(number, 33).alias("_part"), number.bitwiseAND((1 << 33) - 1).alias("_row"))
    written = cut_lineage(placed, "ranked")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        written.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    # one row per part of the sort, a few thousand at most
    return (
        written.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_row") + 1 + F.col("_before"))
        .drop("_part", "_row", "_before")
    )


def group_rank(df: DataFrame, group: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """Zero-based rank of each row in its group by ``order``, and the group size.

    ``chunk`` is a coarser step of the same order (a hash prefix, a day). Rows
    are ranked per chunk and shifted by the chunks before, so one hot group is
    worked on by many tasks.
    """
    keyed = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*group, "_chunk")
        .agg(F.count("*").alias("_rows"))
        .select(
            *group,
            "_chunk",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*group)).alias("group_size"),
        )
    )
    within = Window.partitionBy(*group, "_chunk").orderBy(*order)
    return (
        keyed.withColumn("_row", F.row_number().over(within))
        .join(offsets, [*group, "_chunk"])
        .withColumn(name, (F.col("_row") - 1 + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_row", "_before")
    )


def hash_rank(df: DataFrame, group: list[str], id_col: str, name: str, seed: int = 42) -> DataFrame:
    """``group_rank`` in the reproducible random order of ``hash_of``."""
    keyed = df.withColumn("_hash", hash_of(id_col, seed))
    return group_rank(keyed, group, ["_hash", id_col], F.substring("_hash", 1, 2), name).drop("_hash")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``.

    An aggregate, so copies are folded before the shuffle: a key that holds
    a third of all rows costs one row per input task.
    """
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows per key; Spark drops the others before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(
        F.col(name) <= k
    )
