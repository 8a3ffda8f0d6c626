"""Exact quantiles: sketches give narrow brackets, one counting pass reads them off."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.functions.numeric import is_missing
from songloom.session import cut_lineage

SKETCH = 4000  # values a sketch keeps, about
SLACK = 4 * 2.296 / SKETCH**0.9021  # four times the rank error that a sketch keeps within in 99 of 100 cases
GRID = 256  # steps of the shares that a sketch is asked for
READ_OFF = 100_000  # values of a bracket that may be put in order by one task
ROUNDS = 6  # most times a bracket is narrowed
SENT_ROWS = 10_000  # brackets that are sent to every task


def unpivot(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Wide to long: one (feature, value) row per present value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*(by or []), F.inline(pairs))
    return long.filter(~is_missing(F.col("value")))


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None, kept: bool = False
) -> DataFrame:
    """Interpolated quantiles as rows (by..., feature, prob, value).

    A mergeable sketch of each column (and group) brackets every wanted rank between two of its values. Values below a
    bracket are counted, those inside are counted by value, so the exact value at the rank can be told. A bracket that
    holds too many values for one task is narrowed first, by a sketch of what is inside; one that a sketch missed is
    opened again. Sketches and counts are folded before the shuffle: no task holds the values of a column or group, and
    rows are never dealt out by column. Without groups the brackets enter the plan as constants.

    ``kept`` tells that reading ``df`` several times is cheap; else its columns are written first.

    Null groups count as a group. Infinite values are the ends of the order; a quantile between a finite and an
    infinite value is the infinite one.
    """
    by = by or []
    narrow = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    narrow = narrow if kept else cut_lineage(narrow, "columns")  # several passes follow
    state = _ranks(_sketched(narrow, columns, by), probs)
    for _ in range(ROUNDS):
        state = cut_lineage(state, "brackets")
        if (state.filter("lo < hi").agg(F.max("held")).first()[0] or 0) <= READ_OFF:
            break
        state = _narrowed(narrow, columns, by, state, 2 * len(probs))
    else:
        state = cut_lineage(state, "brackets")
    running = Window.partitionBy("g", "i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside, below = _met(narrow, columns, by, state, 2 * len(probs))
    brackets = state.select("g", "i", "prob", "part", "rank", "upper", "lo").join(below, ["g", "i"])
    values = inside.groupBy("g", "i", "value").agg(F.count("*").alias("c"))
    # adding zero makes -0.0 the 0.0 that it is grouped as
    values = values.unionByName(brackets.filter("at IS NOT NULL").select("g", "i", (F.col("lo") + F.lit(0.0)).alias("value"), F.col("at").alias("c")))
    placed = values.join(brackets.drop("lo", "at"), ["g", "i"])
    found = placed.withColumn("end", F.col("below") + F.sum("c").over(running)).filter(F.col("end") > F.col("rank"))
    ends = found.groupBy("g", "prob", "part").agg(F.min(F.when(~F.col("upper"), F.col("value"))).alias("a"), F.min(F.when(F.col("upper"), F.col("value"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    between = F.when((a == b) | (F.abs(a) == float("inf")), a).when(F.abs(b) == float("inf"), b).otherwise(a + (b - a) * F.col("part"))
    return ends.select("g.*", "prob", between.alias("value"))


def _sketch(value: Column) -> Column:
    return F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("sketch")


def _present(column: str) -> Column:
    return F.when(~is_missing(F.col(column)), F.col(column))


def _long(narrow: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    # a struct, as null fields of a struct are equal in joins
    return unpivot(narrow, columns, by).select(F.struct(*by, "feature").alias("g"), "value")


def _sketched(narrow: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(g, n, sketch) of every column and group that has values."""
    if by:
        return _long(narrow, columns, by).groupBy("g").agg(F.count("*").alias("n"), _sketch(F.col("value")))
    facts = narrow.agg(*[F.struct(F.struct(F.lit(c).alias("feature")).alias("g"), F.count(_present(c)).alias("n"), _sketch(_present(c))).alias(c) for c in columns])
    return facts.select(F.inline(F.array(*[F.col(c) for c in columns]))).filter("n > 0")


def _bracket(rank: Column, n: Column) -> list[Column]:
    """Sketched values that enclose a rank of n. A sketch is asked for fixed shares only, so the ends lie on a grid."""
    at = (rank + F.lit(0.5)) / n
    told = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    low = F.greatest(F.floor((at - SLACK) * GRID), F.lit(0)).cast("int")
    high = F.least(F.ceil((at + SLACK) * GRID), F.lit(GRID)).cast("int")
    return [F.get(told, low).alias("lo"), F.get(told, high).alias("hi"), F.ceil(n * (2 * SLACK + 2 / GRID)).alias("held")]


def _ranks(sketched: DataFrame, probs: list[float]) -> DataFrame:
    """(g, i, prob, part, rank, upper, lo, hi, held): the ranks on either side of each quantile, with their brackets."""
    wanted = []
    for p in probs:
        at = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(at).cast("bigint")
        part = at - low
        for upper in (False, True):
            rank = low + F.when(part > 0, 1).otherwise(0) if upper else low
            wanted.append(F.struct(F.lit(float(p)).alias("prob"), part.alias("part"), rank.cast("bigint").alias("rank"), F.lit(upper).alias("upper")))
    rows = sketched.select("g", "n", "sketch", F.posexplode(F.array(*wanted)).alias("i", "w")).select("g", "n", "sketch", "i", "w.*")
    return rows.select("g", "i", "prob", "part", "rank", "upper", *_bracket(F.col("rank"), F.col("n")))


def _met(narrow: DataFrame, columns: list[str], by: list[str], state: DataFrame, brackets: int) -> tuple[DataFrame, DataFrame]:
    """(g, value, i) of the values inside brackets, and (g, i, below, at): how many values lie under each.

    Without groups a bracket of one value gives no rows: how often it occurs is counted in ``at``, else null.
    """
    if by:
        looked = _looked_up(_long(narrow, columns, by), state)
        return _inside(looked), _below(looked, brackets).withColumn("at", F.lit(None).cast("bigint"))
    listed = [(r["feature"], r["i"], r["lo"], r["hi"]) for r in state.select("g.feature", "i", "lo", "hi").collect()]  # a few for each column
    under = [
        F.struct(
            F.struct(F.lit(c).alias("feature")).alias("g"), F.lit(i).alias("i"), F.count_if(_present(c) < lo).alias("below"),
            (F.count_if(_present(c) == lo) if lo == hi else F.lit(None).cast("bigint")).alias("at"),
        )
        for c, i, lo, hi in listed
    ]
    hits = [(c, i, F.coalesce(_present(c).between(lo, hi), F.lit(False))) for c, i, lo, hi in listed if lo != hi]
    inside = [F.when(hit, F.struct(F.struct(F.lit(c).alias("feature")).alias("g"), F.col(c).alias("value"), F.lit(i).alias("i"))) for c, i, hit in hits]
    shape = "array<struct<g:struct<feature:string>,value:double,i:int>>"
    some = narrow.filter(reduce(Column.__or__, [hit for _, _, hit in hits], F.lit(False)))
    counts = narrow.agg(F.array(*under).cast("array<struct<g:struct<feature:string>,i:int,below:bigint,at:bigint>>").alias("b"))
    return some.select(F.inline(F.array_compact(F.array(*inside).cast(shape)))), counts.select(F.inline("b"))


def _looked_up(long: DataFrame, state: DataFrame) -> DataFrame:
    """Values with the brackets of their column (and group)."""
    listed = state.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("w"))
    # a join by key would deal the values out by column and group
    return long.join(F.broadcast(listed) if state.count() <= SENT_ROWS else listed, "g")


def _inside(looked: DataFrame) -> DataFrame:
    hit = F.filter("w", lambda x: F.col("value").between(x["lo"], x["hi"]))
    return looked.select("g", "value", F.explode(F.transform(hit, lambda x: x["i"])).alias("i"))


def _below(looked: DataFrame, brackets: int) -> DataFrame:
    """(g, i, below): how many values lie under each bracket of a column."""
    under = [F.count_if(F.col("value") < F.col("w")[i]["lo"]) for i in range(brackets)]
    return looked.groupBy("g").agg(F.array(*under).alias("b")).select("g", F.posexplode("b").alias("i", "below"))


def _narrowed(narrow: DataFrame, columns: list[str], by: list[str], state: DataFrame, brackets: int) -> DataFrame:
    """Brackets by sketches of what is inside the present ones."""
    inside, below = _met(narrow, columns, by, state, brackets)
    inside = inside.groupBy("g", "i").agg(F.count("*").alias("c"), _sketch(F.col("value")))
    # read three times
    rows = cut_lineage(state.join(below, ["g", "i"]).join(inside, ["g", "i"], "left").withColumn("c", F.coalesce("at", "c")), "narrowed")
    place = F.col("rank") - F.col("below")
    missed = F.col("c").isNull() | (place < 0) | (place >= F.col("c"))
    lo, hi, held = _bracket(place, F.col("c"))
    kept = rows.filter(~missed & F.col("at").isNull()).select("g", "i", "prob", "part", "rank", "upper", lo, hi, held)
    told = rows.filter(~missed & F.col("at").isNotNull()).select("g", "i", "prob", "part", "rank", "upper", "lo", "hi", "held")
    opened = rows.filter(missed).select("g", "i", "prob", "part", "rank", "upper", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1 << 60).cast("bigint").alias("held"))
    return kept.unionByName(told).unionByName(opened)


def medians_row(df: DataFrame, columns: list[str], kept: bool = False) -> DataFrame:
    """All medians side by side in one row."""
    q = exact_quantiles(df, columns, [0.5], kept=kept)
    return q.agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in columns])
