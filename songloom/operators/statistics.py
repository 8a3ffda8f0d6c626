"""Statistics fitted over a table and applied back to its rows.

A fitted table has one row and enters the plan as a scalar subquery: Spark
computes it once, and applying it adds neither a join nor a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions.numeric import is_missing, zscore
from songloom.operators.quantiles import exact_quantiles, medians_row
from songloom.session import cut_lineage


def attach(df: DataFrame, stats: DataFrame, name: str = "_stats") -> DataFrame:
    """Add a one-row table to every row as a struct column."""
    return df.withColumn(name, stats.select(F.struct("*")).scalar())


def pinned(stats: DataFrame) -> DataFrame:
    """A one-row table computed now, for plans that use it several times."""
    return stats.sparkSession.createDataFrame([stats.first()], stats.schema)


def fit(df: DataFrame, columns: list[str], population: bool) -> DataFrame:
    """One row with a struct (mean, std, min, max) per column."""
    spread = F.stddev_pop if population else F.stddev_samp
    return df.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"), spread(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
            ).alias(c)
            for c in columns
        ]
    )


def fit_long(df: DataFrame, columns: list[str], population: bool) -> DataFrame:
    """The same statistics, one row per feature."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), f"{c}.mean", f"{c}.std", f"{c}.min", f"{c}.max") for c in columns])
    return fit(df, columns, population).select(F.inline(rows))


def apply_zscore(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    s = F.col("_stats")
    scaled = {c: zscore(F.col(c), s.getField(c).getField("mean"), s.getField(c).getField("std")) for c in columns}
    return attach(df, stats).withColumns(scaled).drop("_stats")


def rescale_percent(df: DataFrame, columns: list[str], threshold: float = 1.0) -> DataFrame:
    """Divide a column by 100 when its maximum shows a 0-100 scale."""
    stats = df.agg(*[F.max(c).alias(c) for c in columns])
    top = F.col("_stats")
    scaled = {c: F.when(top.getField(c) > threshold, F.col(c) / 100.0).otherwise(F.col(c)) for c in columns}
    return attach(df, stats).withColumns(scaled).drop("_stats")


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])
    s = F.col("_stats")

    def scaled(c: str) -> Column:
        lo, hi = s.getField(c).getField("lo"), s.getField(c).getField("hi")
        return (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))

    return attach(df, stats).withColumns({c: scaled(c) for c in columns}).drop("_stats")


def impute_median(df: DataFrame, columns: list[str], kept: bool = False) -> DataFrame:
    """Fill missing numbers with the exact column median.

    ``kept`` tells that reading ``df`` several times is cheap: its columns are
    not written for the medians, and these are worked out now, for all plans
    that read the result.
    """
    m = F.col("_stats")
    filled = {c: F.when(is_missing(F.col(c)), m.getField(c)).otherwise(F.col(c)) for c in columns}
    medians = medians_row(df, columns, kept)
    return attach(df, pinned(medians) if kept else medians).withColumns(filled).drop("_stats")


def impute_labels(df: DataFrame) -> DataFrame:
    return df.fillna({"emotion": "neutral", "genre": "Unknown"})


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every listed column is present."""
    return df.dropna(subset=columns)


def null_profile(df: DataFrame) -> DataFrame:
    """Missing count and share per column."""

    def missing(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        gone = is_missing(F.col(c)) if kind in ("double", "float") else F.col(c).isNull()
        return F.count_if(gone).alias(c)

    counted = df.agg(F.count("*").alias("_n"), *[missing(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(df.schema[c].dataType.typeName()).alias("type_name"),
                F.col("_n").alias("row_count"),
                F.col(c).alias("null_count"),
                F.round(F.col(c) * 100.0 / F.col("_n"), 4).alias("null_pct"),
            )
            for c in df.columns
        ]
    )
    return counted.select(F.inline(rows))


def verify_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum, mean and whether the values lie within [0, 1]."""
    long = fit(df, columns, population=True).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), f"{c}.min", f"{c}.max", f"{c}.mean") for c in columns]))
    )
    inside = (F.col("min") >= 0) & (F.col("max") <= 1)
    status = F.when(F.col("min").isNull(), F.lit("SKIP")).when(inside, F.lit("OK")).otherwise(F.lit("WARN"))
    return long.select("feature", "min", "max", F.round("mean", 6).alias("mean"), status.alias("status"))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, null where missing, written once for several passes."""
    return cut_lineage(df.select(*[F.when(~is_missing(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]), "numbers")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max, all exact."""
    table = numbers(df, columns)
    facts = [
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"), F.max(c).alias("max"),
        ).alias(c)
        for c in columns
    ]
    basic = table.agg(*facts).select(F.inline(F.array(*columns))).filter(F.col("count") > 0)
    return basic.join(quartiles(table, columns, kept=True), "feature")


def quartiles(df: DataFrame, columns: list[str], by: list[str] | None = None, kept: bool = False) -> DataFrame:
    """Columns q25, q50 and q75 per feature (and group)."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by, kept)
    wide = [F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return q.groupBy(*(by or []), "feature").agg(*wide)


def boxplot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whisker ends (furthest values within 1.5 IQR) and outliers."""
    table = numbers(df, columns)
    fences = cut_lineage(quartiles(table, columns, kept=True), "fences")  # one row for each column
    found = []
    for r in fences.collect():
        x, reach = F.col(r["feature"]), (r["q75"] - r["q25"]) * 1.5
        inside = x.between(r["q25"] - reach, r["q75"] + reach)
        found.append(
            F.struct(
                F.lit(r["feature"]).alias("feature"), F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
                F.count_if(~inside).alias("outliers"),
            )
        )
    ends = table.agg(F.array(*found).cast("array<struct<feature:string,whisker_lo:double,whisker_hi:double,outliers:bigint>>").alias("f"))
    return fences.join(ends.select(F.inline("f")), "feature")


def column_facts(df: DataFrame, columns: list[str], population: bool = False) -> Row:
    """Rows in ``_n``, and per column a struct (mean, std, n) over its present values."""
    spread = F.stddev_pop if population else F.stddev_samp

    def fact(c: str) -> Column:
        x = F.when(~is_missing(F.col(c).cast("double")), F.col(c).cast("double"))
        return F.struct(F.avg(x).alias("mean"), spread(x).alias("std"), F.count(x).alias("n")).alias(c)

    return df.agg(F.count("*").alias("_n"), *[fact(c) for c in columns]).first()


def correlations(
    df: DataFrame, columns: list[str], pairs: list[tuple[str, str]] | None = None, facts: Row | None = None
) -> DataFrame:
    """Pearson correlation of column pairs over the rows where both are present.

    Two aggregates of one row: means and counts, then sums of products around
    the means. A pair of complete columns needs one product; only where values
    are missing are sums kept for the pair's own rows. Null where a column has
    no spread, or no row has both. ``facts`` are those of ``column_facts``, if
    already at hand.
    """
    pairs = pairs or [(a, b) for a in columns for b in columns]
    used = sorted({c for p in pairs for c in p})
    numbers = df.select(*[F.when(~is_missing(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in used])
    facts = facts or column_facts(numbers, used)
    if not facts["_n"]:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    x = numbers.select(*[(F.col(c) - (facts[c]["mean"] or 0.0)).alias(c) for c in used])
    complete = {c for c in used if facts[c]["n"] == facts["_n"]}
    wanted: dict[str, Column] = {}

    def total(name: str, value: Column) -> Column:
        wanted[name] = F.sum(value).alias(name)
        return F.col(name)

    def measured(a: str, b: str) -> Column:
        u, v = F.col(a), F.col(b)
        joint = total(f"{a}*{b}", u * v)
        if {a, b} <= complete:  # sums around the means of these rows are zero
            return F.try_divide(joint, F.sqrt(total(f"{a}*{a}", u * u) * total(f"{b}*{b}", v * v)))
        n = total(f"n {a}*{b}", F.when((u * v).isNotNull(), 1.0))
        su, sv = total(f"{a} of {a}*{b}", F.when(v.isNotNull(), u)), total(f"{b} of {a}*{b}", F.when(u.isNotNull(), v))
        suu, svv = total(f"{a}2 of {a}*{b}", F.when(v.isNotNull(), u * u)), total(f"{b}2 of {a}*{b}", F.when(u.isNotNull(), v * v))
        return F.try_divide(joint - su * sv / n, F.sqrt((suu - su * su / n) * (svv - sv * sv / n)))

    found = {p: measured(*p) for p in sorted({tuple(sorted(p)) for p in pairs})}
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), found[tuple(sorted((a, b)))].alias("corr")) for a, b in pairs]
    return x.agg(*wanted.values()).select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included."""
    x = F.col(column)
    stats = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("_stats.hi") - F.col("_stats.lo")) / bins
    binned = attach(df.filter(~is_missing(x)).select(column), stats).select(
        F.least(F.floor((x - F.col("_stats.lo")) / width), F.lit(bins - 1)).alias("bin")
    )
    counts = binned.groupBy("bin").agg(F.count("*").alias("rows"))
    edges = stats.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"), "lo", "hi"
    ).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right_edge"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def density_grid(df: DataFrame, x: str, y: str, size: int) -> DataFrame:
    """Non-empty cells of an even ``size`` by ``size`` grid with log counts."""
    stats = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def cell(col: str, lo: str, hi: str) -> Column:
        width = (F.col(f"_stats.{hi}") - F.col(f"_stats.{lo}")) / size
        return F.least(F.floor((F.col(col) - F.col(f"_stats.{lo}")) / width), F.lit(size - 1))

    cells = attach(df.select(x, y).dropna(), stats).select(cell(x, "x0", "x1").alias("cell_x"), cell(y, "y0", "y1").alias("cell_y"))
    return cells.groupBy("cell_x", "cell_y").agg(F.count("*").alias("rows")).withColumn("log_rows", F.log10("rows"))


def class_weights(df: DataFrame, code: str) -> DataFrame:
    """Inverse-frequency weights of the emotion codes, summing to their number."""
    k = len(fixed.EMOTION_CODES)
    counts = df.groupBy(F.col(code).alias("label")).agg(F.count("*").alias("rows"))
    labels = df.sparkSession.createDataFrame([(c, e) for e, c in fixed.EMOTION_CODES.items()], "label int, emotion string")
    total = counts.agg(F.sum("rows").alias("total"))
    raw = attach(labels.join(counts, "label", "left"), total).select(
        "label",
        "emotion",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        (F.col("_stats.total") / (k * F.coalesce("rows", F.lit(1)))).alias("raw"),
    )
    sums = raw.agg(F.sum("raw").alias("all"))
    return attach(raw, sums).select("label", "emotion", "rows", (F.col("raw") / F.col("_stats.all") * k).alias("weight"))
