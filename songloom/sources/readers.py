"""Readers: one entry per file format, schemas always explicit where known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songloom import fixed
from songloom.session import spread

SUFFIX_FORMATS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "jl": "jsonl", "parquet": "parquet"}


class Tables:
    """The given tables of one folder, read lazily by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """The table for costly row work: in no fewer parts than cores."""
        return spread(getattr(self, name), key)


def read_json_lines(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    max_rows: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """JSON lines; lines that do not parse are dropped, or raise when strict.

    A value of another type than the schema's never costs its line: fields are
    parsed as text and cast one by one, and those that cannot be cast are null.
    So the rows do not depend on the columns selected. A row limit counts input
    lines, bad ones included.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path)
    if max_rows is not None:
        lines = first_rows(lines, max_rows)
    row = F.from_json("value", texts, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.filter(F.trim("value") != "").select(row.alias("row"))
    good = F.col("row").isNotNull() & F.col("row._corrupt").isNull()
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.lit("a line is no JSON object")).cast("boolean"))
    return parsed.filter(good).select(*[typed(F.col("row").getField(f.name), f.dataType).alias(f.name) for f in fields])


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a scan in order of its splits.

    Splits are counted, then each keeps its share: nothing is shuffled and no
    task holds all ``n`` rows. For plain scans, which read the same way twice.
    """
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    split, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    left, last = n, -1
    for r in placed.groupBy(split.alias("split")).agg(F.count("*").alias("n")).orderBy("split").collect():  # one row per split
        last = r["split"]
        if left <= r["n"]:
            break
        left -= r["n"]
    return placed.filter((split < last) | ((split == last) & (row < left))).drop("_place")


def typed(text: Column, kind: T.DataType) -> Column:
    """A JSON value, given as text, in its type; null where it has no such value."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind)
    if isinstance(kind, T.IntegralType):
        number = text.try_cast("double")
        return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))
    return text.try_cast(kind)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, max_rows: int | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks (as lyrics do).

    Line breaks in fields make a file one task. ``multi_line=False`` splits
    files of tables that have none.
    """
    df = spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, escape='"')
    return df if max_rows is None else first_rows(df, max_rows)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A whole file as one JSON document (an array of records)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def read_any(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    file_format: str = "auto",
) -> DataFrame:
    """Reader chosen by format name or by file suffix."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower() if file_format == "auto" else file_format
    if kind not in SUFFIX_FORMATS:
        raise ValueError(f"unsupported format: {kind}")
    kind = SUFFIX_FORMATS[kind]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return read_json_document(spark, path, schema)
    if schema is None:
        raise ValueError(f"{kind} files need a schema")
    return read_csv(spark, path, schema) if kind == "csv" else read_json_lines(spark, path, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of an accepted type and size, with their bytes.

    The size test is pushed to the file listing, so large files are not read.
    """
    pattern = "*.{" + ",".join(fixed.IMAGE_SUFFIXES) + "}"
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .filter(F.col("length") <= fixed.IMAGE_MAX_BYTES)
    )


def read_database_table(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A relational table read in parallel over ranges of a numeric key."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )
