"""Secret scanning with an incremental blob ledger. DataFrame functions only.

Every version of a text is named by its content (SHA-256): a blob. The ledger,
a Parquet table that only grows, holds a row for each blob and scan: the rules
applied, with their versions, and the findings. A scan takes the blobs of all
rows, leaves out the pairs of blob and rule version that the ledger holds,
reads one row's text for each of the rest, and appends what it finds. Findings
are joined back to every row, that is to every path and version of a blob.

Only texts that pass the cheap test of some rule are matched at all, and only
those are shuffled to meet the list of blobs to scan; when few blobs are new the
list is a small table, which Spark sends to the readers instead.

Defined results: a null text reads as empty; null ids and repeated rows are
scanned and answered like others; an empty table gives an empty result and
leaves the ledger empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import cut_lineage, scratch_path
from songloom.llm.spans import Rule, collected, masked, matches

# The base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", ASSIGN, "(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]{12,}+", "AKIA"),
    Rule("hex", r"[0-9a-f]{32,}+", "[0-9a-f]{32}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "-----BEGIN "),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ[A-Za-z0-9_-]{8}"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}+", "gh[opsu]_"),
]
RULES = [*BASE, *MORE]
KINDS = [r.kind for r in RULES]
BASE_KINDS = [r.kind for r in BASE]
MASK = "[SECRET]"
LEDGER = "blob binary, rules array<string>, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def blob_of(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256))


def tag(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def update(docs: DataFrame, blobs: DataFrame, ledger: str, id_col: str, text_col: str, rules: list[Rule]) -> int:
    """Scan what the ledger lacks and append it; the number of blobs scanned.

    blobs: (doc_id, blob) of all rows, written before.
    """
    spark = docs.sparkSession
    every = F.array(*[F.lit(tag(r)) for r in rules])
    known = read_ledger(docs, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    first = blobs.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    todo = first.join(known, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    todo = cut_lineage(todo.filter(F.size("todo") > 0).select("blob", "first_id", F.transform("todo", lambda x: F.substring_index(x, "@", 1)).alias("kinds"), "todo"), "ledger-todo")
    n = todo.count()
    if n:
        rows = docs.select(F.col(id_col).alias("first_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), blob_of(text_col).alias("blob")).alias("d")
        picked = rows.join(todo.alias("t"), (F.col("d.blob") == F.col("t.blob")) & F.col("d.first_id").eqNullSafe(F.col("t.first_id"))).select("d.blob", "d.text", "t.kinds")
        found = matches(picked, "blob", "text", rules, "kinds")
        long_enough = (F.col("kind") != "assign") | (F.length(F.regexp_extract("match", ASSIGN, 1)) >= 8)
        spans = collected(found.filter(long_enough), KINDS).withColumnRenamed("key", "blob")
        rows = todo.join(spans, "blob", "left").select("blob", F.col("todo").alias("rules"), F.coalesce("spans", F.array().cast(LEDGER.rsplit(" spans ", 1)[1])).alias("spans"))
        rows.write.mode("append").parquet(ledger)
    elif not has_ledger(docs, ledger):
        spark.createDataFrame([], LEDGER).write.parquet(ledger)
    return n


def has_ledger(docs: DataFrame, ledger: str) -> bool:
    jvm = docs.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    return path.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_ledger(docs: DataFrame, ledger: str) -> DataFrame:
    spark = docs.sparkSession
    return spark.read.schema(LEDGER).parquet(ledger) if has_ledger(docs, ledger) else spark.createDataFrame([], LEDGER)


def findings(docs: DataFrame, ledger: str, rules: list[Rule]) -> DataFrame:
    """(blob, spans) of all blobs with a finding by the given rule versions."""
    current = F.array(*[F.lit(r.kind) for r in rules])
    ok = F.arrays_overlap("rules", F.array(*[F.lit(tag(r)) for r in rules]))
    one = F.explode(F.filter("spans", lambda s: F.array_contains(current, s["kind"]) & F.array_contains("rules", F.concat(s["kind"], F.lit("@"), version_of(s["kind"], rules)))))
    found = read_ledger(docs, ledger).filter(ok & (F.size("spans") > 0)).select("blob", one.alias("s")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.collect_list("s"))).alias("spans"))
    return cut_lineage(found, "ledger-findings")  # so the joins with it can split a blob that many rows hold


def version_of(kind: Column, rules: list[Rule]) -> Column:
    return F.coalesce(*[F.when(kind == r.kind, F.lit(str(r.version))) for r in rules], F.lit("0"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, blob, spans) for every row; spans are (start, rank, kind, end) in order. The ledger is updated first."""
    rules = rules or RULES
    ledger = ledger or scratch_path(docs.sparkSession, "secret-ledger")
    blobs = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), blob_of(text_col).alias("blob")), "ledger-blobs")
    update(docs, blobs, ledger, id_col, text_col, rules)
    none = F.array().cast(LEDGER.rsplit(" spans ", 1)[1])
    return blobs.join(findings(docs, ledger, rules), "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of docs, every column kept, with each secret in the text replaced by a mask."""
    rules = rules or RULES
    ledger = ledger or scratch_path(docs.sparkSession, "secret-ledger")
    blobs = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), blob_of(text_col).alias("blob")), "ledger-blobs")
    update(docs, blobs, ledger, id_col, text_col, rules)
    found = findings(docs, ledger, rules)
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("d"), blob_of(text_col).alias("blob")).join(found, "blob", "left")
    text = F.col("d").getField(text_col)
    clean = F.when(F.col("spans").isNotNull(), masked(text, F.col("spans"), MASK)).otherwise(text)
    return held.select(*[clean.alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns])
