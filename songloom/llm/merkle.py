"""Merkle manifest of a table: leaves, roots and proofs by nested-struct roll-up.

A row's leaf is the sha256 of its fields. Within a language, leaves stand in the
order of their ids; every ``FAN`` nodes in a row become the sha256 of their
digests, level by level, until one is left, the subroot. Subroots, ordered by
language, are treated likewise and give the root.

* The rank of a leaf is written in base ``FAN``. Leaves that share all but the
  last ``DIGITS`` digits form a block, the only thing ever held in one place.
* Within a block the digits are grouped away one after the other: nodes with the
  same digits before the last nest in an array under their parent, which gets
  their digest. All groupings use the partitioning of the block: one exchange.
* A table of blocks has its own ranks, the block numbers, so blocks of blocks
  follow, until every language has one. Each round shrinks the table by the size
  of a block.
* Proofs come down the same way: a block and the steps above it are brought
  together by a grouping of their union, and one explode a digit opens the
  nested arrays; each adds the digests left and right of a child. No node is
  joined with its siblings, and a row never carries more than one path.

A node that is alone on its level ends the tree; a last run of one, with others
before it, is hashed like any run. Such an end shows in the digits: the node has
number zero and its parent a single child.

Defined results: null fields have a sign of their own; null ids come first;
repeated ids are ordered by leaf, repeated rows are leaves of their own; null is
a language, before all others; an empty table gives an empty result; other
columns are not read. Only a row whose id is null is never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import crc_mod, cut_lineage
from songloom.operators.ranking import global_rank

FAN, DIGITS = 8, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = "array<struct<left:string,right:string>>"
CROWN = "struct<subroot:string,root:string>"


def field(value: Column) -> Column:
    """How a value enters a leaf: its length in bytes, a colon and itself; a null is a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda k: k["hash"]), "")


def nest(nodes: DataFrame, digits: int = DIGITS, fan: int = FAN) -> DataFrame:
    """(g, block, hash, kids): blocks of nodes (g, rank, hash, payload) with their nested children."""
    digit = lambda i: F.pmod(F.floor(F.col("rank") / F.lit(fan**i)), F.lit(fan)).cast("int")
    block = F.floor(F.col("rank") / F.lit(fan**digits)).cast("bigint")
    node = F.struct(digit(0).alias("d"), "hash", "rank", "payload")
    rows = nodes.select("g", block.alias("block"), *[digit(i).alias(f"d{i}") for i in range(1, digits)], node.alias("node"))
    rows = rows.repartition("g", "block")
    for level in range(1, digits + 1):
        above = [f"d{i}" for i in range(level, digits)]
        rows = rows.groupBy("g", "block", *above).agg(F.sort_array(F.collect_list("node")).alias("kids"))
        first = F.col("block") == 0
        for name in above:
            first = first & (F.col(name) == 0)
        alone = first & (F.size("kids") == 1)
        rows = rows.withColumn("hash", F.when(alone, F.col("kids")[0]["hash"]).otherwise(F.sha2(joined(F.col("kids")).cast("binary"), 256)))
        if above:
            rows = rows.select("g", "block", *above[1:], F.struct(F.col(above[0]).alias("d"), "hash", "kids").alias("node"))
    return rows.select("g", "block", "hash", "kids")


def climb(nodes: DataFrame, digits: int = DIGITS) -> list[DataFrame]:
    """Tables of blocks, from those of the given nodes to those that stand for a whole group."""
    tables = []
    while True:
        tables.append(cut_lineage(nest(nodes, digits), "merkle-blocks"))
        last = tables[-1].agg(F.max("block")).first()[0]
        if not last:
            return tables
        nodes = tables[-1].select("g", F.col("block").alias("rank"), "hash", F.lit(None).cast("string").alias("payload"))


def unfold(blocks: DataFrame, tops: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(g, rank, hash, payload, path, crown): the nodes of blocks, each with all steps from itself to the root.

    tops: (g, block, path, crown), the steps from a block's own digest upwards.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    kids = blocks.schema["kids"].dataType
    held = blocks.select("g", "block", "kids", nothing(STEPS).alias("path"), nothing(CROWN).alias("crown"))
    told = tops.select("g", "block", nothing(kids).alias("kids"), "path", "crown")
    rows = held.unionByName(told).groupBy("g", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("kids", "path", "crown")])
    rows = rows.withColumn("first", F.col("block") == 0)
    for level in range(digits):
        rows = rows.select("g", "path", "crown", "first", F.col("kids").alias("run"), F.posexplode("kids").alias("at", "kid"))
        left, right = F.slice("run", F.lit(1), F.col("at")), F.slice("run", F.col("at") + 2, F.size("run"))
        step = F.array(F.struct(joined(left).alias("left"), joined(right).alias("right")))
        path = F.when(F.col("first") & (F.size("run") == 1), F.col("path")).otherwise(F.concat(step, F.col("path")))
        below = [F.col("kid.kids").alias("kids")] if level < digits - 1 else [F.col(f"kid.{c}").alias(c) for c in ("rank", "hash", "payload")]
        rows = rows.select("g", path.alias("path"), "crown", (F.col("first") & (F.col("kid.d") == 0)).alias("first"), *below)
    return rows.drop("first")


def descend(tables: list[DataFrame], tops: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The nodes under the lowest blocks with their whole paths."""
    for blocks in reversed(tables[1:]):
        tops = unfold(blocks, tops, digits).select("g", F.col("rank").alias("block"), "path", "crown")
    return unfold(tables[0], tops, digits)


def manifest(docs: DataFrame, digits: int = DIGITS, modulus: int = 3) -> DataFrame:
    """(doc_id, lang, leaf, path, subroot, root, other_leaf) for every row.

    path holds the steps (left, right) from the leaf to the root: a level's digest is the sha256 of left, the
    digest below and right. other_leaf is the leaf of the row as it was tampered with, null where it was not: in
    rows whose crc32(doc_id) is divisible by ``modulus``, the text's A-Z are lower-cased.
    """
    own = [F.col(c) for c in FIELDS]
    lowered = F.translate("text", CAPITALS, CAPITALS.lower())
    touched = F.coalesce(crc_mod("doc_id", modulus) == 0, F.lit(False))
    leaves = docs.select("lang", "doc_id", leaf_of(own).alias("leaf"), F.when(touched, leaf_of([*own[:-1], lowered])).alias("other"), F.monotonically_increasing_id().alias("row"))
    ranked = global_rank(cut_lineage(leaves, "merkle-leaves"), ["lang", "doc_id", "leaf", "row"], "place")
    starts = ranked.groupBy("lang").agg(F.min("place").alias("start")).withColumnRenamed("lang", "of")
    placed = ranked.join(starts, F.col("lang").eqNullSafe(F.col("of")))
    nodes = placed.select(F.col("lang").alias("g"), (F.col("place") - F.col("start")).alias("rank"), F.col("leaf").alias("hash"), F.struct("doc_id", "other").alias("payload"))
    trees = climb(nodes, digits)

    subroots = global_rank(trees[-1].select("g", "hash"), ["g"], "place")
    crown = climb(subroots.select(F.lit("").alias("g"), (F.col("place") - 1).alias("rank"), "hash", F.struct(F.col("g").alias("lang")).alias("payload")), digits)
    no_steps = F.array().cast(STEPS)
    top = crown[-1].select("g", "block", no_steps.alias("path"), F.struct(F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root")).alias("crown"))
    tops = descend(crown, top, digits).select(F.col("payload.lang").alias("g"), F.lit(0).cast("bigint").alias("block"), "path", F.struct(F.col("hash").alias("subroot"), F.col("crown.root").alias("root")).alias("crown"))
    found = descend(trees, tops, digits)
    return found.select(F.col("payload.doc_id").alias("doc_id"), F.col("g").alias("lang"), F.col("hash").alias("leaf"), "path", "crown.subroot", "crown.root", F.col("payload.other").alias("other_leaf"))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))
