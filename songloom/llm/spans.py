"""Places of pattern matches in whole texts, with DataFrame functions only.

A text is split at the matches and the matches are taken out; the lengths of
both, added up in order by a window, give the places in code points. Rows go to
the window only for texts that have a match, and carry no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of span: a Java pattern, and a cheap test that texts without a match mostly fail."""

    kind: str
    pattern: str
    hint: str
    version: int = 1

    def may_match(self, text: Column) -> Column:
        return text.rlike(self.hint)


def matches(texts: DataFrame, key: str, text: str, rules: list[Rule], wanted: str | None = None) -> DataFrame:
    """(key, kind, start, end, match, before, after): leftmost non-overlapping matches of every rule.

    ``key`` stands for the text: rows that share it share the text and are folded. ``wanted`` names an array
    column; a rule is applied only where it holds the rule's kind. before and after are the surroundings.
    """

    def of(rule: Rule) -> Column:
        t = F.col(text)
        gaps, found = F.split(t, rule.pattern, -1), F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0))
        told = F.zip_with(
            found, F.slice(gaps, 1, F.size(found)),
            lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"), F.substring(g, -24, 24).alias("before")),
        )
        later = F.transform(F.slice(gaps, 2, F.size(found)), lambda g: F.substring(g, 1, 12))
        rows = F.zip_with(F.zip_with(told, later, lambda a, b: F.struct(a["match"].alias("match"), a["gap"].alias("gap"), a["before"].alias("before"), b.alias("after"))), F.sequence(F.lit(1), F.size(found)), lambda a, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("nth"), a["gap"].alias("gap"), a["match"].alias("match"), a["before"].alias("before"), a["after"].alias("after")))
        use = rule.may_match(t) if wanted is None else F.array_contains(wanted, rule.kind) & rule.may_match(t)
        some = F.when(use & t.rlike(rule.pattern), rows)
        return F.coalesce(some, F.array().cast("array<struct<kind:string,nth:int,gap:int,match:string,before:string,after:string>>"))

    hit = None
    for rule in rules:
        hit = rule.may_match(F.col(text)) if hit is None else hit | rule.may_match(F.col(text))
    rows = texts.filter(hit).select(F.col(key).alias("key"), F.explode(F.concat(*[of(r) for r in rules])).alias("m")).select("key", "m.*")
    folded = rows.groupBy("key", "kind", "nth").agg(*[F.first(c).alias(c) for c in ("gap", "match", "before", "after")])
    order = Window.partitionBy("key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(order)
    return folded.withColumn("end", end).select("key", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", "after")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (start, rank, kind, end) in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def collected(found: DataFrame, kinds: list[str], extra: list[Column] | None = None) -> DataFrame:
    """(key, spans): the spans of each text by start, then by the order of kinds."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int")
    one = F.struct("start", rank.alias("rank"), "kind", "end", *(extra or []))
    return found.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span replaced; spans that overlap become one mask."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step)
    return F.concat(whole["out"], F.substring(text, (whole["at"] + 1).cast("int"), F.length(text)))
