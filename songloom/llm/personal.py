"""Personal data by weak supervision. DataFrame functions only.

Candidate spans come from patterns: the four base kinds, and looser ones. Each
candidate gets votes (for, against, none) of four labelers: a strict pattern, a
gazetteer (country codes, issuers, top domains, reserved ranges), the words in
front of it, and its edges. Expectation-maximisation estimates from the counts
of vote patterns how reliable each labeler is and how likely each pattern is
personal data. With these as soft labels a logistic span classifier is trained
on the votes. Base spans always stay; others stay if the classifier accepts them
and no base span overlaps them.

Only counts of vote patterns reach the driver: at most 3^4 for each kind. Texts
are never shuffled: spans are keyed by the content of their text, and copies
fold.

Defined results: a null text reads as empty; null ids and repeated rows are
answered like others; with no candidate there are no spans and nothing is
fitted; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import cut_lineage
from songloom.llm.secrets import blob_of
from songloom.llm.spans import Rule, collected, matches, of_kinds

# The base kinds. \G continues a run of letters where the last match ended.
BASE = [
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
]
MORE = [
    Rule("person", r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.? \p{Lu}"),
    Rule("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]"),
    Rule("local_phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "[0-9]{3}[ .-][0-9]{4}"),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
]
RULES = [*BASE, *MORE]
KINDS = [r.kind for r in RULES]
BASE_KINDS = [r.kind for r in BASE]
LABELERS = ["pattern", "gazetteer", "context", "edges"]

# Gazetteers and cue words.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "nl", "ch", "at", "eu", "info"]
IBAN_LANDS = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
FOR = r"(?i)(?:mail|tel|phone|fon|call|contact|mobil|card|visa|ip|addr|host|server|name|ssn|social|iban|konto|account|cuenta|appel|write)[^\p{L}]{0,6}$"
AGAINST = r"(?i)(?:version|ver|v|no|nr|isbn|id|page|fig|section|rfc)[.:#\x20]{0,3}$"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def holds(kind: Column, match: Column) -> Column:
    """Whether a match is one of its kind."""
    number = digits(match)
    octets = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(octets, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).try_cast("int") <= 255))
    size = F.length(number)
    card = F.when(size.between(14, 19), luhn(number)).otherwise(False)
    return F.when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", size.between(10, 15)).otherwise(True)


def votes(kind: Column, match: Column, before: Column, after: Column) -> list[Column]:
    """What the labelers say: 1 for, -1 against, 0 nothing."""
    number = digits(match)
    strict = (
        F.when(kind == "email", F.when(match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[^.]{2,}.*\.[A-Za-z]{2,}$"), 1).otherwise(-1))
        .when(kind == "ip", F.when(match.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"), 1).otherwise(-1))
        .when(kind == "card", F.when(match.rlike(r"^[0-9]{4}([ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}$|^3[47]"), 1).otherwise(-1))
        .when(kind == "phone", F.when(match.rlike(r"^\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?"), 1).otherwise(0))
        .when(kind == "social", F.when(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 1).otherwise(-1))
        .when(kind == "local_phone", F.when(number.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1))
        .when(kind == "iban", F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), 1).otherwise(-1))
        .otherwise(0)
    )
    listed = (
        F.when(kind == "email", F.when(F.lower(F.substring_index(match, ".", -1)).isin(TOP_DOMAINS), 1).otherwise(0))
        .when(kind == "ip", F.when(match.rlike(r"^(0|127|255|22[4-9]|23[0-9])\."), -1).otherwise(0))
        .when(kind == "card", F.when(number.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65)"), 1).otherwise(-1))
        .when(kind == "phone", F.when(number.rlike("^(1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])"), 1).otherwise(-1))
        .when(kind == "iban", F.when(F.substring(match, 1, 2).isin(IBAN_LANDS), 1).otherwise(-1))
        .when(kind == "person", F.when(F.size(F.split(match, " ")) == 3, 1).otherwise(0))
        .otherwise(0)
    )
    near = F.when(before.rlike(FOR), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    glued = before.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]")
    return [strict.alias("pattern"), listed.alias("gazetteer"), near.alias("context"), F.when(glued, -1).otherwise(1).alias("edges")]


def reliabilities(counts: dict[tuple, int], rounds: int = 30) -> dict[tuple, float]:
    """Expectation-maximisation on counted vote patterns (kind, votes...): how likely each is true."""
    belief = {p: min(0.95, max(0.05, 0.5 + 0.2 * sum(p[1:]))) for p in counts}
    for _ in range(rounds):
        share: dict[tuple, float] = {}
        mass: dict[tuple, float] = {}
        for p, n in counts.items():
            for truth, w in ((1, n * belief[p]), (0, n * (1 - belief[p]))):
                share[p[0], truth] = share.get((p[0], truth), 0) + w
                for place, vote in enumerate(p[1:]):
                    mass[place, vote, truth] = mass.get((place, vote, truth), 0) + w
        total = {t: sum(w for (_, u), w in share.items() if u == t) for t in (0, 1)}
        for p in counts:
            odds = math.log((share[p[0], 1] + 1) / (share[p[0], 0] + 1))
            for place, vote in enumerate(p[1:]):
                odds += math.log((mass[place, vote, 1] + 1) / (total[1] + 3)) - math.log((mass[place, vote, 0] + 1) / (total[0] + 3))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return belief


def features(pattern: tuple) -> list[tuple]:
    return [("bias",), ("kind", pattern[0]), *[(name, vote) for name, vote in zip(LABELERS, pattern[1:])]]


def train(counts: dict[tuple, int], belief: dict[tuple, float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple, float]:
    """Weights of a logistic classifier on votes and kind, with soft labels."""
    weights: dict[tuple, float] = {f: 0.0 for p in counts for f in features(p)}
    total = sum(counts.values())
    for _ in range(rounds):
        slope = {f: decay * w for f, w in weights.items()}
        for p, n in counts.items():
            z = sum(weights[f] for f in features(p))
            d = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - belief[p])
            for f in features(p):
                slope[f] += d
        for f in weights:
            weights[f] -= rate * slope[f]
    return weights


def probability(weights: dict[tuple, float]) -> Column:
    """The classifier as a column over kind and votes."""
    z = F.lit(weights.get(("bias",), 0.0))
    for kind in KINDS:
        z = z + F.when(F.col("kind") == kind, F.lit(weights.get(("kind", kind), 0.0))).otherwise(0.0)
    for name in LABELERS:
        for vote in (-1, 0, 1):
            z = z + F.when(F.col(name) == vote, F.lit(weights.get((name, vote), 0.0))).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """(doc_id, spans) for every row; spans are (start, rank, kind, end, p) in order, p the classifier's probability."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), blob_of(text_col).alias("blob"))
    found = matches(rows, "blob", "text", RULES).filter(holds(F.col("kind"), F.col("match")))
    marked = cut_lineage(found.select("key", "kind", "start", "end", *votes(*[F.col(c) for c in ("kind", "match", "before", "after")])), "personal-votes")
    counts = {(r["kind"], *[r[x] for x in LABELERS]): r["n"] for r in marked.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()}
    weights = train(counts, reliabilities(counts)) if counts else {}
    base = F.col("kind").isin(BASE_KINDS)
    judged = marked.withColumn("p", probability(weights)).filter(base | (F.col("p") >= accept))
    spans = collected(judged, KINDS, [F.col("p")]).withColumnRenamed("key", "blob")
    firm = of_kinds(F.col("spans"), BASE_KINDS)
    free = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS) | ~F.exists(firm, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = cut_lineage(spans.withColumn("spans", free), "personal-spans")  # so the join below can split a text that many rows hold
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,p:double>>")
    return rows.select("doc_id", "blob").join(spans, "blob", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
