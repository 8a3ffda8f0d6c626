"""Hard negatives, the n-gram join and the Merkle manifest against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom.llm import hard_negatives, merkle, ngram_join, queries
from tests.llm import cases

MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """The last node, and (left, right) of every level for each of the first."""
    steps, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, p in zip(steps, places):
            own.append(("".join(nodes[p // 8 * 8 : p]), "".join(nodes[p + 1 : p // 8 * 8 + 8])))
        places = [p // 8 for p in places]
        nodes = [digest(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)]
    return nodes[0], steps


def manifest_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, digest(*[field(r[c]) for c in merkle.FIELDS]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda x: x[:3])
    built = [tree([x[2] for x in groups[lang]]) for lang in langs]
    root, top = tree([sub for sub, _ in built])
    for lang, (sub, steps), above in zip(langs, built, top):
        for (_, _, leaf, r), own in zip(groups[lang], steps):
            path, end = own + above, leaf
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
                end = digest(*[field(r[c]) for c in merkle.FIELDS[:-1]], field(lowered))
            for left, right in path:
                end = digest(left, end, right)
            yield r["doc_id"], leaf, sub, root, digest(*[a + b for a, b in path]), end, end == root


def told(found):
    root = merkle.folded(F.coalesce("other_leaf", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), root.alias("folded"))
    return sorted(map(tuple, out.withColumn("ok", F.col("folded") == F.col("root")).collect()), key=repr)


@pytest.mark.parametrize("n, digits", [(1, 1), (65, 1), (150, 2)])
def test_manifest_of_sizes_around_full_trees(spark, n, digits):
    rows = [(i, "s", None if i % 7 == 0 else f"l{i % 11 if n > 100 else 0}", i, "Text " * (i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    expected = sorted(manifest_of([r.asDict() for r in df.collect()]), key=repr)
    assert told(merkle.manifest(df, digits)) == expected


def test_manifest_of_awkward_rows(spark):
    docs = cases.docs(spark)
    assert told(merkle.manifest(docs)) == sorted(manifest_of([r.asDict() for r in docs.collect()]), key=repr)
    assert merkle.manifest(cases.none(spark)).count() == 0


def grams_of(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def joined_of(rows):
    sets = [grams_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted(((key, len(s), least.get(top(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(n):
    """A chain and a star of near copies, copies, sets just under and just at the threshold, and a passage that many share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(30)]
    texts = [" ".join(base)]
    for i in range(n):
        own = list(base)
        for _ in range(i % 5):
            own[rng.randrange(120)] = word()
        texts.append(" ".join(own))
    chain = list(base[:60])
    for i in range(n // 3):
        chain[(i * 7) % 60] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(passage + [word() for _ in range(rng.choice([3, 8, 60]))]) for _ in range(n // 2)]
    texts += [" ".join(base[:84]), " ".join(base[:84] + [word() for _ in range(20)]), " ".join(base[:84] + [word() for _ in range(21)]), "A b", "a B", "a\tb ", None, "", texts[3], texts[3].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_ngram_join_is_exact(spark):
    rows = near_copies(60) + [(None, "same words in a row here"), (None, "same words in a row here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.near_duplicates(df)
    assert sorted(map(tuple, got.drop("set_key").collect()), key=repr) == joined_of(rows)


def test_ngram_join_of_awkward_texts(spark):
    docs = cases.docs(spark)
    got = ngram_join.near_duplicates(docs).drop("set_key")
    assert sorted(map(tuple, got.collect()), key=repr) == joined_of([(r.doc_id, r.text) for r in docs.collect()])
    assert ngram_join.near_duplicates(cases.none(spark)).count() == 0


def negatives_of(rows, k=5):
    out = []
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256 * np.array(v, dtype=float)).astype(np.int64)) for i, label, v in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for a, (anchor, own, q) in enumerate(rows):
        if anchor % 100:
            continue
        score = [(-int(q @ v), i, label) for b, (i, label, v) in enumerate(rows) if b != a and len(v) == len(q)]
        for s, positive, _ in sorted(x for x in score if x[2] == own)[:k]:
            good = sorted(x for x in score if x[2] != own and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(anchor, positive, r + 1, i, -s, -x) for r, (x, i, _) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("bucket, lengths", [(16, True), (4096, False)])
def test_hard_negatives_are_exact(spark, bucket, lengths):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8))
    rows = []
    for i in range(420):
        v = centres[i % 4] + 0.4 * rng.normal(size=8)
        rows.append((i, int(i % 4 + rng.integers(0, 2)), (v * (rng.exponential() if lengths else 1) * 0.2).tolist()))
    rows += [(700, 1, rows[5][2]), (701, 1, rows[5][2]), (800, None, rows[1][2]), (900, 1, None), (1000, 2, [1.0, None] * 4), (1100, 2, [float("nan")] * 8), (1200, 3, [0.0] * 8), (1300, 1, [0.5, 0.25]), (1301, 1, [0.5, 0.5]), (1302, 2, [0.5, 0.45]), (1400, 1, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, label int, embedding array<double>, score string")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df, label, F.col("vec_id") % 100 == 0, bucket=bucket)
    assert sorted(map(tuple, got.collect())) == negatives_of(rows)
    assert hard_negatives.mine(df.filter("false"), label, F.col("vec_id") % 100 == 0).count() == 0


def test_coordinate_ranges_spare_products():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(2000, 16)) * rng.exponential(size=(2000, 1))).astype(np.int64)
    b = hard_negatives.Bucket(np.arange(2000), np.arange(2000), np.zeros(2000, int), x)
    spared = 0
    for q in x[:50]:
        score = x @ q
        least = float(np.sort(score)[-10])
        chosen = b.candidates(q, float(np.linalg.norm(q)), least)
        assert set(np.nonzero(score >= least)[0]) <= set(chosen)
        spared += 2000 - len(chosen)
    assert spared > 0.5 * 50 * 2000


def test_queries_return_their_columns(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.op11_hard_negatives(spark, folder).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert queries.op12_ngram_join(spark, folder).columns == ["doc_id", "n_shingles", "component_id"]
    assert queries.op13_manifest(spark, folder).columns == MANIFEST
