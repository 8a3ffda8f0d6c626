"""Classifiers by held-out accuracy, searches by brute force, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from songloom.llm import language, packing, permutation, quality, queries, simhash, topk
from songloom.llm.common import crc_mod, read_table
from songloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import cases
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.01"


def test_languages_of_held_out_texts(spark):
    lang = {r.doc_id: r.lang for r in read_table(spark, SMALL, "documents").collect()}
    found = queries.op1_language(spark, SMALL).collect()
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found) and np.mean([r.rejected for r in found]) < 0.01


def test_language_of_awkward_texts(spark):
    docs = cases.docs(spark)
    model = language.fit(docs, F.col("doc_id") < 5, sample=200)
    got = language.identify(docs, model).collect()
    assert len(got) == docs.count()
    pred = {r.doc_id: r for r in got}
    assert pred[1].lang_pred == "de" and pred[21].lang_pred == "en"
    for i in (5, 6, 7, 8, 11, 16, 24):
        assert (pred[i].lang_pred, pred[i].score, pred[i].rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs, F.lit(False))).collect()} == {"und"}
    assert language.identify(cases.none(spark), language.fit(cases.none(spark), F.lit(True))).count() == 0


def test_far_texts_are_rejected(spark):
    docs = read_table(spark, SMALL, "documents")
    model = language.fit(docs, F.lit(True), sample=400)
    odd = spark.createDataFrame([(1, "zzzzqqqq xxxxjjjj wwwwkkkk " * 20)], "doc_id bigint, text string")
    assert language.identify(odd, model).first().rejected


def test_quality_of_held_out_texts(spark):
    truth = {r.doc_id: r.quality for r in read_table(spark, SMALL, "labels").collect()}
    found = queries.op9_quality(spark, SMALL).collect()
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in found)


def test_quality_of_awkward_texts(spark):
    docs = cases.docs(spark)
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (10, 0), (16, 0), (16, None), (None, 1), (999, 1)], "doc_id bigint, quality int")
    for usable in (F.lit(True), F.col("quality") == 1, F.lit(False)):
        got = quality.rate(docs, quality.fit(docs, labels, usable)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = cases.none(spark)
    assert quality.rate(empty, quality.fit(empty, labels, F.lit(True))).count() == 0


def test_words_hash_the_same_wherever_they_stand():
    a, b = quality.rows_of(np.frombuffer(b"Thsh the*** Thsh", dtype=np.uint8))
    c, d = quality.rows_of(np.frombuffer(b"\n  the***\tThsh\n", dtype=np.uint8))
    assert a[0] == a[2] == c[1] and a[1] == c[0] and b[1] == d[0] and b[0] != b[1]


def test_temperature_is_found():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 2.4 < quality.calibrate(3 * z, y) < 3.8


VECTORS = "vec_id bigint, embedding array<float>, score double, row bigint, v string, rank int"


def vectors(spark, n=700, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:220] = x[100]  # a crowd of copies: ties
    rows = [(i, [float(c) for c in v], 0.0, 1, "v", 2) for i, v in enumerate(x)]
    rows += [rows[0], rows[0]]
    rows += [(i, v, None, None, None, None) for i, v in ((9000, None), (9001, []), (9002, [1.0, None]), (9003, [float("nan")] * dim), (9004, [float("inf")] * dim), (9050, [1.0, 2.0]), (9100, [3.0, -2.0]), (None, [1.0] * dim))]
    return spark.createDataFrame(rows, VECTORS), rows


def brute(rows, step, k, scale):
    good = [(i, r[0], np.array(r[1], dtype=np.float64)) for i, r in enumerate(rows) if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    if scale:
        good = [(i, key, np.floor(v * scale)) for i, key, v in good]
    out = []
    for i, key, v in good:
        if key % step == 0:
            others = sorted((-(float((w * v).sum())), other) for j, other, w in good if j != i and len(w) == len(v))[:k]
            out += [(key, n + 1, other, -s) for n, (s, other) in enumerate(others)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 150])
def test_exact_top_k(spark, monkeypatch, block):
    from songloom.llm import grid

    monkeypatch.setattr(grid, "BLOCK", block)
    monkeypatch.setattr(grid, "QUERY_BLOCK", max(6, block // 20))
    monkeypatch.setattr(topk, "COLUMNS", 64)
    df, rows = vectors(spark)
    got = sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == brute(rows, 50, 5, 256)
    assert topk.top_k(df.limit(0), F.lit(True), 5).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.normal(3, 2, (40, 37)), rng.normal(-1, 5, (50, 37))
    for s in topk.LEVELS:
        assert (topk.statistics(q, s) @ topk.statistics(x, s).T >= q @ x.T - 1e-9).all()


def test_large_whole_numbers_stay_exact():
    q = np.full((1, 8), 2.0**29 - 1)
    assert topk.inner(q, q)[0, 0] == 8 * (2**29 - 1) ** 2


def test_permutation_index(spark):
    df, rows = vectors(spark)
    got = permutation.neighbours(df, F.col("vec_id") % 20 == 0, 20, share=1.0).collect()
    ours = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got)
    assert ours == sorted((a, b, c, round(s, 9)) for a, b, c, s in brute(rows, 20, 20, None))
    assert permutation.neighbours(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    x = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in read_table(spark, folder, "embeddings").collect()}
    ids, m = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    found, hit, n = {}, 0, 0
    for r in queries.op10_permutation(spark, folder).collect():
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12 and r.vec_id != r.query_id
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, got in found.items():
        s = m @ x[q]
        s[ids == q] = -np.inf
        hit += len(got & set(ids[np.argsort(-s)[:20]].tolist()))
        n += 20
    assert len(found) == sum(i % 20 == 0 for i in ids) and hit / n >= 0.93


def test_pipeline(spark):
    """Every stage against its operator's plain meaning, stage by stage, on awkward rows added to the table."""
    docs = read_table(spark, SMALL, "documents")
    docs = docs.unionByName(cases.docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut_lineage(stage(spark, before, SMALL))
        if name != "best-fit packing":
            assert after.schema == before.schema, name
        if name == "near duplicates":
            prints = before.select("doc_id", "text", simhash.fingerprint_of("text").alias("fp")).collect()
            from tests.llm.test_texts import plain_components

            root = plain_components([r.fp % 2**64 for r in prints])
            least = {}
            for r in prints:
                least.setdefault(root[r.fp % 2**64], []).append((r.doc_id is None, r.doc_id or 0))
            kept = [(r.doc_id is None, r.doc_id or 0) for r in after.collect()]
            assert sorted(kept) == sorted(min(v) for v in least.values())
        if name == "secret scan":
            assert after.count() == before.count()
            assert not after.filter(F.col("text").rlike("(?i)(password|token)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count()
        if name == "quality classifier":
            truth = {r.doc_id: r.quality for r in read_table(spark, SMALL, "labels").collect()}
            left = {r.doc_id for r in after.collect()}
            good = [i for i, q in truth.items() if q == 1]
            assert np.mean([i in left for i in good]) > 0.98 and np.mean([i in left for i, q in truth.items() if q == 0]) < 0.1
        if name == "language identification":
            assert after.count() > 0.97 * before.count() and not after.filter("text is null or text = ''").count()
        if name == "best-fit packing":
            expected = packing.pieces(before).drop("ids")
            assert sorted(map(tuple, after.select(*expected.columns).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
        before = after


def test_pipeline_of_nothing(spark):
    empty = cases.none(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0


def test_held_out_rule(spark):
    import zlib

    got = [r[0] for r in spark.range(20).select(crc_mod("id", 3)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 for i in range(20)]


def test_every_language_is_learnt_however_many(spark):
    """Seventy languages of ten texts each beside one of two thousand: none is left out, each gets its share."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{n:02}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for n in range(70)}
    rows = [(lang, " ".join(rng.choice(ws) for _ in range(30))) for lang, ws in words.items() for _ in range(2000 if lang == "l00" else 10)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = language.fit(docs, F.lit(True), sample=400)
    assert model.languages == sorted(words)
    asked = spark.createDataFrame([(n, " ".join(ws), lang) for n, (lang, ws) in enumerate(words.items())], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()}
    assert [found[n] for n in range(70)] == list(words)


def test_language_query_has_its_columns_in_order(spark):
    assert QUERIES["op1_language"](spark, "/root/testdata/sf0.001").columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    _, differences = compare(QUERIES[name](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), ORACLE_SQL[name])
    assert differences == []
