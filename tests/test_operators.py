import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from songloom import fixed
from songloom.operators import cache, density, encoder, index, learning, moods, neighbours, prepare, quantiles, ranking, search, triplets, users
from songloom.operators import statistics as S
from songloom.sources import catalogue, readers


def test_json_lines_skip_bad_ones(spark, tmp_path):
    file = tmp_path / "songs.jsonl"
    file.write_text('{"id": 1, "song": "a"}\nnot json\n{"id": 2, "song": "b"}\n{"id": 3, "song": "c"}\n')
    schema = "id bigint, song string"
    assert {r.id for r in readers.read_json_lines(spark, str(file), schema).collect()} == {1, 2, 3}
    # the limit counts input lines, the bad one included
    assert {r.id for r in readers.read_json_lines(spark, str(file), schema, max_rows=3).collect()} == {1, 2}
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(file), schema, strict=True).collect()


def test_json_lines_keep_rows_of_other_types(spark, tmp_path):
    file = tmp_path / "drift.jsonl"
    file.write_text('{"a": 1, "v": "1.5"}\n{"a": 2.0, "v": 2.5}\n{"a": "three", "v": "x db"}\n{"a": 4, "v"\n\n{"a": 5, "v": {"x": 1}}\n')
    schema = "a bigint, v double"
    rows = readers.read_json_lines(spark, str(file), schema)
    expected = [(1, 1.5), (2, 2.5), (5, None), (None, None)]
    assert sorted(map(tuple, rows.collect()), key=str) == expected
    assert rows.count() == rows.select("a").count() == len(rows.select("a").collect()) == 4
    assert readers.read_json_lines(spark, str(file), schema, max_rows=4).count() == 3


def test_reader_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n')
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    rows = readers.read_any(spark, str(tmp_path / "a.csv"), "id bigint, text string").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, "quoted"')]
    assert readers.read_any(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError):
        readers.read_any(spark, "a.xml")


def test_sinks_read_back(spark, tmp_path):
    from songloom.sources import sinks

    df = spark.createDataFrame([(1, " a\n\"b\" ", "train"), (2, "c", "test")], "id bigint, text string, split string")
    sinks.write_csv_splits(df, str(tmp_path / "splits"))
    back = readers.read_csv(spark, str(tmp_path / "splits"), "id bigint, text string, split string")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    sinks.write_table(df, str(tmp_path / "table"), ["split"])
    assert spark.read.parquet(str(tmp_path / "table")).filter("split = 'test'").count() == 1
    sinks.write_small_json(S.fit_long(spark.createDataFrame([(1.0,), (3.0,)], "energy double"), ["energy"], True), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first()["mean"] == 2.0


def test_images_by_type_and_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixed, "IMAGE_MAX_BYTES", 10)
    (tmp_path / "a.png").write_bytes(b"123")
    (tmp_path / "b.jpg").write_bytes(b"1" * 20)
    (tmp_path / "c.txt").write_bytes(b"1")
    assert [r.path.rsplit("/", 1)[-1] for r in readers.read_images(spark, str(tmp_path)).collect()] == ["a.png"]


def test_aliases(spark):
    for names, song, artist in [(["song", "Artist(s)"], "song", "Artist(s)"), (["song_name", "artist"], "song_name", "artist"), (["name", "artists"], "name", "artists"), (["x", "y"], "x", "y")]:
        df = spark.createDataFrame([("a", "b")], names)
        assert (prepare.song_column(df), prepare.artist_column(df)) == (song, artist)
    with pytest.raises(ValueError):
        prepare.require_columns(df, ["energy"])


def test_harmonise_features(spark):
    df = spark.createDataFrame([("80", "0.5", "-5db", "13", "3"), ("x", "0.7", "-7 dB", None, "0")], "energy string, valence string, loudness string, key string, mode string")
    rows = prepare.harmonise_features(df).collect()
    assert [(r.energy, r.valence, r.loudness, r.key, r["mode"]) for r in rows] == [(0.8, 0.5, -5.0, 1, 1), (None, 0.7, -7.0, 0, 0)]


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [5.0] * 300 + [1.0], list(range(1, 1000)),
    [math.exp(random.Random(1).gauss(0, 4) * i / 500) for i in range(2000)],
    [random.Random(2).random() for _ in range(5000)] + [1e12, -1e12, float("nan")],
])
@pytest.mark.parametrize("read_off", [1_000_000, 3])
def test_exact_quantiles(spark, values, read_off, monkeypatch):
    monkeypatch.setattr(quantiles, "READ_OFF", read_off)
    monkeypatch.setattr(quantiles, "SKETCH", 64)
    monkeypatch.setattr(quantiles, "SLACK", 0.05)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").unionByName(spark.createDataFrame([(None,)], "x double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.prob: r.value for r in quantiles.exact_quantiles(df, ["x"], probs).collect()}
    clean = [v for v in values if not math.isnan(v)]
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(clean, p), rel=1e-12)


def test_quantiles_of_infinite_values_and_null_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "READ_OFF", 3)
    inf = float("inf")
    rows = [("a", float(i)) for i in range(100)] + [("a", inf)] * 30 + [("a", -inf)] * 30 + [(None, float(i % 3)) for i in range(50)] + [("b", None), ("c", inf)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.prob): r.value for r in quantiles.exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.9, 1.0], ["k"]).collect()}
    assert [got["a", p] for p in (0.0, 0.1, 0.5, 0.9, 1.0)] == [-inf, -inf, 49.5, inf, inf]
    assert [got[None, p] for p in (0.0, 0.5, 1.0)] == [0.0, 1.0, 2.0]
    assert got["c", 0.5] == inf and not any(k == "b" for k, _ in got)
    assert quantiles.exact_quantiles(df.filter("false"), ["x"], [0.5]).count() == 0


def test_brackets_of_one_value_are_counted_in_the_scan(spark):
    df = spark.createDataFrame([(float(i % 3), -0.0 if i % 2 else 0.0, float(i)) for i in range(90)], "a double, b double, c double")
    rows = [(("a",), 0, 1.0, 1.0), (("a",), 1, 1.0, 1.0), (("b",), 0, 0.0, 0.0), (("b",), 1, -0.0, 0.0), (("c",), 0, 40.0, 45.0)]
    state = spark.createDataFrame(rows, "g struct<feature: string>, i int, lo double, hi double")
    inside, below = quantiles._met(df, ["a", "b", "c"], [], state, 2)
    assert sorted((r.g.feature, r.value) for r in inside.collect()) == [("c", float(x)) for x in range(40, 46)]
    assert sorted((r.g.feature, r.i, r.below, r["at"]) for r in below.collect()) == [("a", 0, 30, 30), ("a", 1, 30, 30), ("b", 0, 0, 90), ("b", 1, 0, 90), ("c", 0, 40, None)]
    got = {r.feature: str(r.value) for r in quantiles.exact_quantiles(df, ["a", "b", "c"], [0.5]).collect()}
    assert got == {"a": "1.0", "b": "0.0", "c": "44.5"}


def test_a_null_stratum_is_split_like_others(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    rows = ranking.exact_split(df, "id", ranking.holdout_sizes(0.1, 0.1), ["s"]).collect()
    for s in (None, 1, 2):
        own = [r.split for r in rows if r.s == s]
        assert (own.count("train"), own.count("val"), own.count("test")) == (239, 31, 30)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_knn_leaves_out_unusable_vectors(spark, limit):
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    odd = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [1.0, 2.0, 3.0])]
    shape = "id bigint, embedding array<double>"
    df, all_rows = spark.createDataFrame(rows, shape), spark.createDataFrame(rows + odd, shape)
    expected = sorted(map(tuple, neighbours.knn(df, df, 3).collect()))
    assert sorted(map(tuple, neighbours.knn(all_rows, all_rows, 3, broadcast_bytes=limit).collect())) == expected


def test_split_sizes_and_parts(spark):
    for n in (1, 7, 100, 1003):
        rows = ranking.exact_split(spark.range(n), "id", ranking.holdout_sizes(0.1, 0.1)).collect()
        test = math.ceil(0.1 * n)
        val = math.ceil((n - test) * (0.1 / 0.9))
        counts = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
        assert len({r.id for r in rows}) == n
        assert counts == {"train": n - test - val, "val": val, "test": test}


def test_global_and_group_rank(spark):
    rows = [(i, (i * 7919) % 1000, "hot" if i % 3 else f"g{i % 10}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, v bigint, g string").repartition(7)
    got = {r.id: r["rank"] for r in ranking.global_rank(df, ["v", "id"]).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    placed = ranking.hash_rank(df, ["g"], "id", "place").collect()
    for group in {r[2] for r in rows}:
        inside = [r for r in placed if r.g == group]
        assert sorted(r.place for r in inside) == list(range(len(inside)))
        assert {r.group_size for r in inside} == {len(inside)}


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "pos int, key string")
    assert {(r.pos, r.key) for r in ranking.first_per_key(df, ["key"], ["pos"]).collect()} == {(1, "a"), (3, "b")}
    assert {(r.pos, r.key) for r in ranking.first_per_key(df, ["key"], ["pos"], last=True).collect()} == {(2, "a"), (3, "b")}


def brute(queries, corpus, k):
    out = set()
    for qid, q in queries:
        order = sorted((round(float(((q - c) ** 2).sum()), 9), cid) for cid, c in corpus)[:k]
        out |= {(qid, cid, i + 1) for i, (_, cid) in enumerate(order)}
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("clustered", [True, False])
def test_knn_is_exact(spark, limit, clustered, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) + (rng.integers(0, 5, size=(300, 1)) * 20 if clustered else 0)
    base[200:] = base[0]  # a third of all rows are copies
    corpus = [(i, v) for i, v in enumerate(base)]
    queries = [(i + 1000, v) for i, v in enumerate(np.vstack([base[:40], base[::30] + 0.01]))]
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id bigint, embedding array<double>").repartition(3) for rows in (queries, corpus)]
    for k in (1, 7, 400):
        got = neighbours.knn(*frames, k, broadcast_bytes=limit).collect()
        assert {(r.query_id, r.neighbour_id, r["rank"]) for r in got} == brute(queries, corpus, k)


@pytest.mark.parametrize("limit", [1 << 26, 0])
@pytest.mark.parametrize(("middle", "spread"), [(1e5, 0.01), (0.0, 1e-7), (-3e8, 50.0)])
def test_knn_is_exact_wherever_the_data_lies(spark, limit, middle, spread):
    rng = np.random.default_rng(8)
    rows = middle + spread * rng.normal(size=(300, 16))
    rows[200:230] = rows[5]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in neighbours.knn(frame, frame, 7, broadcast_bytes=limit).collect()}
    for q in range(300):
        d = ((rows - rows[q]) ** 2).sum(1)
        assert [got[q, i + 1] for i in range(7)] == np.lexsort((np.arange(300), d))[:7].tolist()


def test_knn_of_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0])], none.schema)
    for limit in (1 << 26, 0):
        assert neighbours.knn(one, none, 3, broadcast_bytes=limit).count() == 0
        assert neighbours.knn(none, one, 3, broadcast_bytes=limit).count() == 0


def test_knn_cosine_and_text_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [10.0, 1.0]), ("c", [0.0, 2.0])], "id string, embedding array<double>")
    for limit in (1 << 20, 0):
        got = neighbours.knn(df, df, 2, "cosine", broadcast_bytes=limit).filter("rank = 2").collect()
        assert {(r.query_id, r.neighbour_id) for r in got} == {("a", "b"), ("b", "a"), ("c", "b")}
    with pytest.raises(ValueError):
        neighbours.knn(df, df, 2, "dot")


def test_approximate_search_recall(spark, tables):
    rows = tables.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    exact = neighbours.knn(rows, rows, 5)
    assert neighbours.recall(neighbours.knn_approx(rows, rows, 5, probes=64), exact, 5).first()["recall"] == 1.0
    assert neighbours.recall(neighbours.knn_approx(rows, rows, 5, probes=24), exact, 5).first()["recall"] > 0.7


def brute_knn(queries, corpus, k):
    out = set()
    for q, v in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in corpus)[:k]
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(near)}
    return out


@pytest.fixture(scope="module")
def clustered_rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 12)) * 3
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=12)]) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(300)]  # a hot vector
    return rows


@pytest.mark.parametrize("block", [50, 20_000])
def test_saved_index_is_exact_after_rereading_and_appending(spark, tmp_path, clustered_rows, block, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", block)
    shape = "id bigint, embedding array<double>"
    odd = [(5000, None), (5001, []), (5002, [1.0, None] * 6), (5003, [float("nan")] * 12), (5004, [1.0, 2.0])]
    first = spark.createDataFrame(clustered_rows[:700] + odd, shape)
    index.VectorIndex.build(first, str(tmp_path / "index"), cells=12)
    found = index.VectorIndex(spark, str(tmp_path / "index"))
    asked = clustered_rows[::40]
    queries = spark.createDataFrame(asked + odd, shape)
    got = found.search(queries, 6)
    assert {(r.query_id, r.neighbour_id, r["rank"]) for r in got.collect()} == brute_knn(asked, clustered_rows[:700], 6)
    before = found.vectors.count()
    for _ in range(2):  # the second time adds nothing
        found.append(spark.createDataFrame(clustered_rows + odd, shape))
    assert (before, found.vectors.count()) == (700, len(clustered_rows))
    got = index.VectorIndex(spark, str(tmp_path / "index")).search(queries, 6).collect()
    assert {(r.query_id, r.neighbour_id, r["rank"]) for r in got} == brute_knn(asked, clustered_rows, 6)
    if block == 50:  # clusters lie apart, so most vectors are never compared
        assert sum(r.measured for r in got if r["rank"] == 1) < 0.5 * len(asked) * len(clustered_rows)


def test_index_reads_only_visited_cells(spark, tmp_path, clustered_rows):
    shape = "id bigint, embedding array<double>"
    found = index.VectorIndex.build(spark.createDataFrame(clustered_rows, shape), str(tmp_path / "index"), cells=12)
    visits = spark.createDataFrame([(3,), (3,), (7,)], "cell int")
    plan = found.in_cells(visits)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell#\d+ IN \([37], ?[37]\)", plan)
    assert {r.cell for r in found.in_cells(visits).select("cell").distinct().collect()} == {3, 7}


def test_search_by_codes_finds_most(spark, tables, tmp_path):
    rows = tables.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    found = index.VectorIndex.build(rows, str(tmp_path / "index"))
    exact = {(r.query_id, r.neighbour_id) for r in found.search(rows, 5).collect()}
    rough = found.search_codes(rows, 5, cells=1.0).collect()
    assert len({(r.query_id, r.neighbour_id) for r in rough} & exact) > 0.9 * len(exact)
    assert {r.measured for r in rough} == {40}


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id bigint, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], none.schema)
    assert index.VectorIndex.build(none, str(tmp_path / "a")).search(some, 3).count() == 0
    found = index.VectorIndex.build(some, str(tmp_path / "b"))
    assert found.search(none, 3).count() == found.search_codes(none, 3).count() == 0
    assert [tuple(r)[:2] for r in found.search(some, 3).collect()] == [(1, 1)]


def test_find_song_cases(spark, songs):
    asked = [
        ("first of two", "HARBOUR FOG", None), ("by artist", "Harbour Fog", "quay"), ("part", "fog returns", None),
        ("other artist", "Untitled", "Orla"), ("null artist", "ça IRA, zoë", None), ("null artist asked", "Ça ira, Zoë", "x"),
        ("no pattern", "0% copper_", None), ("not a wildcard", "c_pper", None), ("none", "qqq", None), ("blank", "\t ", None), ("one letter", "%", None),
    ]
    requests = spark.createDataFrame(asked, "request_id string, name string, artist string")
    lenient = {r.request_id: r.pos for r in search.find_songs(requests, songs).collect()}
    strict = {r.request_id: r.pos for r in search.find_songs(requests, songs, strict=True).collect()}
    same = {"first of two": 0, "by artist": 1, "part": 2, "null artist": 3, "no pattern": 4, "one letter": 4}
    assert strict == same
    assert lenient == same | {"other artist": 5, "null artist asked": 3}


def test_song_search_order(spark):
    names = ["Love Remix", "love song", "My Love", "Love", "LOVE", "Hate"]
    df = spark.createDataFrame([(i, n, "['A']", "pop", "joy") for i, n in enumerate(names)], "pos bigint, song string, artist string, genre string, emotion string")
    rows = search.song_search(df, " love")
    assert [r.song for r in rows.collect()] == ["Love", "love song", "My Love", "Love Remix"]
    assert tuple(search.search_counts(rows).first()) == (4, 3, 1)
    assert search.song_search(df, "  ").count() == 0
    assert search.song_search(df, "love", "b").count() == 0


def test_moods(spark, songs):
    tracks = songs.withColumn("track_id", F.col("pos").cast("string"))
    # both ends of a range count, a null feature fits no rule, and popularity ties go by id
    happy = [2, 3, 0]
    assert [r.pos for r in moods.mood_top(tracks, "happy").collect()] == happy
    assert [r.pos for r in moods.mood_top(tracks, "unheard").collect()] == happy
    assert [r.pos for r in moods.context_top(tracks, "driving").collect()] == happy
    assert [r.pos for r in moods.mood_top(tracks, "ANGRY").collect()] == [4]
    assert [r.pos for r in moods.context_top(tracks, "party").collect()] == [2, 3]
    assert moods.mood_top(tracks, "calm").count() == 0
    for check, name in ((moods.check_mood, "party"), (moods.check_context, "happy")):
        with pytest.raises(ValueError):
            check(name)
    with pytest.raises(ValueError):
        search.check_limit(51, fixed.RESULT_LIMITS)


def test_zscores(spark):
    df = spark.createDataFrame([(0.8, 120.0), (0.3, 85.0), (0.6, 100.0)], "energy double, tempo double")
    columns = ["energy", "tempo"]
    out = S.apply_zscore(df, S.fit(df, columns, population=True), columns)
    means = out.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    assert list(means) == pytest.approx([0, 0, 1, 1], abs=1e-6)


def test_correlation_with_missing_values(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 3)) + 1000
    data[:, 1] += data[:, 0]
    data[rng.random((200, 3)) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in row) for row in data], "a double, b double, c double")
    got = {(r.feature_a, r.feature_b): r["corr"] for r in S.correlations(df, ["a", "b", "c"]).collect()}
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            assert got[x, y] == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1], abs=1e-9)
    flat = S.correlations(df.withColumn("b", F.lit(3.0)), ["a", "b"]).collect()
    assert {(r.feature_a, r.feature_b) for r in flat if r["corr"] is None} == {("a", "b"), ("b", "a"), ("b", "b")}
    assert S.correlations(df.limit(0), ["a", "b"]).count() == 0


def test_triplets(spark):
    rows = [(i, f"artist {i}", f"song {i}", "hot" if i % 3 else f"g{i % 4}", None) for i in range(60)]
    rows[0] = (0, "artist 0", "song 0", "hot", [("nobody", "nothing"), (" Artist 5 ", "SONG 5")])
    rows[1] = (1, "artist 1", "song 1", "alone", None)
    df = spark.createDataFrame(rows, "id bigint, artist string, song string, genre string, similar array<struct<artist:string,song:string>>")
    genre = {r[0]: r[3] for r in rows}
    mined = {r.anchor_id: r for r in triplets.mine(df).collect()}
    assert set(mined) == set(range(60)) - {1}
    assert mined[0].positive_id == 5
    for anchor, r in mined.items():
        assert r.positive_id != anchor and genre[r.negative_id] != genre[anchor]
        assert anchor == 0 or genre[r.positive_id] == genre[anchor]


def replayed(rows):
    """One plain pass over the lookups of each key."""
    expires, out = {}, {}
    for key, id_, at, ttl in sorted(rows, key=lambda r: (r[2], r[1])):
        hit = expires.get(key, -1) > at
        if not hit:
            expires[key] = at + ttl
        out[key, id_] = hit
    return out


def lookup_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(8)}"
        rows.append((key, i, 1_700_000_000 + rng.randrange(30 * 86400), rng.choice([30, 300, 86400])))
    return rows


@pytest.mark.parametrize("slot_rows", [10_000, 200])
def test_cache_replay(spark, slot_rows):
    """Also with the hot key (40 % of the rows) cut into slots."""
    rows = lookup_rows(slot_rows, 3000)
    df = spark.createDataFrame(rows, "key string, id bigint, at bigint, ttl int").withColumn("ts", F.timestamp_seconds("at"))
    got = {(r.key, r.id): r.is_hit for r in cache.replay(df, slot_rows).collect()}
    assert got == replayed(rows)


@pytest.mark.parametrize("files, order", [(1, "time"), (4, "time"), (5, "any")])
def test_cache_stream_is_the_same_for_any_batches(spark, tmp_path, files, order):
    """Late lookups, several batches, and a state that is empty in the end."""
    from songloom.streaming import jobs

    rows = sorted(lookup_rows(5, 600), key=lambda r: r[2] if order == "time" else zlib.crc32(str(r[1]).encode()))
    schema = "key string, id bigint, at bigint, ttl int"
    size = -(-len(rows) // files)
    parts = [rows[i * size : (i + 1) * size] for i in range(files)]
    for part in [*parts, [(None, -1, max(r[2] for r in rows) + 10**7, 0)]]:
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "lookups.parquet"))
    (tmp_path / "lookups2.parquet").mkdir()
    stream = jobs.table_stream(spark, str(tmp_path), "lookups", df.schema, files_per_batch=1)
    hits = jobs.cache_stream(stream, "100 days")
    got = jobs.run_to_table(hits, str(tmp_path / "out"), jobs.TIMERS_STORE)
    assert {(r.key, r.id): r.is_hit for r in got.collect()} == replayed(rows)
    for name in ("waiting", "entry"):
        state = spark.read.format("statestore").option("stateVarName", name)
        if name == "waiting":
            state = state.option("flattenCollectionTypes", True)
        assert state.load(f"{tmp_path / 'out'}-progress").count() == 0
    assert spark.conf.get(jobs.STATE_STORE, "").find("RocksDB") < 0


def test_history_limits(spark):
    with pytest.raises(ValueError):
        users.latest(spark.range(1), 201)


def test_encoder_artefact(spark, tables, tmp_path):
    tracks = catalogue.tracks(tables)
    values = tracks.select("track_id", *fixed.FEATURES).orderBy("track_id").toPandas()
    z = values[fixed.FEATURES].to_numpy()
    z = (z - z.mean(0)) / (z.std(0, ddof=1) + fixed.EPSILON)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    codes = z @ axes[:8].T
    codes /= np.linalg.norm(codes, axis=1, keepdims=True)
    made = learning.encode_batch(tracks, str(tmp_path / "encoder")).orderBy("track_id").toPandas()
    got = np.stack(made["embedding"].to_numpy())
    assert (made["track_id"] == values["track_id"]).all()
    # an axis may point either way
    assert np.allclose(got @ got[:50].T, codes @ codes[:50].T, atol=1e-4)
    read = encoder.load(spark, str(tmp_path / "encoder"))
    assert read == encoder.load(spark, str(tmp_path / "encoder")) and read.features == fixed.FEATURES
    assert np.allclose(read.codes_of(values[fixed.FEATURES].to_numpy()[7].tolist()), got[7], atol=1e-5)
    with pytest.raises(AnalysisException):
        read.save(spark, str(tmp_path / "encoder"))
    # with all nine axes nothing is lost
    assert learning.reconstruction_mse(learning.pca_encode(tracks, 9)).first()["mse"] < 1e-12


def test_encoder_odd_rows(spark):
    rows = [("a", 1.0, 2.0), ("b", 3.0, float("nan")), ("c", None, 1.0), ("d", 2.0, 2.0), ("e", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    model = encoder.fit(df, 2, ["x", "y"])
    assert {r.id for r in model.encode(df, "id").filter("embedding IS NULL").collect()} == {"b", "c"}
    scaler = encoder.fit_scaler(df, ["x", "y"])
    found = encoder.nearest(df, "id", scaler, {"p": [2.0, 2.0], "q": [0.0, 2.0]}, 2).collect()
    assert {(r.query_id, r["rank"]) for r in found} == {("p", 1), ("p", 2), ("q", 1), ("q", 2)}
    assert [r.neighbour_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == "p"] == ["d", "e"]
    assert encoder.nearest(df.limit(0), "id", scaler, {"p": [2.0, 2.0]}, 2).count() == 0
    assert encoder.nearest(df, "id", scaler, {"p": [2.0, 2.0]}, 9).count() == 3


def test_density(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=500), rng.normal(30, 0.1, 80), np.full(60, 4.0), [500.0]])
    rows = [(float(v),) for v in values] + [(None,), (math.nan,), (math.inf,)]
    df = spark.createDataFrame(rows, "x double")
    curve = density.kde(df, "x", 40).orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 40)
    exact = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.allclose(curve["x"], grid)
    assert np.abs(curve["density"] - exact).max() < 2e-11 / h
    with pytest.raises(ValueError):
        density.kde(df.filter("x = 4"), "x", 40)


def test_text_vectors_and_gradient(spark, tables):
    lengths = learning.text_vectors(catalogue.lyrics(tables), "doc_id").select(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("n")
    )
    assert {round(r.n, 4) for r in lengths.collect()} <= {0.0, 1.0}
    gradient = learning.first_component(catalogue.tracks(tables))
    assert list(gradient.agg(F.min("gradient"), F.max("gradient")).first()) == [0.0, 1.0]
    related = gradient.join(catalogue.tracks(tables).select("track_id", "energy"), "track_id")
    assert related.agg(F.corr("gradient", "energy")).first()[0] > 0


def test_effective_rank(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 8))
    df = spark.createDataFrame([(v.tolist(),) for v in flat], "embedding array<double>")
    rows = learning.effective_rank(df).orderBy("axis").collect()
    assert 1 <= sum(r.needed for r in rows) <= 3
    assert rows[-1].cumulative == pytest.approx(1.0)


def test_classifier_learns(spark):
    """Separable features are told apart whatever the class sizes."""
    rng = random.Random(6)
    rows = []
    for i in range(600):
        label = 1 if i % 10 == 0 else 0
        features = [rng.gauss(3 * label, 0.3) for _ in fixed.FEATURES]
        rows.append((str(i), label, *features))
    schema = "track_id string, label int, " + ", ".join(f"`{f}` double" for f in fixed.FEATURES)
    split = ranking.exact_split(spark.createDataFrame(rows, schema), "track_id", ranking.halved_tail_sizes(0.2), ["label"])
    predicted = learning.train_classifier(split, S.class_weights(split.filter("split = 'train'"), "label"))
    assert predicted.filter("split <> 'train' AND label <> predicted").count() == 0


def test_missing_vectors_are_encoded(spark):
    rows = spark.createDataFrame(
        [(1, "a song", [1.0, 0.0]), (2, "rain on me", None), (3, "rain on me", [0.0, 0.0]), (4, None, None), (5, "  ", []), (None, "x", None)],
        "id bigint, text string, embedding array<float>",
    )
    got = {r.id: r for r in learning.encode_missing(rows, 8).collect()}
    assert {i: r.origin for i, r in got.items()} == {1: "stored", 2: "encoded", 3: "encoded", 4: "empty", 5: "empty", None: "encoded"}
    assert got[2].embedding == got[3].embedding and got[1].embedding == [1.0, 0.0] and got[4].embedding == [0.0] * 8
    assert learning.encode_missing(rows.limit(0), 8).count() == 0


def test_appending_twice_adds_nothing(spark, tmp_path):
    folder = str(tmp_path / "vectors")
    spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, embedding array<float>").write.parquet(folder)
    rows = spark.createDataFrame([(1, "old"), (2, "new words"), (3, None)], "id bigint, text string")
    first = sorted(map(tuple, learning.append_encoded(rows, folder, 2).collect()))
    assert [r[0] for r in first] == [1, 2, 3] and first[0][1] == [1.0, 0.0]
    assert sorted(map(tuple, learning.append_encoded(rows, folder, 2).collect())) == first


def test_similar_songs_by_name(spark):
    songs = spark.createDataFrame([(i, f"Song {i}", "Ann" if i % 2 else "Bob", "pop", "joy") for i in range(12)], "pos bigint, song string, artist string, genre string, emotion string")
    vectors = songs.filter("pos < 10").select(F.col("pos").alias("id"), "song", "artist", "genre", "emotion", F.array(F.col("pos").cast("float")).alias("embedding"))
    asked = spark.createDataFrame([("a", "SONG 3", "ann"), ("b", "song 3", None), ("c", "ong 4", None), ("d", "nothing", None), ("e", "song 11", None), ("f", None, None)], "request_id string, name string, artist string")
    got = search.similar_songs_by_name(asked, songs, vectors, 2).collect()
    by = {r: {x.neighbour_id for x in got if x.request_id == r} for r in "abcdef"}
    assert by == {"a": {2, 4}, "b": {2, 4}, "c": {3, 5}, "d": set(), "e": set(), "f": set()}
    tracks = search.similar_tracks_by_name(asked.filter("request_id < 'c'"), songs, vectors, 3).collect()
    assert {r.request_id for r in tracks} == {"a", "b"} and all(r.query_id == 3 != r.neighbour_id for r in tracks)


def test_knn_sends_a_row_once_for_each_block(spark, monkeypatch):
    """Vectors without structure: a row is copied for the blocks of the other side, not for every cell that could hold a neighbour."""
    def counted(k, unit):
        return lambda q, c: pa.table({"query_id": pa.array([q.num_rows]), "neighbour_id": pa.array([c.num_rows]), "distance": pa.array([0.0])})

    monkeypatch.setattr(neighbours, "FULL_ROWS", 100)
    monkeypatch.setattr(neighbours, "_pair", counted)
    rows = np.random.default_rng(4).normal(size=(2000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id bigint, embedding array<double>")
    sent = neighbours.knn(frame, frame, 5, broadcast_bytes=0).collect()
    # four cores: the root of sixteen blocks on a side
    assert sum(r.query_id for r in sent) + sum(r.neighbour_id for r in sent) <= 2 * 4 * len(rows)


def test_a_table_searched_with_itself_is_dealt_once(spark, monkeypatch):
    """A row is sent once for each block, not once on either side, and what is found does not change."""
    rows = np.random.default_rng(5).normal(size=(400, 6)).round(1)
    rows[300:] = rows[:100]
    frame = spark.createDataFrame([(f"v{i % 390:03}", v.tolist()) for i, v in enumerate(rows)], "id string, embedding array<double>")
    groups = neighbours.own_pairs(frame, 5).groupBy("low", "high").agg(F.count("*").alias("rows")).collect()
    assert len(groups) == 5 * 6 // 2 and sum(g["rows"] for g in groups) == 5 * len(rows)
    expected = sorted(map(tuple, neighbours.knn(frame, frame, 5).collect()))
    monkeypatch.setattr(neighbours, "FULL_ROWS", 100)
    assert sorted(map(tuple, neighbours.knn(frame, frame, 5, broadcast_bytes=0).collect())) == expected
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)  # some pairs lack rows on a side
    assert sorted(map(tuple, neighbours.knn(frame, frame, 5, broadcast_bytes=0).collect())) == expected


def test_similar_songs_of_a_large_catalogue(spark, monkeypatch):
    """Queries drawn from the catalogue itself, more than are sent to the tasks."""
    rng = np.random.default_rng(7)
    rows = [(i, f"Song {i % 25}", "Ann", "pop", fixed.EMOTIONS[i % 6], rng.normal(size=4).tolist()) for i in range(60)]
    songs = spark.createDataFrame(rows, "id bigint, song string, artist string, genre string, emotion string, embedding array<float>")
    searches = [lambda: search.similar_songs(songs.select("id"), songs, 3), lambda: search.similar_tracks(songs.select("id"), songs, 3)]
    expected = [sorted(map(tuple, s().collect())) for s in searches]
    monkeypatch.setattr(search, "knn", lambda *args, **named: neighbours.knn(*args, **named, broadcast_bytes=0))
    assert [sorted(map(tuple, s().collect())) for s in searches] == expected


def test_block_search_in_both_precisions(monkeypatch):
    """Pieces smaller than a block, ties, copies, tight clusters far from the mean, and vectors too long for single precision."""
    monkeypatch.setattr(neighbours, "CORPUS_ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 8)
    rng = np.random.default_rng(6)
    for case in range(12):
        c = (-3e8, 0.0, 1e5)[case % 3] + rng.normal(size=(90, 7)).round(case % 4)
        c[60:70] = c[3]
        if case % 4 == 0:
            c[1:] = c[0] + 1e-6 * rng.normal(size=(89, 7))
        if case % 5 == 0:
            c[7] = 1e40
        q = np.concatenate([c[::9], c[:9] + 0.5, np.full((1, 7), 1e60)])
        got = neighbours.block_best(np.arange(len(q)), q, np.arange(90), c, 5)
        for i in range(len(q)):
            nearest = np.lexsort((np.arange(90), ((q[i] - c) ** 2).sum(1)))[:5]
            assert got[got.query_id == i].sort_values(["distance", "neighbour_id"]).neighbour_id.tolist() == nearest.tolist()


def test_cache_stream_keeps_a_state_for_each_bucket(spark, tmp_path):
    """Many keys share few states, so a batch does not cost a call for every key."""
    from songloom.streaming import jobs

    rows = [(f"k{i}", i, 1_700_000_000 + i, 300) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, id bigint, at bigint, ttl int").withColumn("ts", F.timestamp_seconds("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "lookups.parquet"))
    stream = jobs.table_stream(spark, str(tmp_path), "lookups", df.schema)
    jobs.run_to_table(jobs.cache_stream(stream, "100 days", buckets=3), str(tmp_path / "out"), jobs.TIMERS_STORE)
    state = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", True)
    assert 1 <= state.load(f"{tmp_path / 'out'}-progress").count() <= 3


def test_index_sends_a_query_once_for_each_bundle(spark, tmp_path):
    """Not once for each of the many cells that cannot be ruled out."""
    blocks = [{"cell": c, "block": 0, "rows": 1000, "inner": 0.0, "outer": 9.0} for c in range(600)]
    layout = index.Layout(blocks, 12)
    assert layout.parts == 7 and len(set(layout.bundle.tolist())) == 7
    assert np.bincount(layout.bundle).max() * 1000 <= index.BUNDLE
    rng = np.random.default_rng(2)
    coder = index.Coder(rng.normal(size=(600, 8)), [])
    mask = index._within_limit(rng.normal(size=(5, 8)), np.full(5, np.inf), layout, coder, slice(None))
    assert mask.all()


def test_quantiles_without_groups_deal_nothing_out(spark):
    """Values of a column meet their brackets in the scan, not in a join by column."""
    df = spark.range(3000).select((F.col("id") * 0.5).alias("x"), F.col("id").cast("double").alias("y"))
    state = quantiles._ranks(quantiles._sketched(df, ["x", "y"], []), [0.25, 0.5])
    inside, _ = quantiles._met(df, ["x", "y"], [], state, 4)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {tuple(r) for r in inside.select("g.feature", "i").distinct().collect()} == {(c, i) for c in "xy" for i in range(4)}
