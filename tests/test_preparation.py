"""The preparation job and the row cap of the readers."""

import os
import statistics

import pytest
from pyspark.sql import functions as F

from songloom.operators import preparation, ranking
from songloom.plans import preparation as plans
from songloom.session import shared_dir, shuffles_freed
from songloom.sources import readers

FEATURES = ["energy", "valence", "tempo", "liveness"]


@pytest.fixture
def new_tables(spark):
    """Lists the folders that were added to the shared folder since the test began."""
    shared = shared_dir(spark)
    before = set(os.listdir(shared)) if os.path.exists(shared) else set()
    return lambda: [f"{shared}/{x}" for x in sorted(set(os.listdir(shared)) - before)] if os.path.exists(shared) else []


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {x for x in blocks.split() if x.startswith("shuffle_")}


def sources(spark):
    """Two sources that share ids 20 to 39, with missing values, and a lookup with copies of its names."""
    first = [(f"t{i}", f"Song {i % 9}", f"a{i}", ["joy", None, "anger"][i % 3], str(i % 101), None if i % 4 == 0 else str(i / 100), str(60 + i)) for i in range(40)]
    second = [(f"t{i}", f"Song {i % 9}", f"a{i}", ["joy", None, "anger"][i % 3], str(i % 10 / 10), None if i % 5 == 0 else str(i / 100), str(60 + i), "x") for i in range(20, 70)]
    lookup = [(f"song {i % 7}", i, None if i % 2 else i / 50, i / 14) for i in range(14)]
    return (
        spark.createDataFrame(first, "track_id string, song string, artist string, emotion string, Energy string, Positiveness string, Tempo string"),
        spark.createDataFrame(second, "track_id string, name string, artists string, emotion string, energy string, valence string, tempo string, only_here string"),
        spark.createDataFrame(lookup, "song string, pos int, valence double, liveness double"),
    )


def expected():
    """The same by plain Python: (emotion, energy, valence, tempo, liveness) by id."""
    rows = {}
    for i in range(70):
        known = None if i % 4 == 0 and i < 40 or i % 5 == 0 and i >= 40 else i / 100
        k = i % 9  # the lookup's first row of a name is the one at its number
        side = (None if k % 2 else k / 50, k / 14) if k < 7 else (None, None)
        rows[f"t{i}"] = [["joy", "neutral", "anger"][i % 3], i % 101 / 100 if i < 40 else i % 10 / 10, side[0] if known is None else known, 60.0 + i, side[1]]
    for column in (2, 4):
        middle = statistics.median(r[column] for r in rows.values() if r[column] is not None)
        for r in rows.values():
            r[column] = middle if r[column] is None else r[column]
    return rows


def job(spark, scratch, **more):
    required = ["track_id", "song", "artist", "emotion", "energy", "valence", "tempo"]
    return preparation.prepared(*sources(spark), F.col("track_id"), F.lower("song"), "pos", "track_id", FEATURES, required, scratch, **more)


@pytest.mark.parametrize("most", ["-1", "10m"])
def test_the_job_over_one_written_table(spark, new_tables, tmp_path, most):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        done = job(spark, str(tmp_path / "scratch"))
        assert done.columns == ["track_id", "song", "artist", "emotion", *FEATURES, "split"]
        got = {r.track_id: r for r in done.collect()}
        assert sorted(os.listdir(tmp_path / "scratch")) == ["enriched", "lookup"]
        names = {os.path.basename(x).rsplit("-", 1)[0] for x in new_tables()}
        assert names == {"brackets", "cuts"}  # no columns, merged or imputed rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = expected()
    assert len(got) == done.count() == len(want)
    for i, row in want.items():
        assert got[i].emotion == row[0] and got[i].song == f"Song {int(i[1:]) % 9}"
        assert [got[i][f] for f in FEATURES] == pytest.approx(row[1:])
    for emotion in {r[0] for r in want.values()}:
        order = [r.split for r in sorted((r for r in got.values() if r.emotion == emotion), key=lambda r: ranking_key(r.track_id))]
        n, tail = len(order), -(-len(order) // 5)
        test = -(-tail // 2)
        assert order == ["train"] * (n - tail) + ["val"] * (tail - test) + ["test"] * test
    assert job(spark, str(tmp_path / "again"), names=()).columns == ["track_id", "emotion", *FEATURES, "split"]


def ranking_key(track_id):
    import hashlib

    return hashlib.md5(f"{track_id}-42".encode()).hexdigest()


def test_the_query_leaves_what_it_wrote_and_no_more(spark, new_tables, tmp_path):
    n = 600
    lines = [(i % 150, i % 40, i % 9, i % 7 + 1, float(i % 50 + 1), 900.0 + i, i % 11 / 100, i % 9 / 100) for i in range(n)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(str(tmp_path / "in/lineitem.parquet"))
    spark.createDataFrame([(i, f"name {i % 30}", i % 50) for i in range(40)], "p_partkey bigint, p_name string, p_size int").write.parquet(str(tmp_path / "in/part.parquet"))
    spark.createDataFrame([(i, f"who {i}") for i in range(9)], "s_suppkey bigint, s_name string").write.parquet(str(tmp_path / "in/supplier.parquet"))
    shuffled = shuffle_files(spark)
    rows = plans.prepared_catalogue(readers.Tables(spark, str(tmp_path / "in")))
    assert not shuffle_files(spark) - shuffled
    (folder,) = [x for x in new_tables() if os.path.basename(x).startswith("prepared-")]
    assert sorted(os.listdir(folder)) == ["splits", "statistics"]
    assert {os.path.basename(x).rsplit("-", 1)[0] for x in new_tables()} == {"prepared", "brackets", "cuts"}
    assert rows.count() == rows.select("track_id").distinct().count() == n


def test_freed_shuffles_end_with_the_block(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    shuffled = shuffle_files(spark)
    with shuffles_freed(spark):
        rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        assert rows.count() == 7 and len(rows.collect()) == 7 and len(rows.collect()) == 7
        assert not shuffle_files(spark) - shuffled
    assert spark.conf.get(name, None) == before


def test_rows_are_not_moved_to_find_the_cuts(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    split = ranking.exact_split(rows, "id", ranking.halved_tail_sizes(0.2), ["s"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = split._jdf.queryExecution().executedPlan().toString()
        kept = ranking.exact_split(rows, "id", ranking.halved_tail_sizes(0.2), ["s"], kept=True)
        assert sorted(kept.collect(), key=str) == sorted(split.collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_row_cap_takes_the_first_rows_of_the_splits(spark, tmp_path):
    spark.range(100, numPartitions=7).selectExpr("CAST(id AS STRING) AS value").write.text(str(tmp_path / "lines"))
    lines = spark.read.text(str(tmp_path / "lines"))
    whole = {r.value for r in lines.collect()}
    for n in (0, 1, 14, 15, 99, 100, 500):
        got = [r.value for r in readers.first_rows(lines, n).collect()]
        assert len(got) == len(set(got)) == min(n, 100) and set(got) <= whole
    assert readers.first_rows(lines.filter("value < '0'"), 5).count() == 0


def test_a_source_without_its_columns_is_named(spark):
    df = spark.createDataFrame([("a", "b", "1")], "name string, artists string, Energy string")
    with pytest.raises(ValueError, match="valence"):
        preparation.harmonised(df, ["song", "artist", "energy", "valence"])
    row = preparation.harmonised(df, ["song", "artist", "energy"]).first()
    assert (row.song, row.artist, row.energy) == ("a", "b", 1.0)


def test_statistics_are_written_without_a_table_of_their_own(spark, new_tables, tmp_path):
    rows = [(f"t{i}", ["train", "val"][i % 5 == 0], i / 7) for i in range(50)]
    df = spark.createDataFrame(rows, "track_id string, split string, energy double")
    preparation.write(df, str(tmp_path / "out"), ["energy"])
    assert not new_tables() and sorted(os.listdir(tmp_path / "out")) == ["splits", "statistics"]
    assert {tuple(r) for r in preparation.written(spark, str(tmp_path / "out"), "track_id string, energy double").select("track_id", "split", "energy").collect()} == set(rows)
    train = [x for _, split, x in rows if split == "train"]
    (row,) = preparation.written_statistics(spark, str(tmp_path / "out")).collect()
    assert row.feature == "energy" and list(row)[1:] == pytest.approx([statistics.mean(train), statistics.stdev(train), min(train), max(train)])
