"""Song lookup by stored lists of grams, against a plain loop over all songs."""

import random
import re

import pytest

from songloom.operators import names
from songloom.operators.names import NameIndex

SONGS = "pos bigint, song string, artist string"
ASKED = "request_id int, name string, artist string"


def plain(songs, asked, strict):
    """What each request must find."""
    def fits(artist, wanted):
        return wanted is None or (artist is not None and wanted.lower() in artist.lower())

    out = {}
    for rid, name, artist in asked:
        if name is None or not name.strip(" "):
            continue
        same = [p for p, s, a in songs if s is not None and s.lower() == name.lower() and fits(a, artist)]
        part = [p for p, s, a in songs if s is not None and name.lower() in s.lower() and (not strict or fits(a, artist))]
        if same or part:
            out[rid] = (min(same or part), bool(same))
    return out


def made(n=300):
    rng = random.Random(8)
    words = ["ash", "bell", "Cove", "dune", "É", "fog_", "100%", "a", "go"]
    singers = ["Ann Lee", "annika", "Bo", None, "Zoë"]
    songs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), rng.choice(singers)) for i in range(n)]
    songs += [(n + i, "The Same Name", f"artist {i}") for i in range(200)] + [(900, None, "Ann Lee"), (901, "", "Bo"), (902, " ", None)]
    asked = [(w, a) for w in [*words, "bell c", "E", "l", "ll", "name", "THE SAME NAME", "qqq", "b_ll", "", " ", None, " f", "the same name and more"] for a in (None, "ann", "zoë", "ARTIST 17", "nobody")]
    return songs, [(i, *x) for i, x in enumerate(asked)] + [(5000, "bell", "ann"), (5001, "bell", "ann")]


@pytest.mark.parametrize("strict", [False, True])
def test_finds_what_a_loop_finds(spark, tmp_path, monkeypatch, strict):
    monkeypatch.setattr(names, "BLOCK", 16)  # so that common grams have many blocks
    songs, asked = made()
    table = spark.createDataFrame(songs, SONGS)
    folder = str(tmp_path / "index")
    index = NameIndex.build(table, folder)
    got = index.find(spark.createDataFrame(asked, ASKED), strict).collect()
    assert len(got) == len({r.request_id for r in got})
    assert {r.request_id: (r.pos, r.is_exact) for r in got} == plain(songs, asked, strict)
    sizes = spark.read.parquet(f"{folder}/grams").selectExpr("max(size(entries)) AS most", "count(*) AS rows", "count(DISTINCT gram) AS grams").first()
    assert sizes.most <= 16 and sizes.rows > sizes.grams


def test_appended_songs_are_found_and_repeats_do_no_harm(spark, tmp_path):
    songs, asked = made(60)
    folder = str(tmp_path / "index")
    index = NameIndex.build(spark.createDataFrame(songs[::2], SONGS), folder)
    index.append(spark.createDataFrame(songs, SONGS))
    again = NameIndex(spark, folder).find(spark.createDataFrame(asked, ASKED))
    assert {r.request_id: (r.pos, r.is_exact) for r in again.collect()} == plain(songs, asked, False)
    with pytest.raises(Exception, match="(?i)exists"):
        NameIndex.build(spark.createDataFrame(songs, SONGS), folder)


def test_only_needed_folders_are_read(spark, tmp_path):
    folder = str(tmp_path / "index")
    index = NameIndex.build(spark.createDataFrame(made(60)[0], SONGS), folder)
    found = index.find(spark.createDataFrame([(1, "dune", None)], ASKED))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard#", plan)
    assert found.count() <= 1


def test_nothing_stored_and_nothing_asked(spark, tmp_path):
    none = spark.createDataFrame([], SONGS)
    index = NameIndex.build(none, str(tmp_path / "empty"))
    assert index.find(spark.createDataFrame([(1, "a", None)], ASKED)).count() == 0
    full = NameIndex.build(spark.createDataFrame([(1, "a song", None)], SONGS), str(tmp_path / "full"))
    assert full.find(spark.createDataFrame([], ASKED)).count() == 0
