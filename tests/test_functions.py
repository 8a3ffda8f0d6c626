import datetime as dt

import pytest
from pyspark.sql import functions as F

from songloom import fixed
from songloom.functions import numeric as N
from songloom.functions import text as X
from songloom.functions import vectors as V


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def apply(spark, values, make, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(make(F.col("x"))).collect()]


CLEANED = {
    "": "",
    " \t\n": "",
    "[Intro: 4x]\nLa la [Bridge]la": "la la la",
    "[not closed": "not closed",
    "1 < 2, <br/>3 > 2": "1 3 2",
    "hear http://a.b/c?d=1&e=[f] now": "hear now",
    "WWW.Tunes.EXAMPLE/x y": "www.tunes.example x y",
    "Ørsted: ÆON — “ünder”\u00a0π": "ørsted æon ünder π",
    "don't! \"stop\", (ever); no-one's?": "don't! \"stop\", ever no one's?",
    "#1 & *2* @3": "1 2 3",
}


def test_clean_text_cases(spark):
    got = apply(spark, [None, *CLEANED], X.clean_text)
    assert got == ["", *CLEANED.values()]


def test_clean_text_is_idempotent(spark, tables):
    once = tables.pages.select(X.clean_text(F.col("html")).alias("a"))
    assert once.select(F.col("a"), X.clean_text(F.col("a")).alias("b")).filter("a <> b").count() == 0


def test_combine_text(spark):
    rows = [("la la", "fear", "dub"), ("la la", "", None), (None, None, "dub"), ("", "fear", ""), (None, "", None)]
    df = spark.createDataFrame(rows, "l string, e string, g string")
    out = [r[0] for r in df.select(X.combine_text(F.col("l"), F.col("e"), F.col("g"))).collect()]
    assert out == ["[EMOTION: fear] [GENRE: dub] la la", "la la", "[GENRE: dub]", "[EMOTION: fear]", ""]


def test_clean_artist(spark):
    values = ["['Orla Quay']", "['Orla Quay', \"Nils O'Dea\", '']", "  Glass Heron ", "['']", "", None]
    got = apply(spark, values, X.clean_artist)
    assert got == ["Orla Quay", "Orla Quay, Nils O'Dea", "Glass Heron", "", "", None]


def test_non_original(spark):
    assert apply(spark, ["Song (Remix)", "Oliver", "Plain", "Live at home"], X.is_non_original) == [True, True, False, True]


def test_parse_key(spark):
    values = ["C Maj", "F# min", "Bb", "X", None, ""]
    expected = [0, 6, 10, 5, 5, 5]
    assert apply(spark, values, N.pitch_of_key) == pytest.approx([e / 11 for e in expected])


def test_numbers(spark):
    assert apply(spark, ["-5.2db", "-7 DB", "loud", None], N.parse_loudness) == [-5.2, -7.0, None, None]
    assert apply(spark, ["13", "-1", "x", None], lambda c: N.wrap(c, 12)) == [1, 11, 0, 0]
    assert apply(spark, ["D#", "11", "Eb", None], N.key_index) == [3, 11, 0, 0]
    assert apply(spark, ["2001-05-02", "soon"], N.year_of) == [2001, None]
    assert apply(spark, ["JOY", "thirst", None], N.emotion_code_lenient) == [0, 0, 0]
    assert apply(spark, ["Love", "thirst", None], N.emotion_code) == [4, None, None]


def test_labels_in_time(spark):
    now = dt.datetime(2024, 1, 3)
    seconds = [5, 61, 7200, 90000]
    df = spark.createDataFrame([(now - dt.timedelta(seconds=s), now) for s in seconds], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(X.time_ago(F.col("a"), F.col("b"))).collect()] == ["Just now", "1m ago", "2h ago", "1d ago"]
    assert apply(spark, [None, 0, 61000, 119900], X.format_duration, "bigint") == ["", "", "1:01", "1:60"]


def test_search_url(spark):
    df = spark.createDataFrame([("A b", None), ("A b", "C d")], "s string, a string")
    urls = [r[0] for r in df.select(X.search_url(F.col("s"), F.col("a"), "https://example.org/?q=")).collect()]
    assert urls == ["https://example.org/?q=" + "A%20b", "https://example.org/?q=" + "A%20b%20C%20d"]


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
