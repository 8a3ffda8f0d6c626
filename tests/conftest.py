import pytest

from songloom.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from songloom.sources.readers import Tables

    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def songs(spark):
    """Songs with one name by two artists, a name inside another, a remix, a null artist and null features."""
    rows = [
        (0, "Harbour Fog", "Nils Ardent", "folk", "joy", 0.55, 0.64, 40.0),
        (1, "Harbour Fog", "Orla Quay", "jazz", "sadness", 0.21, 0.12, 75.0),
        (2, "The Harbour Fog Returns (Remix)", "Orla Quay", "electronic", "joy", 0.88, 0.97, 62.0),
        (3, "Ça ira, Zoë", None, "chanson", "joy", 0.70, 0.60, 62.0),
        (4, "100% Copper_Wire", "Glass Heron", "rock", "anger", 0.93, 0.05, 51.0),
        (5, "Untitled", "Glass Heron", "rock", "joy", None, 0.80, 99.0),
    ]
    return spark.createDataFrame(
        rows, "pos bigint, song string, artist string, genre string, emotion string, energy double, valence double, popularity double"
    )
