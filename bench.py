"""Headline timings: one JSON line.

Each query is run in full into a sink that discards rows. A warm-up on the
smallest tables starts the JVM's compiler and the Python workers; it is not
timed. ``rates_per_sec`` gives rows per second for the steps whose published
figures are throughputs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from songloom.plans import all_entries  # noqa: E402
from songloom.session import build_session, scratch_path  # noqa: E402
from songloom.sources.readers import Tables, read_json_lines  # noqa: E402

HEADLINE = [
    "knn_l2", "knn_cosine", "similar_songs", "label_profile_search", "mood_filter", "mood_topk", "song_search", "find_song",
    "autocomplete", "clean_text", "anti_join_unseen", "enrich_features", "impute_median", "split_90_5_5", "split_stratified",
    "zscore_samp", "correlation_matrix", "describe", "histogram", "group_profile", "classification_report", "mine_triplets",
    "playlist_track_count", "history_latest", "ttl_cache_totals", "encode_batch",
]
SCHEMA = "event_id bigint, user_id bigint, event_type string, value double"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 16),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    tables = Tables(spark, folder)
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in HEADLINE:
        run(entries[name].run(spark, small if os.path.isdir(small) else folder))

    seconds, rates = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(entries[name].run(spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)

    path = scratch_path(spark, "bench-events")
    tables.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    start = time.perf_counter()
    run(read_json_lines(spark, path, SCHEMA))
    seconds["load_jsonl"] = round(time.perf_counter() - start, 3)
    events, tracks, vectors = (getattr(tables, n).count() for n in ("events", "lineitem", "embeddings"))
    rates["load_jsonl_rows"] = round(events / seconds["load_jsonl"])
    rates["mood_filter_tracks"] = round(tracks / seconds["mood_filter"])
    rates["knn_query_vectors"] = round(vectors / seconds["knn_l2"])
    rates["encode_tracks"] = round(tracks / seconds["encode_batch"])

    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "rates_per_sec": rates}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
