"""Streams over the event table; each run handles all files present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.plans import accounts
from songloom.plans.registry import query
from songloom.plans.scalars import LABEL_WORDS
from songloom.sources.readers import Tables
from songloom.streaming import jobs


class StreamTables(Tables):
    """The same tables with ``events`` as a stream."""

    @property
    def events(self) -> DataFrame:
        schema = Tables(self.spark, self.folder).__getattr__("events").schema
        return jobs.table_stream(self.spark, self.folder, "events", schema)


def stream_tables(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


@query("""SELECT event_id AS id, user_id, 'model1' AS model_used, CAST(floor(value) AS BIGINT) AS results_count
FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def stream_history(t: Tables) -> DataFrame:
    rows = accounts.history(stream_tables(t)).withColumn("model_used", F.lit(None).cast("string"))
    kept = jobs.history_stream(rows, t.customer.filter("c_acctbal > 0"), "c_custkey")
    return jobs.run_to_table(kept.select("id", "user_id", "model_used", "results_count"), jobs.stream_path(t.spark, "history"))


@query(f"""WITH w AS (SELECT event_id, lower({LABEL_WORDS}[event_id % 6 + 1]) AS label, CASE WHEN event_type IN ('view', 'click') THEN 'context' ELSE 'mood' END AS kind FROM events)
SELECT event_id, kind, CASE WHEN kind = 'context' THEN CASE label WHEN 'party' THEN 'energetic' WHEN 'workout' THEN 'energetic' WHEN 'study' THEN 'calm' WHEN 'relax' THEN 'calm' ELSE 'happy' END
 WHEN label IN ('happy','sad','energetic','calm','angry') THEN label ELSE 'happy' END AS mood FROM w""")
def stream_requests(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in LABEL_WORDS])
    asked = stream_tables(t).events.select(
        "event_id", F.element_at(words, (F.col("event_id") % 6 + 1).cast("int")).alias("label"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("context")).otherwise(F.lit("mood")).alias("kind"),
    )
    return jobs.run_to_table(jobs.request_stream(asked).select("event_id", "kind", "mood"), jobs.stream_path(t.spark, "requests"))


ARRIVALS = 5


def arriving(t: Tables, parts: int = ARRIVALS) -> tuple[str, DataFrame]:
    """A folder into which the events came in several files, a fifth of them a file too late; and the events as a stream from there."""
    folder = jobs.stream_path(t.spark, "arrivals")
    bounds = t.events.agg(F.min("ts").cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi")).first()
    days = max(1, -(-(bounds["hi"] - bounds["lo"]).days // parts)) if bounds["lo"] else 1
    part = F.floor(F.datediff(F.col("ts"), F.lit(bounds["lo"])) / days) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    events = t.events.withColumn("part", part)
    for i in range(parts + 2):
        events.filter(F.col("part") == i).drop("part").write.mode("append").parquet(folder)
    # a batch takes three arrivals; each has as many files as the table has splits
    files = 3 * max(1, t.events.rdd.getNumPartitions())
    return folder, t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files).parquet(folder)


class Arrivals(StreamTables):
    """The same tables with ``events`` as they arrive in a folder."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, t.folder)
        self.arrivals, self._events = arriving(t)

    @property
    def events(self) -> DataFrame:
        return self._events


@query(accounts.REPLAY + "SELECT key, id, is_hit FROM walk")
def stream_cache(t: Tables) -> DataFrame:
    """The cache over lookups that come late and in several batches: the outcomes of the batch form."""
    arrivals = Arrivals(t)
    asked = accounts.lookups(arrivals).withColumn("key", F.when(F.col("id") >= 0, F.col("key")))
    hits, path = jobs.cache_stream(asked, "20 days"), jobs.stream_path(t.spark, "cache")
    jobs.run_to_table(hits, path, jobs.TIMERS_STORE)
    # the source is closed by an event far ahead, whose id stands for none
    last = t.events.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 100 days"), "event_id": F.lit(-1).cast("bigint")})
    last.select(*t.events.columns).write.mode("append").parquet(arrivals.arrivals)
    return jobs.run_to_table(hits, path, jobs.TIMERS_STORE)
