"""Task progress: an append-only event stream with a sequence a task, latest state, staleness.

The batch functions define the meaning; the streaming ones keep it with Structured Streaming: a file
source, event-time watermarks, update mode into a table of batches or ``foreachBatch`` upserts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from grapnel.plans.views import table
from grapnel.registry import query
from grapnel.scratch import checkpoint_dir

STALE_SECONDS = 600
TERMINAL = ("purchase", "error")
#: Stage ranges of the overall percentage: begin and end.
STAGE_RANGE = {"view": (0.0, 25.0), "click": (25.0, 50.0), "search": (50.0, 75.0), "purchase": (75.0, 100.0), "error": (100.0, 100.0)}


# ---- operators -------------------------------------------------------------------------------------

def sequenced(events: DataFrame) -> DataFrame:
    """A running index a task, from 0: what was appended in which order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn("seq", F.row_number().over(w) - 1)


def since(events: DataFrame, index: int) -> DataFrame:
    """Events from an index on, a task."""
    return sequenced(events).where(F.col("seq") >= index)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each task: one aggregate with map-side maxima."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last"), F.count("*").alias("n_events")).select("user_id", "last.event_id", "last.event_type", F.col("last.ts").alias("ts"), "last.value", "n_events")


def is_done(stage: Column) -> Column:
    return stage.isin(*TERMINAL)


def stale(events: DataFrame, seconds: int = STALE_SECONDS) -> DataFrame:
    """Finished tasks whose last event is older than the timeout, measured from the newest event."""
    now = events.agg(F.max("ts").alias("now"))
    return latest(events).join(F.broadcast(now)).where(is_done(F.col("event_type")) & (F.col("ts") < F.col("now") - F.make_interval(secs=F.lit(seconds)))).drop("now")


def percentage(stage: Column, fraction: Column) -> Column:
    """Piecewise linear over the stages."""
    out = F.lit(0.0)
    for s, (a, b) in STAGE_RANGE.items():
        out = F.when(stage == s, a + (b - a) * F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))).otherwise(out)
    return out


def _stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files as they come.  The path is a glob, so one file and a folder of files both work."""
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _to_table(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Changed rows of each micro-batch into a folder of its own: a batch that is run again replaces its folder."""

    def write(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """What the stream says by now: the row of the latest batch for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return spark.read.parquet(target).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "batch")


def stream_latest(spark: SparkSession, path: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """The latest state of every task as a stream: keyed state, changed tasks go out."""
    return _to_table(latest(_stream(spark, path, schema)), target, checkpoint)


def stream_windows(spark: SparkSession, path: str, schema, target: str, checkpoint: str, delay: str = "1 hour", width: str = "1 day") -> StreamingQuery:
    """Counts by event-time window and stage; late rows within the watermark still count, older windows leave the state."""
    events = _stream(spark, path, schema).withWatermark("ts", delay)
    counts = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _to_table(counts.select(F.col("window.start").alias("start"), "event_type", "n", "total"), target, checkpoint)


def stream_upsert(spark: SparkSession, path: str, schema, sink, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's latest states go to ``sink(frame, batch_id)``; the checkpoint makes it resumable."""
    events = _stream(spark, path, schema)
    return latest(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_heartbeats(events: DataFrame, seconds: int = 15) -> DataFrame:
    """Events and, in every gap of a task, a beat each so many seconds: what a client that waits would see."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = events.withColumn("__next", F.lead("ts").over(w)).where(F.col("__next") > F.col("ts") + F.make_interval(secs=F.lit(seconds)))
    every = F.make_dt_interval(secs=F.lit(seconds))
    beats = gap.select("user_id", F.explode(F.sequence(F.col("ts") + every, F.col("__next"), every)).alias("ts"), "__next").where(F.col("ts") < F.col("__next"))
    return events.select("user_id", "ts", F.lit("event").alias("kind")).unionByName(beats.select("user_id", "ts", F.lit("heartbeat").alias("kind")))


def polled(events: DataFrame, every: float = 0.5, misses: int = 20) -> DataFrame:
    """When each event reaches a client that polls: the first tick at or after it, counted from the task's start.

    A client gives up after more than ``misses`` ticks without news, so later events of that task aren't
    sent: (user_id, event_id, tick, sent).
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    t = (micros - F.min(micros).over(whole)) / 1e6
    told = events.withColumn("tick", F.ceil(t / every).cast("long")).withColumn("gap", F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0)))
    gone = F.max((F.col("gap") > misses).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return told.select("user_id", "event_id", "tick", (gone == 0).alias("sent"))


def opened(tasks: DataFrame) -> DataFrame:
    """The first event of a new task."""
    return tasks.select("user_id", F.lit(0).cast("long").alias("seq"), F.lit("created").alias("event_type"), F.lit(0.0).alias("value"))


def removed(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Events without those of tasks that were cleaned up."""
    return events.join(tasks.select("user_id").distinct(), "user_id", "left_anti")


# ---- queries ---------------------------------------------------------------------------------------

@query("SELECT user_id, event_id, event_type, value, n AS n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn = 1")
def progress_latest(spark, sf):
    return latest(table(spark, sf, "events")).drop("ts")


@query("SELECT user_id, event_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) WHERE seq >= 3")
def progress_since(spark, sf):
    return since(table(spark, sf, "events"), 3).select("user_id", "event_id", "seq")


@query("SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS ts FROM events GROUP BY 1) WHERE stage IN ('purchase', 'error') AND ts < (SELECT max(ts) FROM events) - INTERVAL 600 SECOND")
def progress_stale(spark, sf):
    return stale(table(spark, sf, "events")).select("user_id")


@query("""SELECT event_id, round(CASE event_type WHEN 'view' THEN 25 * f WHEN 'click' THEN 25 + 25 * f WHEN 'search' THEN 50 + 25 * f WHEN 'purchase' THEN 75 + 25 * f WHEN 'error' THEN 100 ELSE 0 END, 4)::DOUBLE AS pct
 FROM (SELECT event_id, event_type, least(greatest(value / 100, 0), 1) AS f FROM events)""")
def progress_percent(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(percentage(F.col("event_type"), F.col("value") / 100), 4).alias("pct"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS n_keyed, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def audit_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("n_keyed"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("SELECT user_id, event_id, event_type, value, n AS n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn = 1")
def progress_latest_stream(spark, sf):
    """The same rows from a stream that reads the events' folder to its end."""
    target = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream_latest(spark, f"{sf}/events.parquet", spark.read.parquet(f"{sf}/events.parquet").schema, f"{target}/out", f"{target}/checkpoint")
    q.awaitTermination()
    return read_table(spark, f"{target}/out", ["user_id"]).drop("ts")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def progress_windows_stream(spark, sf):
    target = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream_windows(spark, f"{sf}/events.parquet", spark.read.parquet(f"{sf}/events.parquet").schema, f"{target}/out", f"{target}/checkpoint")
    q.awaitTermination()
    return read_table(spark, f"{target}/out", ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, event_id, tick::BIGINT AS tick, max(CASE WHEN gap > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 0 AS sent FROM (
  SELECT *, tick - coalesce(lag(tick) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS gap FROM (SELECT *, ceil((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 / 0.5) AS tick FROM events))""")
def progress_polled(spark, sf):
    return polled(table(spark, sf, "events"))


@query("""SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts >= p + INTERVAL 6 HOUR OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY ALL) GROUP BY 1""")
def progress_sessions(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))
