"""Queries that run a stream over a whole table, each with the SQL that it is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions import workers
from lyrebird.operators import steps
from lyrebird.plans.catalogue import query
from lyrebird.streaming import journal, stateful


def _folder(spark: SparkSession, name: str) -> str:
    return f"{steps.checkpoint_dir(spark)}/lyrebird/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream."""
    workers.ship(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream's folder may not be a file


def _finished(rows: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its source is used up."""
    spark = rows.sparkSession
    out = _folder(spark, name)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("""WITH r AS (SELECT user_id::VARCHAR AS path, event_id AS seq, floor(value / 8) AS version, CASE WHEN event_type = 'click' THEN 'found ' || event_id END AS known FROM events),
n AS (SELECT *, lag(version) OVER w AS before, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY path ORDER BY seq)),
i AS (SELECT *, sum(CASE WHEN n > 1 AND version = before THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY seq) AS run FROM n)
SELECT path, seq, CASE WHEN n = 1 THEN 'added' WHEN version = before THEN 'kept' ELSE 'replaced' END AS state, last_value(known IGNORE NULLS) OVER (PARTITION BY path, run ORDER BY seq) AS known FROM i""")
def rescan_stream(spark, d):
    found = F.when(F.col("event_type") == "click", F.concat(F.lit("found "), F.col("event_id").cast("string")))
    scans = _events(spark, d).select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 8).cast("double").alias("version"), F.col("event_type").alias("tags"), found.alias("known"))
    return _finished(stateful.rescanned(scans), "rescan").select("path", "seq", "state", "known")


@query("""WITH r AS (SELECT user_id::VARCHAR AS key, event_id AS seq, event_type = 'click' AS put, CASE WHEN value >= 10 THEN props END AS value, date_trunc('millisecond', ts) AS ts FROM events),
j AS (SELECT g.key, g.seq, g.ts, p.value, p.ts AS made, row_number() OVER (PARTITION BY g.key, g.seq ORDER BY p.ts DESC, p.seq DESC) AS n FROM (SELECT * FROM r WHERE NOT put) g LEFT JOIN (SELECT * FROM r WHERE put) p ON p.key = g.key AND (p.ts < g.ts OR (p.ts = g.ts AND p.seq < g.seq)))
SELECT key, seq, CASE WHEN made IS NULL THEN 'miss' WHEN ts - made > INTERVAL 2 HOUR THEN 'expired' WHEN value IS NULL THEN 'null' ELSE 'hit' END AS answer, CASE WHEN ts - made <= INTERVAL 2 HOUR THEN value END AS value FROM j WHERE n = 1""")
def cache_stream(spark, d):
    put = F.col("event_type") == "click"
    rows = _events(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(put, "put").otherwise("get").alias("op"), F.when(F.col("value") >= 10, F.col("props")).alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    return _finished(stateful.cached(rows, 2 * 3600, "3650 days"), "cache")


@query("SELECT event_id, user_id, event_type FROM events")
def journal_stream(spark, d):
    """The events through the journal, whose stream is run twice from two checkpoints: the second time adds nothing."""
    rows = _events(spark, d).select("event_id", "user_id", "event_type")
    path = _folder(spark, "journal")
    for state in (_folder(spark, "journal-state"), _folder(spark, "journal-state")):
        journal.write_stream(rows, path, state).awaitTermination()
    return journal.read(spark, path, rows.schema).drop("batch")
