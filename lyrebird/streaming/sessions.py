"""Streams: sessions of events with a watermark, and scans that are merged into a table batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Events of a key that are at most gap apart are one session; works on batches and on streams."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def merge_stream(stream: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], key: list[str], version: list[Column], checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch. write gets the merged table and the batch's number, so a repeated batch can be skipped."""
    from lyrebird.operators.ledger import latest

    def merge(batch: DataFrame, number: int) -> None:
        old = read()
        write(latest(batch if old is None else old.unionByName(batch), key, version), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(batch: DataFrame, path: str, key: list[str], version: list[Column], buckets: int = 256) -> None:
    """Upsert a batch into the table at path, one row a key, the highest version.

    The table is kept in buckets by a hash of the key, as partitions; only those that the batch touches are read and
    written again, and each is replaced as a whole. The same batch may be merged twice.
    """
    from lyrebird.operators.ledger import latest

    spark = batch.sparkSession
    new = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
    if not touched:
        return
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        new = old.unionByName(new)
    merged = latest(new, key, version).repartition(len(touched), "bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_stream_into(stream: DataFrame, path: str, key: list[str], version: list[Column], checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """merge_into() of each micro-batch of what is there now."""
    one = lambda batch, _: merge_into(batch, path, key, version, buckets)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
