"""An append-only journal as a sink that takes each micro-batch exactly once.

A batch's entries are written to a folder of their own, and only then its mark, by a rename: readers take the batches that
have one. A batch that is written again finds its mark and adds nothing; one that broke off has none, so it isn't seen, and
when it comes again its folder is replaced. Failures are entries too: marks that a later batch sets on earlier entries.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _mark(path: str, batch: int) -> str:
    return f"{path}/_marks/{batch}.json"


def is_committed(spark: SparkSession, path: str, batch: int) -> bool:
    return _fs(spark, path).exists(_path(spark, _mark(path, batch)))


def append(entries: DataFrame, path: str, batch: int, before_mark=None) -> bool:
    """Append a batch once; whether it was new. before_mark is called between the write and the mark (tests break off there)."""
    spark = entries.sparkSession
    if is_committed(spark, path, batch):
        return False
    entries.write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")
    if before_mark:
        before_mark()
    fs = _fs(spark, path)
    half = _path(spark, f"{path}/_marks/.{uuid.uuid4().hex}")
    out = fs.create(half)
    out.write(bytearray(json.dumps({"batch": batch}).encode()))
    out.close()
    # A rename onto a mark that another writer has set meanwhile does nothing, and the batch counts once all the same.
    if not fs.rename(half, _path(spark, _mark(path, batch))):
        fs.delete(half, False)
        return False
    return True


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Entries of the committed batches, with their batch; none if there is no journal yet."""
    fields = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    if not _fs(spark, path).exists(_path(spark, f"{path}/_marks")):
        return spark.createDataFrame([], fields).withColumn("batch", F.lit(0).cast("long"))
    marks = spark.read.schema("batch long").json(f"{path}/_marks")  # dot files, which are half marks, are not read
    rows = spark.read.schema(fields).option("basePath", f"{path}/batches").parquet(f"{path}/batches")
    return rows.withColumn("batch", F.col("batch").cast("long")).join(marks, "batch", "left_semi")


def write_stream(stream: DataFrame, path: str, checkpoint: str, before_mark=None) -> StreamingQuery:
    """append() each micro-batch of what is there now under its number; a restart repeats the one that broke off."""
    one = lambda batch, number: append(batch, path, number, before_mark)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clear(spark: SparkSession, path: str, schema: StructType | str) -> None:
    """Replace the table at path by an empty one with the same schema."""
    fields = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    spark.createDataFrame([], fields).write.mode("overwrite").parquet(path)
