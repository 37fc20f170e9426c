"""Token ids in ORC: sorted by document id, run-length encoded, with row indexes and Bloom filters on the ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.llm.shared import ship
from lyrebird.llm.tokens import crc32s, encoder, small_batches, with_end

ORC = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, then end_id, to ORC files under path, in ascending order of doc_id.

    Rows: doc_id, part (the file's place in the order), start (ids before the row in its part), n_tokens, ids. Texts
    are range-partitioned before they are encoded, so ids aren't shuffled, and each task streams its part. A null text
    is empty and holds the end id alone; null ids come first; rows of one id are ordered by text. Other columns of docs
    are not read.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "text"):
            ids, bounds = with_end(*enc.encode([x or "" for x in batch.column("text").to_pylist()]), end_id)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))),
            ], ["doc_id", "part", "start", "n_tokens", "ids"])
            start += int(bounds[-1])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows.mapInArrow(encode, f"doc_id {kind}, part int, start long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole set), n_tokens, ids. Filters on doc_id reach the files' indexes.

    The parts' totals come from the files; there is one a file, so the table of them is small enough to broadcast.
    """
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("__base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("__base")).alias("start"), "n_tokens", "ids")


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, taken from the ids as they were read."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets).astype(np.int64)
            crc = crc32s(np.asarray(lists.values).view(np.uint32), bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
