"""Exact top-k by integer inner product, with MaxScore.

Components are the terms and rows the documents; a shard keeps a posting list a component (its column) with the
largest and the smallest value. For a query, a term's contribution lies between two bounds, so a row's score is a base
plus non-negative parts of at most the term's spread. Terms whose spreads together can't lift a row to the k-th best
score so far are non-essential: only essential lists are traversed, the others are probed for rows still competitive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.llm.shared import materialise, ship

SHARD_ROWS, QUERY_ROWS = 8192, 512
#: Terms that are probed at a time, and rows that set the first threshold.
PROBE, SEED = 6, 64
LONG = (-(2**63), 2**63 - 1)
#: Tasks of the join of shards and query blocks at most, and parts of the query blocks at most.
TASKS, QUERY_PARTS = 1024, 32


def to_integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a long (beyond a long: its nearest); null if a component can't be."""
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale))))


def top_k(queries: tuple[np.ndarray, np.ndarray], shard: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of each query's k best rows of the shard; (ids, matrix) each, ids ascending."""
    (query_ids, q_all), (ids, m) = queries, shard
    width = max(q_all.shape[1], m.shape[1])
    q_all, m = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q_all, m))
    most = max(1, width) * max(1, _largest(q_all)) * max(1, _largest(m))
    kind = np.float64 if 4 * most < 2**53 else np.int64 if 4 * most < 2**62 else object
    lists = [np.ascontiguousarray(m[:, d]).astype(kind) for d in range(width)]
    columns = np.array(lists) if width else np.zeros((0, len(ids)))
    high, low = (f(columns, axis=1) if len(ids) else None for f in (np.max, np.min))
    out = []
    for own, q in zip(query_ids.tolist(), q_all.astype(kind)):
        rows = np.flatnonzero(ids != own)
        if not len(rows):
            continue
        ends = np.array([q * high, q * low])
        floor, spread = ends.min(axis=0), np.ptp(ends, axis=0)
        terms = np.argsort(-spread.astype(np.float64), kind="stable")
        q, lists_of_q, base = q[terms], columns[terms], floor.sum() if width else 0
        rest = np.concatenate([np.cumsum(spread[terms][::-1])[::-1], np.zeros(1, kind)])  # what the terms from i on can add at most
        low_rest = np.concatenate([np.cumsum(floor[terms][::-1])[::-1], np.zeros(1, kind)])
        threshold = None
        if len(rows) > 4 * SEED and width:
            lead = lists_of_q[0][rows] * q[0]
            seed = rows[np.argpartition(-lead.astype(np.float64), SEED)[:SEED]]
            scores = q @ lists_of_q[:, seed]
            if len(seed) >= k:
                threshold = np.sort(scores)[-k]
        # Essential: the terms before the first from which on all spreads together stay below the threshold.
        essential = width if threshold is None else int(np.argmax(base + rest < threshold)) if (base + rest < threshold).any() else width
        partial = q[:essential] @ lists_of_q[:essential][:, rows] if essential else np.zeros(len(rows), kind)
        at = essential
        while True:
            if threshold is not None:
                stays = partial + low_rest[at] + rest[at] >= threshold
                if not stays.all():
                    rows, partial = rows[stays], partial[stays]
            if at == width:
                break
            upto = min(width, at + PROBE)
            partial = partial + q[at:upto] @ lists_of_q[at:upto][:, rows]
            at = upto
            if len(rows) > k:
                best = np.sort(partial)[-k] + low_rest[at]  # k rows reach at least this
                threshold = best if threshold is None else max(threshold, best)
        if len(rows) > 4 * k and kind is not object:
            edge = np.partition(partial, len(rows) - k)[len(rows) - k]
            rows, partial = rows[partial >= edge], partial[partial >= edge]
        best = sorted(zip((-int(x) for x in partial), ids[rows].tolist()))[:k]
        out += [(own, i, min(max(-x, LONG[0]), LONG[1])) for x, i in best]
    return out


def _largest(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0


def _smallest(m: np.ndarray) -> str:
    most = _largest(m)
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"


def _blocks(rows: DataFrame, n: int, rows_each: int) -> tuple[DataFrame, int]:
    """Rows (id, v) as packed blocks (block, ids, width, kind, data), and the number of blocks; data has the smallest
    integers (kind) that hold the block's values."""
    count = max(1, -(-n // rows_each))

    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy().astype("<i8")
        order = np.argsort(ids, kind="stable")
        lists = group.column("v").combine_chunks()
        size = np.diff(np.asarray(lists.offsets))
        m = np.zeros((len(ids), int(size.max(initial=0))), "<i8")
        m[np.arange(m.shape[1]) < size[:, None]] = np.asarray(lists.flatten())
        kind, fields = _smallest(m), [("block", pa.int32()), ("ids", pa.binary()), ("width", pa.int32()), ("kind", pa.string()), ("data", pa.binary())]
        return pa.table({"block": [group.column("block")[0].as_py()], "ids": [ids[order].tobytes()], "width": [m.shape[1]], "kind": [kind], "data": [m[order].astype(kind).tobytes()]}, schema=pa.schema(fields))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, width int, kind string, data binary"), count


def _grid(shards: int, blocks: int) -> tuple[int, int]:
    """Parts of the shards and of the query blocks, each of which meets each in a task."""
    across = min(blocks, QUERY_PARTS)
    return min(shards, max(1, TASKS // across)), across


def max_score_top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with other rows, ties to smaller vec_id.

    Vectors are floor(scale * x). Rows whose id is null, or whose vector is null or holds a null or non-finite
    component, take no part; a shorter vector counts as 0 beyond its end; scores beyond a long are its nearest. A query
    id that repeats asks once, with its smallest vector, and rows with the query's own id aren't its candidates; other
    repeated rows are candidates each. Fewer rows than k give all. Shards and query blocks are dealt over parts, of which
    each pair is a task that reads both: what is shuffled and the number of tasks don't grow with the pairs of blocks. Each
    pair keeps k rows a query, and the merge limits these again, task by task, before it shuffles them.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), to_integers(F.col(vector), scale).alias("v"), "__q")
    rows = materialise(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()), "vectors")
    asked = rows.where("__q").groupBy("id").agg(F.min("v").alias("v"))
    totals = rows.agg(F.count("*").alias("n"), F.count_if("__q").alias("q")).first()
    shards, n_shards = _blocks(rows.select("id", "v"), totals["n"], SHARD_ROWS)
    blocks, n_blocks = _blocks(asked, totals["q"], QUERY_ROWS)
    down, across = _grid(n_shards, n_blocks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                x = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                q, m = ((np.frombuffer(x[p + "ids"], "<i8"), np.frombuffer(x[p + "data"], x[p + "kind"]).astype("<i8").reshape(len(x[p + "ids"]) // 8, x[p + "width"])) for p in ("q_", ""))
                found = list(zip(*top_k(q, m, k))) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    shards = materialise(shards, "shards").repartitionByRange(down, "block").drop("block")
    asks = materialise(blocks, "queries").select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "width", "kind", "data"))).repartition(across)
    pairs = shards.hint("shuffle_replicate_nl").crossJoin(asks)
    found = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
