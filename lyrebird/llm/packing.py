"""Best-two-fit packing of documents into sequences of a fixed size.

A document's place follows from its length alone, so the packing is made over the counts of each length (at most
max_len of them, whatever the corpus), as patterns with a number of repeats. Documents then take the places of their
length in the order of a distributed rank. Nothing else reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.llm.shared import materialise, ship
from lyrebird.llm.tokens import crc32s, encoder, small_batches, with_end

#: Pieces of a length that are ranked together, about; a length with more of them is dealt, into parts of at least this
#: and at most as many as their square root, so that neither a part nor the table of parts outgrows a task.
RANKED_TOGETHER = 1000


def best_two_fit(counts: dict[int, int], max_len: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) with the times that each is used; together they use up counts.

    A bin is filled greedily, each time with the longest length that fits its gap. Then its shortest length gives way
    to the two unpacked ones that together fill its place and the gap best, if they fill more than it did.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        bin_, used = [lengths[-1]], Counter([lengths[-1]])
        gap = max_len - lengths[-1]

        def longest(most: int, taken: Counter) -> int:
            i = bisect_right(lengths, most) - 1
            while i >= 0 and taken[lengths[i]] >= left[lengths[i]]:
                i -= 1
            return lengths[i] if i >= 0 else 0

        while gap and (x := longest(gap, used)):
            fit = min(gap // x, left[x] - used[x])
            bin_ += [x] * fit
            used[x] += fit
            gap -= x * fit
        if gap:
            small = bin_[-1]
            room, best = gap + small, (small, 0, 0)
            for a in reversed(lengths[: bisect_right(lengths, room)]):
                if 2 * a < best[0] or best[0] == room:
                    break
                if used[a] >= left[a]:
                    continue
                used[a] += 1
                b = longest(min(room - a, a), used)
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
            if best[1] and len(bin_) > 1:
                bin_[-1:] = best[1:]
                used[small] -= 1
                used[best[1]] += 1
                used[best[2]] += 1
        used = Counter(bin_)
        times = min(left[x] // n for x, n in used.items())
        out.append((sorted(bin_, reverse=True), times))
        for x, n in used.items():
            left[x] -= n * times
        lengths = [x for x in lengths if left[x]]
    return out


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces; only the last is under max_len."""
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in small_batches(batches, "text"):
            ids, bounds = with_end(*enc.encode([x or "" for x in batch.column("text").to_pylist()]), end_id)
            size = np.diff(bounds)
            pieces = -(-size // max_len)
            row = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * max_len
            length = np.minimum(max_len, size[row] - start)
            at = np.concatenate([bounds[row] + start, bounds[-1:]])
            columns = {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc32s(ids, at), pa.int64())}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, max_len: int) -> DataFrame:
    """Every row of pieces (doc_id, piece, length of 1 to max_len, ...), with its sequence_id and its offset in it.

    pieces is read twice: pass a written table. Sequences are gapless from 0 and no longer than max_len. Rows that
    repeat are packed each; among equal lengths, doc_id, piece and start decide the order. An empty table gives none.
    """
    ship(pieces.sparkSession)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    deals = [-(-n // max(RANKED_TOGETHER, isqrt(n))) for n in (counts.get(x, 0) for x in range(max_len + 1))]
    deal = F.get(F.split(F.lit(",".join(map(str, deals))), ",").cast("array<int>"), F.col("length").cast("int"))
    dealt = pieces.withColumn("__deal", F.pmod(F.xxhash64("doc_id", "piece"), deal))
    own = Window.partitionBy("length", "__deal").orderBy("doc_id", "piece", "start")
    ranked = dealt.withColumn("__rank", F.row_number().over(own) - 1)
    sizes = dealt.groupBy("length", "__deal").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__deal", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = ranked.join(bases, ["length", "__deal"]).withColumn("__rank", F.col("__rank") + F.col("__base")).drop("__deal", "__base")

    plan, sequence, taken = {}, 0, Counter()
    for lengths, times in best_two_fit(counts, max_len):
        offsets = np.cumsum([0, *lengths])
        for x, n in Counter(lengths).items():
            first = lengths.index(x)
            plan.setdefault(x, []).append((taken[x], n, sequence, int(offsets[first])))
            taken[x] += n * times
        sequence += times
    plan = {x: np.array(rows, np.int64) for x, rows in plan.items()}  # rows: first rank, places a bin, first bin, first offset

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "__rank"))
            bin_, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(length):
                on = length == x
                rows = plan[int(x)]
                first, places, begin, at = rows[np.searchsorted(rows[:, 0], rank[on], "right") - 1].T
                k = rank[on] - first
                bin_[on], offset[on] = begin + k // places, at + (k % places) * x
            keep = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bin_), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut every whole text (null: empty) into pieces of at most max_len ids, the last being end_id, and pack these."""
    return pack(materialise(token_pieces(docs, tokenizer, max_len, end_id, doc_id, text, with_ids), "pieces"), max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from pieces that were packed with their ids. A sequence has max_len ids at most."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))
