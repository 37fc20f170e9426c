"""Numbers of rows in one order over a whole table, and pages anywhere in it, without a task that sees all rows.

Rows are range-partitioned by the order and sorted within their range; a row's number is its place in the range plus the
rows of the ranges before. Ranges are written once, so numbers don't change if a task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.operators import steps

#: Bits of monotonically_increasing_id() that count within a task.
_PLACE = (1 << 33) - 1


def laid_out(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """rows as a table, with __range and __at (from 0) of each.

    Give an order that tells all rows apart: rows equal in it share a range, and a task sorts them. Columns that the result
    adds must not be in rows. parts: the ranges at most; spark.sql.shuffle.partitions if None.
    """
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    return steps.stored(ranged.sortWithinPartitions(*order).withColumns({"__range": F.spark_partition_id(), "__at": at}), "ranges")


def _ranges(table: DataFrame) -> list[tuple[int, int, int]]:
    """Each range, the rows before it and its own: as many as the tasks that wrote the table, so they may be collected."""
    out, before = [], 0
    for r in table.groupBy("__range").count().sort("__range").collect():
        out.append((r["__range"], before, r["count"]))
        before += r["count"]
    return out


def _added(table: DataFrame, ranges: list[tuple[int, int, int]], name: str) -> DataFrame:
    before = table.sparkSession.createDataFrame(ranges, "__range int, __before bigint, __n bigint")
    out = table.join(before.drop("__n"), "__range")
    return out.withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__before", "__at")


def numbered(rows: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """rows with their number from 1 in the order, as a column of longs."""
    table = laid_out(rows, order, parts)
    return _added(table, _ranges(table), name)


def page(table: DataFrame, offset: int, size: int, name: str) -> DataFrame:
    """The rows numbered offset + 1 to offset + size of what laid_out() gave, with their numbers. Other ranges' files are
    skipped by their statistics; a page beyond the end is empty."""
    met = [r for r in _ranges(table) if r[1] < offset + size and r[1] + r[2] > offset]
    out = _added(table.where(F.col("__range").isin([r[0] for r in met])), met, name)
    return out.where((F.col(name) > offset) & (F.col(name) <= offset + size))
