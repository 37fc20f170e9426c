"""Exact order statistics of groups of any size by histograms: no task sorts or holds a group.

A first histogram is by sign and logarithm, at most about 68,000 buckets a group; each rank that is asked for lies in one of
them, between its least and greatest value. The next histograms split such an interval evenly into 65,536, until its ends are
one value: three at most, as a first bucket is 4 % wide. Counts are combined before they are shuffled; values meet their
group's interval by a join whose interval side is a written table of at most two rows a group, broadcast by Spark if it
is small and dealt over PARTS with the values if not. From the third histogram on, only the values still inside are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.operators import steps

#: Parts that a group's values are dealt over where intervals are too many to be broadcast; buckets of an interval.
PARTS, BUCKETS = 8, 65536


def _coarse(v: Column) -> Column:
    """Buckets in the order of values: by sign and sixteenths of a doubling; infinite values and NaN (the greatest) apart."""
    size = (F.floor(F.log2(F.abs(v)) * 16) + 20000).cast("bigint")
    fixed = lambda n: F.lit(n).cast("bigint")
    return F.when(F.isnan(v), fixed(90000)).when(v == float("inf"), fixed(80000)).when(v == float("-inf"), fixed(-80000)).when(v == 0, fixed(0)).when(v > 0, size).otherwise(-size)


def _hit(histogram: DataFrame, key: list[str], ranks: Column) -> DataFrame:
    """The buckets that hold a rank: key, the ends lo and hi, and an array of (name, rank inside)."""
    ordered = Window.partitionBy(*key).orderBy("bucket")
    upto = histogram.withColumns({"__upto": F.sum("n").over(ordered), "__total": F.sum("n").over(Window.partitionBy(*key))})
    before = F.col("__upto") - F.col("n")
    mine = F.filter(ranks, lambda r: (r["rank"] > before) & (r["rank"] <= F.col("__upto")))
    left = F.transform(mine, lambda r: F.struct(r["name"].alias("name"), (r["rank"] - before).alias("rank")))
    return upto.select(*key, "lo", "hi", left.alias("ranks")).where(F.size("ranks") > 0)


def _met(values: DataFrame, key: list[str], side: DataFrame, on: Column) -> DataFrame:
    """__v of each group with the columns of its rows of the side table; null keys are equal."""
    part = F.explode(F.array(*(F.lit(i) for i in range(PARTS)))).alias("__part")
    theirs = side.select(*(F.col(c).alias(f"__k_{c}") for c in key), *(c for c in side.columns if c not in key), part)
    on = on & (F.pmod(F.xxhash64("__v"), F.lit(PARTS)).cast("int") == F.col("__part"))
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return values.join(theirs, on).drop("__part", *(f"__k_{c}" for c in key))


def _values(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    return rows.select(*key, (value.cast("double") + F.lit(0.0)).alias("__v")).where("__v IS NOT NULL")


def at_ranks(rows: DataFrame, key: list[str], value: Column, ranks: Column) -> DataFrame:
    """key, name and value of each rank of each group.

    ranks: an array of struct(name, rank from 1), which may read `__total`, a group's number of values; ranks that a group
    doesn't have give nothing. Null values don't count; NaN is the greatest, -0.0 is 0.0. Groups without a value have no row.
    """
    v = _values(rows, key, value)
    ends = [F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")]
    asked = steps.stored(_hit(v.groupBy(*key, _coarse(F.col("__v")).alias("bucket")).agg(*ends), key, ranks), "ranks")
    found, level = asked.where("lo = hi"), 1
    while not (wide := asked.where("lo <> hi")).isEmpty():
        level += 1
        inside = _met(v.select(*key, "__v"), key, wide, F.col("__v").between(F.col("lo"), F.col("hi")))
        if level == 3:
            v = inside = steps.stored(inside, "narrowed")
        share = F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (BUCKETS - 1)).cast("bigint")
        split = inside.select(*key, F.col("lo").alias("__lo"), "ranks", "__v", share.alias("bucket"))
        histogram = split.groupBy(*key, "__lo", "bucket").agg(*ends, F.first("ranks").alias("ranks"))
        asked = steps.stored(_hit(histogram, [*key, "__lo"], F.col("ranks")).drop("__lo"), "ranks")
        found = found.unionByName(asked.where("lo = hi"))
    return found.select(*key, F.explode("ranks").alias("r"), F.col("lo").alias("value")).select(*key, "r.name", "value")


def medians(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """key and median of each group with a value: the middle one, or the mean of the middle two."""
    rank = lambda name, n: F.struct(F.lit(name).alias("name"), F.floor(n).cast("bigint").alias("rank"))
    both = at_ranks(rows, key, value, F.array(rank("lower", (F.col("__total") + 1) / 2), rank("upper", F.col("__total") / 2 + 1)))
    low, high = F.min("value"), F.max("value")
    return both.groupBy(*key).agg(F.when(low == high, low).otherwise(low + (high - low) / 2).alias("median"))


def deviations(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """key, median and mad (the median distance from it) of each group with a value."""
    middle = steps.stored(medians(rows, key, value), "medians")
    away = _met(_values(rows, key, value), key, middle, F.lit(True)).select(*key, F.abs(F.col("__v") - F.col("median")).alias("away"))
    spread = medians(away, key, F.col("away")).withColumnRenamed("median", "mad")
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return middle.join(spread.select(*(F.col(c).alias(f"__k_{c}") for c in key), "mad"), on).drop(*(f"__k_{c}" for c in key))
