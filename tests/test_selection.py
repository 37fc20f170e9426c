"""Selection by histograms gives what sorting gives."""

import random

import pytest
from pyspark.sql import functions as F

from lyrebird.operators import selection

INF, NAN = float("inf"), float("nan")


def groups():
    rng = random.Random(9)
    out = {k: [rng.gauss(0, 10 ** rng.randint(-3, 3)) for _ in range(n)] for k, n in enumerate((1, 2, 3, 100, 1001))}
    # Neighbouring doubles, ties, the ends of the range, and what isn't finite.
    out[10] = [1.0 + i * 2**-52 for i in range(300)]
    out[11] = [7.5] * 900 + [7.25] * 900
    out[12] = [5e-324, 1.7e308, -1.7e308, 0.0, -0.0, -5e-324, 1e-310]
    out[13] = [INF, -INF, 1.0, NAN, NAN, INF, INF]
    out[14] = [NAN, NAN]
    out[15] = [-INF, -INF, INF, INF]
    out[None] = [3.0, None, 1.0, 2.0]
    return out | {16: [None, None]}


@pytest.fixture(scope="module")
def rows(spark):
    every = [(k, v) for k, vs in groups().items() for v in vs]
    random.Random(4).shuffle(every)
    return spark.createDataFrame(every, "k int, v double").repartition(4)


def order(v):
    return (v != v, v if v == v else 0.0)


def test_every_rank_of_every_group(spark, rows):
    ranks = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("__total")), lambda r: F.struct(r.alias("name"), r.alias("rank")))
    few = rows.where("k IS NULL OR k NOT IN (4, 11)")
    got = {(r["k"], r["name"]): repr(r["value"] + 0.0) for r in selection.at_ranks(few, ["k"], F.col("v"), ranks).collect()}
    want = {}
    for k, vs in groups().items():
        if k not in (4, 11):
            for i, v in enumerate(sorted((v for v in vs if v is not None), key=order), 1):
                want[k, i] = repr(v + 0.0)
    assert got == want


def test_medians_and_deviations(spark, rows):
    fine = rows.where("k IS NULL OR k < 13")
    got = {r["k"]: (r["median"], r["mad"]) for r in selection.deviations(fine, ["k"], F.col("v")).collect()}
    m = fine.groupBy(F.col("k").alias("j")).agg(F.median("v").alias("m"))
    away = fine.join(m, F.col("k").eqNullSafe(F.col("j"))).select("k", "m", F.abs(F.col("v") - F.col("m")).alias("a"))
    want = {r["k"]: (r["m"], r["d"]) for r in away.groupBy("k").agg(F.first("m").alias("m"), F.median("a").alias("d")).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k


def test_ends_that_are_not_finite(spark, rows):
    got = {r["k"]: repr(r["median"]) for r in selection.medians(rows.where("k BETWEEN 13 AND 16"), ["k"], F.col("v")).collect()}
    assert got == {13: "inf", 14: "nan", 15: "nan"}


def test_one_hot_block(spark):
    """A million values of one group, a third of them equal: counts are what is shuffled."""
    v = F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise((F.xxhash64("id") % 1000003) / 1e6)
    hot = spark.range(1_000_000).select(F.lit("a").alias("k"), v.alias("v"))
    got = selection.medians(hot, ["k"], F.col("v")).first()["median"]
    assert got == hot.agg(F.median("v")).first()[0]


def test_no_rows(spark, rows):
    assert selection.deviations(rows.where("k > 99"), ["k"], F.col("v")).isEmpty()
