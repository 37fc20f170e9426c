"""Greedy matching in rounds against greedy matching in one task."""

import random

from pyspark.sql import functions as F

from lyrebird.operators import resolve


def brute(pairs):
    left, right, out = set(), set(), set()
    for g, a, b, s in sorted((p for p in pairs if p[3] is not None), key=lambda p: (-p[3], p[1], p[2])):
        if (g, a) not in left and (g, b) not in right:
            left.add((g, a))
            right.add((g, b))
            out.add((g, a, b, s))
    return out


FIELDS = "g int, a int, b int, s double"


def test_rounds_equal_greedy(spark):
    rng = random.Random(5)
    pairs = list({(g, a, b): (g, a, b, rng.choice([None, 0.5, 1.0, rng.random()])) for g in range(4) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(60 if g else 6))}.values())
    df = spark.createDataFrame(pairs, FIELDS)
    for small in (0, 10, 1000):
        assert {tuple(r) for r in resolve.seats(df, ["g"], "a", "b", "s", small).collect()} == brute(pairs)


def test_a_chain_takes_one_pair_a_round_until_it_is_small(spark):
    pairs = [(0, i // 2 + i % 2, i // 2, float(i)) for i in range(24)]
    assert {tuple(r) for r in resolve.seats(spark.createDataFrame(pairs, FIELDS), ["g"], "a", "b", "s", 12).collect()} == brute(pairs)


def test_one_large_group(spark):
    df = spark.range(300_000).select(F.lit(0).alias("g"), F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("int").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(20_000)).cast("int").alias("b"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000).alias("s"))
    df = df.dropDuplicates(["a", "b"])
    pairs = [tuple(r) for r in df.collect()]
    assert {tuple(r) for r in resolve.seats(df, ["g"], "a", "b", "s", 20_000).collect()} == brute(pairs)
