"""Measures of signals in chunks are those of the whole array, however it is cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.operators import chunks, signal


def cut(x, rng, size):
    """Pieces of size samples, or of random sizes, empty ones included."""
    out, i = [], 0
    while i < len(x):
        n = size or rng.choice([0, 1, 2, 3, 17, 50, 400])
        out.append(x[i : i + n])
        i += n
    return out


def songs():
    rng = np.random.default_rng(5)
    out = {}
    for k in range(6):
        x = rng.normal(0, 0.02, 300 + 211 * k) * (rng.random(300 + 211 * k) < 0.6)
        x[: 40 * k] = 0
        x[-25 * k - 1 :] = 0
        for at in rng.integers(60, len(x) - 5, 4 + k):
            x[at] += 0.9
        x[100 : 100 + 13 * k] = 1.0
        out[k] = x.tolist()
    return out | {10: [1.0] * 500, 11: [0.0] * 129, 12: [0.5, -0.5, 0.5], 13: [1.0], None: [0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.2, 0.9, -0.9, 0.9]}


@pytest.fixture(scope="module", params=[1, 2, 7, 64, 1000, None])
def both(spark, request):
    rng = random.Random(3)
    whole = songs()
    rows = [(k, 5 * i - 40, p) for k, x in whole.items() for i, p in enumerate(cut(x, rng, request.param))]
    rng.shuffle(rows)
    a = spark.createDataFrame(list(whole.items()), "k int, s array<double>")
    return a, spark.createDataFrame(rows, "k int, at int, s array<double>").repartition(3)


def by_key(df):
    return {r["k"]: tuple(round(x, 9) if isinstance(x, float) else x for x in r[1:]) for r in df.collect()}


def test_levels(both):
    a, c = both
    want = by_key(signal.levels(a, "s").select("k", F.size("s").cast("bigint"), "peak", "rms", "dc", "crest_db"))
    assert by_key(chunks.levels(c, ["k"], "s").select("k", "n", "peak", "rms", "dc", "crest_db")) == want


def test_runs(both):
    a, c = both
    mark = F.transform("s", lambda x: F.abs(x) >= signal.CLIP)
    r = a.select("k", signal.run_lengths(mark).alias("r"))
    n = F.coalesce(F.aggregate("r", F.lit(0), lambda x, y: x + y), F.lit(0))
    want = by_key(r.select("k", n, F.size(F.filter("r", lambda x: x >= 4)), F.coalesce(F.array_max("r"), F.lit(0))))
    assert by_key(chunks.runs(c, ["k"], "at", mark).select("k", "marked", "long_runs", "longest")) == want


def test_silence(both):
    a, c = both
    want = by_key(a.where(F.size("s") >= 20).select("k", signal.silence(signal.frames(F.col("s"), 20)).alias("x")).select("k", "x.*"))
    assert by_key(chunks.silence(chunks.frames(chunks.placed(c, ["k"], "at", "s"), ["k"], "s", 20), ["k"])) == want


@pytest.mark.parametrize("rate", [200.0, 900.0, 40000.0])
def test_local_clicks(both, rate):
    a, c = both
    want = by_key(a.select("k", signal.local_clicks(F.col("s"), F.lit(rate)).alias("x")).select("k", "x.spikes", "x.events"))
    assert rate > 1000 or any(n > m > 0 for n, m in want.values())
    assert by_key(chunks.local_clicks(chunks.placed(c, ["k"], "at", "s"), ["k"], "at", "s", rate)) == want


def test_more_chunks_than_a_tree_node(spark):
    """Three levels of the tree, and spans that are summed apart."""
    n = 9000
    c = spark.range(n).select(F.lit(1).alias("k"), "id", F.array(F.when(F.col("id") % 100 < 60, 1.0).otherwise(0.0)).alias("s"))
    got = chunks.runs(c, ["k"], "id", F.transform("s", lambda x: x > 0.5)).first()
    assert (got["marked"], got["long_runs"], got["longest"]) == (5400, 90, 60)
    assert chunks.placed(c, ["k"], "id", "s").where("start <> id OR total <> 9000").isEmpty()


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, 0, []), (3, 0, [0.5])], "k int, at int, s array<double>")
    none = rows.where("k > 9")
    mark = F.transform("s", lambda x: x > 0.1)
    assert by_key(chunks.runs(rows, ["k"], "at", mark)) == {1: (0, 0, 0), 2: (0, 0, 0), 3: (1, 0, 1)}
    assert by_key(chunks.levels(rows, ["k"], "s").select("k", "n", "peak")) == {1: (0, None), 2: (0, None), 3: (1, 0.5)}
    placed = chunks.placed(rows, ["k"], "at", "s")
    assert by_key(chunks.local_clicks(placed, ["k"], "at", "s", 100.0)) == {1: (0, 0), 2: (0, 0), 3: (0, 0)}
    assert chunks.runs(none, ["k"], "at", mark).isEmpty() and chunks.levels(none, ["k"], "s").isEmpty()
    assert chunks.silence(chunks.frames(placed, ["k"], "s", 2), ["k"]).isEmpty()
