"""Queries on recordings and whole orders against their SQL; numbers against a sort."""

import random

import pytest
from against import same
from pyspark.sql import functions as F

from lyrebird.operators import numbers
from lyrebird.plans import catalogue, recordings, resolution  # noqa: F401  they register their queries

NAMES = ("recording_levels", "recording_runs", "recording_silence", "recording_clicks", "document_order", "deep_page", "version_order", "block_mad")


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.SQL[name], "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(i, rng.choice([None, "a", "a", "b", f"{i}"])) for i in range(3000)], "id int, x string").repartition(7)


order = lambda: [F.col("x").asc_nulls_last(), F.col("id").desc()]


def sorted_rows(rows):
    return sorted(((r["id"], r["x"]) for r in rows.collect()), key=lambda r: (r[1] is None, r[1] or "", -r[0]))


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_numbers(rows, parts):
    got = numbers.numbered(rows, order(), "n", parts).sort("n").collect()
    assert [r["n"] for r in got] == list(range(1, 3001))
    assert [(r["id"], r["x"]) for r in got] == sorted_rows(rows)


def test_pages(rows):
    table, want = numbers.laid_out(rows, order(), 9), sorted_rows(rows)
    for offset, size in ((0, 10), (333, 500), (2990, 50), (2999, 1), (3000, 5), (0, 0), (0, 4000)):
        got = numbers.page(table, offset, size, "n").sort("n").collect()
        assert [(r["id"], r["x"]) for r in got] == want[offset : offset + size]


def test_a_page_reads_its_ranges_only(rows):
    plan = numbers.page(numbers.laid_out(rows, order(), 9), 100, 10, "n")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(__range)" in plan or "In(__range" in plan or "EqualTo(__range" in plan
    assert "Window" not in plan


def test_no_rows_and_equal_rows(spark, rows):
    assert numbers.numbered(rows.where("id < 0"), order(), "n").isEmpty()
    equal = spark.range(1000).select(F.lit(1).alias("x"))
    assert sorted(r["n"] for r in numbers.numbered(equal, [F.col("x")], "n").collect()) == list(range(1, 1001))
