"""Measures of signals longer than a row: a recording is many rows, each of them a chunk of its samples.

Chunks may be of any sizes, empty ones included; `at` is a chunk's place in its recording (distinct whole numbers, gaps
allowed). Every measure is a summary of a chunk that can be merged with that of the next one, so no task sees a whole
recording: sums are combined before the shuffle, and summaries that depend on order are merged in a tree of FAN at a time.
Results equal those of signal.py on the whole array, however it is cut. Null arrays are empty; keys may be null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.operators import signal, steps

#: Summaries that a task merges at a time; chunks (frames) that a task numbers (puts in a row) at a time.
FAN, SPAN = 64, 4096
_RUNS = "struct<n:bigint,left:bigint,right:bigint,inner:bigint,long:bigint,marked:bigint>"
_CLICKS = "struct<spikes:bigint,first:bigint,last:bigint,events:bigint>"


def _zero(kind: str, names: list[str]) -> Column:
    return F.struct(*(F.lit(0).cast("bigint").alias(c) for c in names)).cast(kind)


def _same(df: DataFrame, key: list[str], other: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """A join by key in which nulls are equal; the other side's keys go."""
    names = [*key, *more]
    theirs = other.select(*(F.col(c).alias(f"__{c}") for c in names), *(c for c in other.columns if c not in names))
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(theirs, on, how).drop(*(f"__{c}" for c in names))


def folded(rows: DataFrame, key: list[str], at: str, summary: str, zero: Column, merge) -> DataFrame:
    """key and summary: all of a key's summaries, merged in the order of `at`, FAN at a time in as many rounds as that takes.

    Summaries are written once: the range of their places, which says how many rounds there are, is asked of the table.
    """
    rows = steps.stored(rows.select(*key, at, summary), "summaries")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = 0 if low is None else high - low
    out = rows.withColumn("__at", F.col(at) - F.lit(low or 0)).select(*key, "__at", F.col(summary).alias("__s"))
    while True:
        group = F.floor(F.col("__at") / FAN).cast("bigint")
        parts = F.transform(F.sort_array(F.collect_list(F.struct("__at", "__s"))), lambda x: x["__s"])
        out = out.groupBy(*key, group.alias("__up")).agg(F.aggregate(parts, zero, merge).alias("__s")).withColumnRenamed("__up", "__at")
        width //= FAN
        if width == 0:
            return out.select(*key, F.col("__s").alias(summary))


def placed(chunks: DataFrame, key: list[str], at: str, samples: str) -> DataFrame:
    """chunks with start (samples before it in its recording) and total (samples of the recording).

    Sizes are summed over spans of SPAN places, spans over recordings; so a window's rows are few, and samples stay out of it.
    """
    sizes = chunks.select(*key, at, F.coalesce(F.array_size(samples), F.lit(0)).cast("bigint").alias("__n")).withColumn("__span", F.floor(F.col(at) / SPAN))
    spans = sizes.groupBy(*key, "__span").agg(F.sum("__n").alias("__m"))
    of = Window.partitionBy(*key)
    spans = spans.select(*key, "__span", (F.sum("__m").over(of.orderBy("__span")) - F.col("__m")).alias("__base"), F.sum("__m").over(of).alias("total"))
    inside = F.sum("__n").over(Window.partitionBy(*key, "__span").orderBy(at)) - F.col("__n")
    starts = _same(sizes.withColumn("__in", inside), key, spans, "__span").select(*key, at, (F.col("__base") + F.col("__in")).alias("start"), "total")
    return _same(chunks, key, starts, at)


def levels(chunks: DataFrame, key: list[str], samples: str) -> DataFrame:
    """n, peak, rms, dc and crest_db of each recording; all but n null without a sample."""
    s = F.coalesce(samples, F.array().cast("array<double>"))
    total = lambda f: F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))
    one = chunks.select(*key, F.size(s).cast("bigint").alias("n"), F.array_max(F.transform(s, F.abs)).alias("peak"), total(lambda x: x * x).alias("squares"), total(lambda x: x).alias("sum"))
    sums = one.groupBy(*key).agg(F.sum("n").alias("n"), F.max("peak").alias("peak"), F.sum("squares").alias("squares"), F.sum("sum").alias("sum"))
    some = F.nullif("n", F.lit(0))
    out = sums.withColumns({"rms": F.sqrt(F.col("squares") / some), "dc": F.col("sum") / some}).drop("squares", "sum")
    return out.withColumn("crest_db", signal.decibels(F.col("peak")) - signal.decibels(F.col("rms")))


def run_summary(marked: Column, long_run: int) -> Column:
    """What an array of booleans says of runs: the one open to the left and to the right (both are all of it where all are
    marked), the longest that touches neither end, how many of those have long_run or more, and how many are marked."""
    zero = _zero("struct<n:bigint,run:bigint,left:bigint,inner:bigint,long:bigint,marked:bigint>", ["n", "run", "left", "inner", "long", "marked"])

    def step(a: Column, m: Column) -> Column:
        ends, whole = ~m & (a["run"] > 0), a["run"] == a["n"]
        closed = ends & ~whole
        return F.struct(
            (a["n"] + 1).alias("n"), F.when(m, a["run"] + 1).otherwise(F.lit(0).cast("bigint")).alias("run"), F.when(ends & whole, a["run"]).otherwise(a["left"]).alias("left"),
            F.when(closed, F.greatest(a["inner"], a["run"])).otherwise(a["inner"]).alias("inner"), (a["long"] + F.when(closed & (a["run"] >= long_run), 1).otherwise(0)).alias("long"),
            (a["marked"] + F.when(m, 1).otherwise(0)).alias("marked"),
        )

    def end(a: Column) -> Column:
        left = F.when(a["run"] == a["n"], a["n"]).otherwise(a["left"])
        return F.struct(a["n"], left.alias("left"), a["run"].alias("right"), a["inner"], a["long"], a["marked"]).cast(_RUNS)

    return F.aggregate(F.transform(marked, lambda m: F.coalesce(m, F.lit(False))), zero, step, end)


def merged_runs(long_run: int):
    """How two summaries of runs, side by side, become one."""

    def merge(a: Column, b: Column) -> Column:
        all_a, all_b = a["left"] == a["n"], b["left"] == b["n"]
        across = F.when(~all_a & ~all_b, a["right"] + b["left"]).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            (a["n"] + b["n"]).alias("n"), F.when(all_a, a["n"] + b["left"]).otherwise(a["left"]).alias("left"), F.when(all_b, b["n"] + a["right"]).otherwise(b["right"]).alias("right"),
            F.greatest(a["inner"], b["inner"], across).alias("inner"), (a["long"] + b["long"] + F.when(across >= long_run, 1).otherwise(0)).alias("long"), (a["marked"] + b["marked"]).alias("marked"),
        ).cast(_RUNS)

    return merge


_RUN_NAMES = ["n", "left", "right", "inner", "long", "marked"]


def runs(chunks: DataFrame, key: list[str], at: str, marked: Column, long_run: int = signal.CLIP_RUN) -> DataFrame:
    """marked samples, long_runs (of long_run or more in a row) and the longest run of each recording."""
    own = chunks.select(*key, at, run_summary(F.coalesce(marked, F.array().cast("array<boolean>")), long_run).alias("s"))
    s = folded(own, key, at, "s", _zero(_RUNS, _RUN_NAMES), merged_runs(long_run))
    whole, is_long = F.col("s.left") == F.col("s.n"), lambda c: F.when(F.col(c) >= long_run, 1).otherwise(0)
    ends = is_long("s.left") + F.when(whole, 0).otherwise(is_long("s.right"))
    return s.select(*key, "s.marked", (F.col("s.long") + ends).alias("long_runs"), F.greatest("s.left", "s.right", "s.inner").alias("longest"))


def frames(chunks: DataFrame, key: list[str], samples: str, size: int) -> DataFrame:
    """frame (from 0) and db of each whole frame of size samples; frames go on over the ends of chunks.

    chunks: as placed() gives them. A chunk sums its part of each frame, so what is shuffled is a row a frame and chunk.
    """
    first = F.floor(F.col("start") / size)
    n = F.array_size(samples)
    last = F.floor((F.col("start") + n - 1) / size)

    def part(f: Column) -> Column:
        low = F.greatest(f * size - F.col("start"), F.lit(0)).cast("int")
        high = F.least((f + 1) * size - F.col("start"), n).cast("int")
        return F.struct(f.alias("frame"), (high - low).alias("n"), F.aggregate(F.slice(samples, low + 1, high - low), F.lit(0.0), lambda a, x: a + x * x).alias("squares"))

    parts = chunks.where(n > 0).select(*key, F.explode(F.transform(F.sequence(first, last), part)).alias("p")).select(*key, "p.*")
    whole = parts.groupBy(*key, "frame").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares")).where(F.col("n") == size)
    return whole.select(*key, "frame", signal.decibels(F.sqrt(F.col("squares") / size)).alias("db"))


def silence(framed: DataFrame, key: list[str], floor: float = signal.SILENCE_DB) -> DataFrame:
    """lead, trail and longest interior run of frames under the floor, as signal.silence(); recordings without a whole
    frame have no row."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("frame", "db"))), lambda x: x["db"] < floor)
    spans = framed.groupBy(*key, F.floor(F.col("frame") / SPAN).alias("span")).agg(row.alias("quiet"))
    s = folded(spans.select(*key, "span", run_summary(F.col("quiet"), 1).alias("s")), key, "span", "s", _zero(_RUNS, _RUN_NAMES), merged_runs(1))
    whole = F.col("s.left") == F.col("s.n")
    return s.select(*key, F.col("s.left").alias("lead"), F.when(whole, F.lit(0).cast("bigint")).otherwise(F.col("s.right")).alias("trail"), F.col("s.inner").alias("longest"))


def _merged_clicks(gap: int):
    def merge(a: Column, b: Column) -> Column:
        close = (b["first"] - a["last"] <= gap).cast("bigint")
        both = F.struct((a["spikes"] + b["spikes"]).alias("spikes"), a["first"].alias("first"), b["last"].alias("last"), (a["events"] + b["events"] - close).alias("events"))
        return F.when(a["spikes"] == 0, b).when(b["spikes"] == 0, a).otherwise(both.cast(_CLICKS))

    return merge


def local_clicks(chunks: DataFrame, key: list[str], at: str, samples: str, rate: float, block_least: int = signal.BLOCK_LEAST, sigmas: float = signal.CLICK_SIGMA, least: float = signal.CLICK_LEAST) -> DataFrame:
    """spikes and events of each recording, as signal.local_clicks(); 0 and 0 for one of under 4 samples.

    chunks: as placed() gives them. They are cut anew into the blocks of the noise floor, each with the two samples after it
    (the last with what is left after the last whole block), so a task holds less than two blocks.
    """
    block, gap = max(block_least, int(signal.BLOCK_S * rate)), max(1, int(signal.CLICK_S * rate))
    n, start, total = F.array_size(samples), F.col("start"), F.col("total")
    top = F.greatest(F.floor((total - 1) / block) - 1, F.lit(0))
    first = F.least(F.greatest(F.floor((start - 2) / block), F.lit(0)), top)
    last = F.least(F.floor((start + n - 1) / block), top)

    def piece(b: Column) -> Column:
        low = F.greatest(b * block - start, F.lit(0)).cast("int")
        high = F.least(F.when(b == top, total).otherwise((b + 1) * block + 2) - start, n).cast("int")
        return F.struct(b.alias("block"), (start + low).alias("place"), F.slice(samples, low + 1, F.greatest(high - low, F.lit(0))).alias("x"), (b == top).alias("ends"))

    cut = chunks.where((n > 0) & (total > 3)).select(*key, F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select(*key, "p.*")
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]))
    blocks = cut.groupBy(*key, "block").agg(whole.alias("x"), F.bool_or("ends").alias("ends"))

    @F.pandas_udf("spikes long, first long, last long, events long")
    def found(xs: pd.Series, ends: pd.Series, at: pd.Series) -> pd.DataFrame:
        def one(x: np.ndarray, end: bool, b: int) -> tuple[int, int, int, int]:
            d = np.diff(x)
            own = len(d) if end else block
            limit = np.maximum(sigmas * signal._noise(d[:own], block), least)[: len(d) - 1]
            here, after = d[: len(limit)], d[1 : len(limit) + 1]
            i = np.flatnonzero((np.abs(here) > limit) & (np.sign(here) != np.sign(after)) & (np.abs(after) > 0.5 * limit))
            if not len(i):
                return 0, 0, 0, 0
            return len(i), b * block + int(i[0]), b * block + int(i[-1]), 1 + int(np.count_nonzero(np.diff(i) > gap))

        return pd.DataFrame([one(*r) for r in zip(xs, ends, at)], columns=["spikes", "first", "last", "events"], dtype="int64")

    each = blocks.select(*key, "block", found("x", "ends", "block").alias("s"))
    clicks = folded(each, key, "block", "s", _zero(_CLICKS, ["spikes", "first", "last", "events"]), _merged_clicks(gap))
    every = _same(chunks.select(*key).distinct(), key, clicks, how="left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c.split(".")[-1])
    return every.select(*key, zero("s.spikes"), zero("s.events"))
