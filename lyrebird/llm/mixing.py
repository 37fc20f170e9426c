"""Mixing sources to target weights by Poisson replication, in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.shared import materialise

#: A rate above this is the sum of several draws, so that exp(-rate) never vanishes.
ONE_DRAW = 16.0
#: Hexadecimal digits of the hash that a draw takes.
DIGITS = 13


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) that the seed and the parts decide."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson(u: Column, rate: Column) -> Column:
    """How many of the distribution's partial sums are u at most: its inverse at u, for a rate of ONE_DRAW at most."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int")  # beyond lies less than the resolution of u
    p0 = F.exp(-rate)
    start = F.struct(p0.alias("p"), p0.alias("sum"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        below = s["sum"] <= u
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.when(below, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["n"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: str = "mix", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Copies of the rows of docs, so that sources have their target shares, in a random order.

    A source's share is its weight over all weights (one without a weight: 0), or without weights the power
    `temperature` of its number of rows over the sum of these. The output has about size times as many rows. Each row
    has a Poisson number of copies, with its source's target over its rows as the mean: `copy` numbers them from 0, and
    shuffle_key gives the global order. Partitions are random by that key and sorted by it.
    A null source is a source of its own (its weight: that of ""). Draws depend on seed, doc_id and source alone, so
    rows that repeat are copied equally often. A null doc_id is replaced by a hash of the row in draws and in the order,
    so rows without an id are drawn one by one and spread. Columns of docs with these names are replaced. Rows are counted over all docs, combined before the shuffle; the table of sources is joined as Spark sees
    fit by its size. No rows give none.
    """
    own = F.coalesce(F.col(source), F.lit(""))
    # A row without an id is told apart by all that it holds; maps have no hash.
    hashed = {f.name for f in docs.schema if "map<" not in f.dataType.simpleString()} - {"copy", "shuffle_key"}
    ident = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("row "), F.xxhash64(*(F.col(f"`{c}`") for c in sorted(hashed))).cast("string")))
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("__n"))
    if weights is None:
        weight = F.pow(F.col("__n").cast("double"), F.lit(temperature))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "__name string, __weight double")
        counts = counts.join(table, F.coalesce("__source", F.lit("")) == F.col("__name"), "left").drop("__name")
        weight = F.coalesce("__weight", F.lit(0.0))
    counts = materialise(counts.select("__source", "__n", weight.alias("__weight")), "sources")
    total = counts.agg(F.sum("__n").alias("n"), F.sum("__weight").alias("w")).first()
    scale = size * (total["n"] or 0) / total["w"] if total["w"] else 0.0
    rates = counts.select("__source", (F.col("__weight") * F.lit(scale) / F.col("__n")).alias("__rate"))
    draws = F.greatest(F.ceil(F.col("__rate") / ONE_DRAW), F.lit(1)).cast("int")
    one = lambda j: poisson(uniform(seed, F.col("__ident"), own, j), F.col("__rate") / draws)
    n = F.aggregate(F.transform(F.sequence(F.lit(0), draws - 1), one), F.lit(0), lambda s, x: s + x)
    rows = docs.drop("copy", "shuffle_key").withColumn("__ident", ident).join(rates, F.col(source).eqNullSafe(F.col("__source"))).withColumn("__copies", n)
    numbers = F.when(F.col("__copies") > 0, F.sequence(F.lit(0), F.col("__copies") - 1))  # null: no row
    copies = rows.withColumn("copy", F.explode(numbers)).drop("__source", "__rate", "__copies")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("__ident"), own, F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", key).drop("__ident").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
