"""Duplicates of catalogue rows: by id, then by normalised title with a weighted likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of title, artist and album, and the least score.
TITLE, ARTIST, ALBUM, LEAST = 0.5, 0.4, 0.1, 0.82


def by_id(rows: DataFrame, existing: DataFrame, key: str, seq: list[str], carry: list[str]) -> DataFrame:
    """rows joined with the first existing row of their id; the index is cut to one row an id before the join."""
    first = existing.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*seq))).where("__r = 1")
    return rows.join(first.select(key, *(F.col(c).alias(f"existing_{c}") for c in carry)), key)


def first_other(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """rows joined with the first other row of their key, by row_id; existing_ is its row_id. Rows alone are left out."""
    some = rows.where(F.col(key).isNotNull())
    first = some.groupBy(key).agg(F.min(row_id).alias("__first"))
    second = some.join(first, key).where(F.col(row_id) > F.col("__first")).groupBy(key, "__first").agg(F.min(row_id).alias("__second"))
    other = F.when(F.col(row_id) == F.col("__first"), F.col("__second")).otherwise(F.col("__first"))
    return some.join(second, key).withColumn(f"existing_{row_id}", other).drop("__first", "__second")


def fuzzy(rows: DataFrame, existing: DataFrame, row_id: str, block: str, artist: Column, album: Column, ids_differ: Column, order: list[str]) -> DataFrame:
    """The best existing row of each row within its block, ties to the first in order; at least LEAST.

    artist and album are likenesses of the pair, in columns of both sides; equal blocks make the title's 1.
    """
    score = F.bround(F.lit(TITLE) + ARTIST * F.coalesce(artist, F.lit(0.0)) + ALBUM * F.coalesce(album, F.lit(0.0)), 6)
    pairs = rows.join(existing, block).where(~F.coalesce(ids_differ, F.lit(False))).withColumn("score", score).where(F.col("score") >= LEAST)
    return pairs.withColumn("__r", F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc("score"), *order))).where("__r = 1").drop("__r")


def _met(rows: DataFrame, block: str, value: str, like) -> DataFrame:
    """__x, __y and __like: each two values that meet in some block, once, whatever the number of blocks and rows."""
    own = rows.select(block, F.col(value).alias("__x")).distinct()
    return own.join(own.withColumnRenamed("__x", "__y"), block).select("__x", "__y").distinct().withColumn("__like", like("__x", "__y"))


def _paired(rows: DataFrame, met: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """rows with the likeness of two of their columns; rows whose two values aren't in met go."""
    fits = F.col(one).eqNullSafe(F.col("__x")) & F.col(other).eqNullSafe(F.col("__y"))
    return rows.join(met, fits).drop("__x", "__y").withColumnRenamed("__like", name)


def fuzzy_within(rows: DataFrame, row_id: str, block: str, artist: str, album: str, like) -> DataFrame:
    """row_id, existing_ row_id and score: the best other row of each row's block, ties to the smaller id, at least LEAST.

    like(a, b) is the likeness of two columns, 0 to 1. Only distinct pairs of artist and album of a block are compared, each with
    the two smallest ids that have it, so rows that say the same are never paired with each other one by one. Pairs meet by
    their albums and then by their artists: of n in a block, n times its albums and artists rather than n times n.
    """
    key = [block, artist, album]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(row_id))
    two = rows.select(row_id, *key).withColumn("__r", place).where("__r <= 2").groupBy(*key)
    two = two.agg(F.min(row_id).alias("first"), F.max(F.when(F.col("__r") == 2, F.col(row_id))).alias("second"))
    other = two.select(block, F.col(artist).alias("__artist"), F.col(album).alias("__album"), F.col("first").alias("__first"))
    # An album first meets the other albums of each artist in its block, and only the best of these meet its own artists.
    asked = two.select(block, F.col(album).alias("__asked")).distinct()
    near = _paired(other.join(asked, block), _met(two, block, album, like), "__asked", "__album", "__by_album")
    near = near.withColumn("__same", F.col("__asked").eqNullSafe(F.col("__album")))
    near = near.groupBy(block, "__asked", "__artist", "__same", "__by_album").agg(F.min("__first").alias("__first"))
    # Likenesses of albums that are this close may round to one score, among which the smaller id wins.
    most = F.max("__by_album").over(Window.partitionBy(block, "__asked", "__artist", "__same"))
    near = near.withColumn("__most", most).where(F.col("__by_album") >= F.col("__most") - 2e-6 / ALBUM).withColumnRenamed(block, "__block")
    near = two.join(near, (F.col(block) == F.col("__block")) & F.col(album).eqNullSafe(F.col("__asked")))
    near = near.withColumn("own", F.col("__same") & F.col(artist).eqNullSafe(F.col("__artist"))).where("NOT own OR second IS NOT NULL")
    artists = _met(two, block, artist, like).where(F.col("__like") >= (LEAST - TITLE - ALBUM) / ARTIST - 1e-5)
    score = F.bround(TITLE + ARTIST * F.col("__by_artist") + ALBUM * F.col("__by_album"), 6)
    pairs = _paired(near, artists, artist, "__artist", "__by_artist").withColumn("score", score).where(F.col("score") >= LEAST)
    best = F.max(F.when(~F.col("own"), F.struct("score", (-F.col("__first")).alias("less"))))
    found = pairs.groupBy(*key, "first", "second").agg(best.alias("best"), F.max(F.when(F.col("own"), F.col("score"))).alias("mine"))
    renamed = found.select(F.col(block).alias("__b"), F.col(artist).alias("__a"), F.col(album).alias("__l"), "first", "second", "best", "mine")
    fits = (F.col(block) == F.col("__b")) & F.col(artist).eqNullSafe(F.col("__a")) & F.col(album).eqNullSafe(F.col("__l"))
    twin = F.when(F.col(row_id) == F.col("first"), F.col("second")).otherwise(F.col("first"))
    choice = F.greatest(F.col("best"), F.when(F.col("mine").isNotNull(), F.struct(F.col("mine").alias("score"), (-twin).alias("less"))))
    out = rows.select(row_id, *key).join(renamed, fits).withColumn("__c", choice)
    return out.select(row_id, (-F.col("__c.less")).alias(f"existing_{row_id}"), F.col("__c.score").alias("score"))
