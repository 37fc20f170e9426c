"""Substring search over postings of trigrams.

What is searched is one text a row: its fields, joined by single spaces without blanks and lower-cased. Postings have a row a
gram (any one, two or three characters in a row, so that short searches are grams themselves) and row that has it. A
search starts from its rarest grams; rows that have all of these are its candidates, and whether the text is there in one
piece is then looked up in the candidates alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.operators import steps

#: Grams of a search, its rarest, whose postings are met; the others are left to the look at the text itself.
LEADS = 3
#: Parts that each gram's postings are dealt over.
PARTS = 8


def haystack(fields: list[Column]) -> Column:
    """The fields, joined by single spaces without blanks, lower-cased."""
    return F.lower(F.concat_ws(" ", *(F.nullif(c.cast("string"), F.lit("")) for c in fields)))


def _runs(size: int) -> Column:
    """A run of `size` characters of the array c from each place, shorter at the end; repeated ones too."""
    return F.transform("c", lambda _, i: F.array_join(F.slice("c", i + 1, size), ""))


def asked(searches: DataFrame, text: str) -> DataFrame:
    """The searches' columns (none named c) and gram, a row each distinct one: trigrams, or the text itself if it is shorter."""
    low = searches.withColumn("c", F.split(F.lower(F.col(text)), "")).where(F.col(text) != "")
    # Runs at the end are shorter: left out, but for a text that is one.
    runs = F.slice(_runs(3), 1, F.greatest(F.size("c") - 2, F.lit(1)))
    return low.withColumn("gram", F.explode(F.array_distinct(runs))).drop("c")


def index(rows: DataFrame, row_id: str, fields: list[Column], only: DataFrame | None = None) -> DataFrame:
    """gram and id of every distinct gram of every row. only: the grams of an index that serves some searches and no others."""
    text = rows.select(F.col(row_id).alias("id"), haystack(fields).alias("text"))
    # The characters are a column of their own, not worked out for each gram; a long text takes time by its length.
    chars = text.select("id", F.split("text", "").alias("c")).where(F.size("c") > 0)
    grams = chars.select("id", F.explode(F.array_distinct(F.flatten(F.array(*(_runs(k) for k in (1, 2, 3)))))).alias("gram")).where("gram <> ''")
    return grams if only is None else grams.join(only.select("gram").distinct(), "gram", "left_semi")


def write_index(postings: DataFrame, path: str, shards: int = 64) -> None:
    """Postings in shards by a hash of the gram, sorted within."""
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int")
    postings.withColumn("shard", shard).repartition(shards, "shard", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("shard", "gram", "id").write.partitionBy("shard").parquet(path)


def read_index(spark: SparkSession, path: str, only: DataFrame, shards: int = 64) -> DataFrame:
    """The postings of some grams; the other shards' files are not read. What is collected is `shards` numbers at most."""
    keyed = only.select("gram").distinct().withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int"))
    met = [r.shard for r in keyed.select("shard").distinct().collect()]
    return spark.read.parquet(path).where(F.col("shard").isin(met)).join(keyed, ["shard", "gram"], "left_semi").select("gram", "id")


def search(searches: DataFrame, key: str, text: str, rows: DataFrame, row_id: str, fields: list[Column], postings: DataFrame) -> DataFrame:
    """key and row_id of every row that has a search's text in any case. Keys and row ids should be distinct.

    An empty or null text is no search and finds nothing.
    """
    grams = asked(searches.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__text")
    known = grams.join(postings.groupBy("gram").agg(F.count("*").alias("docs")), "gram", "left")
    # A search with a gram that no row has (docs is null) finds nothing.
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("docs", "gram"))), 1, LEADS)
    leads = known.groupBy("__key").agg(rarest.alias("leads"), F.bool_and(F.col("docs").isNotNull()).alias("all")).where("all")
    leads = leads.select("__key", F.size("leads").alias("n"), F.explode("leads.gram").alias("gram")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    leads = steps.stored(leads, "leads")
    dealt = postings.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    met = leads.join(dealt, ["gram", "part"]).groupBy("__key", "id").agg(F.count("*").alias("have"), F.first("n").alias("n")).where("have = n")
    texts = rows.select(F.col(row_id).alias("id"), haystack(fields).alias("__hay"))
    wanted = searches.select(F.col(key).alias("__key"), F.lower(F.col(text)).alias("__text"))
    found = met.select("__key", "id").join(texts, "id").join(wanted, "__key").where(F.contains("__hay", F.col("__text")))
    return found.select(F.col("__key").alias(key), F.col("id").alias(row_id))
