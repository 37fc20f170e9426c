"""Importance resampling towards a target: hashed word features, array-scored weights, and an exact draw.

Each document's features are kept as an array of bucket numbers, written once. Both sides' buckets are counted, and a
bucket's gain is its log-ratio in whole thousandths; a document's weight is the mean gain of its array. Scores add Gumbel
noise that is seeded by the id, so the highest ones are a draw without replacement. The cutoff is found by bisection:
exact counts over the written scores, then over the ids that tie at it. Only what is drawn is ranged and numbered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.shared import discard, materialise

#: What separates words, once A-Z are lower-cased: ASCII that is neither a digit nor a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Halvings that one counting job makes: it counts at 2 ** HALVINGS - 1 thresholds.
HALVINGS = 4
#: Drawn rows of a task that numbers them.
ROWS = 500_000


def words(text: Column) -> Column:
    """The words of a whole text in order; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def runs(tokens: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by one space, repeats included."""

    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return tokens if longest == 1 else F.concat(tokens, *(of(n) for n in range(2, longest + 1)))


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(features: DataFrame) -> DataFrame:
    """bucket and n; added up in each task before the shuffle, so no bucket is hot."""
    return features.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Each bucket's gain. What comes to the driver is a row a bucket, of which there are `buckets` at most."""
    s, t = source.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    gain = lambda a, b: F.floor(1000 * F.ln((b + 1).cast("double") * float(total["s"] + buckets) / ((a + 1).cast("double") * float(total["t"] + buckets)))).cast("int")
    rows = both.withColumn("g", gain(F.col("s"), F.col("t"))).collect()
    empty = both.sparkSession.range(1).select(gain(F.lit(0), F.lit(0)).alias("g")).first()["g"]
    out = [empty] * buckets
    for r in rows:
        out[r["bucket"]] = r["g"]
    return out


def _bisect(rows: DataFrame, value: Column, low: int, high: int, wanted: int) -> int:
    """The largest v in low..high that at least `wanted` rows are not below; `wanted` of them are not below low.

    Each job halves the interval HALVINGS times: it counts exactly at all thresholds that this could meet.
    """
    while low < high:
        step = max(1, (high - low + 1) >> HALVINGS)
        cuts = list(range(low + step, high + 1, step))
        counted = rows.agg(*(F.count_if(value >= c).alias(f"c{i}") for i, c in enumerate(cuts))).first()
        enough = [c for c, n in zip(cuts, counted) if n >= wanted]
        low, high = (max(enough), min([c - 1 for c in cuts if c not in enough], default=high)) if enough else (low, cuts[0] - 1)
    return low


def draw_top(scored: DataFrame, eligible: Column, wanted: Callable[[int], int], columns: list[str]) -> DataFrame:
    """columns and rank of all rows: 1 to wanted(number of eligible rows) by score, highest first, then by the smallest doc_id
    (null ones last), then by the smallest n_features; null for the rest. scored is a written table with a distinct `row`."""
    n = scored.where(eligible).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    k = min(wanted(n["n"]), n["n"])
    none = F.lit(None).cast("long").alias("rank")
    if k <= 0:
        return scored.select(*columns, none)
    cut = _bisect(scored.where(eligible), F.col("score"), n["low"], n["high"], k)
    level = scored.where(eligible & (F.col("score") == cut))
    above = scored.where(eligible & (F.col("score") > cut)).count()
    ids = level.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    # Of the rows that tie at the cutoff, those up to the last id that is still needed; without an id, only if all ids are.
    if ids["n"] >= k - above:
        last = -_bisect(level.where("doc_id IS NOT NULL"), -F.col("doc_id"), -ids["high"], -ids["low"], k - above)
        tie = F.coalesce(F.col("doc_id") <= last, F.lit(False))
    else:
        tie = F.lit(True)
    chosen = eligible & ((F.col("score") > cut) | ((F.col("score") == cut) & tie))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    ranged = scored.where(chosen).repartitionByRange(max(1, -(-k // ROWS)), *order).sortWithinPartitions(*order)
    # The number that Spark gives a row is its partition's, and its place there in the lower 33 bits.
    placed = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "resample-drawn")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a task
    before, starts = 0, []
    for p in range(max(sizes) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    rank = F.element_at(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), (part + 1).cast("int")) + place + 1
    drawn = placed.select(*columns, F.when(rank <= k, rank).alias("rank"))  # rows beyond k equal the last one that is drawn
    return drawn.unionByName(scored.where(~F.coalesce(chosen, F.lit(False))).select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    Of the documents with at least least_words words, percent are drawn: rank is their place by score, null for the others.
    A null, empty or wordless text has no features, weight 0 and is never drawn (unless least_words is 0); texts are read
    to their ends, however long. Repeated rows count each; those with equal id and score take ranks in the order of
    n_features, and equal rows any. A null id is seeded as an empty one and comes after all ids of its score. No documents
    give no rows; without target texts all features are weighed against none. Other columns of docs are not read.
    """
    hashed = F.transform(runs(F.col("w"), longest), lambda x: bucket_of(x, buckets)).alias("features")
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words(F.col(text)).alias("w"))
    features = materialise(mine.select("doc_id", F.size("w").alias("n_words"), hashed), "resample-features")
    theirs = target.select(words(F.col(target_text)).alias("w")).select(hashed)
    gain = gains(bucket_counts(features), bucket_counts(theirs), buckets)
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded into one array before the rows are read
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    size = F.size("features").cast("long")
    weight = F.when(F.col("__n") > 0, F.expr("(__t - pmod(__t, __n)) div __n")).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = features.select("doc_id", "n_words", size.alias("__n"), total.alias("__t")).select("doc_id", "n_words", F.col("__n").alias("n_features"), weight.alias("weight"))
    scored = scored.withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()})
    scored = materialise(scored, "resample-scores")
    discard(features)
    return draw_top(scored, F.col("n_words") >= least_words, lambda n: percent * n // 100, ["doc_id", "n_features", "weight", "score"])
