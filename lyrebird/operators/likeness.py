"""Pairs of names with a likeness of at least some threshold, found without comparing all pairs.

The likeness of two normalised names is the best of three Indel ratios (2 * common subsequence / both lengths): of the names,
of their distinct words with the shared ones first, and of the shared words with either side's words. The bag of character
pairs of a name with single spaces around its words is the same in whatever order the words stand, so one filter serves the
first two: an insertion or deletion undoes few pairs, and from lengths L and M with a ratio of t follows an overlap of at
least 1 + (L + M) * (1.5 t - 1) pairs, which is above 1 for t over 2/3. Bags are ordered by rarity and only prefixes that must
share a pair meet; lengths, places in the prefix and a bitmap of each bag bound the overlap before a candidate is emitted.
The third ratio is a containment: shared words that weigh t / (2 - t) of the shorter name, met by its rarest words.

Names alike are found exactly; a name is blank, or equal to another, once normalised: blank ones are like nothing, equal ones
count as one name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyrebird.functions import text
from lyrebird.functions.workers import ship
from lyrebird.operators import steps

#: Entries of one key that a task meets at most on each side, on average; a key with more is dealt over tiles.
TILE = 4096
#: Elements of fewer entries are met in blocks of many such elements.
SMALL = 64
#: Entries of a block that meet all others at once.
ROWS = 128
#: Longs of a bag's bitmap. Names of 50 letters fill a fifth of 256 bits; the bitmap of a very long name prunes nothing.
BITMAP = tuple(f"bits_{i}" for i in range(4))
#: What products of doubles may be off by.
_EPS = 1e-9


@F.pandas_udf(T.DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """likeness() of names that are normalised and differ."""
    for a, b in pairs:
        yield pd.Series([max(text.indel_ratio(x, y), text.token_set_ratio(x, y)) for x, y in zip(a, b)], index=a.index, dtype="float64")


def _elements(names: DataFrame) -> DataFrame:
    """id, whole and element: a number of each character pair, and which of its occurrences it is, of a name's distinct words
    (whole false) and, where words repeat, of all its words."""
    distinct = F.array_join(F.array_distinct(F.split("name", " ")), " ")
    forms = F.array(F.struct(F.lit(False).alias("whole"), distinct.alias("s")), F.struct(F.lit(True).alias("whole"), F.col("name").alias("s")))
    each = names.select("id", F.explode(F.when(distinct == F.col("name"), F.slice(forms, 1, 1)).otherwise(forms)).alias("f")).select("id", "f.*")
    chars = each.select("id", "whole", F.split(F.concat(F.lit(" "), "s", F.lit(" ")), "").alias("c"))
    pair = lambda c, i: F.shiftleft(F.ascii(c).cast("long"), 42) + F.shiftleft(F.ascii(F.get("c", i + 1)).cast("long"), 21)
    pairs = chars.select("id", "whole", F.explode(F.transform(F.slice("c", 1, F.size("c") - 1), pair)).alias("pair"))
    counted = pairs.groupBy("id", "whole", "pair").count()
    return counted.select("id", "whole", F.explode(F.sequence(F.col("pair"), F.col("pair") + F.col("count") - 1)).alias("element"))


def _bags(elements: DataFrame, least: float) -> DataFrame:
    """id, whole, n (elements), length, a bitmap and prefix: the rarest elements, one of which any bag alike has."""
    known = elements.join(elements.groupBy("element").count(), "element")
    bit = F.pmod(F.xxhash64("element"), F.lit(64 * len(BITMAP))).cast("int")
    one = F.expr("shiftleft(1L, __bit % 64)")
    known = known.withColumn("__bit", bit)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("count", "element"))), lambda x: x["element"])
    bits = [F.coalesce(F.bit_or(F.when(F.floor(F.col("__bit") / 64) == i, one)), F.lit(0).cast("long")).alias(c) for i, c in enumerate(BITMAP)]
    bags = known.groupBy("id", "whole").agg(ordered.alias("ordered"), *bits).withColumn("n", F.size("ordered")).withColumn("length", F.col("n") - 1)
    fewest = F.ceil(1 + F.col("length") * (1 + least / (2 - least)) * (1.5 * least - 1) - _EPS)
    return bags.select("id", "whole", "n", "length", *BITMAP, F.slice("ordered", 1, (F.col("n") - fewest + 1).cast("int")).alias("prefix"))


def _tasks(df: DataFrame) -> int:
    """Tasks of a step whose rows are small for the work that they make; if merged by their bytes, they would be few."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _tiled(left: DataFrame, right: DataFrame, key: str, fits: Column) -> DataFrame:
    """a and b, the smaller id first, of left and right entries that share a key and fit; columns of left begin with a_, of right
    with b_. A key with more than TILE right entries is dealt over tiles by both ids, so that no task meets all of its pairs."""
    tasks = _tasks(left)
    tiles = right.groupBy(key).count().where(F.col("count") > TILE).select(key, F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))

    def dealt(side: DataFrame, own: str, others: str, name: str) -> DataFrame:
        known = side.join(tiles, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        known = known.withColumn(own, F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
        return known.select(key, "__i", "__j", *(F.col(c).alias(f"{name}_{c}") for c in side.columns if c != key)).repartition(tasks, key, "__i", "__j")

    met = dealt(left, "__i", "__j", "a").join(dealt(right, "__j", "__i", "b"), [key, "__i", "__j"]).where(fits)
    return met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def _missing(one: str, other: str) -> Column:
    """At most as many as the elements of one that other lacks."""
    return sum(F.bit_count(F.col(f"{one}_{c}").bitwiseAND(F.bitwise_not(f"{other}_{c}"))) for c in BITMAP)


def _overlapping(least: float):
    """Of a block's entries, pairs of ids whose bags may overlap as far as alike names' do; each pair of entries is looked at once."""
    slope, need = 1.5 * least - 1, least / (2 - least)

    def run(block: pa.Table) -> pa.Table:
        col = {c: block.column(c).to_numpy() for c in block.column_names}
        bits = np.stack([col[c].view(np.uint64) for c in BITMAP])
        # What the overlap may be at most is `lack` below the bits that both have, and what is left of either bag from here on.
        lack, rest = np.bitwise_count(bits).sum(0, dtype=np.int64) - col["n"], col["n"] - col["at"]
        found = [np.empty((2, 0), np.int64)]

        def meet(left: np.ndarray, right: np.ndarray, triangle: bool) -> None:
            """Places of entries, both in the order of their lengths."""
            size = col["length"][right]
            for at in range(0, len(left), ROWS):
                some = left[at : at + ROWS]
                own = col["length"][some]
                start = max(np.searchsorted(size, own[0] * need - 2 * _EPS), at + 1 if triangle else 0)
                others = right[start : np.searchsorted(size, own[-1] / need + 1)]
                if not len(others):
                    continue
                common = np.zeros((len(some), len(others)), np.uint16)
                for word in bits:
                    common += np.bitwise_count(word[some][:, None] & word[others][None, :])
                fewest = 1 + slope * (own + col["length"][others[0]]) - 2 * _EPS + lack[some]
                x, y = np.nonzero(common >= np.clip(np.ceil(fewest), 0, 1 << 15).astype(np.uint16)[:, None])
                both, i, j = common[x, y].astype(np.int64), some[x], others[y]
                overlap = 1 + (col["length"][i] + col["length"][j]) * slope - _EPS
                fits = (both - lack[i] >= overlap) & (both - lack[j] >= overlap) & (np.minimum(rest[i], rest[j]) >= overlap)
                fits &= (col["length"][i] >= col["length"][j] * need - _EPS) & (col["length"][j] >= col["length"][i] * need - _EPS) & (col["id"][i] != col["id"][j])
                if triangle:
                    fits &= start + y > at + x
                i, j = col["id"][i[fits]], col["id"][j[fits]]
                found.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))

        order = np.lexsort((col["length"], col["tile"], col["element"]))
        ends = np.flatnonzero(np.diff(col["element"][order], append=-1)) + 1
        for first, last in zip([0, *ends], ends):
            entries = order[first:last]
            if col["__i"][entries[0]] == col["__j"][entries[0]]:
                meet(entries, entries, True)
            else:
                cut = np.searchsorted(col["tile"][entries], col["__j"][entries[0]])
                meet(entries[:cut], entries[cut:], False)
        pairs = np.concatenate(found, axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return run


def _near(bags: DataFrame, least: float) -> DataFrame:
    """Pairs of ids whose bags may overlap as much as alike names' do.

    An element's entries are dealt over tiles of TILE, and each two tiles are a block; elements of few entries share blocks.
    """
    ship(bags.sparkSession)
    entries = bags.select("id", "n", "length", *BITMAP, F.posexplode("prefix").alias("at", "element"))
    counted = entries.groupBy("element").agg(F.count("*").alias("met")).where("met > 1")
    tiles = F.ceil(F.col("met") / TILE).cast("int")
    block = F.when(F.col("met") > SMALL, F.col("element")).otherwise(-1 - F.pmod(F.xxhash64("element"), F.lit(8 * _tasks(bags))))
    known = entries.join(counted.select("element", tiles.alias("tiles"), block.alias("block")), "element").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = known.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"__i": F.least("tile", "__other"), "__j": F.greatest("tile", "__other")}).drop("__other", "tiles")
    return dealt.repartition(_tasks(bags), "block", "__i", "__j").groupBy("block", "__i", "__j").applyInArrow(_overlapping(least), "a long, b long")


def _contained(names: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Pairs of ids of which the shorter's words may be in the other but for what the threshold leaves."""
    words = names.select("id", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).withColumn("weight", F.char_length("word") + 1)
    known = words.join(words.groupBy("word").count(), "word")
    rest = F.sum("weight").over(Window.partitionBy("id").orderBy("count", "word").rowsBetween(0, Window.unboundedFollowing))
    sets = bags.where("NOT whole").select("id", "length", *BITMAP)
    entries = known.select("id", "word", (rest - 1).alias("rest")).join(sets, "id")
    need = least / (2 - least)
    probes = entries.where(F.col("rest") >= F.col("length") * need - _EPS)
    fits = (F.col("a_id") != F.col("b_id")) & (F.col("a_length") <= F.col("b_length")) & (_missing("a", "b") <= F.col("a_length") * (1 - need) + _EPS)
    return _tiled(probes.drop("rest"), entries.drop("rest"), "word", fits)


def candidates(names: DataFrame, least: float) -> DataFrame:
    """a and b, a < b, of names (id and name, normalised, distinct, not blank) that the filters leave, each pair once."""
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be over 2/3 and at most 1: below, alike names need not share pairs of characters")
    bags = steps.stored(_bags(steps.stored(_elements(names), "elements"), least), "bags")
    return _near(bags, least).unionByName(_contained(names, bags, least)).repartition(_tasks(names), "a", "b").distinct()


def alike(names: DataFrame, name: str, least: float) -> DataFrame:
    """name, other (the greater), likeness, n_names and n_others (rows that have each): all pairs of different names, once
    normalised, with a likeness of at least `least`. Null and blank names are in no pair; an empty table has none."""
    counted = names.select(text.normalise_unicode(F.col(name)).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    table = steps.stored(counted.withColumn("id", F.monotonically_increasing_id()), "names")
    pairs = steps.stored(candidates(table.select("id", "name"), least), "candidates")
    x, y = (table.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("n").alias(f"{side}_n")) for side in ("a", "b"))
    scored = pairs.join(x, "a").join(y, "b").withColumn("likeness", _ratio("a_name", "b_name")).where(F.col("likeness") >= least - _EPS)
    swap = F.col("a_name") > F.col("b_name")
    first = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return scored.select(first("a_name", "b_name").alias("name"), first("b_name", "a_name").alias("other"), "likeness", first("a_n", "b_n").alias("n_names"), first("b_n", "a_n").alias("n_others"))
