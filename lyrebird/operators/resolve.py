"""Entity resolution: candidate generation in stages, explained weighted scores, ranking, ceilings, votes and seats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the signals.
WEIGHTS = {
    "fingerprint": 3.0, "existing_id": 3.0, "duration": 2.0, "title": 2.0, "artist": 1.5, "album": 1.0, "track_no": 0.5,
    "search_rank": 0.5, "filename_title": 2.0, "filename_artist": 1.0, "consensus": 0.6,
}
#: Differences of length in seconds, and what an identical one is worth.
IDENTICAL, PERFECT, ZERO, VETO, BOOST, FLOOR = 0.1, 10.0, 90.0, 180.0, 1.5, 0.1
#: Strong fingerprint, least fingerprint, margin to a rival, and the discounts of a close one.
STRONG, LEAST, MARGIN, SAME_SONG, OTHER_SONG = 0.8, 0.5, 12.0, 0.95, 0.80


def duration_signal(observed: Column, candidate: Column) -> tuple[Column, Column, Column]:
    """Score, weight and veto. Without an observed length: nulls; without the candidate's: half at half weight."""
    have, other = F.coalesce(observed, F.lit(0)) > 0, F.coalesce(candidate, F.lit(0)) > 0
    d = F.abs(observed - candidate)
    close = F.when(d <= PERFECT, 1.0).when(d >= ZERO, 0.0).otherwise(1.0 - (d - PERFECT) / (ZERO - PERFECT))
    factor = F.when(d <= IDENTICAL, BOOST).when(d <= PERFECT, BOOST - (d - IDENTICAL) / (PERFECT - IDENTICAL) * (BOOST - 1.0)).otherwise(FLOOR + (1 - FLOOR) * close)
    w = WEIGHTS["duration"]
    return F.when(have, F.when(other, close).otherwise(0.5)), F.when(have, F.when(other, w * factor).otherwise(w / 2)), F.coalesce(have & other & (d > VETO), F.lit(False))


def weighted_score(signals: list[tuple[Column, Column]], veto: Column | None = None, title: Column | None = None, excused: Column | None = None) -> Column:
    """0 to 100 with one decimal: the mean of the scores that aren't null by weight, and two kinds of veto on it."""
    total = weight = F.lit(0.0)
    for s, w in signals:
        total, weight = total + F.coalesce(s * w, F.lit(0.0)), weight + F.when(s.isNotNull(), w).otherwise(0.0)
    raw = F.when(weight > 0, total / weight * 100).otherwise(0.0)
    if veto is not None:
        raw = F.when(veto, raw * 0.35).otherwise(raw)
    if title is not None:
        bad = F.coalesce(title < 0.5, F.lit(False)) & ~(excused if excused is not None else F.lit(False))
        raw = F.when(bad, raw * 0.55).otherwise(raw)
    return F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 1)


def ceiling(fingerprint: Column, source: Column, unverified: Column, from_tags: Column, evidence: Column) -> Column:
    """The most confidence that the evidence allows; the first case that holds."""
    return (
        F.when(fingerprint >= 0.9, 99.0).when(fingerprint >= 0.6, 95.0).when(source == "existing-id", 96.0).when(source == "filename", 45.0)
        .when(unverified, 75.0).when(~from_tags, 60.0).when(evidence >= 6, 93.0).when(evidence >= 4, 85.0).otherwise(72.0)
    )


def rank(df: DataFrame, group: list[str], score: str, strong: Column, seq: list[str], k: int = 5) -> DataFrame:
    """The k best candidates of a group: strong fingerprints first, then by score, ties as they were generated."""
    w = Window.partitionBy(*group).orderBy(strong.desc(), F.desc_nulls_last(score), *seq)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rated(df: DataFrame, group: list[str], score: str, same_song: Column, settled: Column, most: Column) -> DataFrame:
    """confidence of ranked candidates: the leader is discounted by how close the second is; no one is above the leader."""
    all_ = Window.partitionBy(*group)
    second = F.max(F.when(F.col("rank") == 2, F.col(score))).over(all_)
    first = F.max(F.when(F.col("rank") == 1, F.col(score))).over(all_)
    rival = F.when(F.col("rank") == 1, second).otherwise(first)
    margin = F.when(F.col("rank") == 1, F.greatest(F.col(score) - rival, F.lit(0.0))).otherwise(0.0)
    floor = F.when(same_song, SAME_SONG).otherwise(OTHER_SONG)
    factor = F.when(rival.isNotNull() & (margin < MARGIN) & ~settled, floor + margin / MARGIN * (1 - floor)).otherwise(1.0)
    out = df.withColumn("confidence", F.bround(F.least(F.col(score) * factor, most), 1))
    return out.withColumn("confidence", F.least("confidence", F.max(F.when(F.col("rank") == 1, F.col("confidence"))).over(all_)))


def cascade(left: DataFrame, right: DataFrame, key: list[str], attempts: list[Callable[[DataFrame, DataFrame], DataFrame]], together: int = 3) -> DataFrame:
    """What the first attempt (from 1) that finds anything for a row finds.

    So many attempts at a time are made of the same rows, of which the first that succeeds counts; the next ones are
    made of what these left over. One by one, each would hold all before it twice in its plan.
    """
    out, rest = None, left
    w = Window.partitionBy(*key)
    for at in range(0, len(attempts), together):
        hits = None
        for n, attempt in enumerate(attempts[at : at + together], at + 1):
            one = attempt(rest, right).withColumn("attempt", F.lit(n))
            hits = one if hits is None else hits.unionByName(one)
        hits = hits.withColumn("__first", F.min("attempt").over(w)).where("attempt = __first").drop("__first")
        out = hits if out is None else out.unionByName(hits)
        if at + together < len(attempts):
            rest = rest.join(hits.select(*key).distinct(), key, "left_anti")
    return out


def within(left: DataFrame, right: DataFrame, value: str, other: str, most: float) -> DataFrame:
    """Range join: rows of right whose value is within `most`, by bins of that width, so it is an equi-join first."""
    near = right.withColumn("__bin", F.explode(F.array(*(F.floor(F.col(other) / most) + d for d in (-1, 0, 1)))))
    return left.withColumn("__bin", F.floor(F.col(value) / most)).join(near, "__bin").where(F.abs(F.col(value) - F.col(other)) <= most).drop("__bin")


def vote(df: DataFrame, group: list[str], choice: str, seq: list[str], least: int = 3, share: float = 0.5) -> DataFrame:
    """A group's most frequent choice, ties to the one seen first; votes, share, and whether it carries.

    First seen is the smallest seq among the rows of a choice; of those with the same seq, the smallest choice. A group is
    counted before it is shuffled to one place.
    """
    first = F.min(F.struct(*seq)).alias("first")
    counts = df.where(F.col(choice).isNotNull()).groupBy(*group, choice).agg(F.count("*").alias("votes"), first)
    w = Window.partitionBy(*group)
    ranked = counts.withColumn("matched", F.sum("votes").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("votes"), "first", choice)))
    ratio = F.col("votes") / F.col("matched")
    return ranked.where("r = 1").select(*group, choice, "votes", "matched", ratio.alias("share"), ((F.col("matched") >= least) & (ratio >= share)).alias("carried"))


def consensus(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """How often each key is credited in its group, over the most that any is."""
    counts = df.groupBy(*group, key).agg(F.count("*").alias("credited"))
    most = F.max("credited").over(Window.partitionBy(*group))
    return counts.withColumn("most", most).withColumn("ratio", F.col("credited") / most)


def merged(df: DataFrame, key: list[str], seq: str, source: str, length: str, unverified: str, signal: str) -> DataFrame:
    """Candidates of one key as one: the first one's source, with each later one that differs from the text so far appended
    by "+"; the first length there is; unverified only if all are; signals by name, the first of each."""
    rows = F.sort_array(F.collect_list(F.struct(seq, source, length, unverified, signal)))
    g = df.groupBy(*key).agg(rows.alias("rows"), F.bool_and(unverified).alias(unverified), F.count("*").alias("n"))
    lengths = F.filter(F.transform("rows", lambda r: r[length]), lambda x: x.isNotNull() & (x > 0))
    signals = F.array_join(F.array_distinct(F.transform("rows", lambda r: r[signal])), ",")
    return g.select(*key, "n", joined_sources(F.transform("rows", lambda r: r[source])).alias(source), F.get(lengths, F.lit(0)).alias(length), unverified, signals.alias("signals"))


def joined_sources(sources: Column) -> Column:
    """The sources in order, each appended by "+" unless it is the text so far."""
    return F.aggregate(sources, F.lit(""), lambda s, x: F.when(s == "", x).when(s == x, s).otherwise(F.concat(s, F.lit("+"), x)))


def cluster_cut(df: DataFrame, group: list[str], credited: Column, gap_s: Column, seq: list[str], keep: int = 8) -> DataFrame:
    """The recordings of a fingerprint's result that are kept: those of the most credited artist first, then by how far
    their lengths are off (unknown ones last), then in order."""
    w = Window.partitionBy(*group).orderBy(F.when(F.coalesce(credited, F.lit(False)), 0).otherwise(1), F.coalesce(gap_s, F.lit(float("inf"))), *seq)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def with_rival(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """rival_ of each column: what the second has for the first, and the first for all others; null for a lone one."""
    w = Window.partitionBy(*group)
    of = lambda r: F.max(F.when(F.col("rank") == r, F.struct(*columns))).over(w)
    out = df.withColumn("__rival", F.when(F.col("rank") == 1, of(2)).otherwise(of(1)))
    return out.withColumns({f"rival_{c}": F.col(f"__rival.{c}") for c in columns}).drop("__rival")


def same_text(a: Column, b: Column) -> Column:
    """Whether two values would be written the same, but for case and the space around them; null is empty."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return plain(a) == plain(b)


def seat_score(same_id: Column, likeness: Column, gap_s: Column, same_number: Column) -> Column:
    """How well a track fits an entry of a release's list: 2 if it is the very recording; else the likeness of the titles
    (0.6 at least), a quarter of which an equal length stands for where both are known, and more for the same number.
    Null: it doesn't."""
    known = gap_s.isNotNull() & (gap_s < float("inf"))
    score = F.when(known, likeness * 0.75 + F.when(gap_s <= 3, 0.25).otherwise(0.0)).otherwise(likeness)
    score = score + F.when(F.coalesce(same_number, F.lit(False)), 0.15).otherwise(0.0)
    return F.when(F.coalesce(same_id, F.lit(False)), 2.0).when((likeness >= 0.6) & (score >= 0.55), score)


def agreed(confidence: Column, share: Column) -> Column:
    """A seated track's confidence: raised by its folder's agreement, though never over 97."""
    return F.bround(F.least(F.lit(97.0), confidence + 8.0 * share), 1)


def agreed_album(confidence: Column, share: Column) -> Column:
    """The album field's."""
    return F.bround(F.least(F.lit(98.0), F.greatest(F.coalesce(confidence, F.lit(0.0)), 70 + 25 * share)), 1)


def rescued(ranked: DataFrame, group: list[str], album: str, equivalent: Column, depth: int = 4) -> DataFrame:
    """The winner of each group: the first if it has an album, else the best of the next ones (up to depth in all) that
    has one and is the same recording, at the first one's confidence; else the first all the same."""
    fit = (F.col("rank") == 1) | (equivalent & (F.col("rank") <= depth))
    has = F.coalesce(F.col(album) != "", F.lit(False))
    order = F.row_number().over(Window.partitionBy(*group).orderBy(F.when(fit & has, 0).when(F.col("rank") == 1, 1).otherwise(2), "rank"))
    first = F.max(F.when(F.col("rank") == 1, F.col("confidence"))).over(Window.partitionBy(*group))
    return ranked.withColumns({"__o": order, "__c": first}).where("__o = 1").withColumn("confidence", F.col("__c")).drop("__o", "__c")


def passes(confidence: Column, least: Column | float) -> Column:
    """Whether a match is applied: at least so sure."""
    return F.coalesce(confidence >= least, F.lit(False))


def _greedy(pairs: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """Greedy matching of each group in one task, which reads its pairs in order and holds the sides that are taken."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used_l, used_r = None, set(), set()
        for batch in batches:
            keep = []
            for key, a, b in zip(zip(*(batch[c] for c in group)), batch[left], batch[right]):
                if key != now:
                    now, used_l, used_r = key, set(), set()
                free = a not in used_l and b not in used_r
                keep.append(free)
                if free:
                    used_l.add(a)
                    used_r.add(b)
            yield batch[keep]

    rows = pairs.select(*group, left, right, score)
    ordered = rows.repartition(*group).sortWithinPartitions(*group, F.desc(score), left, right)
    return ordered.mapInPandas(take, rows.schema)


def seats(pairs: DataFrame, group: list[str], left: str, right: str, score: str, small: int = 100_000) -> DataFrame:
    """Greedy one-to-one matching within each group: the best pair whose two sides are both free, again and again; of equal
    scores the one with the smaller left, then right. Pairs without a score are not matched.

    Groups of up to `small` pairs are worked through in a task each. In larger ones, all pairs that are the best of both
    their sides are taken at once, since greedy takes each of them whatever comes before; what they leave is dealt with
    again, until it is small. A round is two aggregations by side and an anti-join, written once; nothing is gathered by group.
    """
    from lyrebird.operators import steps

    rest, out = pairs.select(*group, left, right, score).where(F.col(score).isNotNull()), None
    while True:
        rest = steps.written(rest)
        size = rest.groupBy(*group).agg(F.count("*").alias("__n"))
        large = size.where(F.col("__n") > small).select(*group)
        if large.isEmpty():
            last = _greedy(rest, group, left, right, score)
            return last if out is None else out.unionByName(last)
        done = _greedy(rest.join(large, group, "left_anti"), group, left, right, score)
        many = rest.join(large, group, "left_semi")
        best = F.min(F.struct((-F.col(score)).alias("less"), F.col(left).alias("l"), F.col(right).alias("r"))).alias("__best")
        by_left, by_right = many.groupBy(*group, left).agg(best), many.groupBy(*group, right).agg(best)
        pick = lambda df: df.select(*group, F.col("__best.l").alias(left), F.col("__best.r").alias(right), (-F.col("__best.less")).alias(score))
        taken = steps.written(pick(by_left).join(pick(by_right).select(*group, left, right), [*group, left, right], "left_semi"))
        found = steps.written(done).unionByName(taken)
        out = found if out is None else out.unionByName(found)
        rest = many.join(taken.select(*group, left), [*group, left], "left_anti").join(taken.select(*group, right), [*group, right], "left_anti")


def best_release(df: DataFrame, group: list[str], official: Column, kind: Column, secondary: Column, date: Column, seq: list[str]) -> DataFrame:
    """The release that names a recording: official, an album before an EP before others, no compilation, the earliest."""
    order = F.when(kind == "album", 0).when(kind == "ep", 1).otherwise(2)
    w = Window.partitionBy(*group).orderBy(F.when(official, 0).otherwise(1), order, F.when(secondary, 1).otherwise(0), F.coalesce(F.nullif(date, F.lit("")), F.lit("9999")), *seq)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


#: How far each field is trusted once a candidate is chosen.
RELIABILITY = {
    "title": 1.00, "artist": 0.98, "album": 0.92, "album_artist": 0.92, "track_no": 0.88, "track_total": 0.85, "disc_no": 0.90, "disc_total": 0.85, "date": 0.80, "year": 0.80,
    "isrc": 0.95, "composer": 0.70, "genre": 0.55, "compilation": 0.90,
}
NUMBERS = ("track_no", "track_total", "disc_no", "disc_total")


def field_confidence(overall: Column, reliability: float, likeness: Column | None = None, number_agrees: Column | None = None) -> Column:
    """overall by the field's reliability; likeness over 0.92 halves the gap to 100, under 0.5 takes a quarter off, and a
    track number that agrees takes two fifths of the gap."""
    c = overall * reliability
    if likeness is not None:
        c = F.when(likeness > 0.92, c + (100 - c) * 0.5).when(likeness < 0.5, c * 0.75).otherwise(c)
    if number_agrees is not None:
        c = F.when(number_agrees, c + (100 - c) * 0.4).otherwise(c)
    return F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c)), 1)


def proposal(own: dict[str, Column], chosen: dict[str, Column], various_id: str = "", various_name: str = "Various Artists", only_missing: bool = False) -> dict[str, Column]:
    """The fields to write, from a file's own and its chosen candidate's: genre and composer stay where the candidate has
    none, an album artist is never empty, compilations by various artists get their name, the year follows the date.
    only_missing keeps the file's own fields that aren't blank."""
    from lyrebird.functions.text import year_of

    blank = lambda c: F.coalesce(c.cast("string").isin("", "0", "false"), F.lit(True))
    first = lambda *cs: F.coalesce(*(F.when(~blank(c), c) for c in cs))
    out = dict(chosen)
    for name in ("genre", "composer"):
        if name in own:
            out[name] = first(chosen[name], own[name]) if name in chosen else own[name]
    if "album_artist" in chosen:
        out["album_artist"] = first(chosen["album_artist"], chosen["artist"], own["album_artist"])
        if various_id and "album_artist_id" in chosen:
            out["album_artist"] = F.when(F.coalesce(chosen["compilation"] & (chosen["album_artist_id"] == various_id), F.lit(False)), various_name).otherwise(out["album_artist"])
    if "date" in chosen and "year" in chosen:
        out["year"] = F.when(~blank(chosen["year"]), chosen["year"]).otherwise(year_of(chosen["date"]))
    return {k: first(own[k], v) if only_missing and k in own else v for k, v in out.items()}
