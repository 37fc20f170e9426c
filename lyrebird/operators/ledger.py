"""A change ledger: batches and entries, replay, pruning, upserts by version, and collision-free destinations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batches(heads: DataFrame, entries: DataFrame, key: str, started: str, limit: int = 50) -> DataFrame:
    """The newest batches with their number of entries, 0 if there are none."""
    counts = entries.groupBy(key).agg(F.count("*").alias("entries"))
    return heads.join(counts, key, "left").withColumn("entries", F.coalesce("entries", F.lit(0))).orderBy(F.desc(started), key).limit(limit)


def replay(entries: DataFrame, group: list[str], seq: str, ok: Column, skipped: Column) -> DataFrame:
    """Entries to undo, last first: step numbers them, and outcome says what becomes of each."""
    step = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(seq)))
    return entries.where(ok).withColumn("step", step).withColumn("outcome", F.when(skipped, "skipped").otherwise("restored"))


def pruned(heads: DataFrame, entries: DataFrame, key: str, started: str, keep: int) -> DataFrame:
    """The entries of the newest `keep` batches."""
    return entries.join(heads.orderBy(F.desc(started), key).limit(keep).select(key), key, "left_semi")


def latest(rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """One row a key: the highest version. An upsert is a union and this."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*(v.desc() for v in version)))).where("__r = 1").drop("__r")


def fresh(rows: DataFrame, created: Column, now: Column, ttl: Column) -> DataFrame:
    """Rows that aren't older than ttl."""
    return rows.where(now - created <= ttl)


def merge_scan(old: DataFrame, new: DataFrame, key: str, version: str, kept: list[str]) -> DataFrame:
    """The rows after a scan: of a key with an unchanged version the `kept` columns stay, else they are dropped."""
    o = old.select(key, F.col(version).alias("__v"), *(F.col(c).alias(f"__{c}") for c in kept), F.lit(True).alias("__old"))
    n = new.select(key, version, F.lit(True).alias("__new"))
    same = F.coalesce(F.col("__v") == F.col(version), F.lit(False))
    stays = F.col("__new").isNull() | same
    state = F.when(F.col("__new").isNull(), "untouched").when(F.col("__old").isNull(), "added").when(same, "kept").otherwise("replaced")
    return o.join(n, key, "full").select(key, F.coalesce(version, "__v").alias(version), *(F.when(stays, F.col(f"__{c}")).alias(c) for c in kept), state.alias("state"))


def destinations(rows: DataFrame, folder: str, name: str, suffix: str, seq: str) -> DataFrame:
    """dest: name and suffix, with " (n)" where the folder has it already in any case, in the order of seq.

    Numbers go on from 2 without an end, so no two rows of a folder ever share a destination. A numbered name can itself
    be another row's, but only that of one with the same stem: these few are worked through in order, a stem at a time,
    and all others are numbered by a window.
    """
    stem = F.struct(F.col(folder), F.lower(F.regexp_replace(F.col(name), r"( \(\d+\))+$", "")), F.lower(F.col(suffix)))
    marked = rows.withColumns({"__stem": stem, "__own": F.col(name).rlike(r" \(\d+\)$")})
    mixed = marked.groupBy("__stem").agg(F.bool_or("__own").alias("__mixed"))
    marked = marked.join(mixed, "__stem")
    number = F.row_number().over(Window.partitionBy(folder, F.lower(F.col(name)), F.lower(F.col(suffix))).orderBy(seq))
    plain = marked.where("NOT __mixed").withColumn("__n", number)
    numbered = F.when(F.col("__n") > 1, F.concat(F.lit(" ("), F.col("__n").cast("string"), F.lit(")"))).otherwise("")
    plain = plain.withColumn("dest", F.concat(F.col(name), numbered, F.col(suffix)))
    fields, names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), rows.columns

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        g, taken, after, out = g.sort_values(seq, kind="stable"), set(), {}, []
        for n, s in zip(g[name], g[suffix]):
            dest, key = f"{n}{s}", f"{n}{s}".lower()
            k = after.get(key, 2)
            while dest.lower() in taken:
                dest, k = f"{n} ({k}){s}", k + 1
            after[key] = k
            taken.add(dest.lower())
            out.append(dest)
        return g[names].assign(dest=out)

    odd = marked.where("__mixed").groupBy("__stem").applyInPandas(assign, f"{fields}, dest string")
    return plain.select(*rows.columns, "dest").unionByName(odd)


def resolved(entries: DataFrame, marks: DataFrame, key: str, seq: str) -> DataFrame:
    """Entries of an append-only log with what later marks say of them: ok and error of the last mark, else their own."""
    last = marks.groupBy(key).agg(F.max_by(F.struct("ok", "error"), seq).alias("__m"))
    of = lambda c: F.when(F.col("__m").isNotNull(), F.col(f"__m.{c}")).otherwise(F.col(c))
    return entries.join(last, key, "left").withColumns({"ok": of("ok"), "error": of("error")}).drop("__m")


def purged(rows: DataFrame, created: Column, now: Column, most: Column) -> DataFrame:
    """What is left when rows older than most are thrown away."""
    return rows.where(created >= now - most)


def removed(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows without those of the keys, and the rows that go: no more than there are of the keys."""
    return rows.join(keys.select(key), key, "left_anti"), rows.join(keys.select(key), key, "left_semi")


def renamed(rows: DataFrame, moves: DataFrame, key: str, new: str) -> DataFrame:
    """Rows under their new keys (moves: key and new, one row a key), which replace any that were there before."""
    moved = rows.join(moves.select(key, F.col(new).alias("__new")), key).withColumn(key, F.col("__new")).drop("__new")
    gone = moves.select(key).unionByName(moved.select(key))
    return rows.join(gone, key, "left_anti").unionByName(moved.select(*rows.columns))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with {names}, compiled to one expression; blanks are empty, and the separators around them tidied."""
    import re

    parts = []
    for text, name, width in re.findall(r"([^{}]*)(?:\{(\w+)(?::0(\d)d)?\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            v = F.coalesce(values[name].cast("string"), F.lit(""))
            parts.append(F.when(v == "", "").otherwise(F.lpad(v, F.greatest(F.lit(int(width)), F.char_length(v)), F.lit("0"))) if width else v)
    s = F.regexp_replace(F.concat(*parts), r"\s*-\s*-\s*", " - ")
    return F.trim(F.regexp_replace(s, r"\s{2,}", " "), F.lit(" -_."))
