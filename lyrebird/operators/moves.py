"""The log of changes by file rather than by path: which file each entry is about, through chains of renames.

An entry names a path, and files move. Of each entry the file is found that lay at its path then: the last move to the path
before it, unless a later one led away from there. So moves point to moves, and pointer jumping leads each to its file's
first path in as many rounds as the logarithm of the longest chain. From there everything is by file: where it is and what its
tags are after any batch, and what undoing a batch does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.operators import steps

#: Operations that make a file of their own at dest, which undoing leaves in place.
MADE = ("copy", "convert", "cover")


def files(entries: DataFrame) -> DataFrame:
    """entries with origin and born: the first path of the file that each is about, and the seq of the entry that made it or
    of the one that took the path's earlier file away (0: it was there before the log).

    entries: seq (distinct), op (move, tags, copy, convert or cover), src, dest and ok, and whatever else. Entries that aren't
    ok changed nothing, and are about the file that lay there. A path that is moved to while a file lies there is the
    mover's from then on. Null paths are about no file: origin is null.
    """
    log = steps.written(entries)
    ok = F.coalesce("ok", F.lit(False))
    moved = log.where(ok & (F.col("op") == "move") & F.col("dest").isNotNull() & F.col("src").isNotNull())
    away = moved.select(F.col("src").alias("path"), "seq", F.struct(F.lit(None).cast("long").alias("by"), F.col("seq").alias("born")).alias("event"))
    here = moved.select(F.col("dest").alias("path"), "seq", F.struct(F.col("seq").alias("by"), F.lit(None).cast("long").alias("born")).alias("event"))
    made = log.where(ok & F.col("op").isin(*MADE) & F.col("dest").isNotNull()).select(F.col("dest").alias("path"), "seq", F.struct(F.lit(None).cast("long").alias("by"), F.col("seq").alias("born")).alias("event"))
    asked = log.where("src IS NOT NULL").select(F.col("src").alias("path"), "seq", F.lit(None).cast("struct<by:bigint,born:bigint>").alias("event"))
    # What holds at a path before an entry: entries of the same seq come after the question.
    rows = away.unionByName(here).unionByName(made).unionByName(asked)
    before = F.last("event", ignorenulls=True).over(Window.partitionBy("path").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1))
    at = rows.withColumn("before", before).where("event IS NULL")
    at = at.select("seq", F.col("before.by").alias("by"), F.when(F.col("before.by").isNull(), F.col("path")).alias("origin"), F.when(F.col("before.by").isNull(), F.coalesce("before.born", F.lit(0))).alias("born"))
    at = steps.written(at)
    # Moves point to moves until each has an origin; each round doubles how far a pointer leads.
    move = at.join(moved.select("seq"), "seq", "left_semi")
    while True:
        move = steps.written(move)
        if move.where("by IS NOT NULL").isEmpty():
            break
        up = move.select(F.col("seq").alias("by"), F.col("by").alias("next"), F.col("origin").alias("o"), F.col("born").alias("b"))
        going = move.where("by IS NOT NULL").drop("origin", "born").join(up, "by").select("seq", F.col("next").alias("by"), F.col("o").alias("origin"), F.col("b").alias("born"))
        move = move.where("by IS NULL").unionByName(going)
    top = move.select(F.col("seq").alias("by"), F.col("origin").alias("o"), F.col("born").alias("b"))
    found = at.join(top, "by", "left").select("seq", F.coalesce("origin", "o").alias("origin"), F.coalesce("born", "b").alias("born"))
    return log.join(found, "seq", "left")


def state_at(of_files: DataFrame, last_seq: int | None = None) -> DataFrame:
    """origin, born, path and tags of each file of files() after the entry last_seq (all, if None): where its last move led,
    and what its last tags entry set (column after; null: it has none). Files of failed entries alone are as they were."""
    rows = of_files.where("origin IS NOT NULL")
    if last_seq is not None:
        rows = rows.where(F.col("seq") <= last_seq)
    ok = F.coalesce("ok", F.lit(False))
    last = lambda op, c: F.max_by(c, F.when(ok & (F.col("op") == op) & (F.col(c).isNotNull() if op == "move" else F.lit(True)), F.col("seq")))
    out = rows.groupBy("origin", "born").agg(last("move", "dest").alias("path"), last("tags", "after").alias("tags"))
    return out.withColumn("path", F.coalesce("path", "origin"))


def undo(of_files: DataFrame, batch: int, undone: bool = False) -> DataFrame:
    """seq, step, op, origin, outcome, path and tags of what undoing a batch does, last entry first (step from 1).

    A move is restored to its src if no other batch has moved the file since; tags are restored to before, where the file is
    then, which path says. Copies and the like stay in place, entries that name no file are skipped, and so is all of a batch
    that was undone already. Entries that aren't ok are left out. taken: another file lies at the src, so the file comes back
    beside it, under a free name (destinations() of the ledger gives it).
    """
    ok = of_files.where(F.coalesce("ok", F.lit(False)))
    mine = ok.where(F.col("batch") == batch)
    others = ok.where((F.col("batch") != batch) & (F.col("op") == "move")).groupBy("origin", "born").agg(F.max("seq").alias("other"))
    rows = mine.join(others, ["origin", "born"], "left")
    free = F.col("origin").isNotNull() & (F.col("other").isNull() | (F.col("other") < F.col("seq")))
    moved = F.when(F.col("op") == "move", F.when(free, "restored").otherwise("skipped")).when((F.col("op") == "tags") & F.col("before").isNotNull() & F.col("origin").isNotNull(), "restored").otherwise("skipped")
    now = state_at(of_files).select("origin", "born", F.col("path").alias("now"))
    # Where the file is when an entry's turn comes: at the src of the earliest move that was put back before it, else where it is now.
    later = Window.partitionBy("origin", "born").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = F.last(F.when((F.col("op") == "move") & free, F.col("src")), ignorenulls=True).over(later)
    rows = rows.join(now, ["origin", "born"], "left").withColumns({"outcome": F.lit("skipped") if undone else moved, "back": F.lit(None).cast("string") if undone else back})
    rows = rows.withColumn("path", F.when(F.col("outcome") == "restored", F.coalesce("back", "now")))
    holders = now.select(F.col("now").alias("path"), F.col("origin").alias("__o"), F.col("born").alias("__b")).withColumn("held", F.lit(True))
    put = rows.where("op = 'move' AND outcome = 'restored'").select("seq", "origin", "born", F.col("src").alias("path")).join(holders, "path")
    put = put.where("NOT (origin = __o AND born = __b)").select("seq", "held").distinct()
    step = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("seq")))
    out = rows.join(put, "seq", "left").withColumn("step", step)
    return out.select("seq", "step", "op", "origin", "outcome", "path", F.when((F.col("op") == "tags") & (F.col("outcome") == "restored"), F.col("before")).alias("tags"), F.coalesce("held", F.lit(False)).alias("taken"))
