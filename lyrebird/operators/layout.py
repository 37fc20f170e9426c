"""Where files go once they are named by their tags: templates of folders and names, the root that they stay below, and
destinations that no two files share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.functions import text
from lyrebird.operators import ledger, steps, tracks

#: What a template may name (the numbers may have a width, as in {track:02d}), and the one that stands in
#: for a template that isn't valid.
NUMBERS = ("track", "track_total", "disc", "disc_total", "year")
TEXTS = ("album_artist", "artist", "album", "title", "genre", "disc_prefix", "year_suffix")
INSTEAD = "{album_artist}/{album}"


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem_of(path: Column) -> Column:
    """The name without its last suffix; a name that begins with its only dot has none."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]+$", "")


def suffix_of(path: Column) -> Column:
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1)


def folder_of(path: Column) -> Column:
    """What holds it: / and . of what has no name before its own."""
    up = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(~F.contains(path, F.lit("/")), F.lit(".")).when(up == "", F.lit("/")).otherwise(up)


def values(tag: dict[str, Column], path: Column) -> dict[str, Column]:
    """What each name of a template stands for, from columns of tags (missing ones are blank).

    Texts are made safe first, so a slash in a tag is no level of folders. An artist and an album artist stand in for each
    other; a file without a title has its stem. Discs are a prefix if there are several, or if there is a second one of
    nobody knows how many. 0 is blank for a number.
    """
    blank, null = F.lit(""), F.lit(None)
    said = lambda c: F.nullif(tag.get(c, null).cast("string"), blank)
    number = lambda c: F.nullif(F.coalesce(tag.get(c, null).cast("int"), F.lit(0)), F.lit(0))
    clean = lambda c, other: F.when(c.isNotNull(), text.safe_name(c)).otherwise(other)
    disc, discs, year = number("disc_no"), number("disc_total"), number("year")
    several = (F.coalesce(discs, F.lit(0)) > 1) | (discs.isNull() & (F.coalesce(disc, F.lit(0)) > 1))
    return {
        "album_artist": clean(F.coalesce(said("album_artist"), said("artist")), F.lit("Unknown Artist")), "artist": clean(F.coalesce(said("artist"), said("album_artist")), F.lit("Unknown Artist")),
        "album": clean(said("album"), F.lit("Unknown Album")), "title": clean(said("title"), stem_of(path)), "genre": clean(said("genre"), blank), "track": number("track_no"), "track_total": number("track_total"),
        "disc": disc, "disc_total": discs, "year": year, "disc_prefix": F.when(several & disc.isNotNull(), F.concat(disc.cast("string"), F.lit("-"))), "year_suffix": F.when(year.isNotNull(), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))),
    }


def valid(template: str) -> bool:
    """Whether all its braces are names that a template may have; a width is for numbers, and nothing else may follow a name."""
    left = re.sub(rf"\{{(?:{'|'.join(NUMBERS)})(?::0\dd)?\}}|\{{(?:{'|'.join(TEXTS)})\}}", "", template)
    return "{" not in left and "}" not in left


def components(template: str, named: dict[str, Column]) -> Column:
    """An array of a path's safe components; those that are blank go. Only the template's own slashes part them."""
    template = template if valid(template) else INSTEAD
    parts = [ledger.rendered(p, named) for p in template.split("/") if p]
    safe = F.transform(F.filter(F.array(*parts), lambda p: p != ""), lambda p: text.safe_name(p)) if parts else F.array()
    return safe.cast("array<string>")


def root_of(path: Column, roots: list[str]) -> Column:
    """The first of the roots that holds it, or two folders up."""
    return F.coalesce(tracks.library_root(path, roots), folder_of(folder_of(path)))


def planned(files: DataFrame, path: str, seq: str, tag: dict[str, Column], folder_template: str, file_template: str, roots: list[str], target: str | None = None) -> DataFrame:
    """files that have a title or an album, with `planned`: where each goes. Others have no row, as they aren't planned.

    tag: columns by the names album_artist, artist, album, title, genre, track_no, track_total, disc_no, disc_total, year.
    target: the root for all; without one it is root_of(). Files that would meet, in any case of letters, are numbered in the
    order of seq, which tells all files apart. Null paths have no row.
    """
    p = F.col(path)
    said = lambda c: F.coalesce(tag.get(c, F.lit(None)).cast("string") != "", F.lit(False))
    named = values(tag, p)
    root = F.rtrim(F.lit(target) if target is not None else root_of(p, roots), F.lit("/"))
    below = F.array_join(components(folder_template, named), "/")
    name = F.element_at(components(file_template, named), -1) if file_template.strip("/") else F.lit(None).cast("string")
    rows = files.where(p.isNotNull() & (said("title") | said("album"))).select("*", root.alias("__root"), below.alias("__below"), name.alias("__own"), stem_of(p).alias("__stem_of"), F.lower(suffix_of(p)).alias("__suffix"))
    top = F.when(F.col("__root") == ".", F.lit("")).otherwise(F.concat("__root", F.lit("/")))
    rows = rows.withColumn("__folder", F.when(F.col("__below") == "", top).otherwise(F.concat(top, "__below", F.lit("/"))))
    rows = rows.select(*files.columns, "__folder", F.lower("__folder").alias("__lower"), F.coalesce("__own", "__stem_of").alias("__name"), "__suffix")
    # Numbering reads its rows three times.
    rows = steps.stored(rows, "planned")
    out = ledger.destinations(rows, "__lower", "__name", "__suffix", seq)
    return out.select(*files.columns, F.concat("__folder", "dest").alias("planned"))
