"""Sources and sinks: media files below folders, key-value tables of JSON, and writers that replace a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of audio files, and folders that no scan enters (nor any whose name begins with a dot).
AUDIO = "mp3 flac m4a mp4 m4b ogg oga opus wma wav aiff aif".split()
SKIPPED = ("$RECYCLE.BIN", "System Volume Information", ".git", ".svn", "__pycache__", "@eaDir", ".Trash", ".Trashes", "#recycle", ".plexignore")
#: Files that go along with an album, and names of pictures among them.
COMPANIONS, PICTURES = "jpg jpeg png webp cue log m3u m3u8 nfo txt".split(), "jpg jpeg png webp".split()
PICTURE_NAMES = "cover folder front album albumart thumb".split()


def listing(files: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """The rows whose path is an audio file outside hidden and skipped folders. Folders down to root are never skipped."""
    p = F.regexp_replace(F.col(path), "^file:(//)?", "")
    below = F.when(p.startswith(root), F.substring(p, F.lit(len(root) + 1), F.char_length(p))).otherwise(p) if root else p
    skipped = "|".join(re.escape(x) for x in SKIPPED)
    return files.where(p.rlike(rf"(?i)\.({'|'.join(AUDIO)})$") & ~below.rlike(rf"/(\.[^/]*|{skipped})/") & ~p.rlike(r"/\._[^/]*$"))


def audio_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime and length of audio files; their content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return listing(files.select("path", "modificationTime", "length"), root=root.rstrip("/"))


def companion(name: Column) -> Column:
    """Whether a file goes along with its album: notes and lists do, pictures only under names that pictures of albums have."""
    suffix, stem = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)), F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return suffix.isin(*COMPANIONS) & (~suffix.isin(*PICTURES) | stem.isin(*PICTURE_NAMES))


def parsed(rows: DataFrame, value: str, schema: str) -> DataFrame:
    """Rows whose JSON parses, with its fields; unknown ones are dropped and missing ones null. What is no JSON object is a
    miss, as is null."""
    bad = F.try_parse_json(value).isNull() | ~F.ltrim(value).startswith("{")
    return rows.withColumn("__j", F.when(~F.coalesce(bad, F.lit(True)), F.from_json(value, schema))).where(F.col("__j").isNotNull()).select(*rows.columns, "__j.*")


def loaded(rows: DataFrame, error: Column, fields: list[str], seq: Column) -> DataFrame:
    """Rows of a scan in its order (seq), where one that can't be read stays, with status error, its message and no fields."""
    bad = error.isNotNull()
    return rows.withColumns({c: F.when(~bad, F.col(c)) for c in fields} | {"seq": seq, "status": F.when(bad, "error").otherwise("new"), "error": error})


def first_tag(*names: Column) -> Column:
    """The first that isn't blank once trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in names))


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: list[Column], path: str) -> None:
    """Write both, one row a key, to a new path; the caller swaps paths, so readers never see half a table."""
    from lyrebird.operators.ledger import latest

    latest(old.unionByName(new, allowMissingColumns=True), key, version).write.parquet(path)


def cleared(rows: DataFrame, path: str) -> None:
    """Replace the table at path by an empty one with the columns of rows."""
    rows.limit(0).write.mode("overwrite").parquet(path)
