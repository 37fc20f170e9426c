"""Text functions: normalising, similarity, safe names, path guesses and small parsers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bracketed remarks that say nothing about what a title names.
REMARKS = (
    r"official\s+(?:music\s+)?video|official\s+audio|lyrics?\s*video|audio|video|hd|hq|4k|remaster(?:ed)?(?:\s*\d{4})?"
    r"|explicit|clean|album\s+version|radio\s+edit|single\s+version|bonus\s+track|free\s+download"
)
REMARK = rf"\s*[(\[{{]\s*(?:{REMARKS})\s*[)\]}}]"
GUEST = r"\s*[(\[]?\s*(?:feat\.?|ft\.?|featuring)\s+[^)\]]*[)\]]?"
ARTICLES = ("the ", "a ", "an ")
#: Characters of names that file systems refuse, and what reads well in their place.
REPLACED = {"/": "-", "\\": "-", ":": " -", "|": "-", "<": "(", ">": ")", '"': "'", "?": "", "*": ""}
RESERVED = "CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]"


def normalise(c: Column, drop_articles: bool = False, drop_guests: bool = False) -> Column:
    """For comparison: without bracketed remarks, punctuation, case and doubled spaces; "&" is "and".

    All in Spark expressions, so accents stay; normalise_unicode() folds them too.
    """
    s = F.regexp_replace(F.coalesce(c, F.lit("")), f"(?iU){REMARK}", " ")
    if drop_guests:
        s = F.regexp_replace(s, f"(?iU){GUEST}", " ")
    s = F.regexp_replace(F.replace(F.lower(s), F.lit("&"), F.lit(" and ")), r"(?U)[^\w\s]", " ")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.regexp_replace(s, "^(?:the|a|an) ", "") if drop_articles else s


def fold(text: str | None, drop_articles: bool = False, drop_guests: bool = False) -> str:
    """The same of one string, with compatibility forms and accents folded."""
    s = re.sub(REMARK, " ", unicodedata.normalize("NFKC", text or ""), flags=re.I)
    if drop_guests:
        s = re.sub(GUEST, " ", s, flags=re.I)
    s = "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x)).lower()
    s = " ".join(re.sub(r"[^\w\s]", " ", s.replace("&", " and ")).split())
    article = next((a for a in ARTICLES if s.startswith(a)), "") if drop_articles else ""
    return s[len(article) :]


@F.pandas_udf(T.StringType())
def normalise_unicode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        folded = {x: fold(x) for x in s.unique()}
        yield s.map(folded) if len(s) else s


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with bit-parallel rows; a shared beginning is part of one."""
    start = 0
    for x, y in zip(a, b):
        if x != y:
            break
        start += 1
    a, b = a[start:], b[start:]
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for x in b:
        hit = rest & at.get(x, 0)
        rest = (rest + hit | rest - hit) & full
    return start + len(a) - rest.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / sum of the lengths; 1 for two empty strings."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words, and these with either side's own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if not both:
        return indel_ratio(only_x, only_y)
    if not only_x or not only_y:
        return 1.0
    # Shared words stand first: they are the subsequence that they have in common with either side.
    n = len(both)
    shared = max(2 * n / (2 * n + 1 + len(own)) for own in (only_x, only_y))
    return max(shared, 2 * (n + 1 + _common(only_x, only_y)) / (2 * n + 2 + len(only_x) + len(only_y)))


def likeness(a: str | None, b: str | None, **how: bool) -> float:
    """0 to 1; 0 if either is blank once normalised."""
    x, y = fold(a, **how), fold(b, **how)
    if not x or not y:
        return 0.0
    return 1.0 if x == y else max(indel_ratio(x, y), token_set_ratio(x, y))


def bare_title(c: Column) -> Column:
    """A title without the track number of one or two digits that a file's name put before it; null if there is none."""
    got = F.regexp_extract(F.trim(c), r"(?U)^\d{1,2}\s+([^\W\d].*)$", 1)
    return F.nullif(F.trim(got), F.lit(""))


def host_name(c: Column) -> Column:
    """The host of host:port in lower case; brackets of an address stay."""
    s = F.lower(F.trim(c))
    return F.when(s.startswith("["), F.concat(F.substring_index(s, "]", 1), F.lit("]"))).when(F.contains(s, F.lit(":")), F.regexp_replace(s, ":[^:]*$", "")).otherwise(s)


@F.pandas_udf(T.DoubleType())
def song_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """likeness() without featured guests and leading articles."""
    for a, b in pairs:
        known = {p: likeness(*p, drop_articles=True, drop_guests=True) for p in set(zip(a, b))}
        yield pd.Series([known[p] for p in zip(a, b)], index=a.index, dtype="float64")


@F.pandas_udf(T.DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """likeness() of two columns, each distinct pair once a batch."""
    for a, b in pairs:
        known = {p: likeness(*p) for p in set(zip(a, b))}
        yield pd.Series([known[p] for p in zip(a, b)], index=a.index, dtype="float64")


def safe_name(c: Column, longest: int = 120) -> Column:
    """One path component that all file systems take; blank: Unknown."""
    s = F.coalesce(c, F.lit(""))
    for old, new in REPLACED.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, r"[\x00-\x1f]", "")
    s = F.rtrim(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(". "))
    # Each step names the one before it once: where it is named twice it is worked out twice, and so is all that it names.
    s = F.regexp_replace(s, rf"(?i)^(?=(?:{RESERVED})(?:\.|$))", "_")
    s = F.rtrim(F.left(s, F.lit(longest)), F.lit(". "))
    return F.regexp_replace(s, r"^\z", "Unknown")


def year_of(c: Column) -> Column:
    """The first 19dd or 20dd of a text."""
    return F.nullif(F.regexp_extract(c, r"(?:19|20)\d{2}", 0), F.lit("")).try_cast("int")


def first_int(c: Column) -> Column:
    """The first run of digits."""
    return F.regexp_substr(c, F.lit("[0-9]+")).try_cast("int")


def pair_of(c: Column) -> tuple[Column, Column]:
    """Both numbers of "3/12", split at the first slash; the second is null without one."""
    at = F.instr(c, "/")
    left = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    return first_int(left), F.when(at > 0, first_int(F.substring(c, at + 1, F.char_length(c))))


def hidden(c: Column, shown: int = 3) -> Column:
    """All but the last characters as asterisks."""
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.char_length(c) - shown, F.lit(0))), F.right(c, F.lit(shown)))


def clock(seconds: Column) -> Column:
    """m:ss."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def version_key(c: Column) -> Column:
    """A struct that sorts like the version does: one with a suffix after "-" or "+" comes before its release. Null if it
    is none."""
    c = F.trim(c)
    #: Fixed value: what a version looks like.
    m = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:[-+](.+))?$"
    part = lambda i: F.coalesce(F.regexp_extract(c, m, i).try_cast("int"), F.lit(0))
    pre = F.regexp_extract(c, m, 4)
    return F.when(c.rlike(m), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("release"), pre.alias("pre")))


def path_guess(path: Column, root: str | None = None) -> Column:
    """disc_no, track_no, artist, title, album, album_artist and year that a path suggests, as one struct.

    Four shapes of file names are tried in order. The folder is the album, with a year before or after it, and the one
    above it the artist; a folder of a numbered disc is stepped over. Files in root have neither, a folder below it no
    artist.
    """
    parts = F.split(path, "/")
    part = lambda k: F.coalesce(F.get(parts, F.size(parts) - k), F.lit(""))
    stem = F.trim(F.regexp_replace(part(1), r"(?<=.)\.[^.]*$", ""))
    # The shapes of file names and folders.
    shapes = (
        (r"^(\d{1,2})[-.](\d{1,3})\s*[-._)]\s*(.+)$", {"disc": 1, "track": 2, "title": 3}),
        (r"^(\d{1,3})\s*[-._)]\s*(.+?)\s+-\s+(.+)$", {"track": 1, "artist": 2, "title": 3}),
        (r"^(\d{1,3})\s*[-._)]\s*(.+)$", {"track": 1, "title": 2}),
        (r"^(.+?)\s+-\s+(.+)$", {"artist": 1, "title": 2}),
    )

    def found(what: str, otherwise: Column) -> Column:
        out = otherwise
        for shape, groups in reversed(shapes):
            got = F.regexp_extract(stem, shape, groups[what]) if what in groups else F.lit(None).cast("string")
            out = F.when(stem.rlike(shape), got).otherwise(out)
        return out

    none, bare = F.lit(None).cast("string"), lambda c: F.trim(c, F.lit(" -_."))
    disc_folder = r"(?i)^(?:cd|disc)\s*\d+$"
    below = F.size(F.split(F.substring(path, len(root.rstrip("/")) + 2, 1 << 20), "/")) - 1 if root else F.lit(99)
    after, before = r"^(.+?)\s*[(\[]((?:19|20)\d{2})[)\]]\s*$", r"^((?:19|20)\d{2})\s*[-._]\s*(.+)$"
    folder = part(2)
    own = F.when(folder.rlike(after), F.trim(F.regexp_extract(folder, after, 1))).when(folder.rlike(before), F.trim(F.regexp_extract(folder, before, 2)))
    own = own.when((folder != "") & ~folder.rlike(disc_folder), folder)
    year = F.when(folder.rlike(after), F.regexp_extract(folder, after, 2)).when(folder.rlike(before), F.regexp_extract(folder, before, 1))
    stepped = folder.rlike(disc_folder) & (F.size(parts) >= 4)
    album = F.when((below >= 2) & stepped, part(3)).otherwise(own)
    artist = F.when(below >= 2, F.nullif(F.when(stepped, part(4)).otherwise(part(3)), F.lit("")))
    return F.struct(
        found("disc", none).try_cast("int").alias("disc_no"), found("track", none).try_cast("int").alias("track_no"),
        bare(found("artist", none)).alias("artist"), F.when(stem.rlike("|".join(s for s, _ in shapes)), bare(found("title", none))).otherwise(stem).alias("title"),
        F.when(below >= 1, album).alias("album"), artist.alias("album_artist"), F.when(below >= 1, year).try_cast("int").alias("year"),
    )


def register(spark: SparkSession) -> None:
    """Make the functions that have no Spark expression usable in SQL: fold_text, similarity and song_similarity."""
    spark.udf.register("fold_text", normalise_unicode)
    spark.udf.register("similarity", similarity)
    spark.udf.register("song_similarity", song_similarity)
