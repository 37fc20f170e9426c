"""Tags and facts of media containers as columns: raw fields by container, and what a probe says, typed.

Decoding bytes is left to whoever reads the files; here, a row has its container's fields as a map of lists of texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyrebird.functions import text
from lyrebird.sources.files import first_tag

#: The kind of container by suffix.
KINDS = {"id3": ("mp3", "wav", "aiff", "aif"), "vorbis": ("flac", "ogg", "oga", "opus"), "mp4": ("m4a", "mp4", "m4b"), "asf": ("wma",)}
#: The fields of each container, those that are looked at in turn after one another.
FIELDS = {
    "id3": {
        "title": ["TIT2"], "artist": ["TPE1"], "album": ["TALB"], "album_artist": ["TPE2"], "date": ["TDRC", "TYER"], "genre": ["TCON"], "composer": ["TCOM"], "isrc": ["TSRC"],
        "compilation": ["TCMP"], "track": ["TRCK"], "disc": ["TPOS"], "art": ["APIC"],
    },
    "vorbis": {
        "title": ["TITLE"], "artist": ["ARTIST"], "album": ["ALBUM"], "album_artist": ["ALBUMARTIST", "ALBUM ARTIST", "ENSEMBLE"], "date": ["DATE", "YEAR", "ORIGINALDATE"], "genre": ["GENRE"], "composer": ["COMPOSER"],
        "isrc": ["ISRC"], "compilation": ["COMPILATION"], "track": ["TRACKNUMBER"], "track_total": ["TRACKTOTAL", "TOTALTRACKS"], "disc": ["DISCNUMBER"], "disc_total": ["DISCTOTAL", "TOTALDISCS"], "art": ["METADATA_BLOCK_PICTURE"],
    },
    "mp4": {
        "title": ["©nam"], "artist": ["©ART"], "album": ["©alb"], "album_artist": ["aART"], "date": ["©day"], "genre": ["©gen"], "composer": ["©wrt"], "isrc": ["----:com.apple.iTunes:ISRC"], "compilation": ["cpil"],
        "track": ["trkn"], "disc": ["disk"], "art": ["covr"],
    },
    "asf": {
        "title": ["Title"], "artist": ["Author"], "album": ["WM/AlbumTitle"], "album_artist": ["WM/AlbumArtist"], "date": ["WM/Year"], "genre": ["WM/Genre"], "composer": ["WM/Composer"], "isrc": ["WM/ISRC"],
        "track": ["WM/TrackNumber"], "disc": ["WM/PartOfSet"], "art": ["WM/Picture"],
    },
}
PLAIN = ("title", "artist", "album", "album_artist", "date", "genre", "composer", "isrc")


def kind_of(path: Column) -> Column:
    """The kind of container that a path's suffix tells; null for any other, which has no reader."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.lit(None).cast("string")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def _value(raw: Column, kind: str, field: str) -> Column:
    """The first value of the first of the field's keys that isn't blank; keys of comments may be in lower case."""
    keys = FIELDS[kind].get(field, [])
    if kind == "vorbis":
        keys = [k for key in keys for k in (key, key.lower())]
    return first_tag(*(F.get(F.try_element_at(raw, F.lit(k)), F.lit(0)) for k in keys)) if keys else F.lit(None).cast("string")


def tags(kind: Column, raw: Column) -> Column:
    """The fields of a container's raw ones, as a struct; of an unknown kind, all null and no art.

    Numbers may come with their totals ("3/12"); a zero is none in mp4. The year is the date's.
    """

    def of(k: str) -> Column:
        v = {f: _value(raw, k, f) for f in (*PLAIN, "compilation", "track", "track_total", "disc", "disc_total")}
        known = (lambda c: F.nullif(c, F.lit(0))) if k == "mp4" else (lambda c: c)
        numbers = {}
        for n in ("track", "disc"):
            own, total = text.pair_of(v[n])
            given = text.first_int(v[f"{n}_total"])
            numbers |= {f"{n}_no": known(own), f"{n}_total": F.coalesce(given, known(total)) if k != "vorbis" or n == "track" else given}
        if k == "asf":
            numbers |= {"track_total": F.lit(None).cast("int"), "disc_total": F.lit(None).cast("int")}
        has_art = F.coalesce(F.size(F.map_filter(raw, lambda key, x: F.lower(key).startswith(FIELDS[k]["art"][0].lower()) & (F.size(x) > 0))) > 0, F.lit(False))
        said = F.coalesce(~F.lower(v["compilation"]).isin("0", "", "false"), F.lit(False))
        return F.struct(*(v[f].alias(f) for f in PLAIN), *(numbers[n].alias(n) for n in ("track_no", "track_total", "disc_no", "disc_total")), text.year_of(v["date"]).alias("year"), said.alias("compilation"), has_art.alias("has_art"))

    none = F.struct(*(F.lit(None).cast("string").alias(f) for f in PLAIN), *(F.lit(None).cast("int").alias(n) for n in ("track_no", "track_total", "disc_no", "disc_total", "year")), F.lit(False).alias("compilation"), F.lit(False).alias("has_art"))
    out = none
    for k in FIELDS:
        out = F.when(kind == k, of(k)).otherwise(out)
    return out


_PROBE = "streams array<struct<codec_name:string,sample_rate:string,channels:string,bits_per_raw_sample:string,sample_fmt:string,bit_rate:string,duration:string>>, format struct<bit_rate:string,duration:string,format_name:string,size:string>"


def probe(value: Column) -> Column:
    """A probe's JSON as typed facts of its first stream and format; what is missing or no number is 0 or empty. Null if
    it isn't JSON at all."""
    j = F.from_json(value, _PROBE)
    s, f = F.get(j["streams"], F.lit(0)), j["format"]
    whole = lambda c: F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    plain = lambda c: F.coalesce(c, F.lit(""))
    seconds = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
    return F.when(
        F.try_parse_json(value).isNotNull(),
        F.struct(
            plain(s["codec_name"]).alias("codec"), whole(s["sample_rate"]).alias("sample_rate"), whole(s["channels"]).alias("channels"), whole(s["bits_per_raw_sample"]).alias("bits"), plain(s["sample_fmt"]).alias("sample_format"),
            whole(s["bit_rate"]).alias("stream_bitrate"), whole(f["bit_rate"]).alias("format_bitrate"), F.coalesce(seconds(f["duration"]), seconds(s["duration"]), F.lit(0.0)).alias("duration_s"),
            plain(f["format_name"]).alias("format_name"), whole(f["size"]).alias("size"),
        ),
    )
