"""Nested records of tracks: reference data flattened, matches chosen and edited, and small decisions on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One family of containers; sizes that a cover service offers.
MP4 = ("m4a", "mp4", "aac")
COVERS = (250, 500, 1200)


def credit(artists: Column) -> tuple[Column, Column]:
    """Names with their join phrases as one text, and the first artist's id, of an array of (name, joinphrase, id)."""
    name = F.array_join(F.transform(artists, lambda a: F.concat(F.coalesce(a["name"], F.lit("")), F.coalesce(a["joinphrase"], F.lit("")))), "")
    return F.nullif(F.trim(name), F.lit("")), F.get(artists, F.lit(0))["id"]


def tracklist(releases: DataFrame, key: str, media: str) -> DataFrame:
    """A row a track of nested media (position, tracks of (id, title, length)), with numbers and totals from 1."""
    discs = releases.select(key, F.size(media).alias("disc_total"), F.posexplode(media).alias("m", "medium"))
    tracks = discs.select(key, "disc_total", (F.col("m") + 1).alias("disc_no"), F.size("medium.tracks").alias("track_total"), F.posexplode("medium.tracks").alias("t", "track"))
    return tracks.select(key, "track.id", "track.title", seconds(F.col("track.length")).alias("length_s"), (F.col("t") + 1).alias("track_no"), "track_total", "disc_no", "disc_total")


def position(media: Column, recording: Column) -> Column:
    """track_no, track_total, disc_no and disc_total of a recording on a release, as a struct; null if it isn't there.

    media: position, track_count, track_offset and tracks of (position, number, recording_id). A medium without tracks, as
    searches give them, places the recording by its offset. A disc beyond the number of media tells that not all of them
    are known, so the total isn't either.
    """
    number = lambda c: F.nullif(F.regexp_substr(c.cast("string"), F.lit("[0-9]+")), F.lit("")).try_cast("int")

    def of(m: Column) -> Column:
        hit = F.get(F.filter(m["tracks"], lambda t: recording.isNull() | t["recording_id"].isNull() | (t["recording_id"] == recording)), F.lit(0))
        disc = F.coalesce(F.nullif(m["position"], F.lit(0)), F.lit(1))
        bare = F.coalesce(F.size(m["tracks"]), F.lit(0)) <= 0
        at = F.when(hit.isNotNull(), F.coalesce(number(hit["position"]), number(hit["number"]))).when(bare, m["track_offset"] + 1)
        total = F.when(disc <= F.size(media), F.size(media))
        return F.when(hit.isNotNull() | (bare & m["track_offset"].isNotNull()), F.struct(at.cast("int").alias("track_no"), m["track_count"].alias("track_total"), disc.alias("disc_no"), total.alias("disc_total")))

    return F.get(F.filter(F.transform(media, of), lambda p: p.isNotNull()), F.lit(0))


def recording_tags(recording: Column, release: Column, various_id: str = "") -> Column:
    """The tags that a recording (id, title, artists, isrcs) has on a release (id, title, artists, date, group_id,
    first_date, media): its own artist is the album's where the release names none."""
    from lyrebird.functions.text import year_of

    artist, artist_id = credit(recording["artists"])
    album_artist, album_artist_id = credit(release["artists"])
    date = F.coalesce(F.nullif(release["date"], F.lit("")), F.nullif(release["first_date"], F.lit("")))
    at = position(release["media"], recording["id"])
    return F.struct(
        recording["title"].alias("title"), artist.alias("artist"), artist_id.alias("artist_id"), F.get(recording["isrcs"], F.lit(0)).alias("isrc"), release["title"].alias("album"), F.coalesce(album_artist, artist).alias("album_artist"),
        F.coalesce(album_artist_id == various_id, F.lit(False)).alias("compilation"), date.alias("date"), year_of(date).alias("year"), *(at[c].alias(c) for c in ("track_no", "track_total", "disc_no", "disc_total")),
    )


def reshaped(recordings: Column) -> Column:
    """Recordings as a fingerprint service gives them (id, title, duration in seconds, artists), as the catalogue has them."""
    return F.transform(recordings, lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), F.floor(r["duration"] * 1000).cast("long").alias("length"), r["artists"].alias("artists")))


def signal_score(signals: Column, name: str) -> Column:
    """The first signal of a name's score, else 0."""
    return F.coalesce(F.get(F.filter(signals, lambda s: s["name"] == name), F.lit(0))["score"], F.lit(0.0))


def art(rows: DataFrame, releases: DataFrame, groups: DataFrame, release: str, group: str, picture: str) -> DataFrame:
    """Each row with its release's picture, else with that of the release's group; both tables have one row a key."""
    own = releases.select(release, F.col(picture).alias("__own"))
    other = groups.select(group, F.col(picture).alias("__other"))
    return rows.join(own, release, "left").join(other, group, "left").withColumn(picture, F.coalesce("__own", "__other")).drop("__own", "__other")


def seconds(milliseconds: Column) -> Column:
    """0 and null are unknown."""
    return F.nullif(milliseconds, F.lit(0)) / 1000.0


def gap(a: Column, b: Column) -> Column:
    """Difference of two lengths; infinite where one is unknown or 0."""
    known = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    return F.when(known, F.abs(a - b).cast("double")).otherwise(F.lit(float("inf")))


def summary(*parts: Column) -> Column:
    """The parts that aren't blank, joined by commas."""
    return F.concat_ws(", ", *(F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts))


def choose(rows: DataFrame, at: Column, index: int) -> DataFrame:
    """Rows (candidates of (confidence, tags), chosen_index, confidence, proposed, field_confidence): candidate `index`
    chosen where `at` holds and there is one; every known field then has its confidence."""
    hit = at & (F.size("candidates") > index) if index >= 0 else F.lit(False)
    best = F.get("candidates", F.lit(index))
    new = {
        "chosen_index": F.lit(index), "confidence": best["confidence"], "proposed": best["tags"],
        "field_confidence": F.transform_values("field_confidence", lambda k, v: best["confidence"]),
    }
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def edit(rows: DataFrame, at: Column, values: dict[str, Column]) -> DataFrame:
    """Fields of proposed set by hand where `at` holds; each submitted one, even an unknown one, has confidence 100.

    Without a proposal the current fields are the start, by hand and sure.
    """
    proposed = F.coalesce(F.col("proposed"), F.col("current"))
    known = {f.name for f in rows.schema["proposed"].dataType.fields}
    for name, value in values.items():
        if name in known:
            proposed = proposed.withField(name, value)
    sure = F.create_map(*(F.lit(x) for name in values for x in (name, 100.0)))
    old = F.coalesce(F.col("field_confidence"), F.create_map().cast("map<string,double>"))
    kept = F.map_filter(old, lambda k, v: ~k.isin(list(values)))
    new = {
        "field_confidence": F.map_concat(kept, sure), "confidence": F.when(F.col("proposed").isNull(), 100.0).otherwise(F.col("confidence")),
        "method": F.when(F.col("proposed").isNull(), "manual").otherwise(F.col("method")), "proposed": proposed,
    }
    if "notes" in rows.columns:
        new["notes"] = F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.array(F.lit("Edited by hand.")))
    return rows.withColumns({c: F.when(at, v).otherwise(F.col(c)) for c, v in new.items()})


def library_root(path: Column, roots: list[str]) -> Column:
    """The first root that holds the path."""
    out = F.lit(None).cast("string")
    for r in reversed(roots):
        out = F.when(path.startswith(r.rstrip("/") + "/"), r).otherwise(out)
    return out


def companions(files: DataFrame, moves: DataFrame, folder: str, destination: str, seq: str, audio_left: str) -> DataFrame:
    """Where the other files of a folder go: with its first move, copied rather than moved while audio stays behind."""
    w = Window.partitionBy(folder).orderBy(seq)
    first = moves.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(folder, destination)
    return files.join(first, folder).withColumn("action", F.when(F.col(audio_left), "copy").otherwise("move"))


def same_format(a: Column, b: Column) -> Column:
    family = lambda c: F.when(F.lower(c).isin(*MP4), "m4a").otherwise(F.lower(c))
    return family(a) == family(b)


def cover_size(most: Column) -> Column:
    """The largest size on offer up to most, else the smallest."""
    sizes = F.array(*(F.lit(x) for x in COVERS))
    return F.coalesce(F.array_max(F.filter(sizes, lambda s: s <= most)), F.lit(COVERS[0]))


def conflicts(kind: Column, running: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whether two kinds of jobs must not run together, either way round."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ((kind == a) & (running == b)) | ((kind == b) & (running == a))
    return out


def eligible(title: Column, artist: Column, album: Column) -> Column:
    """A proposal that says anything."""
    said = lambda c: F.coalesce(c != "", F.lit(False))
    return said(title) | said(artist) | said(album)


def album_key(artist: Column, album: Column, folder: Column) -> Column:
    """What files of one album share: artist and album without case, or else their folder."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(clean(album) != "", F.concat_ws("|", clean(artist), clean(album))).otherwise(folder)
