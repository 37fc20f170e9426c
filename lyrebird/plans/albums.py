"""Queries on folders of one album, fingerprints and chains of renames, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lyrebird.operators import catalog, layout, moves, steps
from lyrebird.plans import identify
from lyrebird.plans.catalogue import query, t


@query("""WITH f AS (SELECT l_orderkey AS folder, l_linenumber AS seq, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN s % 4 > 0 THEN folder * 10 + CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END END AS release, 'album ' || (p % 5) AS album, CASE WHEN p % 2 = 0 THEN 1990 + p % 20 END AS year, 50.0 + p % 40 AS confidence, (p % 100)::DOUBLE AS album_confidence FROM f),
v AS (SELECT folder, release, count(*) AS votes, min(seq) AS first FROM m WHERE release IS NOT NULL GROUP BY 1, 2),
w AS (SELECT folder, release AS won, votes / files AS share FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY votes DESC, first) AS r FROM v) JOIN (SELECT folder, count(*) AS files FROM m GROUP BY 1) USING (folder) WHERE r = 1 AND files >= 3 AND votes / files >= 0.5),
o AS (SELECT folder, arg_min(album, seq) AS album, arg_min(coalesce(year, -1), seq) AS year FROM m JOIN w USING (folder) WHERE release = won GROUP BY 1),
e AS (SELECT folder, seq AS entry, p, CASE WHEN seq % 2 = 0 THEN seq + 10 ELSE 0 END AS track_no, row_number() OVER (PARTITION BY folder, p ORDER BY seq) AS n FROM f WHERE seq % 5 <> 0),
s AS (SELECT m.*, w.won, w.share, o.album AS own_album, nullif(o.year, -1) AS own_year, e.entry, e.track_no FROM (SELECT *, row_number() OVER (PARTITION BY folder, p ORDER BY seq) AS n FROM m) m LEFT JOIN (e JOIN w USING (folder) JOIN o USING (folder)) ON m.folder = e.folder AND m.p = e.p AND m.n = e.n)
SELECT folder, seq, CASE WHEN entry IS NULL THEN release ELSE won END AS release, CASE WHEN entry IS NULL THEN album ELSE own_album END AS album, CASE WHEN entry IS NULL THEN year ELSE own_year END AS year, CASE WHEN entry IS NULL THEN 1 ELSE coalesce(nullif(track_no, 0), 1) END::INTEGER AS track_no,
  CASE WHEN entry IS NULL THEN confidence ELSE round_even(least(97, confidence + 8 * share), 1) END::DOUBLE AS confidence, CASE WHEN entry IS NULL THEN album_confidence ELSE round_even(least(98, greatest(album_confidence, 70 + 25 * share)), 1) END::DOUBLE AS album_confidence,
  entry AS seat, entry IS NOT NULL AND (release IS NULL OR release <> won) AS moved FROM s""")
def consolidate_folders(spark, d):
    """Lines as files of their order's folder; a release lists the parts of all its order's lines but each fifth."""
    f = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("folder"), F.col("l_linenumber").alias("seq")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    f = steps.stored(f, "files")
    release = F.when(F.col("s") % 4 > 0, F.col("folder") * 10 + F.when(F.col("s") % 3 == 0, 1).otherwise(0))
    files = f.select(
        "folder", F.concat_ws("/", "folder", "seq").alias("path"), "seq", release.alias("release"), F.col("p").alias("recording"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("track_no"), F.lit(0.0).alias("duration_s"), (50.0 + F.col("p") % 40).alias("confidence"),
        (F.col("p") % 100).cast("double").alias("album_confidence"), F.concat(F.lit("album "), (F.col("p") % 5).cast("string")).alias("album"), F.when(F.col("p") % 2 == 0, 1990 + F.col("p") % 20).alias("year"),
    )
    number = F.when(F.col("seq") % 2 == 0, F.col("seq") + 10).otherwise(0)
    entries = f.where("seq % 5 <> 0").select(F.explode(F.array(F.col("folder") * 10, F.col("folder") * 10 + 1)).alias("release"), F.col("seq").alias("entry"), F.col("p").alias("recording"), F.lit(None).cast("string").alias("title"), number.alias("track_no"), F.lit(None).cast("double").alias("length_s"))
    return identify.consolidate(files, entries).select("folder", "seq", "release", "album", "year", "track_no", "confidence", "album_confidence", "seat", "moved")


@query("""WITH g AS (SELECT * FROM (SELECT user_id, event_id, event_id % 97 AS id, least(1, value / 20) AS score, dense_rank() OVER (PARTITION BY user_id ORDER BY least(1, value / 20) DESC, event_id) AS place FROM events) WHERE place <= 5 AND score >= 0.5),
h AS (SELECT g.*, lower(p_brand) AS brand, lower(p_type) AS kind FROM g JOIN part ON p_partkey = id),
c AS (SELECT user_id, name, count(*) AS n FROM (SELECT DISTINCT user_id, event_id, unnest([brand, kind]) AS name FROM h) GROUP BY 1, 2),
r AS (SELECT *, n / max(n) OVER (PARTITION BY user_id) AS ratio FROM (SELECT user_id, regexp_replace(name, '[^a-z0-9]+', ' ', 'g') AS name, n FROM c))
SELECT h.user_id::VARCHAR AS path, id, score AS s_print, greatest(a.ratio, b.ratio) AS s_consensus FROM h JOIN r a ON a.user_id = h.user_id AND a.name = regexp_replace(brand, '[^a-z0-9]+', ' ', 'g') JOIN r b ON b.user_id = h.user_id AND b.name = kind""")
def print_candidates(spark, d):
    """Events as results of their user's fingerprint, a recording each, whose artists are a part's brand and type."""
    e = t(spark, d, "events")
    prints = e.select(F.col("user_id").cast("string").alias("print"), F.col("event_id").alias("result"), F.least(F.lit(1.0), F.col("value") / 20).alias("score"), (F.col("event_id") % 97).alias("id"))
    ref = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("r_title"), F.col("p_brand").alias("r_artist"), F.array("p_brand", "p_type").alias("r_artists"), F.col("p_type").alias("r_album"), F.lit(None).cast("int").alias("r_track_no"), F.lit(None).cast("double").alias("r_length_s"), F.col("p_partkey").alias("r_seq"))
    files = e.select(F.col("user_id").cast("string").alias("path"), F.col("user_id").cast("string").alias("print")).distinct().withColumn("duration_s", F.lit(None).cast("double"))
    return identify.by_print(files, prints, ref).select("path", "id", "s_print", "s_consensus")


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'click' AS moves, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM events)
SELECT user_id || '/0' AS origin, user_id || '/' || count(*) FILTER (moves) AS path, max(event_id) FILTER (NOT moves)::VARCHAR AS tags, count(*) AS entries FROM e GROUP BY user_id""")
def rename_chains(spark, d):
    """A file a user, moved by each click and tagged by all other events: as long chains of renames as a user has clicks."""
    e = t(spark, d, "events")
    clicks = F.count(F.when(F.col("event_type") == "click", 1)).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    path = lambda n: F.concat_ws("/", F.col("user_id"), n)
    moved = F.col("event_type") == "click"
    e = e.withColumn("n", F.coalesce(clicks, F.lit(0)))
    log = e.select(
        F.col("event_id").alias("seq"), F.lit(1).alias("batch"), F.when(moved, "move").otherwise("tags").alias("op"), path(F.col("n")).alias("src"), F.when(moved, path(F.col("n") + 1)).alias("dest"),
        F.lit(None).cast("string").alias("before"), F.when(~moved, F.col("event_id").cast("string")).alias("after"), F.lit(True).alias("ok"),
    )
    found = moves.files(log)
    entries = found.groupBy("origin", "born").agg(F.count("*").alias("entries"))
    return moves.state_at(found).join(entries, ["origin", "born"]).select("origin", "path", "tags", "entries")


@query("""WITH f AS (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN '/m/a/' WHEN p_size > 20 THEN '/x/y/z/' ELSE '/m/' END || p_partkey || '.MP3' AS path, CASE WHEN p_partkey % 3 > 0 THEN p_brand || '/' || p_type END AS aa, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS a,
  CASE WHEN p_partkey % 5 > 0 THEN p_type ELSE '' END AS album, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS title, p_size % 4 AS track, p_size % 3 AS disc, CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 0 END AS discs, CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_size % 3 END AS year FROM part),
n AS (SELECT k, CASE WHEN path LIKE '/m/a/%' THEN '/m/a' WHEN path LIKE '/m/%' THEN '/m' ELSE '/x/y' END || '/' || replace(coalesce(aa, a, 'Unknown Artist'), '/', '-') || '/' || coalesce(nullif(album, ''), 'Unknown Album') || coalesce(' (' || year || ')', '') || '/' AS folder,
  CASE WHEN disc > 0 AND (discs > 1 OR (discs = 0 AND disc > 1)) THEN disc || '-' ELSE '' END AS d, CASE WHEN track > 0 THEN lpad(track::VARCHAR, 2, '0') ELSE '' END AS t, coalesce(title, k::VARCHAR) AS title FROM f WHERE title IS NOT NULL OR album <> ''),
o AS (SELECT k, folder, CASE WHEN t <> '' THEN d || t || ' - ' || title WHEN d <> '' THEN left(d, 1) || ' - ' || title ELSE title END AS name FROM n)
SELECT k AS p_partkey, folder || name || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END || '.mp3' AS planned FROM (SELECT *, row_number() OVER (PARTITION BY lower(folder), lower(name) ORDER BY k) AS r FROM o)""")
def plan_paths(spark, d):
    """Parts as files below two roots or none, with tags of which some are blank."""
    p, k, n = t(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    path = F.concat(F.when(n > 40, "/m/a/").when(n > 20, "/x/y/z/").otherwise("/m/"), k.cast("string"), F.lit(".MP3"))
    tag = {
        "album_artist": F.when(k % 3 > 0, F.concat("p_brand", F.lit("/"), "p_type")), "artist": F.when(k % 4 > 0, F.col("p_brand")), "album": F.when(k % 5 > 0, F.col("p_type")).otherwise(""),
        "title": F.when(k % 7 > 0, F.col("p_name")), "track_no": n % 4, "disc_no": n % 3, "disc_total": F.when(k % 6 == 0, 2).otherwise(0), "year": F.when(k % 2 == 0, 1990 + n % 3),
    }
    return layout.planned(p.withColumn("path", path), "path", "p_partkey", tag, "{album_artist}/{album}{year_suffix}", "{disc_prefix}{track:02d} - {title}", ["/m/a", "/m"]).select("p_partkey", "planned")


@query("SELECT count(*) FILTER (doc_id % 3 > 0) AS analysed, count(*) FILTER (doc_id % 3 > 0 AND (quality = 0 OR toxic = 1)) AS flagged FROM labels")
def flagged_count(spark, d):
    issues = F.filter(F.array(F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda i: i.isNotNull())
    return catalog.flagged(t(spark, d, "labels").select((F.col("doc_id") % 3 > 0).alias("analysed"), issues.alias("issues")), "analysed", "issues")
