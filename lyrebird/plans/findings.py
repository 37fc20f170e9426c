"""Queries for findings on signals and their containers, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lyrebird.operators import quality, signal
from lyrebird.plans.catalogue import query, t

_X = "SELECT vec_id, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS x FROM embeddings"


def _listed(rows, key, issues):
    """A row an issue."""
    return rows.select(key, F.explode(issues).alias("i")).select(key, "i.code", "i.severity")


def _codec():
    return F.element_at(F.array(*(F.lit(c) for c in ("mp3", "aac", "vorbis", "opus", "wma", "flac", "other"))), (F.col("p_partkey") % 7 + 1).cast("int"))


_FACTS = """SELECT p_partkey, ['mp3', 'aac', 'vorbis', 'opus', 'wma', 'flac', 'other'][(p_partkey % 7 + 1)::INTEGER] AS codec, (p_partkey % 5 * 60)::INTEGER AS kbps,
  (p_size * 1000)::INTEGER AS rate, (p_size % 3)::INTEGER AS channels, p_retailprice / 40 AS seconds FROM part"""


def _facts(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", _codec().alias("codec"), (F.col("p_partkey") % 5 * 60).cast("int").alias("kbps"), (F.col("p_size") * 1000).cast("int").alias("rate"), (F.col("p_size") % 3).cast("int").alias("channels"), (F.col("p_retailprice") / 40).alias("seconds"))


@query(f"""WITH f AS ({_FACTS}), l AS (SELECT *, codec <> 'flac' AND kbps > 0 AS lossy, CASE codec WHEN 'mp3' THEN 128 WHEN 'aac' THEN 96 WHEN 'vorbis' THEN 96 WHEN 'opus' THEN 64 ELSE 128 END AS a,
  CASE codec WHEN 'mp3' THEN 160 WHEN 'aac' THEN 128 WHEN 'vorbis' THEN 128 WHEN 'opus' THEN 96 ELSE 160 END AS b FROM f)
SELECT p_partkey, 'very_low_bitrate' AS code, 'high' AS severity FROM l WHERE lossy AND kbps < a UNION ALL SELECT p_partkey, 'low_bitrate', 'medium' FROM l WHERE lossy AND kbps >= a AND kbps < b
UNION ALL SELECT p_partkey, 'low_sample_rate', 'medium' FROM l WHERE rate > 0 AND rate < 44100 UNION ALL SELECT p_partkey, 'mono', 'info' FROM l WHERE channels = 1 UNION ALL SELECT p_partkey, 'very_short', 'info' FROM l WHERE seconds > 0 AND seconds < 30""")
def quality_container(spark, d):
    f = _facts(spark, d)
    return _listed(f, "p_partkey", quality.container(F.col("codec"), F.col("kbps"), F.col("rate"), F.col("channels"), F.col("seconds")))


@query("""SELECT p_partkey, round(CASE codec WHEN 'mp3' THEN CASE WHEN k <= 64 THEN 11.0 WHEN k <= 96 THEN 11 + (k - 64) * 4.5 / 32 WHEN k <= 128 THEN 15.5 + (k - 96) / 32 WHEN k <= 160 THEN 16.5 + (k - 128) / 32 WHEN k <= 192 THEN 17.5 + (k - 160) * 1.5 / 32 WHEN k <= 256 THEN 19 + (k - 192) * 0.8 / 64 WHEN k <= 320 THEN 19.8 + (k - 256) * 0.8 / 64 ELSE 20.6 END
  WHEN 'opus' THEN CASE WHEN k <= 64 THEN 16.0 WHEN k <= 96 THEN 16 + (k - 64) * 2.0 / 32 WHEN k <= 128 THEN 18 + (k - 96) * 1.5 / 32 WHEN k <= 192 THEN 19.5 + (k - 128) * 0.5 / 64 ELSE 20.0 END END::DOUBLE, 6) AS khz
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mp3' WHEN p_partkey % 3 = 1 THEN 'opus' ELSE 'flac' END AS codec, p_size * 8 AS k FROM part)""")
def quality_reach(spark, d):
    codec = F.when(F.col("p_partkey") % 3 == 0, "mp3").when(F.col("p_partkey") % 3 == 1, "opus").otherwise("flac")
    return t(spark, d, "part").select("p_partkey", F.round(quality.reach(codec, F.col("p_size") * 8), 6).alias("khz"))


@query("""WITH s AS (SELECT p_partkey, p_partkey % 2 = 0 AS whole, 44100 AS rate, 15.25 + p_size / 8 AS khz, 160 + p_size % 3 * 80 AS k FROM part), e AS (SELECT *, CASE WHEN NOT whole THEN CASE k WHEN 160 THEN 17.5 WHEN 240 THEN 19.6 ELSE 20.6 END - khz END AS short FROM s)
SELECT p_partkey, CASE WHEN whole AND khz < 19 THEN 'fake_lossless' WHEN whole THEN 'lossless_rolloff' WHEN short > 3 THEN 'transcode' ELSE 'possible_transcode' END AS code, CASE WHEN (whole AND khz < 19) OR short > 3 THEN 'high' ELSE 'medium' END AS severity
FROM e WHERE (whole AND khz < 20.5) OR short > 1.5""")
def quality_spectrum(spark, d):
    codec = F.when(F.col("p_partkey") % 2 == 0, "flac").otherwise("mp3")
    return _listed(t(spark, d, "part"), "p_partkey", quality.spectrum(codec, 160 + F.col("p_size") % 3 * 80, F.lit(44100), 15.25 + F.col("p_size") / 8))


@query(f"""WITH d AS (SELECT vec_id, idx, lead(x) OVER (PARTITION BY vec_id ORDER BY idx) - x AS d FROM ({_X})), b AS (SELECT *, least(idx // 16, (count(*) OVER (PARTITION BY vec_id)) // 16 - 1) AS b FROM d WHERE d IS NOT NULL),
m AS (SELECT vec_id, idx // 16 AS b, median(d) AS m FROM b WHERE idx // 16 = b GROUP BY ALL), s AS (SELECT vec_id, b, greatest(1.4826 * median(abs(d - m)), 1e-7) AS sigma FROM b JOIN m USING (vec_id, b) WHERE idx // 16 = b GROUP BY ALL),
j AS (SELECT *, lead(d) OVER (PARTITION BY vec_id ORDER BY idx) AS e, greatest(1.5 * sigma, 0.08) AS lim FROM b JOIN s USING (vec_id, b)),
k AS (SELECT vec_id, idx - lag(idx) OVER (PARTITION BY vec_id ORDER BY idx) AS gap FROM j WHERE abs(d) > lim AND sign(d) <> sign(e) AND abs(e) > lim * 0.5)
SELECT v.vec_id, count(k.vec_id) AS spikes, count(k.vec_id) FILTER (gap IS NULL OR gap > 1) AS events FROM embeddings v LEFT JOIN k USING (vec_id) GROUP BY 1""")
def quality_local_clicks(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", signal.doubles(F.col("embedding")).alias("s"))
    return e.select("vec_id", signal.local_clicks(F.col("s"), F.lit(40.0), 16, 1.5).alias("c")).select("vec_id", "c.spikes", "c.events")


@query("""SELECT p_partkey, 'clicks' AS code, CASE WHEN p_size / greatest(1, p_retailprice / 600) >= 15 THEN 'medium' ELSE 'low' END AS severity FROM part WHERE p_size >= 4""")
def quality_clicks(spark, d):
    return _listed(t(spark, d, "part"), "p_partkey", quality.clicks(F.col("p_size"), F.col("p_retailprice") / 10))


@query("""WITH s AS (SELECT p_partkey, p_size / 8 AS lead, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 3 END AS trail, p_size / 4 AS gap FROM part)
SELECT p_partkey, 'leading_silence' AS code, 'low' AS severity FROM s WHERE lead > 3 UNION ALL SELECT p_partkey, 'trailing_silence', 'low' FROM s WHERE trail > 10 UNION ALL SELECT p_partkey, 'dropout', CASE WHEN gap >= 10 THEN 'high' ELSE 'medium' END FROM s WHERE gap >= 2""")
def quality_silences(spark, d):
    p = F.col("p_size")
    return _listed(t(spark, d, "part"), "p_partkey", quality.silences(p / 8, F.when(F.col("p_partkey") % 4 != 0, p / 3), p / 4))


@query("""WITH s AS (SELECT p_partkey, p_size / 3 - 20 AS e, p_size % 5 AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 2 - 25 END AS s, p_retailprice / 10 AS dur, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice / 10 + p_size - 25 ELSE 0 END AS ref FROM part)
SELECT p_partkey, 'abrupt_end' AS code, 'medium' AS severity FROM s WHERE e > -10 AND k < 3 UNION ALL SELECT p_partkey, 'abrupt_start', 'low' FROM s WHERE s > -15
UNION ALL SELECT p_partkey, CASE WHEN ref - dur > 20 THEN 'truncated' WHEN ref - dur > 6 THEN 'short_duration' ELSE 'long_duration' END, CASE WHEN ref - dur > 20 THEN 'high' WHEN ref - dur > 6 THEN 'medium' ELSE 'info' END FROM s WHERE ref > 0 AND dur > 0 AND (ref - dur > 6 OR ref - dur < -20)""")
def quality_edges_and_length(spark, d):
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") / 3 - 20).alias("e"), (F.col("p_size") % 5).alias("k"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") / 2 - 25).alias("s"), (F.col("p_retailprice") / 10).alias("dur"), F.col("p_size").alias("n"))
    ref = F.when(F.col("p_partkey") % 6 != 0, F.col("dur") + F.col("n") - 25).otherwise(0)
    return _listed(p, "p_partkey", F.concat(quality.edges(F.col("e"), F.col("k"), F.col("s")), quality.length(ref, F.col("dur"))))


@query("""SELECT vec_id, 'fake_stereo' AS code, 'info' AS severity FROM embeddings WHERE vec_id % 3 = 0 AND len(embedding) > 0""")
def quality_fake_stereo(spark, d):
    s = t(spark, d, "embeddings").select("vec_id", signal.doubles(F.col("embedding")).alias("s"))
    other = F.when(F.col("vec_id") % 3 == 0, F.col("s")).otherwise(F.transform("s", lambda x: -x - 1e-3))
    return _listed(s, "vec_id", quality.channels(F.col("s"), other))


@query("""SELECT p_partkey, array_to_string(list_concat(list_filter(c, lambda x: x = 'high'), list_filter(c, lambda x: x = 'medium'), list_filter(c, lambda x: x = 'low'), list_filter(c, lambda x: x = 'info')), ',') AS severities
  FROM (SELECT p_partkey, [['info', 'high', 'low', 'medium'][(p_size % 4 + 1)::INTEGER], ['low', 'medium', 'high'][(p_partkey % 3 + 1)::INTEGER], 'low'] AS c FROM part)""")
def issue_rank(spark, d):
    from lyrebird.operators import catalog

    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (n + 1).cast("int"))
    one = lambda c: F.struct(c.alias("severity"))
    issues = F.array(one(pick(("info", "high", "low", "medium"), F.col("p_size") % 4)), one(pick(("low", "medium", "high"), F.col("p_partkey") % 3)), one(F.lit("low")))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.transform(catalog.by_severity(issues), lambda i: i["severity"]), ",").alias("severities"))


@query("""SELECT p_partkey, CASE f WHEN 's16' THEN 16 WHEN 's16p' THEN 16 WHEN 'fltp' THEN 32 WHEN 'dbl' THEN 64 ELSE 0 END::INTEGER AS bits, round(pow(10, -p_size / 20), 9) AS level FROM (SELECT *, ['s16', 's16p', 'fltp', 'dbl', 'u8'][(p_size % 5 + 1)::INTEGER] AS f FROM part)""")
def sample_depth_and_level(spark, d):
    f = F.element_at(F.array(*(F.lit(x) for x in ("s16", "s16p", "fltp", "dbl", "u8"))), (F.col("p_size") % 5 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", signal.bit_depth(f).alias("bits"), F.round(signal.from_decibels(-F.col("p_size")), 9).alias("level"))


@query()
def quality_report(spark, d):
    """All checks together on vectors as two channels of 32 samples a second; tests hold each against made-up signals."""
    e = t(spark, d, "embeddings")
    bad = F.when(F.col("vec_id") % 11 == 0, "damaged")
    rows = e.select(
        "vec_id", F.lit("mp3").alias("codec"), F.lit(128_000).alias("bitrate"), F.lit(None).cast("long").alias("size"), F.lit(32).alias("sample_rate"), F.lit(2).alias("channels"), F.lit(2.0).alias("duration_s"), F.lit(40.0).alias("reference_s"),
        F.col("embedding").alias("left"), F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).otherwise(F.reverse("embedding")).alias("right"), F.lit(None).cast("string").alias("no_tool"), bad.alias("probe_error"), F.lit(None).cast("string").alias("decode_error"),
    )
    return quality.analyse(rows, n_fft=16).select("vec_id", "quality.analysed", "quality.score", F.array_join(F.transform("quality.issues", lambda i: i["code"]), ",").alias("codes"), "quality.error")
