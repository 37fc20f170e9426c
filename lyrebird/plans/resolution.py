"""Queries for resolving, deciding and keeping records, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lyrebird.functions import text
from lyrebird.operators import catalog, ledger, numbers, resolve, tracks
from lyrebird.plans import identify as ends
from lyrebird.plans.catalogue import query, t
from lyrebird.sources import files
from lyrebird.sources import tags as containers

# Candidates


@query("""WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, max(n) AS m FROM a GROUP BY 1),
r AS (SELECT l.*, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN n = m THEN 0 ELSE 1 END, CASE WHEN l_quantity > 5 THEN abs(l_quantity - 25) ELSE 1e9 END, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS place FROM lineitem l JOIN a USING (l_partkey, l_suppkey) JOIN m USING (l_partkey))
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, place::INTEGER AS place FROM r WHERE place <= 8""")
def cluster_order(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    credit = resolve.consensus(rows, ["l_partkey"], "l_suppkey")
    gap = F.when(F.col("l_quantity") > 5, F.abs(F.col("l_quantity") - 25).cast("double"))
    cut = resolve.cluster_cut(rows.join(credit, ["l_partkey", "l_suppkey"]), ["l_partkey"], F.col("ratio") == 1, gap, ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    return cut.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "place")


@query("""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS known FROM orders), i AS (SELECT o_orderkey, c_custkey AS id FROM f JOIN customer ON known = c_custkey),
p AS (SELECT l_orderkey, l_partkey AS id, l_discount * 10 AS score FROM lineitem WHERE l_discount * 10 >= 0.5), s AS (SELECT o_orderkey FROM f WHERE o_orderkey NOT IN (SELECT l_orderkey FROM p WHERE score >= 0.8))
SELECT o_orderkey, 'existing-id' AS source, id::BIGINT AS id FROM i UNION ALL SELECT DISTINCT l_orderkey, 'fingerprint', id FROM p UNION ALL SELECT o_orderkey, 'search', NULL FROM s""")
def strong_gate(spark, d):
    """An id that is known, fingerprints that aren't noise, and a search only where none of these is strong."""
    f = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("known"))
    by_id = f.join(t(spark, d, "customer").select(F.col("c_custkey").alias("known")), "known").select("o_orderkey", F.lit("existing-id").alias("source"), F.col("known").cast("long").alias("id"))
    heard = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("long").alias("id"), (F.col("l_discount") * 10).alias("score")).where(F.col("score") >= resolve.LEAST)
    rest = f.join(heard.where(F.col("score") >= resolve.STRONG).select("o_orderkey"), "o_orderkey", "left_anti")
    heard = heard.select("o_orderkey", F.lit("fingerprint").alias("source"), "id").distinct()
    return by_id.unionByName(heard).unionByName(rest.select("o_orderkey", F.lit("search").alias("source"), F.lit(None).cast("long").alias("id")))


_PICK = """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank, CASE WHEN l_quantity >= 20 THEN 'album ' || l_suppkey ELSE '' END AS album FROM lineitem"""


@query(f"""WITH r AS ({_PICK}), f AS (SELECT l_orderkey, l_returnflag AS flag, l_extendedprice AS c FROM r WHERE rank = 1),
o AS (SELECT r.*, c, row_number() OVER (PARTITION BY r.l_orderkey ORDER BY CASE WHEN (rank = 1 OR (l_returnflag = flag AND rank <= 4)) AND album <> '' THEN 0 WHEN rank = 1 THEN 1 ELSE 2 END, rank) AS o FROM r JOIN f USING (l_orderkey))
SELECT l_orderkey, rank::INTEGER AS rank, l_partkey, album, round(c / 1000, 6)::DOUBLE AS confidence FROM o WHERE o = 1""")
def enrich_rescue(spark, d):
    """The winner, or where that is on no album the best equivalent that is, at the winner's confidence."""
    rows = t(spark, d, "lineitem").withColumns({"album": F.when(F.col("l_quantity") >= 20, F.concat(F.lit("album "), F.col("l_suppkey").cast("string"))).otherwise(""), "confidence": F.round(F.col("l_extendedprice") / 1000, 6)})
    top = resolve.rank(rows, ["l_orderkey"], "l_extendedprice", F.lit(False), ["l_linenumber", "l_partkey", "l_suppkey"], 1 << 30)
    top = resolve.with_rival(top, ["l_orderkey"], ["l_returnflag"])
    same = (F.col("rank") > 1) & (F.col("l_returnflag") == F.col("rival_l_returnflag"))
    return resolve.rescued(top, ["l_orderkey"], "album", same).select("l_orderkey", "rank", "l_partkey", "album", "confidence")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS genre, CASE WHEN p_size % 5 = 0 AND p_partkey % 2 = 0 THEN 'Various Artists' WHEN p_size % 4 = 0 THEN p_brand ELSE p_name END AS album_artist,
  CASE WHEN p_size % 7 <> 0 THEN (1950 + p_size)::INTEGER WHEN p_size % 14 = 0 THEN NULL ELSE 1999 END AS year FROM part""")
def proposal(spark, d):
    p, n = t(spark, d, "part"), F.col("p_size")
    own = {"genre": F.col("p_type"), "album_artist": F.lit("own")}
    chosen = {
        "genre": F.when(n % 3 != 0, F.col("p_brand")).otherwise(""), "artist": F.col("p_name"), "album_artist": F.when(n % 4 == 0, F.col("p_brand")), "album_artist_id": F.when(n % 5 == 0, "various"),
        "compilation": F.col("p_partkey") % 2 == 0, "date": F.when(n % 14 != 0, "1999-02"), "year": F.when(n % 7 != 0, 1950 + n).otherwise(0),
    }
    out = resolve.proposal(own, chosen, various_id="various")
    return p.select("p_partkey", *(out[c].alias(c) for c in ("genre", "album_artist", "year")))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 = 0 AS same, l_quantity / 50 AS k, CASE WHEN l_suppkey % 3 <> 0 THEN l_tax * 100 END AS g, l_linenumber = 1 AS num FROM lineitem),
x AS (SELECT *, CASE WHEN g IS NULL THEN k ELSE k * 0.75 + CASE WHEN g <= 3 THEN 0.25 ELSE 0 END END + CASE WHEN num THEN 0.15 ELSE 0 END AS v FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((CASE WHEN same THEN 2 WHEN k >= 0.6 AND v >= 0.55 THEN v END)::DOUBLE, 6) AS fit FROM x""")
def seat_score(spark, d):
    rows = t(spark, d, "lineitem")
    fit = resolve.seat_score(F.col("l_partkey") % 50 == 0, (F.col("l_quantity") / 50).cast("double"), F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_tax") * 100).cast("double")), F.col("l_linenumber") == 1)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(fit, 6).alias("fit"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(97, l_quantity * 2 + 8 * l_discount * 10)::DOUBLE, 1) AS confidence, round(least(98, greatest(l_tax * 1000, 70 + 25 * l_discount * 10))::DOUBLE, 1) AS album FROM lineitem""")
def agreement_boost(spark, d):
    q, share = F.col("l_quantity").cast("double"), (F.col("l_discount") * 10).cast("double")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(resolve.agreed(q * 2, share), 1).alias("confidence"), F.round(resolve.agreed_album((F.col("l_tax") * 1000).cast("double"), share), 1).alias("album"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice / 5000 >= 70")
def confidence_gate(spark, d):
    return t(spark, d, "orders").where(resolve.passes(F.col("o_totalprice") / 5000, catalog.REVIEW)).select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 10 WHEN p_size > 12 THEN 5 ELSE 0 END::DOUBLE / 10 AS first_score FROM part""")
def first_signal(spark, d):
    n = F.col("p_size")
    one = lambda name, score: F.struct(F.lit(name).alias("name"), F.lit(score).alias("score"))
    signals = F.filter(F.array(one("title", 0.9), F.when(n > 40, one("print", 1.0)), F.when(n > 12, one("print", 0.5))), lambda s: s.isNotNull())
    return t(spark, d, "part").select("p_partkey", tracks.signal_score(signals, "print").alias("first_score"))


@query("""SELECT a.s_suppkey, b.s_suppkey AS other, a.s_nationkey = b.s_nationkey AS same FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1""")
def same_answer(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" Nation "), F.col("s_nationkey").cast("string")).alias("n"))
    other = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("other"), F.upper(F.trim("n")).alias("m"))
    return s.join(other, "s_suppkey").select("s_suppkey", "other", resolve.same_text(F.col("n"), F.col("m")).alias("same"))


@query()
def identify_parts(spark, d):
    """Every part is a file, and parts are the reference. Tests hold identify() against made-up libraries."""
    p = t(spark, d, "part")
    rows = p.select(
        F.concat(F.lit("/m/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.lpad((F.col("p_size") % 20 + 1).cast("string"), 2, "0"), F.lit(" - "), "p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".mp3")).alias("path"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("title"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("artist"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("album"),
        (F.col("p_size") % 20 + 1).cast("int").alias("track_no"), F.col("p_retailprice").cast("double").alias("duration_s"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey").cast("string")).alias("known_id"),
    )
    ref = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), (F.col("p_size") % 20 + 1).cast("int").alias("track_no"), F.col("p_retailprice").cast("double").alias("length_s"), F.col("p_partkey").alias("seq"))
    return ends.identify(rows, ref).select("path", "confidence", "chosen", "source")


# Records


@query("""SELECT conv_id, turn, role, CASE WHEN offs IS NULL THEN list_position(ids, conv_id * 100 + turn) ELSE offs + 1 END::INTEGER AS track_no, len(ids)::INTEGER AS track_total, disc::INTEGER AS disc_no, CASE WHEN disc <= 1 THEN 1 END::INTEGER AS disc_total
  FROM (SELECT DISTINCT conv_id, turn, role, CASE WHEN conv_id % 4 = 0 THEN turn END AS offs, conv_id % 3 + 1 AS disc FROM conversations) JOIN (SELECT conv_id, list(DISTINCT conv_id * 100 + turn ORDER BY conv_id * 100 + turn) AS ids FROM conversations GROUP BY 1) USING (conv_id)""")
def track_position(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    ids = c.groupBy("conv_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    track = lambda x, i: F.struct((i + 1).cast("string").alias("position"), F.lit(None).cast("string").alias("number"), x.alias("recording_id"))
    listed = F.when(F.col("conv_id") % 4 != 0, F.transform("ids", track))
    medium = F.struct((F.col("conv_id") % 3 + 1).cast("int").alias("position"), F.size("ids").alias("track_count"), F.when(F.col("conv_id") % 4 == 0, F.col("turn")).cast("int").alias("track_offset"), listed.alias("tracks"))
    rows = c.distinct().join(ids, "conv_id").withColumn("p", tracks.position(F.array(medium), F.col("id")))
    return rows.select("conv_id", "turn", "role", "p.*")


@query("""SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_brand || ' & ' || p_mfgr ELSE p_brand END AS artist, p_type AS album, CASE WHEN p_size % 3 = 0 THEN p_mfgr WHEN p_size % 2 = 0 THEN p_brand || ' & ' || p_mfgr ELSE p_brand END AS album_artist,
  p_size % 3 = 0 AND p_partkey % 2 = 0 AS compilation, CASE WHEN p_size % 4 = 0 THEN '1987' ELSE (1960 + p_size) || '-05' END AS date, CASE WHEN p_size % 4 = 0 THEN 1987 ELSE 1960 + p_size END::INTEGER AS year FROM (SELECT *, 'M' || p_size AS p_mfgr FROM (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part))""")
def recording_tags(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.concat(F.lit("M"), F.col("p_size").cast("string")).alias("m"))
    n = F.col("p_size")
    one = lambda name, join, i: F.struct(name.alias("name"), F.lit(join).alias("joinphrase"), i.alias("id"))
    artists = F.when(n % 2 == 0, F.array(one(F.col("p_brand"), " & ", F.lit("a")), one(F.col("m"), "", F.lit("b")))).otherwise(F.array(one(F.col("p_brand"), "", F.lit("a"))))
    various = F.when(F.col("p_partkey") % 2 == 0, "various").otherwise("one")
    media = F.array().cast("array<struct<position:int,track_count:int,track_offset:int,tracks:array<struct<position:string,number:string,recording_id:string>>>>")
    release = F.struct(F.lit("r").alias("id"), F.col("p_type").alias("title"), F.when(n % 3 == 0, F.array(one(F.col("m"), "", various))).alias("artists"), F.when(n % 4 != 0, F.concat((1960 + n).cast("string"), F.lit("-05"))).otherwise("").alias("date"), F.lit("1987").alias("first_date"), media.alias("media"))
    recording = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), artists.alias("artists"), F.array().cast("array<string>").alias("isrcs"))
    tags = p.select("p_partkey", tracks.recording_tags(recording, release, "various").alias("x"))
    return tags.select("p_partkey", *(f"x.{c}" for c in ("title", "artist", "album", "album_artist", "compilation", "date", "year")))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN c_name END, 'nation ' || c_nationkey) AS picture FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 2 = 0 UNION ALL
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN c_name END FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 2 = 1""")
def art_per_release(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_name")
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(c.select("o_custkey", "c_nationkey"), "o_custkey")
    groups = c.where("c_nationkey % 2 = 0").select("c_nationkey", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("picture")).distinct()
    return tracks.art(rows, c.where("o_custkey % 3 = 0").withColumnRenamed("c_name", "picture"), groups, "o_custkey", "c_nationkey", "picture").select("o_orderkey", "picture")


@query("""SELECT count(*) AS total, count(*) FILTER (c >= 92) AS high_bucket, count(*) FILTER (c >= 70 AND c < 92) AS review, count(*) FILTER (c < 70) AS low, count(*) FILTER (c IS NULL) AS unidentified, count(q) AS analysed,
  count(*) FILTER (s = 'applied') AS applied, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (q IS NOT NULL AND x = 1) AS issues_high, count(*) FILTER (q = 0) AS issues_medium, 0::BIGINT AS issues_low, count(*) FILTER (q IS NOT NULL AND doc_id % 7 = 0) AS issues_info,
  round(avg(100 - 15 * (1 - q) - 30 * x)::DOUBLE, 1) AS average FROM (SELECT doc_id, quality AS q, toxic AS x, CASE WHEN doc_id % 4 > 0 THEN n_chars % 101 END AS c, CASE WHEN doc_id % 5 = 0 THEN 'applied' WHEN doc_id % 5 = 1 THEN 'error' ELSE 'new' END AS s FROM documents LEFT JOIN labels USING (doc_id))""")
def library_stats(spark, d):
    from lyrebird.plans.catalogue import _issues

    rows = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("doc_id") % 5 == 0, "applied").when(F.col("doc_id") % 5 == 1, "error").otherwise("new")
    rows = rows.withColumns({"c": F.when(F.col("doc_id") % 4 > 0, F.col("n_chars") % 101), "s": status, "done": F.col("quality").isNotNull(), "issues": _issues()})
    return catalog.stats(rows.withColumn("points", catalog.score(catalog.penalty(F.col("issues")))), "c", "s", "done", "points", "issues")


@query("""SELECT outcome, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('ineligible')) o(outcome) LEFT JOIN (SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1) USING (outcome)""")
def report_by_outcome(spark, d):
    return catalog.tally(t(spark, d, "events"), F.col("event_type"), ("view", "click", "purchase", "ineligible"))


@query("SELECT o_custkey, (floor(sum(o_totalprice / 100))::BIGINT // 60) || ':' || lpad((floor(sum(o_totalprice / 100))::BIGINT % 60)::VARCHAR, 2, '0') AS length FROM orders GROUP BY 1")
def total_duration(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice") / 100).alias("s")).select("o_custkey", text.clock(F.col("s")).alias("length"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN false ELSE event_type <> 'error' END AS ok, CASE WHEN user_id % 3 = 0 THEN 'late ' || m END AS error FROM events LEFT JOIN (SELECT event_id, max(k) AS m FROM (SELECT event_id, unnest([1, 2]) AS k FROM events WHERE user_id % 3 = 0) GROUP BY 1) USING (event_id)""")
def journal_marks(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", (F.col("event_type") != "error").alias("ok"), F.lit(None).cast("string").alias("error"))
    marks = e.where("user_id % 3 = 0").select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("event_id", "k", F.lit(False).alias("ok"), F.concat(F.lit("late "), F.col("k").cast("string")).alias("error"))
    return ledger.resolved(e, marks, "event_id", "k").select("event_id", "ok", "error")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAYS")
def purge_by_age(spark, d):
    return ledger.purged(t(spark, d, "events"), F.col("ts"), F.lit("2024-01-30").cast("timestamp"), F.expr("INTERVAL 10 DAYS")).select("event_id")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS gone FROM customer")
def delete_by_key(spark, d):
    keys = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    left, gone = ledger.removed(t(spark, d, "customer").select("c_custkey"), keys, "c_custkey")
    return left.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))


@query("""WITH m AS (SELECT c_custkey AS k, c_custkey - 1 AS n FROM customer WHERE c_custkey % 10 = 0) SELECT coalesce(n, c_custkey) AS c_custkey, c_name FROM customer LEFT JOIN m ON k = c_custkey WHERE c_custkey NOT IN (SELECT n FROM m)""")
def rename_key(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    moves = c.where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_custkey") - 1).alias("new"))
    return ledger.renamed(c, moves, "c_custkey", "new")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):
    return t(spark, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name")


@query("""SELECT event_id, event_id // 10 * 10 AS k FROM events WHERE event_id % 10 IN (0, 5)""")
def json_bad_rows(spark, d):
    """Broken JSON, arrays and nulls are misses; an object without the field is a row with a null."""
    k = (F.floor(F.col("event_id") / 10) * 10).cast("long")
    good = F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "other": [1]}'))
    n = F.col("event_id") % 10
    value = F.when(n.isin(0, 5), good).when(n == 1, F.lit("{not json")).when(n == 2, F.lit("[1, 2]")).when(n == 3, F.lit("")).when(n == 4, F.lit('{"k": 1')).when(n == 6, F.lit("null"))
    return files.parsed(t(spark, d, "events").select("event_id", value.alias("v")), "v", "k long").select("event_id", "k")


@query("""SELECT path FROM (SELECT p_partkey, '/lib/' || ['a', '#recycle', 'node_modules', '.git', '@eaDir'][(p_size % 5 + 1)::INTEGER] || '/' || CASE WHEN p_partkey % 9 = 0 THEN '._' ELSE '' END || p_partkey || ['.m4b', '.OGA', '.aac', '.asf', '.Aif'][(p_partkey % 5 + 1)::INTEGER] AS path, p_size FROM part)
WHERE p_size % 5 IN (0, 2) AND p_partkey % 9 <> 0 AND p_partkey % 5 NOT IN (2, 3)""")
def file_listing_edges(spark, d):
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (n + 1).cast("int"))
    k = F.col("p_partkey")
    path = F.concat(F.lit("/lib/"), pick(("a", "#recycle", "node_modules", ".git", "@eaDir"), F.col("p_size") % 5), F.lit("/"), F.when(k % 9 == 0, "._").otherwise(""), k.cast("string"), pick((".m4b", ".OGA", ".aac", ".asf", ".Aif"), k % 5))
    return files.listing(t(spark, d, "part").select(path.alias("path")))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS url, CASE WHEN page_id % 3 = 0 THEN 'cannot read' END AS error, CASE WHEN page_id % 3 = 0 THEN 'error' ELSE 'new' END AS status, page_id AS seq FROM pages""")
def scan_rows_with_errors(spark, d):
    p = t(spark, d, "pages").select("page_id", "url")
    return files.loaded(p, F.when(F.col("page_id") % 3 == 0, "cannot read"), ["url"], F.col("page_id")).select("page_id", "url", "error", "status", "seq")


@query("""SELECT page_id, CASE WHEN contains(h, ':') THEN regexp_replace(h, ':[^:]*$', '') ELSE h END AS host FROM (SELECT page_id, lower(split_part(split_part(url, '://', 2), '/', 1)) || CASE WHEN page_id % 2 = 0 THEN ':8080' ELSE '' END AS h FROM pages)""")
def host_name(spark, d):
    h = F.concat(F.substring_index(F.substring_index("url", "://", -1), "/", 1), F.when(F.col("page_id") % 2 == 0, ":8080").otherwise(""))
    return t(spark, d, "pages").select("page_id", text.host_name(h).alias("host"))


@query(r"""SELECT p_partkey, nullif(regexp_extract(x, '^\d{1,2}\s+([A-Za-z].*)$', 1), '') AS title FROM (SELECT p_partkey, p_size || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' END || p_name AS x FROM part)""")
def bare_title(spark, d):
    x = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "").otherwise(" "), "p_name")
    return t(spark, d, "part").select("p_partkey", text.bare_title(x).alias("title"))


@query("""SELECT p_partkey, p_size % 6 IN (0, 3, 5) AS goes FROM part""")
def companion_files(spark, d):
    name = F.element_at(F.array(*(F.lit(x) for x in ("Cover.JPG", "holiday.png", "a.mp3", "disc.cue", "x", "list.m3u8"))), (F.col("p_size") % 6 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", files.companion(name).alias("goes"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, CASE p_partkey % 3 WHEN 1 THEN 'beta' WHEN 2 THEN 'rc1' ELSE '' END, p_partkey)::INTEGER AS place FROM part""")
def version_order(spark, d):
    n = F.col("p_partkey") % 3
    v = F.concat(F.lit("v1."), F.col("p_size").cast("string"), F.when(n == 1, "-beta").when(n == 2, "+rc1").otherwise(""))
    versions = t(spark, d, "part").select("p_partkey", text.version_key(v).alias("version"))
    return numbers.numbered(versions, [F.col("version"), F.col("p_partkey")], "place").select("p_partkey", F.col("place").cast("int").alias("place"))


@query("""SELECT o_orderkey, CASE WHEN n >= 2 THEN 'b' ELSE 'a' END AS title, CASE WHEN n >= 2 THEN 70.0 ELSE 90.0 END::DOUBLE AS confidence, CASE WHEN n >= 2 THEN 1 ELSE 0 END::INTEGER AS chosen_index FROM (SELECT o_orderkey, o_orderkey % 3 + 1 AS n FROM orders)""")
def choose_candidate(spark, d):
    tag = lambda x: F.struct(F.lit(x).alias("title"))
    one = lambda c, x: F.struct(F.lit(c).alias("confidence"), tag(x).alias("tags"))
    every = F.array(one(90.0, "a"), one(70.0, "b"), one(50.0, "c"))
    rows = t(spark, d, "orders").select("o_orderkey", F.slice(every, F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("candidates"), F.lit(0).alias("chosen_index"), F.lit(90.0).alias("confidence"), tag("a").alias("proposed"), F.create_map(F.lit("title"), F.lit(90.0)).alias("field_confidence"))
    return tracks.choose(rows, F.lit(True), 1).select("o_orderkey", "proposed.title", "confidence", "chosen_index")


@query("""SELECT p_partkey, p_size % 3 <> 0 OR p_partkey % 2 = 0 AS eligible, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) || '|' || lower(p_type) ELSE '/' || p_size END AS key, CASE WHEN p_size > 25 THEN '/m/a' ELSE '/m' END AS root, CASE WHEN p_size * 30 >= 1200 THEN 1200 WHEN p_size * 30 >= 500 THEN 500 ELSE 250 END::INTEGER AS cover FROM part""")
def small_decisions(spark, d):
    even, n = F.col("p_partkey") % 2 == 0, F.col("p_size")
    album = F.when(even, F.col("p_type"))
    path = F.when(n > 25, "/m/a/x.mp3").otherwise("/m/b/x.mp3")
    return t(spark, d, "part").select(
        "p_partkey", tracks.eligible(F.when(n % 3 != 0, F.col("p_name")).otherwise(""), F.lit(None).cast("string"), album).alias("eligible"), tracks.album_key(F.col("p_brand"), album, F.concat(F.lit("/"), n.cast("string"))).alias("key"),
        tracks.library_root(path, ["/m/a", "/m"]).alias("root"), tracks.cover_size(n * 30).alias("cover"),
    )


@query("""SELECT user_id, event_id, f.event_type AS destination, CASE WHEN user_id % 2 = 0 THEN 'copy' ELSE 'move' END AS action FROM events e JOIN (SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_type <> 'view' GROUP BY 1) f USING (user_id) WHERE e.event_type = 'view'""")
def companion_decision(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type")
    moves = e.where("event_type <> 'view'").select("user_id", "event_id", F.col("event_type").alias("destination"))
    rest = e.where("event_type = 'view'").select("user_id", "event_id", (F.col("user_id") % 2 == 0).alias("left_behind"))
    return tracks.companions(rest, moves, "user_id", "destination", "event_id", "left_behind").select("user_id", "event_id", "destination", "action")


# Containers


@query("""SELECT p_partkey, kind, CASE WHEN kind IN ('id3', 'vorbis', 'mp4') THEN p_name END AS title, CASE WHEN kind = 'vorbis' THEN p_brand END AS album_artist, CASE WHEN kind IN ('id3', 'vorbis') OR (kind = 'mp4' AND p_size % 4 > 0) THEN p_size % 4 END::INTEGER AS track_no,
  CASE WHEN kind IN ('id3', 'vorbis') OR (kind = 'mp4' AND p_size % 3 > 0) THEN p_size % 3 END::INTEGER AS track_total, CASE kind WHEN 'id3' THEN 1990 WHEN 'asf' THEN 2001 END::INTEGER AS year, coalesce(kind = 'vorbis', false) AS compilation, coalesce(kind = 'id3', false) AS has_art
  FROM (SELECT *, ['id3', 'vorbis', 'mp4', 'asf', NULL][(p_partkey % 5 + 1)::INTEGER] AS kind FROM part)""")
def tag_readers(spark, d):
    pick = lambda *names: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("p_partkey") % 5 + 1).cast("int"))
    pair = F.concat((F.col("p_size") % 4).cast("string"), F.lit("/"), (F.col("p_size") % 3).cast("string"))
    values = {"TIT2": "p_name", "title": "p_name", "©nam": "p_name", "ENSEMBLE": "p_brand"}
    raw = F.create_map(
        *(x for k, c in values.items() for x in (F.lit(k), F.array(F.col(c)))), F.lit("ALBUMARTIST"), F.array(F.lit("  ")), *(x for k in ("TRCK", "TRACKNUMBER", "trkn") for x in (F.lit(k), F.array(pair))),
        F.lit("TYER"), F.array(F.lit("12/1990")), F.lit("WM/Year"), F.array(F.lit("2001")), F.lit("compilation"), F.array(F.lit("1")), F.lit("TCMP"), F.array(F.lit("0")), F.lit("APIC:front"), F.array(F.lit("x")),
    )
    kind = containers.kind_of(pick("/a/b.MP3", "/a/b.oga", "/a/b.m4b", "/a/b.wma", "/a/b.txt"))
    rows = t(spark, d, "part").select("p_partkey", kind.alias("kind"), raw.alias("raw")).withColumn("t", containers.tags(F.col("kind"), F.col("raw")))
    return rows.select("p_partkey", "kind", *(f"t.{c}" for c in ("title", "album_artist", "track_no", "track_total", "year", "compilation", "has_art")))


@query("""SELECT p_partkey, 'flac' AS codec, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size * 1000 END::BIGINT AS sample_rate, 2::BIGINT AS channels, 0::BIGINT AS stream_bitrate, CASE WHEN p_size % 4 = 0 THEN 1.5 ELSE p_size + 0.25 END::DOUBLE AS duration_s, '' AS format_name FROM part WHERE p_size % 7 > 0""")
def container_probe(spark, d):
    n = F.col("p_size").cast("string")
    rate = F.when(F.col("p_size") % 3 == 0, F.lit("N/A")).otherwise(F.concat(n, F.lit("000.7")))
    whole = F.when(F.col("p_size") % 4 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"duration": "'), n, F.lit('.25"}')))
    value = F.concat(F.lit('{"streams": [{"codec_name": "flac", "channels": 2, "duration": "1.5", "sample_rate": "'), rate, F.lit('"}, {"codec_name": "png"}], "format": '), whole, F.lit("}"))
    value = F.when(F.col("p_size") % 7 == 0, F.lit("no json")).otherwise(value)
    rows = t(spark, d, "part").select("p_partkey", containers.probe(value).alias("f")).where("f IS NOT NULL")
    return rows.select("p_partkey", *(f"f.{c}" for c in ("codec", "sample_rate", "channels", "stream_bitrate", "duration_s", "format_name")))


@query("SELECT p_partkey, lower(p_name) AS name, 1.0::DOUBLE AS likeness FROM part")
def sql_functions(spark, d):
    """The registered functions, called from SQL."""
    text.register(spark)
    t(spark, d, "part").createOrReplaceTempView("lyrebird_parts")
    return spark.sql("SELECT p_partkey, fold_text(p_name) AS name, similarity(p_name, upper(p_name)) AS likeness FROM lyrebird_parts")


@query("""SELECT p_partkey, '{"name":"' || p_name || '","has_print":' || (p_size % 2 = 0) || '}' AS row FROM part""")
def json_projection(spark, d):
    """A row as JSON, with whether it has a fingerprint rather than the fingerprint."""
    row = F.to_json(F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).isNotNull().alias("has_print")))
    return t(spark, d, "part").select("p_partkey", row.alias("row"))
