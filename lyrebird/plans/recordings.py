"""Queries on recordings of many chunks, and on rows numbered as a whole, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lyrebird.operators import chunks, numbers, signal
from lyrebird.plans.catalogue import query, t

#: A third of all vectors are chunks of one recording; of the others, a recording has two hundred.
_REC = "CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 + vec_id // 300 END"
_S = f"""v AS (SELECT {_REC} AS rec, vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT rec, x, row_number() OVER (PARTITION BY rec ORDER BY vec_id, i) - 1 AS pos FROM v)"""


def _chunks(spark, d):
    rec = F.when(F.col("vec_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(1 + F.floor(F.col("vec_id") / 300))
    return t(spark, d, "embeddings").select(rec.alias("rec"), F.col("vec_id").alias("at"), signal.doubles(F.col("embedding")).alias("s"))


@query(f"WITH {_S} SELECT rec, count(*) AS n, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) AS dc, round(20 * log10(greatest(max(abs(x)), 1e-10)) - 20 * log10(greatest(sqrt(avg(x * x)), 1e-10)), 4) AS crest_db FROM s GROUP BY 1")
def recording_levels(spark, d):
    out = chunks.levels(_chunks(spark, d), ["rec"], "s")
    return out.select("rec", "n", *(F.round(c, 6).alias(c) for c in ("peak", "rms", "dc")), F.round("crest_db", 4).alias("crest_db"))


@query(f"""WITH {_S}, r AS (SELECT rec, count(*) AS n FROM (SELECT rec, pos - row_number() OVER (PARTITION BY rec ORDER BY pos) AS g FROM s WHERE abs(x) >= 0.1) GROUP BY rec, g)
SELECT rec, coalesce(sum(n), 0)::BIGINT AS marked, count(*) FILTER (n >= 4) AS long_runs, coalesce(max(n), 0)::BIGINT AS longest FROM (SELECT DISTINCT rec FROM s) LEFT JOIN r USING (rec) GROUP BY 1""")
def recording_runs(spark, d):
    return chunks.runs(_chunks(spark, d), ["rec"], "at", F.transform("s", lambda x: F.abs(x) >= 0.1), 4)


@query(f"""WITH {_S}, f AS (SELECT rec, pos // 6 AS frame, 20 * log10(greatest(sqrt(avg(x * x)), 1e-10)) AS db FROM s GROUP BY 1, 2 HAVING count(*) = 6),
n AS (SELECT rec, count(*) AS n, min(frame) FILTER (db >= -17) AS a, max(frame) FILTER (db >= -17) AS b FROM f GROUP BY 1),
g AS (SELECT rec, min(frame) AS s, max(frame) AS e, count(*) AS k FROM (SELECT *, frame - row_number() OVER (PARTITION BY rec ORDER BY frame) AS i FROM f WHERE db < -17) GROUP BY rec, i)
SELECT n.rec, coalesce(a, n)::BIGINT AS lead, coalesce(n - 1 - b, 0)::BIGINT AS trail, coalesce(max(k) FILTER (s > a AND e < b), 0)::BIGINT AS longest FROM n LEFT JOIN g USING (rec) GROUP BY n.rec, a, b, n""")
def recording_silence(spark, d):
    """Frames of six samples, which go on over the ends of chunks of 64."""
    framed = chunks.frames(chunks.placed(_chunks(spark, d), ["rec"], "at", "s"), ["rec"], "s", 6)
    return chunks.silence(framed, ["rec"], -17.0)


@query(f"""WITH {_S}, d AS (SELECT rec, pos, lead(x) OVER (PARTITION BY rec ORDER BY pos) - x AS d FROM s), b AS (SELECT *, least(pos // 100, greatest((count(*) OVER (PARTITION BY rec)) // 100 - 1, 0)) AS b FROM d WHERE d IS NOT NULL),
m AS (SELECT rec, pos // 100 AS b, median(d) AS m FROM b WHERE pos // 100 = b GROUP BY ALL), g AS (SELECT rec, b, greatest(1.4826 * median(abs(d - m)), 1e-7) AS sigma FROM b JOIN m USING (rec, b) WHERE pos // 100 = b GROUP BY ALL),
j AS (SELECT *, lead(d) OVER (PARTITION BY rec ORDER BY pos) AS e, greatest(2.5 * sigma, 0.08) AS lim FROM b JOIN g USING (rec, b)),
k AS (SELECT rec, pos - lag(pos) OVER (PARTITION BY rec ORDER BY pos) AS gap FROM j WHERE abs(d) > lim AND sign(d) <> sign(e) AND abs(e) > lim * 0.5)
SELECT r.rec, count(k.rec) AS spikes, count(k.rec) FILTER (gap IS NULL OR gap > 10) AS events FROM (SELECT DISTINCT rec FROM s) r LEFT JOIN k USING (rec) GROUP BY 1""")
def recording_clicks(spark, d):
    """At 500 samples a second: blocks of a hundred, events ten apart. No recording here is under a block."""
    return chunks.local_clicks(chunks.placed(_chunks(spark, d), ["rec"], "at", "s"), ["rec"], "at", "s", 500.0, sigmas=2.5)


@query("""SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY lang NULLS LAST, n_chars DESC NULLS LAST, doc_id) AS place FROM documents""")
def document_order(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return numbers.numbered(docs, [F.col("lang").asc_nulls_last(), F.col("n_chars").desc_nulls_last(), F.col("doc_id")], "place").select("doc_id", "lang", "n_chars", "place")


@query("""SELECT l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place, count(*) OVER () AS n FROM lineitem) WHERE place > n // 2 AND place <= n // 2 + 500""")
def deep_page(spark, d):
    """The page of 500 rows in the middle of the whole order."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = numbers.laid_out(rows, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")])
    return numbers.page(order, order.count() // 2, 500, "place").select("l_orderkey", "l_linenumber", "place")
