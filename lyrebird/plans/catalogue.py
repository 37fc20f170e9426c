"""Named queries over the driver's tables, each with the SQL it is held against where SQL can say it.

The tables hold no media, so columns play roles: a price is a length, an order a folder, a vector a signal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyrebird.functions import blanks, text, workers
from lyrebird.operators import catalog, duplicates, ledger, resolve, signal
from lyrebird.sources import files
from lyrebird.streaming import sessions as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str = "", *also: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, and under those that it had before."""

    def add(f: Query) -> Query:
        for name in (f.__name__, *also):
            QUERIES[name] = f
            if sql:
                SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _issues() -> object:
    """An array of issues from a label's two marks."""
    one = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    return F.filter(F.array(one(F.col("quality") == 0, "quality", "medium"), one(F.col("toxic") == 1, "toxic", "high"), one(F.col("doc_id") % 7 == 0, "note", "info")), lambda i: i.isNotNull())


# Catalogue


@query("""SELECT b.bucket, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('high'), ('review'), ('low'), ('unidentified')) b(bucket) LEFT JOIN (
  SELECT CASE WHEN c IS NULL THEN 'unidentified' WHEN c >= 92 THEN 'high' WHEN c >= 70 THEN 'review' ELSE 'low' END AS bucket, count(*) AS n
  FROM (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END AS c FROM customer) GROUP BY 1) USING (bucket)""")
def catalog_bucket_counts(spark, d):
    c = t(spark, d, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100).alias("c"))
    names = ("high", "review", "low", "unidentified")
    counts = c.withColumn("b", catalog.bucket(F.col("c"))).agg(*(F.count_if(F.col("b") == x).alias(x) for x in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(x).alias("bucket"), F.col(x).alias("n")) for x in names))).alias("s")).select("s.*")


@query("SELECT coalesce(nullif(lang, ''), '?') AS lang, count(*) AS n FROM documents GROUP BY 1")
def catalog_format_facet(spark, d):
    return catalog.facet(t(spark, d, "documents"), "lang")


@query("""SELECT count(*) AS total, count(quality) AS analysed, count(*) FILTER (quality = 0) AS medium, count(*) FILTER (toxic = 1) AS high,
  round(avg(CASE WHEN quality IS NOT NULL THEN 100 - 15 * (1 - quality) - 30 * toxic END)::DOUBLE, 1) AS average FROM documents LEFT JOIN labels USING (doc_id)""")
def catalog_stats(spark, d):
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").withColumn("issues", F.when(F.col("quality").isNotNull(), _issues()))
    has = lambda s: F.count_if(catalog.issue_filter(F.col("issues"), s))
    scored = F.when(F.col("issues").isNotNull(), catalog.score(catalog.penalty(F.col("issues"))))
    return rows.agg(F.count("*").alias("total"), F.count("issues").alias("analysed"), has("medium").alias("medium"), has("high").alias("high"), F.round(F.avg(scored), 1).alias("average"))


@query("""SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE contains(lower(concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, ''))), 'brand#1')
  ORDER BY (p_name IS NULL OR p_name = ''), lower(p_name) DESC, p_partkey LIMIT 50 OFFSET 20""")
def catalog_search_page(spark, d):
    q = catalog.Query(search=["p_name", "p_brand", "p_type"], text="Brand#1", sort="p_name_desc", tie=["p_partkey"], offset=20, limit=50)
    return catalog.page(t(spark, d, "part"), q).select("p_partkey", "p_name", "p_brand", "p_size")


@query("""SELECT doc_id, quality, rank::INTEGER AS rank FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY quality IS NULL, quality DESC, doc_id) AS rank
  FROM documents LEFT JOIN labels USING (doc_id)) WHERE rank <= 200""")
def catalog_blanks_last(spark, d):
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    top = catalog.blanks_last(rows, "quality", True, ["doc_id"], text=False).limit(200)
    w = Window.orderBy(F.col("quality").isNull(), F.desc("quality"), "doc_id")
    return top.withColumn("rank", F.row_number().over(w))


@query("""SELECT p_partkey, CASE WHEN m.name IS NOT NULL AND m.name <> '' THEN m.name ELSE p_name END AS name, CASE WHEN m.qty IS NOT NULL AND m.qty <> 0 THEN m.qty ELSE p_size END AS size FROM part LEFT JOIN
  (SELECT l_partkey, CASE WHEN max(l_quantity) >= 49 THEN 'bulk' ELSE '' END AS name, (max(l_quantity)::BIGINT % 10)::INTEGER AS qty FROM lineitem GROUP BY 1) m ON l_partkey = p_partkey""")
def catalog_effective_value(spark, d):
    most = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q"))
    most = most.select("p_partkey", F.when(F.col("q") >= 49, "bulk").otherwise("").alias("name2"), (F.col("q").cast("long") % 10).cast("int").alias("size2"))
    out = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size")).join(most, "p_partkey", "left")
    return blanks.overlay(out, {"name": "name2", "size": "size2"}).select("p_partkey", "name", "size")


@query("SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1 OR doc_id % 7 = 0")
def catalog_issue_any(spark, d):
    return t(spark, d, "labels").where(catalog.issue_filter(_issues(), "any")).select("doc_id")


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def catalog_issue_severity(spark, d):
    return t(spark, d, "labels").where(catalog.issue_filter(_issues(), "high")).select("doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def select_semi(spark, d):
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def select_anti(spark, d):
    done = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


_NEW = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END"


@query(f"SELECT p_partkey FROM (SELECT *, {_NEW} AS new_name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE 0 END AS new_size FROM part) WHERE (new_name <> '' AND new_name <> p_name) OR (new_size <> 0 AND new_size <> p_size)")
def pending_changes(spark, d):
    p = t(spark, d, "part").withColumns({"new_name": F.expr(_NEW), "new_size": F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(0)})
    return p.where(blanks.pending(p, {"p_name": "new_name", "p_size": "new_size"})).select("p_partkey")


@query("""WITH a AS (SELECT user_id, count(*) AS version, min(value) AS kept FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
 b AS (SELECT user_id, count(*) FILTER (ts < TIMESTAMP '2024-01-16' OR event_type = 'purchase') AS version FROM events GROUP BY 1)
SELECT user_id, coalesce(b.version, a.version)::BIGINT AS version, CASE WHEN b.version IS NULL OR a.version = b.version THEN kept END AS kept,
 CASE WHEN b.version IS NULL THEN 'untouched' WHEN a.version IS NULL THEN 'added' WHEN a.version = b.version THEN 'kept' ELSE 'replaced' END AS state FROM a FULL JOIN b USING (user_id)""")
def state_merge_version(spark, d):
    e = t(spark, d, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    old = e.where(early).groupBy("user_id").agg(F.count("*").alias("version"), F.min("value").alias("kept"))
    new = e.groupBy("user_id").agg(F.count_if(early | (F.col("event_type") == "purchase")).alias("version"))
    return ledger.merge_scan(old, new, "user_id", "version", ["kept"])


@query("SELECT doc_id, greatest(0, 100 - 15 * (1 - quality) - 30 * toxic)::INTEGER AS score FROM labels")
def quality_score_penalty(spark, d):
    return t(spark, d, "labels").select("doc_id", catalog.score(catalog.penalty(_issues())).alias("score"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'info' END AS worst FROM labels")
def worst_severity(spark, d):
    return t(spark, d, "labels").select("doc_id", catalog.worst(_issues()).alias("worst"))


@query("""SELECT severity, count(*) AS n, sum(points)::BIGINT AS points FROM (SELECT unnest([CASE WHEN quality = 0 THEN 'medium' END, CASE WHEN toxic = 1 THEN 'high' END]) AS severity FROM labels)
  JOIN (VALUES ('high', 30), ('medium', 15)) p(severity, points) USING (severity) GROUP BY 1""")
def deduction_breakdown(spark, d):
    i = t(spark, d, "labels").select(F.explode(_issues()).alias("i")).select("i.severity")
    points = F.create_map(*(F.lit(x) for kv in catalog.PENALTY.items() for x in kv))[F.col("severity")]
    return i.withColumn("p", points).where("p > 0").groupBy("severity").agg(F.count("*").alias("n"), F.sum("p").alias("points"))


_POINTS = [(8, 11.0), (16, 16.5), (32, 19.0), (48, 20.6)]


@query("""SELECT p_partkey, round(CASE WHEN p_size <= 8 THEN 11.0 WHEN p_size <= 16 THEN 11 + (p_size - 8) * 5.5 / 8 WHEN p_size <= 32 THEN 16.5 + (p_size - 16) * 2.5 / 16
  WHEN p_size <= 48 THEN 19 + (p_size - 32) * 1.6 / 16 ELSE 20.6 END::DOUBLE, 6) AS cutoff FROM part""")
def cutoff_interp(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(catalog.interpolate(F.col("p_size").cast("double"), _POINTS), 6).alias("cutoff"))


# Duplicates


@query("""WITH r AS (SELECT md5(text) AS id, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents)
SELECT d.doc_id, f.doc_id AS existing_doc_id FROM r AS d JOIN r AS f ON d.id = f.id AND f.r = CASE WHEN d.r = 1 THEN 2 ELSE 1 END""", "dup_exact_id_all")
def dup_exact_id(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("id"))
    return duplicates.first_other(docs, "id", "doc_id").select("doc_id", "existing_doc_id")


def _parts(spark, d):
    p = t(spark, d, "part")
    return p.select(text.normalise(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("block"), "p_partkey", "p_brand", "p_type")


@query()
def dup_blocked_fuzzy(spark, d):
    return duplicates.fuzzy_within(_parts(spark, d), "p_partkey", "block", "p_brand", "p_type", text.similarity)


@query("""WITH p AS (SELECT p_partkey, p_brand, lower(p_name) || ' ' || p_size AS block FROM part),
i AS (SELECT a.p_partkey, min(b.p_partkey) AS e FROM p AS a JOIN p AS b ON a.block = b.block AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey GROUP BY 1),
o AS (SELECT a.p_partkey, min(b.p_partkey) AS e FROM p AS a JOIN p AS b ON a.block = b.block AND a.p_partkey <> b.p_partkey GROUP BY 1)
SELECT p_partkey, 'id' AS kind, e AS existing_p_partkey FROM i UNION ALL SELECT p_partkey, 'block', e FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM i)""", "dup_two_pass_all")
def dup_two_pass(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.lower("p_name"), F.col("p_size").cast("string")).alias("block"), "p_brand")
    out = ["p_partkey", "kind", "existing_p_partkey"]
    first = duplicates.first_other(p.withColumn("id", F.struct("block", "p_brand")), "id", "p_partkey").withColumn("kind", F.lit("id")).select(*out)
    second = duplicates.first_other(p, "block", "p_partkey").withColumn("kind", F.lit("block")).select(*out)
    return first.unionByName(second.join(first.select("p_partkey"), "p_partkey", "left_anti"))


# Resolution


@query("""WITH l AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier), c AS (SELECT * FROM customer),
a AS (SELECT s_suppkey, min(c_custkey) AS c FROM l JOIN c ON s_nationkey = c_nationkey AND floor(s_acctbal / 50) = floor(c_acctbal / 50) GROUP BY 1),
b AS (SELECT s_suppkey, min(c_custkey) AS c FROM l JOIN c ON s_nationkey = c_nationkey AND floor(s_acctbal / 500) = floor(c_acctbal / 500) WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a) GROUP BY 1),
e AS (SELECT s_suppkey, min(c_custkey) AS c FROM l JOIN c ON s_nationkey = c_nationkey WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a UNION SELECT s_suppkey FROM b) GROUP BY 1)
SELECT s_suppkey, c AS c_custkey, 1 AS attempt FROM a UNION ALL SELECT s_suppkey, c, 2 FROM b UNION ALL SELECT s_suppkey, c, 3 FROM e""")
def search_loosen_cascade(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), "s_acctbal")
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), "c_acctbal")

    def attempt(width):
        def run(left, right):
            if width:
                left, right = left.withColumn("w", F.floor(F.col("s_acctbal") / width)), right.withColumn("w", F.floor(F.col("c_acctbal") / width))
            keys = ["n", "w"] if width else ["n"]
            return left.join(right.groupBy(*keys).agg(F.min("c_custkey").alias("c_custkey")), keys).select("s_suppkey", "c_custkey")

        return run

    return resolve.cascade(s, c, ["s_suppkey"], [attempt(50), attempt(500), attempt(None)])


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 5")
def duration_range_join(spark, d):
    s, c = t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return resolve.within(s, c, "s_acctbal", "c_acctbal", 5.0).select("s_suppkey", "c_custkey")


_TOP = """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount >= 0.08 DESC, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey)::INTEGER AS rank FROM lineitem"""


def _ranked(spark, d, k):
    seq = ["l_linenumber", "l_partkey", "l_suppkey"]
    return resolve.rank(t(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", F.col("l_discount") >= 0.08, seq, k)


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice, rank FROM ({_TOP}) WHERE rank <= 3")
def candidate_rank_topk(spark, d):
    return _ranked(spark, d, 3).select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query(f"SELECT l_orderkey, p_name, p_brand, o_orderdate FROM ({_TOP}) JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE rank = 1")
def enrich_after_rank(spark, d):
    best = _ranked(spark, d, 1).select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    named = best.join(t(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    return named.join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").select("l_orderkey", "p_name", "p_brand", "o_orderdate")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END, strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS r FROM orders) WHERE r = 1""")
def release_pick(spark, d):
    kind = F.when(F.col("o_orderpriority").startswith("1"), "album").when(F.col("o_orderpriority").startswith("2"), "ep").otherwise("single")
    out = resolve.best_release(t(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", kind, F.col("o_totalprice") > 200000, F.date_format("o_orderdate", "yyyy-MM-dd"), ["o_orderkey"])
    return out.select("o_custkey", "o_orderkey")


@query("""SELECT l_partkey, l_suppkey, credited, most, round(credited / most, 6) AS ratio FROM (SELECT *, max(credited) OVER (PARTITION BY l_partkey) AS most
  FROM (SELECT l_partkey, l_suppkey, count(*) AS credited FROM lineitem GROUP BY 1, 2))""")
def cluster_consensus(spark, d):
    return resolve.consensus(t(spark, d, "lineitem"), ["l_partkey"], "l_suppkey").withColumn("ratio", F.round("ratio", 6))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS votes, min((l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(votes) OVER (PARTITION BY l_orderkey) AS matched, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, first) AS r FROM c)
SELECT l_orderkey, l_returnflag, votes, matched::BIGINT AS matched, round(votes / matched, 6)::DOUBLE AS share, matched >= 3 AND votes / matched >= 0.5 AS carried FROM r WHERE r = 1""")
def folder_vote(spark, d):
    return resolve.vote(t(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", ["l_linenumber", "l_partkey"]).withColumn("share", F.round("share", 6))


_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_DUR = """SELECT *, abs(o - c) AS d FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice / 100 AS o,
  CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE p_retailprice * l_quantity / 100 END AS c FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_SIG = f"""SELECT *, CASE WHEN c IS NULL OR c = 0 THEN 0.5 ELSE close END AS score, CASE WHEN c IS NULL OR c = 0 THEN 1.0 ELSE 2 * (CASE WHEN d <= 0.1 THEN 1.5 WHEN d <= 10 THEN 1.5 - (d - 0.1) / 9.9 * 0.5
  ELSE 0.1 + 0.9 * close END) END AS weight, coalesce(c <> 0 AND d > 180, false) AS veto FROM (SELECT *, CASE WHEN d <= 10 THEN 1.0 WHEN d >= 90 THEN 0.0 ELSE 1 - (d - 10) / 80 END AS close FROM ({_DUR}))"""


def _durations(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = t(spark, d, "lineitem").select(*_KEY, "l_extendedprice", "l_discount", "l_tax").join(p, "l_partkey")
    rows = rows.withColumns({"o": F.col("l_extendedprice") / 100, "c": F.when(F.col("l_partkey") % 10 != 0, F.col("p_retailprice") * F.col("l_quantity") / 100)})
    s, w, v = resolve.duration_signal(F.col("o"), F.col("c"))
    return rows.withColumns({"score": s, "weight": w, "veto": v})


@query(f"SELECT {', '.join(_KEY)}, round(score + 1e-9, 6)::DOUBLE AS score, round(weight + 1e-9, 6)::DOUBLE AS weight, veto FROM ({_SIG})")
def duration_signal(spark, d):
    return _durations(spark, d).select(*_KEY, F.round(F.col("score") + 1e-9, 6).alias("score"), F.round(F.col("weight") + 1e-9, 6).alias("weight"), "veto")


@query(f"""SELECT {", ".join(_KEY)}, round(round_even(greatest(0, least(100, (score * weight + l_discount * 10 * 2 + l_tax * 10 * 1.5) / (weight + 3.5) * 100 * CASE WHEN veto THEN 0.35 ELSE 1 END
  * CASE WHEN l_discount * 10 < 0.5 AND l_tax * 10 < 0.8 THEN 0.55 ELSE 1 END))::DOUBLE, 1), 0)::DOUBLE AS total FROM ({_SIG})""")
def weighted_score(spark, d):
    rows, title, artist = _durations(spark, d), F.col("l_discount") * 10, F.col("l_tax") * 10
    total = resolve.weighted_score([(F.col("score"), F.col("weight")), (title, F.lit(2.0)), (artist, F.lit(1.5))], F.col("veto"), title, artist >= 0.8)
    # The tenths of a score can fall either side of a rounding edge, so whole points are compared.
    return rows.select(*_KEY, F.round(total, 0).alias("total"))


@query(f"""WITH r AS (SELECT *, l_extendedprice / 1200 AS score FROM ({_TOP}) WHERE rank <= 5),
x AS (SELECT *, max(score) FILTER (rank = 2) OVER w AS s2, max(score) FILTER (rank = 1) OVER w AS s1 FROM r WINDOW w AS (PARTITION BY l_orderkey)),
m AS (SELECT *, CASE WHEN rank = 1 THEN s2 ELSE s1 END AS rival, CASE WHEN rank = 1 THEN greatest(score - s2, 0) ELSE 0 END AS margin, CASE WHEN l_returnflag = 'A' THEN 0.95 ELSE 0.8 END AS fl FROM x),
c AS (SELECT *, round_even(least(score * CASE WHEN rival IS NOT NULL AND margin < 12 AND l_tax < 0.07 THEN fl + margin / 12 * (1 - fl) ELSE 1 END, 72)::DOUBLE, 1) AS own FROM m)
SELECT l_orderkey, rank, round(least(own, max(own) FILTER (rank = 1) OVER (PARTITION BY l_orderkey)), 0)::DOUBLE AS confidence FROM c""")
def ambiguity_discount(spark, d):
    r = _ranked(spark, d, 5).withColumn("score", F.col("l_extendedprice") / 1200)
    out = resolve.rated(r, ["l_orderkey"], "score", F.col("l_returnflag") == "A", F.col("l_tax") >= 0.07, F.lit(72.0))
    return out.select("l_orderkey", "rank", F.round("confidence", 0).alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN f >= 0.9 THEN 99.0 WHEN f >= 0.6 THEN 95.0 WHEN s = 'existing-id' THEN 96.0 WHEN s = 'filename' THEN 45.0 WHEN o_custkey % 4 = 0 THEN 75.0
  WHEN o_custkey % 3 = 0 THEN 60.0 WHEN o_orderkey % 9 >= 6 THEN 93.0 WHEN o_orderkey % 9 >= 4 THEN 85.0 ELSE 72.0 END::DOUBLE AS most
  FROM (SELECT *, o_totalprice / 500000 AS f, CASE left(o_orderpriority, 1) WHEN '1' THEN 'existing-id' WHEN '2' THEN 'filename' ELSE 'search' END AS s FROM orders)""")
def evidence_ceiling(spark, d):
    source = F.when(F.col("o_orderpriority").startswith("1"), "existing-id").when(F.col("o_orderpriority").startswith("2"), "filename").otherwise("search")
    most = resolve.ceiling(F.col("o_totalprice") / 500000, source, F.col("o_custkey") % 4 == 0, F.col("o_custkey") % 3 != 0, F.col("o_orderkey") % 9)
    return t(spark, d, "orders").select("o_orderkey", most.alias("most"))


@query("""SELECT user_id, value_band, n, list_reduce(types, lambda a, b: CASE WHEN a = b THEN a ELSE a || '+' || b END) AS source, (list_filter(vals, lambda x: x > 50))[1] AS length, unverified FROM (
   SELECT user_id, floor(value / 50)::BIGINT AS value_band, count(*) AS n, list(event_type ORDER BY event_id) AS types, list(value ORDER BY event_id) AS vals, bool_and(value < 40) AS unverified FROM events GROUP BY 1, 2)""")
def candidate_dedupe_merge(spark, d):
    e = t(spark, d, "events").select("user_id", F.floor(F.col("value") / 50).alias("value_band"), "event_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("length"), (F.col("value") < 40).alias("unverified"), F.col("event_type").alias("sig"))
    return resolve.merged(e, ["user_id", "value_band"], "event_id", "event_type", "length", "unverified", "sig").select("user_id", "value_band", "n", F.col("event_type").alias("source"), "length", "unverified")


@query("""SELECT p_partkey, field, round(CASE WHEN field = 'album' THEN c * 0.92 WHEN sim > 0.92 THEN c * r + (100 - c * r) * 0.5 WHEN sim < 0.5 THEN c * r * 0.75 ELSE c * r END::DOUBLE - 0.013, 0) AS confidence FROM (
  SELECT p_partkey, unnest(['title', 'artist', 'album']) AS field, unnest([1.0, 0.98, 0.92]::DOUBLE[]) AS r, floor(p_retailprice / 25)::DOUBLE AS c, p_size / 50 AS sim FROM part)""")
def field_confidence_map(spark, d):
    c, sim = F.floor(F.col("p_retailprice") / 25).cast("double"), F.col("p_size") / 50
    m = F.create_map(F.lit("title"), resolve.field_confidence(c, 1.0, sim), F.lit("artist"), resolve.field_confidence(c, 0.98, sim), F.lit("album"), resolve.field_confidence(c, 0.92))
    return t(spark, d, "part").select("p_partkey", F.explode(m).alias("field", "confidence")).withColumn("confidence", F.round(F.col("confidence") - 0.013, 0))


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INTEGER AS position, count(*) OVER (PARTITION BY conv_id)::INTEGER AS total FROM conversations""")
def tracklist_flatten(spark, d):
    turns = t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("tracks"))
    return turns.select("conv_id", F.size("tracks").alias("total"), F.posexplode("tracks").alias("p", "x")).select("conv_id", "x.turn", "x.role", (F.col("p") + 1).alias("position"), "total")


@query()
def seat_greedy(spark, d):
    c = t(spark, d, "conversations").withColumn("n", F.char_length("text"))
    left, right = (c.where(F.col("role") == r).groupBy("conv_id", "turn").agg(F.max("n").alias(f"n_{r}")).withColumnRenamed("turn", r) for r in ("user", "assistant"))
    closeness = F.round(F.least("n_user", "n_assistant") / F.greatest("n_user", "n_assistant", F.lit(1)), 6)
    pairs = left.join(right, "conv_id").withColumn("score", closeness).where("score >= 0.3")
    return resolve.seats(pairs, ["conv_id"], "user", "assistant", "score")


@query("""WITH c AS (SELECT l_orderkey, l_suppkey % 5 AS v, count(*) AS n, min((l_linenumber, l_partkey)) AS f FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f) AS r FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN m >= 3 AND n / m >= 0.5 THEN v ELSE l_suppkey % 5 END AS album, CASE WHEN m >= 3 AND n / m >= 0.5 THEN round(least(97, 80 + 8 * n / m), 4) ELSE 80 END::DOUBLE AS confidence
FROM lineitem JOIN r USING (l_orderkey) WHERE r = 1""")
def consolidate_group(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 5).alias("v"))
    won = resolve.vote(rows, ["l_orderkey"], "v", ["l_linenumber", "l_partkey"]).withColumnRenamed("v", "won").select("l_orderkey", "won", "share", "carried")
    out = rows.join(won, "l_orderkey")
    conf = F.when(F.col("carried"), F.round(F.least(F.lit(97.0), 80 + 8 * F.col("share")), 4)).otherwise(80.0)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("carried"), F.col("won")).otherwise(F.col("v")).alias("album"), conf.alias("confidence"))


# Text


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(p_name || ' & Co. (Remastered 2014)', '(?i)\s*\(remaster(ed)?(\s*\d{4})?\s*\)', ' ', 'g')), '&', ' and '), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part""")
def text_normalize_ascii(spark, d):
    return t(spark, d, "part").select("p_partkey", text.normalise(F.concat("p_name", F.lit(" & Co. (Remastered 2014)"))).alias("name"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), '&', ' and '), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS head FROM documents""")
def text_normalize_unicode(spark, d):
    return t(spark, d, "documents").select("doc_id", text.normalise_unicode(F.col("text")).alias("head"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), '&', ' and '), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def text_normalize_whole(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.normalise_unicode(F.col("text")).cast("binary")).alias("digest"))


@query()
def similarity_pairs(spark, d):
    p = t(spark, d, "part").select("p_name").distinct()
    words = p.withColumn("w", F.explode(F.array_distinct(F.split("p_name", " "))))
    pairs = words.join(words.withColumnRenamed("p_name", "other"), "w").where("p_name < other").select("p_name", "other").distinct()
    return pairs.withColumn("likeness", F.round(text.similarity("p_name", "other"), 6))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(stem, '^\d{1,3}\s*[-._)]\s*(.+)$') THEN regexp_extract(stem, '^(\d{1,3})\s*[-._)]\s*(.+)$', 1)::INTEGER END AS track_no, folder AS album FROM (
  SELECT page_id, trim(regexp_replace(name, '^(.+)\.[^.]*$', '\1')) AS stem, folder FROM (SELECT page_id, parts[-1] AS name, nullif(parts[-2], '') AS folder FROM (SELECT page_id, string_split(split_part(split_part(url, '?', 1), '#', 1), '/') AS parts FROM pages)))""")
def path_guess(spark, d):
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return t(spark, d, "pages").select("page_id", text.path_guess(path).alias("g")).select("page_id", "g.track_no", "g.album")


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'Unknown' ELSE s END AS name FROM (SELECT page_id, rtrim(left(rtrim(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(url, '/', '-'), ':', ' -'), '?', ''), '*', ''), '|', '-'), '[\x00-\x1f]', '', 'g'), '\s+', ' ', 'g')), '. '), 120), '. ') AS s FROM pages)""")
def sanitize_component(spark, d):
    return t(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(CASE WHEN p_size > 25 THEN '2-' ELSE '' END || lpad(p_size::VARCHAR, greatest(2, length(p_size::VARCHAR))::INTEGER, '0') || ' - ' || p_name, '\\s*-\\s*-\\s*', ' - ', 'g'), '\\s{2,}', ' ', 'g'), ' -_.') AS file FROM part""".replace("\\\\", "\\"))
def render_template(spark, d):
    values = {"disc_prefix": F.when(F.col("p_size") > 25, "2-"), "track": F.col("p_size"), "title": F.col("p_name")}
    return t(spark, d, "part").select("p_partkey", ledger.rendered("{disc_prefix}{track:02d} - {title}", values).alias("file"))


@query("""SELECT p_partkey, p_name || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END || '.mp3' AS dest FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS r FROM part)""")
def plan_collisions(spark, d):
    rows = t(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.lit(".mp3").alias("suffix"))
    return ledger.destinations(rows, "p_brand", "p_name", "suffix", "p_partkey").select("p_partkey", "dest")


@query("""SELECT o_orderkey, try_cast(regexp_extract(strftime(o_orderdate, '%d.%m.%Y'), '(19|20)\\d{2}') AS INTEGER) AS year, (o_orderkey % 12)::INTEGER AS track_no, CASE WHEN o_orderkey % 2 = 0 THEN 12 END::INTEGER AS track_total FROM orders""".replace("\\\\", "\\"))
def year_safe_int_pair(spark, d):
    o = t(spark, d, "orders")
    first, second = text.pair_of(F.concat((F.col("o_orderkey") % 12).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "/12").otherwise("")))
    return o.select("o_orderkey", text.year_of(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("year"), first.alias("track_no"), second.alias("track_total"))


@query("SELECT c_custkey, repeat('*', greatest(length(c_name) - 3, 0)) || right(c_name, 3) AS name, (floor(abs(c_acctbal))::BIGINT // 60) || ':' || lpad((floor(abs(c_acctbal))::BIGINT % 60)::VARCHAR, 2, '0') AS length FROM customer")
def hidden_and_clock(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.hidden(F.col("c_name")).alias("name"), text.clock(F.abs("c_acctbal")).alias("length"))


# Signals

_X = "SELECT vec_id, unnest(range(64)) AS idx, unnest(embedding)::DOUBLE AS x FROM embeddings"


def _samples(spark, d):
    return t(spark, d, "embeddings").select("vec_id", signal.doubles(F.col("embedding")).alias("s"))


@query(f"""SELECT vec_id, round(peak, 6) AS peak, round(rms, 6) AS rms, round(dc, 6) AS dc, round(20 * log10(greatest(peak, 1e-10)) - 20 * log10(greatest(rms, 1e-10)), 4) AS crest_db,
  abs(dc) > 0.01 AS offset_issue FROM (SELECT vec_id, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, avg(x) AS dc FROM ({_X}) GROUP BY 1)""")
def pcm_levels(spark, d):
    out = signal.levels(t(spark, d, "embeddings").select("vec_id", signal.doubles(F.col("embedding")).alias("s")), "s")
    wrong = F.array_contains(signal.level_issues(F.col("peak"), F.col("rms"), F.col("crest_db"), F.col("dc")), "dc_offset")
    return out.select("vec_id", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"), F.round("dc", 6).alias("dc"), F.round("crest_db", 4).alias("crest_db"), wrong.alias("offset_issue"))


_RUN = f"""SELECT vec_id, count(*) AS length FROM (SELECT vec_id, idx, idx - row_number() OVER (PARTITION BY vec_id ORDER BY idx) AS g FROM ({_X}) WHERE abs(x) >= 0.1) GROUP BY vec_id, g"""


@query(f"SELECT vec_id, sum(length)::BIGINT AS marked, count(*) FILTER (length >= 4) AS long_runs, max(length) AS longest FROM ({_RUN}) GROUP BY 1")
def pcm_clip_runs(spark, d):
    r = _samples(spark, d).select("vec_id", signal.run_lengths(F.transform("s", lambda x: F.abs(x) >= 0.1)).alias("r")).where(F.size("r") > 0)
    long_ = F.size(F.filter("r", lambda x: x >= signal.CLIP_RUN))
    return r.select("vec_id", F.aggregate("r", F.lit(0), lambda a, x: a + x).cast("long").alias("marked"), long_.cast("long").alias("long_runs"), F.array_max("r").cast("long").alias("longest"))


_FR = f"SELECT vec_id, idx // 4 AS frame, 20 * log10(greatest(sqrt(avg(x * x)), 1e-10)) AS db FROM ({_X}) GROUP BY 1, 2 HAVING count(*) = 4"


@query(f"""WITH f AS ({_FR}), n AS (SELECT vec_id, max(frame) + 1 AS n, min(frame) FILTER (db > -20) AS a, max(frame) FILTER (db > -20) AS b FROM f GROUP BY 1),
g AS (SELECT vec_id, min(frame) AS s, max(frame) AS e, count(*) AS k FROM (SELECT *, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS i FROM f WHERE db <= -20) GROUP BY vec_id, i)
SELECT n.vec_id, coalesce(a, n)::BIGINT AS lead, coalesce(n - 1 - b, 0)::BIGINT AS trail, coalesce(max(k) FILTER (s > a AND e < b), 0)::BIGINT AS longest FROM n LEFT JOIN g USING (vec_id) GROUP BY n.vec_id, a, b, n""")
def pcm_frames_silence(spark, d):
    return _samples(spark, d).select("vec_id", signal.silence(signal.frames(F.col("s"), 4), -20.0).alias("x")).select("vec_id", "x.*")


@query(f"""WITH a AS (SELECT vec_id, idx, lead(x) OVER w - x AS d FROM ({_X}) WINDOW w AS (PARTITION BY vec_id ORDER BY idx)), b AS (SELECT *, lead(d) OVER (PARTITION BY vec_id ORDER BY idx) AS e FROM a WHERE d IS NOT NULL),
s AS (SELECT *, coalesce(idx - lag(idx) OVER (PARTITION BY vec_id ORDER BY idx) > 3, true) AS new FROM b WHERE e IS NOT NULL AND abs(d) > 0.15 AND sign(d) <> sign(e) AND abs(e) > 0.075)
SELECT vec_id, count(*) AS spikes, count(*) FILTER (new) AS events FROM s GROUP BY 1""")
def pcm_clicks(spark, d):
    p = _samples(spark, d).select("vec_id", signal.spikes(F.col("s"), 0.15).alias("p")).where(F.size("p") > 0)
    return p.select("vec_id", F.size("p").cast("long").alias("spikes"), F.size(signal.events(F.col("p"), 3)).cast("long").alias("events"))


@query("""WITH b AS (SELECT event_type, date_trunc('day', ts)::DATE AS block, value FROM events), m AS (SELECT event_type, block, median(value) AS median FROM b GROUP BY 1, 2)
SELECT event_type, block, round(median, 6) AS median, round(median(abs(value - median)), 6) AS mad FROM b JOIN m USING (event_type, block) GROUP BY event_type, block, m.median""")
def block_mad(spark, d):
    out = signal.block_floor(t(spark, d, "events"), ["event_type"], F.to_date("ts"), "value")
    return out.select("event_type", "block", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query(f"SELECT vec_id, idx::INTEGER AS idx, round(sum(x) OVER (PARTITION BY vec_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM ({_X})")
def moving_average_zero_pad(spark, d):
    return _samples(spark, d).select("vec_id", F.posexplode(signal.moving_average(F.col("s"), 5)).alias("idx", "x")).select("vec_id", "idx", F.round("x", 6).alias("smooth"))


@query()
def fft_cutoff(spark, d):
    """Sixteen vectors in a row are a signal, long enough for a few frames."""
    e = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("clip"), "vec_id", signal.doubles(F.col("embedding")).alias("s"))
    joined = e.groupBy("clip").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "s"))), lambda x: x["s"])).alias("s"))
    return joined.select("clip", signal.cutoff(F.col("s"), 8000.0, n_fft=64, least_db=1.0).alias("cutoff_hz"))


# Ledger


@query("""SELECT user_id, started, (SELECT count(*) FROM events e WHERE e.user_id = h.user_id AND e.event_type = 'error') AS entries FROM (SELECT user_id, min(ts) AS started FROM events GROUP BY 1) h ORDER BY started DESC, user_id LIMIT 50""")
def ledger_batches(spark, d):
    e = t(spark, d, "events")
    return ledger.batches(e.groupBy("user_id").agg(F.min("ts").alias("started")), e.where("event_type = 'error'"), "user_id", "started", 50)


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INTEGER AS step, CASE WHEN event_type = 'view' THEN 'skipped' ELSE 'restored' END AS outcome FROM events WHERE event_type <> 'error'""")
def ledger_replay(spark, d):
    return ledger.replay(t(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") != "error", F.col("event_type") == "view").select("user_id", "event_id", "step", "outcome")


@query("""SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY min(ts) DESC, user_id LIMIT 20)""")
def ledger_prune(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    return ledger.pruned(e.groupBy("user_id").agg(F.min("ts").alias("started")), e, "user_id", "started", 20).select("event_id", "user_id")


@query("""SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events WHERE props IS NOT NULL""", "json_props_all")
def json_props(spark, d):
    return files.parsed(t(spark, d, "events").select("event_id", "props"), "props", "k int").select("event_id", "k")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-23') WHERE r = 1""")
def cache_ttl(spark, d):
    live = ledger.fresh(t(spark, d, "events"), F.col("ts"), F.lit("2024-01-30").cast("timestamp"), F.expr("INTERVAL 7 DAYS"))
    return ledger.latest(live, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""WITH n AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM n) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    return streams.sessions(t(spark, d, "events"), "user_id", "ts", "6 hours", "1 day")


@query(r"""SELECT path FROM (SELECT '/lib/' || p_brand || '/' || CASE WHEN p_size % 10 = 0 THEN '.hidden/' ELSE '' END || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.txt' ELSE '.MP3' END AS path, p_size FROM part) WHERE p_size % 10 <> 0 AND p_size % 3 <> 0""")
def file_listing(spark, d):
    p = t(spark, d, "part").select(F.concat(F.lit("/lib/"), "p_brand", F.lit("/"), F.when(F.col("p_size") % 10 == 0, ".hidden/").otherwise(""), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, ".txt").otherwise(".MP3")).alias("path"))
    return files.listing(p)
