"""The queries that apply each operator to its whole table, and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm import shared, warc
from lyrebird.llm.langid import identify_languages
from lyrebird.llm.lm import score_documents
from lyrebird.llm.maxscore import max_score_top_k
from lyrebird.llm.mixing import mix_sources
from lyrebird.llm.ngram_join import jaccard_classes
from lyrebird.llm.packing import pack_documents
from lyrebird.llm.pii import pseudonyms
from lyrebird.llm.prefix_trie import prefix_trie
from lyrebird.llm.quality import STOP_WORDS, quality_rules
from lyrebird.llm.resample import resample
from lyrebird.llm.token_store import digest, read_token_ids, write_token_ids
from lyrebird.llm.urls import junk_text, url_filter


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

#: The key of the queries' pseudonyms; a production run takes its own from a secret store.
KEY = "an example key"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_len=2048)


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(shared.table(spark, sf_dir, "documents"))


def op4_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(shared.table(spark, sf_dir, "documents"))


def op5_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_score_top_k(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(shared.table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "warc")
    index = warc.write_archive(warc.with_types(shared.table(spark, sf_dir, "pages")), folder)
    found = warc.read_archive(spark, folder, index)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(shared.table(spark, sf_dir, "pages").select("page_id", "url", "html"), bad=junk_text(F.col("html")))


def op10_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared.scratch(spark, "token-ids")
    write_token_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(read_token_ids(spark, path))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return identify_languages(shared.table(spark, sf_dir, "documents"), held_out)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(shared.table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_feistel_pii, op3_maxent_scores, op4_jaccard_trie, op5_max_score, op6_poisson_mix, op7_warc, op8_quality_rules, op9_url_templates, op10_orc_token_ids, op11_importance_resample, op12_language_id, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op5_max_score": OP5_SQL, "op6_poisson_mix": OP6_SQL, "op7_warc": OP7_SQL, "op8_quality_rules": OP8_SQL, "op11_importance_resample": OP11_SQL, "op13_prefix_trie": OP13_SQL}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
starts AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM grams WHERE c > 1),
repeats AS (SELECT doc_id, sum(least(5, coalesce(gap, 5)))::BIGINT AS r FROM starts GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(rtrim(x, '.,')))))::BIGINT AS n_stop,
    coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id)),
n AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
    AND n_stop / n_words >= 0.06 AND n_dup_lines / len(lines) <= 0.5 AS kept
FROM n
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_U = "('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, coalesce(source, ''), '0')), 1, 13))::BIGINT / 16.0 ** 13"

OP6_SQL = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (sum(n) OVER ()) / (sum(w) OVER ()) / n AS rate FROM s),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 12)),
d AS (SELECT *, {_U} AS u FROM documents),
c AS (SELECT d.doc_id, count(*) AS copies FROM d JOIN steps ON d.source IS NOT DISTINCT FROM steps.source AND steps.total <= d.u GROUP BY d.doc_id),
e AS (SELECT d.* EXCLUDE u, unnest(range(copies))::INTEGER AS copy FROM d JOIN c USING (doc_id))
SELECT *, md5(concat_ws('|', 'mix', 'order', doc_id::VARCHAR, coalesce(source, ''), copy::VARCHAR)) AS shuffle_key FROM e
"""

# DuckDB has no crc32: its table of 256 values by eight steps each, then byte by byte over each distinct value x of a table v.
_CRC32 = """
steps AS (SELECT b, 0 AS i, b::UBIGINT AS c FROM range(256) AS r(b) UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE i < 8),
lookup AS (SELECT list(c ORDER BY b) AS l FROM steps WHERE i = 8),
bytes AS (SELECT x, hex(encode(x)) AS h FROM v),
crc AS (
  SELECT x, 0 AS i, 4294967295::UBIGINT AS c, h FROM bytes
  UNION ALL SELECT x, i + 1, xor(c >> 8, l[(xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT) + 1)::BIGINT]), h FROM crc, lookup WHERE 2 * i < length(h)),
crc32 AS (SELECT x, xor(c, 4294967295) AS crc FROM crc WHERE 2 * i = length(h))"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM} AS w FROM documents),
b AS (SELECT unnest({_ALNUM}) AS x FROM benchmark),
f AS (SELECT r, unnest(w) AS x FROM d),
v AS (SELECT x FROM f UNION SELECT x FROM b),
{_CRC32},
s AS (SELECT crc % 10000 AS k, count(*) AS s FROM f JOIN crc32 USING (x) GROUP BY 1),
t AS (SELECT crc % 10000 AS k, count(*) AS t FROM b JOIN crc32 USING (x) GROUP BY 1),
total AS (SELECT (SELECT count(*) FROM f) AS big_s, (SELECT count(*) FROM b) AS big_t),
g AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (k), total),
m AS (SELECT r, count(*) AS n, sum(g) AS total FROM f JOIN crc32 USING (x) JOIN g ON g.k = crc % 10000 GROUP BY r),
e AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place, (SELECT count(*) FROM z WHERE n_features >= 20) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM p
"""

OP13_SQL = f"""
WITH RECURSIVE own AS (
  SELECT conv_id AS c, list(struct_pack(role := coalesce(role, ''), txt := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
v AS (SELECT c::VARCHAR AS x FROM own),
{_CRC32},
h AS (SELECT o.c, o.t, b.t AS base, (crc % 9)::BIGINT AS h FROM own o JOIN crc32 ON x = o.c::VARCHAR LEFT JOIN own b ON b.c = o.c - o.c % 5),
r AS (SELECT c, list_concat(coalesce(base[:h], []), t[h + 1:]) AS t FROM h),
m AS (SELECT c, len(t) AS long, unnest(range(len(t) + 1)) AS d, t FROM r),
n AS (
  SELECT d, t[:d] AS p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (long = d), '')) AS ends_sha256
  FROM m GROUP BY 1, 2),
k AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.p[:n.d] = n.p) AS n_children,
    CASE WHEN n.d > 0 THEN (n.n_convs - 1) * octet_length(encode(n.p[n.d].txt)) ELSE 0 END AS own_saved
  FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.p = n.p[:n.d - 1]),
up AS (SELECT unnest(range(d + 1)) AS d, p, n_children, own_saved FROM k),
s AS (SELECT d, p[:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved FROM up GROUP BY 1, 2)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM k JOIN s USING (d, p)
"""
