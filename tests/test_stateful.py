"""Streams with state: the same output however the stream is cut, restarts, expiry against SQL, and a journal that breaks off."""

import duckdb
import pandas as pd
import pytest

from lyrebird.streaming import journal, stateful

SCAN = "path string, seq long, version double, tags string, known string"
REQUEST = "key string, seq long, op string, value string, ts timestamp"


def run(spark, make, schema, folders, tmp_path, name):
    """Rows of make(stream) over parquet files that come one a micro-batch."""
    source, out = tmp_path / f"{name}-in", tmp_path / f"{name}-out"
    source.mkdir(exist_ok=True)
    for rows in folders:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(source)))
        # A new query a file from one checkpoint: each is a restart.
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    got = [tuple(r) for r in spark.read.parquet(str(out)).collect()]
    return sorted(got, key=repr)


def scans(n):
    rows = []
    for i in range(n):
        path = f"/m/{i * 7 % 11}.mp3"
        rows.append((path, i, float(i // 25 if i * 7 % 11 % 3 else i % 2), f"tags {i}", f"found {i}" if i % 4 == 0 else None))
    rows.append((None, n, 1.0, "nobody", None))
    rows.append(("/m/none.mp3", n + 1, None, "no version", "x"))
    rows.append(("/m/none.mp3", n + 2, None, "no version", None))
    return rows


def brute_scans(rows):
    state, out = {}, []
    for path, seq, version, tags, known in sorted(rows, key=lambda r: r[1]):
        if path is None:
            continue
        old = state.get(path)
        if old is None:
            what = "added"
        elif version is not None and old[0] == version:
            what, known = "kept", known if known is not None else old[1]
        else:
            what = "replaced"
        state[path] = (version, known)
        out.append((path, seq, version, tags, known, what))
    return sorted(out, key=repr)


def test_rescan_is_the_same_in_one_and_in_many_batches(spark, tmp_path):
    rows = scans(60)
    want = brute_scans(rows)
    assert {r[5] for r in want} == {"added", "kept", "replaced"}
    one = run(spark, stateful.rescanned, SCAN, [rows], tmp_path, "one")
    many = run(spark, stateful.rescanned, SCAN, [rows[i : i + 16] for i in range(0, len(rows), 16)], tmp_path, "many")
    assert one == want and many == want


def requests():
    base = pd.Timestamp("2024-01-01", tz="UTC")
    rows = []
    for i in range(80):
        key = f"k{i * 5 % 7}"
        rows.append((key, i, "put" if i % 3 == 0 else "get", None if i % 6 == 0 else f"v{i}", (base + pd.Timedelta(seconds=i * 4)).to_pydatetime()))
    return rows


TTL = 40

SQL = f"""
WITH p AS (SELECT * FROM r WHERE op = 'put'), g AS (SELECT * FROM r WHERE op = 'get'),
j AS (SELECT g.key, g.seq, g.ts, p.value, p.ts AS made, row_number() OVER (PARTITION BY g.key, g.seq ORDER BY p.ts DESC, p.seq DESC) AS n FROM g LEFT JOIN p ON p.key = g.key AND (p.ts < g.ts OR (p.ts = g.ts AND p.seq < g.seq)))
SELECT key, seq, CASE WHEN made IS NULL THEN 'miss' WHEN ts - made > INTERVAL {TTL} SECOND THEN 'expired' WHEN value IS NULL THEN 'null' ELSE 'hit' END AS answer,
  CASE WHEN ts - made <= INTERVAL {TTL} SECOND THEN value END AS value FROM j WHERE n = 1
"""


def answers(rows):
    r = pd.DataFrame(rows, columns=["key", "seq", "op", "value", "ts"])  # noqa: F841  DuckDB reads it
    return sorted((tuple(None if isinstance(x, float) else x for x in row) for row in duckdb.sql(SQL).fetchall()), key=repr)


def test_cache_against_sql_in_one_batch(spark, tmp_path):
    rows = requests()
    want = answers(rows)
    assert {a for _, _, a, _ in want} == {"hit", "null", "miss", "expired"}
    got = run(spark, lambda s: stateful.cached(s, TTL, "1 hour"), REQUEST, [rows], tmp_path, "cache")
    assert got == want


def test_cache_in_batches_late_rows_and_cleared_keys(spark, tmp_path):
    """Batches in order give what SQL gives, but that an expired key whose state is gone is a miss; late requests go."""
    rows = requests()
    base = rows[0][4]
    late = ("k0", 999, "get", None, base)
    got = run(spark, lambda s: stateful.cached(s, TTL, "5 seconds"), REQUEST, [rows[:40], rows[40:], [late, rows[-1][:1] + (1000, "get", None, rows[-1][4])]], tmp_path, "batches")
    plain = lambda a: [(k, s, "gone" if x in ("miss", "expired") else x, v) for k, s, x, v in a]
    extra = [r for r in got if r[1] >= 999]
    assert [r[1] for r in extra] == [1000]  # the late one is dropped
    assert plain([r for r in got if r[1] < 999]) == plain(answers(rows))


FIELDS = "seq long, path string, ok boolean"


def test_journal_takes_a_batch_once(spark, tmp_path):
    path = f"file://{tmp_path}/journal"
    batch = lambda n: spark.createDataFrame([(n * 10 + i, f"/m/{i}", True) for i in range(3)], FIELDS)
    assert journal.read(spark, path, FIELDS).count() == 0
    assert journal.append(batch(0), path, 0) and journal.append(batch(1), path, 1)
    assert not journal.append(batch(1), path, 1)

    def crash():
        raise RuntimeError("power cut")

    with pytest.raises(RuntimeError):
        journal.append(batch(2), path, 2, crash)
    seen = lambda: sorted((r["batch"], r["seq"]) for r in journal.read(spark, path, FIELDS).collect())
    assert seen() == [(b, b * 10 + i) for b in (0, 1) for i in range(3)]  # the half batch isn't seen
    assert journal.append(batch(2), path, 2)
    assert seen() == [(b, b * 10 + i) for b in (0, 1, 2) for i in range(3)]


def test_journal_stream_that_breaks_off_adds_each_row_once(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "in"), f"file://{tmp_path}/journal", str(tmp_path / "cp")
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, "/m", True) for i in range(4)], FIELDS).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(source)
    calls = []

    def crash():
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("power cut")

    q = journal.write_stream(stream(), path, checkpoint, crash)
    with pytest.raises(Exception, match="power cut"):
        q.awaitTermination()
    assert journal.read(spark, path, FIELDS).count() == 4
    journal.write_stream(stream(), path, checkpoint).awaitTermination()
    got = sorted(r["seq"] for r in journal.read(spark, path, FIELDS).collect())
    assert got == sorted(k * 10 + i for k in range(3) for i in range(4))


def test_clear_keeps_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x", True)], FIELDS).write.parquet(path)
    journal.clear(spark, path, FIELDS)
    out = spark.read.parquet(path)
    assert out.count() == 0 and out.schema.simpleString() == "struct<seq:bigint,path:string,ok:boolean>"
