import numpy as np
import pytest
from pyspark.sql import functions as F

from lyrebird.functions import blanks, text
from lyrebird.operators import catalog, ledger, resolve, signal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "how", "want"),
    [
        ("Čaj Ünd Žár", {}, "caj und zar"), ("ﬁne ①", {}, "fine 1"), ("Salt & Ash & Co", {}, "salt and ash and co"), ("Low Tide [2011 Remaster]", {}, "low tide 2011 remaster"), ("Low Tide [Remaster 2011]", {}, "low tide"),
        ("Low Tide (HD) {Explicit}", {}, "low tide"), ("Ferry ft. The Oars", {"drop_guests": True}, "ferry"), ("Ferry (featuring Oar)", {"drop_guests": True}, "ferry"), ("Ferry (featuring Oar)", {}, "ferry featuring oar"),
        ("An A The Hour", {"drop_articles": True}, "a the hour"), ("Theory", {"drop_articles": True}, "theory"), ("a.b--c  \t d", {}, "a b c d"), ("...", {}, ""), (None, {}, ""),
    ],
)
def test_fold(spark, given, how, want):
    assert text.fold(given, **how) == want
    if given is None or given.isascii():
        assert one(spark, text.normalise(F.lit(given).cast("string"), **how)) == want


def test_likeness():
    assert text.likeness("it's a long way", "its a long way") > 0.95
    assert text.likeness("red kite", "copper mill") < 0.5
    assert text.likeness("", "x") == text.likeness(None, "x") == text.likeness("?!", "x") == 0.0
    assert text.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13)
    assert text.token_set_ratio("x y z", "z x") == 1.0
    assert text.token_set_ratio("x y", "x z") == pytest.approx(max(text.indel_ratio("x y", "x z"), text.indel_ratio("x", "x y")))


def slow_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_indel_is_the_longest_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = ("".join(r.choice(list("abcd"), r.integers(0, 90))) for _ in range(2))
        want = 2 * slow_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert text.indel_ratio(a, b) == pytest.approx(want)


@pytest.mark.parametrize(
    ("path", "root", "want"),
    [
        ("/srv/Kite Club/Low Tide [2011]/007. Ferry.opus", None, (None, 7, None, "Ferry", "Low Tide", "Kite Club", 2011)),
        ("/srv/Kite Club/2011_Low Tide/1.12 ) Ferry.ogg", None, (1, 12, None, "Ferry", "Low Tide", "Kite Club", 2011)),
        ("/srv/Kite Club/Low Tide/4_Oar - Ferry - Again.wav", None, (None, 4, "Oar", "Ferry - Again", "Low Tide", "Kite Club", None)),
        ("/srv/Kite Club/Low Tide/disc 3/9-Ferry.flac", None, (None, 9, None, "Ferry", "Low Tide", "Kite Club", None)),
        ("/srv/Kite Club/Low Tide/Ferry.flac", "/srv/Kite Club", (None, None, None, "Ferry", "Low Tide", None, None)),
        ("/srv/Oar - Ferry.flac", "/srv", (None, None, "Oar", "Ferry", None, None, None)),
        ("/srv/a/b/1999.flac", None, (None, None, None, "1999", "b", "a", None)),
    ],
)
def test_path_guess(spark, path, root, want):
    assert tuple(one(spark, text.path_guess(F.lit(path), root))) == want


@pytest.mark.parametrize(("given", "want"), [("up\\down|left", "up-down-left"), ("1<2>0", "1(2)0"), ('say "so": *now*?', "say 'so' - now"), ("nul", "_nul"), ("Lpt9.log", "_Lpt9.log"), ("nullable", "nullable"), (" x\n y .. ", "x y"), ("", "Unknown"), ("...", "Unknown"), (None, "Unknown"), ("y" * 119 + ". z", "y" * 119)])
def test_safe_name(spark, given, want):
    assert one(spark, text.safe_name(F.lit(given).cast("string"))) == want


def test_small_parsers(spark):
    assert one(spark, text.year_of(F.lit("3/2018, again 2020"))) == 2018
    assert one(spark, text.year_of(F.lit("none"))) is None
    assert one(spark, text.first_int(F.lit("a12b3"))) == 12
    assert [one(spark, c) for c in text.pair_of(F.lit("3/12"))] == [3, 12]
    assert [one(spark, c) for c in text.pair_of(F.lit("3"))] == [3, None]
    assert one(spark, text.clock(F.lit(185.9))) == "3:05"
    below = lambda a, b: one(spark, text.version_key(F.lit(a)) < text.version_key(F.lit(b)))
    assert below("1.2.0-rc1", "v1.2") and below("1.2+x", "1.2") and below("1.9", "1.10.0") and one(spark, text.version_key(F.lit("soon"))) is None


def test_template(spark):
    value = lambda **v: {"disc_prefix": F.lit(v.get("d")).cast("string"), "track": F.lit(v.get("t")).cast("int"), "title": F.lit("Low Tide")}
    shape = "{disc_prefix}{track:02d} - {title}"
    assert one(spark, ledger.rendered(shape, value())) == "Low Tide"
    assert one(spark, ledger.rendered(shape, value(d="2-", t=10))) == "2-10 - Low Tide"
    assert one(spark, ledger.rendered(shape, value(t=123))) == "123 - Low Tide"


def test_blanks(spark):
    df = spark.createDataFrame([("", "x", 0, 5), ("a", "", 3, 0), (None, None, None, None)], "a string, b string, n int, m int")
    assert [tuple(r) for r in df.select(blanks.effective(df, "a", "b"), blanks.effective(df, "n", "m")).collect()] == [("x", 5), ("a", 3), (None, None)]
    assert [r[0] for r in df.select(blanks.pending(df, {"b": "a", "m": "n"})).collect()] == [False, True, False]


def test_blanks_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "A"), (4, ""), (5, "a")], "seq int, k string")
    order = lambda d: [r["seq"] for r in catalog.blanks_last(df, "k", d, ["seq"]).collect()]
    assert order(False) == [3, 5, 2, 1, 4]
    assert order(True) == [2, 3, 5, 1, 4]


def test_page(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "seq int, title string")
    assert [r["seq"] for r in catalog.page(df, catalog.Query(sort="seq_desc", numeric=True, tie=["seq"], offset=2, limit=3)).collect()] == [17, 16, 15]
    assert [r["seq"] for r in catalog.page(df, catalog.Query(sort="nothing", tie=["seq"], limit=2)).collect()] == [0, 1]
    with pytest.raises(ValueError):
        catalog.page(df, catalog.Query(offset=-1))


@pytest.mark.parametrize(("f", "source", "unverified", "tags", "evidence", "want"), [(0.95, "x", False, True, 7, 99.0), (0.7, "x", False, True, 7, 95.0), (0.0, "filename", False, True, 7, 45.0), (0.0, "x", False, False, 7, 60.0), (0.0, "x", False, True, 7, 93.0), (0.0, "x", True, True, 7, 75.0), (0.0, "x", False, True, 1, 72.0)])
def test_ceiling(spark, f, source, unverified, tags, evidence, want):
    assert one(spark, resolve.ceiling(F.lit(f), F.lit(source), F.lit(unverified), F.lit(tags), F.lit(evidence))) == want


def test_seats_are_taken_best_first(spark):
    pairs = spark.createDataFrame([("f", 1, 1, 0.9), ("f", 1, 2, 0.8), ("f", 2, 1, 0.95), ("f", 3, 2, 0.1)], "g string, track int, entry int, score double")
    assert sorted((r["track"], r["entry"]) for r in resolve.seats(pairs, ["g"], "track", "entry", "score").collect()) == [(1, 2), (2, 1)]


def test_destinations(spark):
    names = [(1, "d", "A", ".x"), (2, "d", "a", ".x"), (3, "d", "a (2)", ".x"), (4, "e", "A", ".x"), (5, "d", "A", ".X"), (6, "d", "b", ".x")] + [(k, "d", "Z", ".x") for k in range(100, 250)]
    rows = spark.createDataFrame(names, "seq int, folder string, name string, suffix string")
    got = {r["seq"]: r["dest"] for r in ledger.destinations(rows, "folder", "name", "suffix", "seq").collect()}
    assert [got[k] for k in range(1, 7)] == ["A.x", "a (2).x", "a (2) (2).x", "A.x", "A (3).X", "b.x"]
    assert [got[k] for k in range(100, 250)] == ["Z.x", *(f"Z ({n}).x" for n in range(2, 151))]
    assert len({(f, got[k].lower()) for k, f, _, _ in names}) == len(names)


def test_ledger_of_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, v string")
    left, gone = ledger.removed(rows, spark.createDataFrame([(2,), (9,)], "k int"), "k")
    assert sorted(r["k"] for r in left.collect()) == [1, 3, 4] and [r["k"] for r in gone.collect()] == [2]
    moved = ledger.renamed(rows, spark.createDataFrame([(1, 2), (4, 7)], "k int, n int"), "k", "n")
    assert sorted(tuple(r) for r in moved.collect()) == [(2, "a"), (3, "c"), (7, "d")]


def test_quality_scores(spark):
    issues = lambda *s: F.array(*(F.struct(F.lit(x).alias("severity")) for x in s))
    assert [one(spark, catalog.score(catalog.penalty(issues(*s)))) for s in (["high", "low"], ["high"] * 20, ["info"] * 3)] == [64, 0, 100]


def test_cutoff_finds_a_low_pass(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal(44100 * 2)
    f = np.fft.rfft(x)
    f[np.fft.rfftfreq(len(x), 1 / 44100) > 16000] = 0
    df = spark.createDataFrame([(1, np.fft.irfft(f).tolist()), (2, x.tolist())], "id int, s array<double>")
    got = {r["id"]: r["c"] for r in df.select("id", signal.cutoff(F.col("s"), 44100.0).alias("c")).collect()}
    # Where all of both sides is flat, the drop is the same for half a span either way of the edge.
    assert abs(got[1] - 16000) <= signal.SPAN_HZ / 2 + signal.STEP_HZ and got[2] == pytest.approx(22050)


def test_runs_and_silence(spark):
    assert one(spark, signal.run_lengths(F.array(*(F.lit(x >= 1) for x in (0.0, 1.0, 1.0, 0.0, 1.0))))) == [2, 1]
    quiet = lambda *db: tuple(one(spark, signal.silence(F.array(*map(F.lit, db)))))
    assert quiet(-90.0, -3.0, -90.0, -90.0, -3.0, -90.0) == (1, 1, 2) and quiet(-90.0, -90.0) == (2, 0, 0)


def test_stream_merge(spark, tmp_path):
    from lyrebird.streaming.sessions import merge_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], "k int, v int, x string").write.parquet(src)
    held = {}
    stream = spark.readStream.schema("k int, v int, x string").parquet(src)

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{out}/{number}")
        held["at"] = f"{out}/{number}"

    merge_stream(stream, lambda: spark.read.parquet(held["at"]) if held else None, write, ["k"], [F.col("v")], str(tmp_path / "c")).awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(held["at"]).collect()) == [(1, 2, "c"), (2, 1, "b")]


def test_stream_merges_into_buckets(spark, tmp_path):
    from lyrebird.streaming.sessions import merge_stream_into

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, v int, x string"
    runs = [[(k, 1, "a") for k in range(40)], [(3, 2, "b"), (50, 1, "c")], [(3, 1, "old"), (7, 5, None)], []]
    want, written = {}, []
    for n, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        merge_stream_into(spark.readStream.schema(schema).parquet(src), out, ["k"], [F.col("v")], str(tmp_path / "c"), buckets=8).awaitTermination(60)
        for k, v, x in rows:
            if k not in want or v >= want[k][0]:
                want[k] = v, x
        table = spark.read.parquet(out)
        assert {r["k"]: (r["v"], r["x"]) for r in table.collect()} == want
        written.append(set(table.inputFiles()))
    assert len(written[0] & written[1]) >= 6 and written[2] == written[3]  # untouched buckets keep their files
