"""Planned paths, counts and tables that are written and read again."""

import pytest
from against import same
from pyspark.sql import functions as F

from lyrebird.operators import catalog, layout
from lyrebird.plans import albums, catalogue  # noqa: F401  they register their queries
from lyrebird.sources import files


@pytest.mark.parametrize("name", ["plan_paths", "flagged_count"])
def test_equals_its_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.SQL[name], "/root/testdata/sf0.001")


FOLDER, FILE = "{album_artist}/{album}{year_suffix}", "{disc_prefix}{track:02d} - {title}"


def plan(spark, rows, folder=FOLDER, name=FILE, roots=("/lib",), **more):
    schema = "seq int, path string, album_artist string, artist string, album string, title string, track_no int, disc_no int, disc_total int, year int"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    tag = {c: F.col(c) for c in df.columns[2:]}
    return [r["planned"] for r in layout.planned(df, "path", "seq", tag, folder, name, list(roots), **more).sort("seq").collect()]


def row(path, album_artist=None, artist=None, album=None, title=None, track=None, disc=None, discs=None, year=None):
    return path, album_artist, artist, album, title, track, disc, discs, year


def test_names_and_roots(spark):
    rows = [
        row("/lib/in/a.FLAC", "Night/Owls", None, "Tides", "Low: tide?", 3, 1, 2, 2004), row("/far/x/y/b.mp3", None, "Vane", "", "Gale", 0, 2, None, None), row("/c.mp3", album="Solo", disc=1),
        row("d.ogg", title="Alone"), row("e/.f", artist="", album="  ", track=12), row(None, title="gone"), row("/lib/g.mp3", title="", album=""),
    ]
    assert plan(spark, rows) == [
        "/lib/Night-Owls/Tides (2004)/1-03 - Low - tide.flac", "/far/x/Vane/Unknown Album/2 - Gale.mp3", "/Unknown Artist/Solo/c.mp3",
        "Unknown Artist/Unknown Album/Alone.ogg", "Unknown Artist/Unknown/12 - .f",
    ]
    assert plan(spark, rows[:1], target="/new/") == ["/new/Night-Owls/Tides (2004)/1-03 - Low - tide.flac"]
    assert plan(spark, []) == []


def test_meeting_files_are_numbered_in_any_case(spark):
    rows = [row(f"/lib/{x}.mp3", "A", None, "B", t, 1) for x, t in (("p", "Song"), ("q", "SONG"), ("r", "Song (2)"), ("s", "song"))]
    rows.append(row("/lib/t.mp3", "a", None, "b", "Song", 1))
    got = plan(spark, rows)
    assert got == ["/lib/A/B/01 - Song.mp3", "/lib/A/B/01 - SONG (2).mp3", "/lib/A/B/01 - Song (2) (2).mp3", "/lib/A/B/01 - song (3).mp3", "/lib/a/b/01 - Song (4).mp3"]
    assert len({x.lower() for x in got}) == 5


@pytest.mark.parametrize("bad", ["{nobody}", "{title:02d}", "{track:>4}", "{title", "title}", "{}"])
def test_templates_that_are_not_valid(spark, bad):
    one = [row("/lib/a.mp3", "A", None, "B", "C", 1)]
    assert plan(spark, one, folder=bad) == ["/lib/A/B/01 - C.mp3"]
    assert plan(spark, one, name=bad) == ["/lib/A/B/B.mp3"]


def test_templates_without_names(spark):
    one = [row("/lib/a.mp3", "A", None, "B", "C", 1)]
    assert plan(spark, one, folder="", name="") == ["/lib/a.mp3"]
    assert plan(spark, one, folder="all//{genre}/of it", name="x/{track}") == ["/lib/all/of it/1.mp3"]


def test_columns_that_sort(spark):
    df = spark.createDataFrame([], "path string, tags struct<title:string,album:string>, confidence double")
    assert [tuple(r) for r in catalog.sortable(df, "tags").collect()] == [("tag", "title", 0), ("tag", "album", 1), ("file", "confidence", 0), ("file", "path", 1)]


def test_state_is_written_updated_and_cleared(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, None)], "k string, v int, s string")
    new = spark.createDataFrame([("b", 2, "y"), ("c", 1, None)], "k string, v int, s string")
    first, second = str(tmp_path / "1"), str(tmp_path / "2")
    files.upsert(old, new, ["k"], [F.col("v")], first)
    assert sorted(map(tuple, spark.read.parquet(first).collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 1, None)]
    files.upsert(spark.read.parquet(first), new.withColumn("more", F.lit(1)), ["k"], [F.col("v"), F.col("more")], second)
    assert spark.read.parquet(second).count() == 3
    files.cleared(spark.read.parquet(second), first)
    empty = spark.read.parquet(first)
    assert empty.isEmpty() and empty.columns == ["k", "v", "s", "more"]


def test_audio_files_of_a_folder(spark, tmp_path):
    for p in ("a.MP3", "x/b.flac", "x/notes.txt", ".git/c.mp3", "x/@eaDir/d.mp3", "x/._e.mp3", "x/y/f.opus"):
        (tmp_path / "lib" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / p).write_bytes(b"12345")
    root = str(tmp_path / "lib")
    got = files.audio_files(spark, root)
    assert sorted(r["path"].split("/lib/")[1] for r in got.collect()) == ["a.MP3", "x/b.flac", "x/y/f.opus"]
    assert {r["length"] for r in got.collect()} == {5}
    assert [r["path"].split("/lib/")[1] for r in files.audio_files(spark, root, recursive=False).collect()] == ["a.MP3"]


def test_a_safe_name_is_worked_out_once(spark):
    """Each step of safe_name() names its input once; named twice at each of three steps it was worked out eight times and more."""
    from pyspark.sql import functions as F

    from lyrebird.functions import text

    rows = spark.createDataFrame([("con",), ("CON.txt",), ("console",), ("",), (None,), (" . ",), ("x" * 119 + ". y",), ("con" + "x" * 130,), ("nul.",), ("a\u2028",)], "raw_name string")
    named = rows.select(text.safe_name(F.col("raw_name")).alias("safe"))
    assert str(text.safe_name(F.col("raw_name"))).count("raw_name") == 1
    assert [r["safe"] for r in named.collect()] == ["_con", "_CON.txt", "console", "Unknown", "Unknown", "Unknown", "x" * 119, "con" + "x" * 117, "_nul", "a\u2028"]


def test_files_of_folders_are_written_once(spark, monkeypatch):
    from lyrebird.operators import steps

    names, own = [], steps.stored
    monkeypatch.setattr(steps, "stored", lambda df, name: names.append(name) or own(df, name))
    plan = albums.consolidate_folders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert names == ["files"] and "lineitem.parquet" not in plan and "l_orderkey" not in plan
