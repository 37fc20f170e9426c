from pyspark.sql import functions as F

from lyrebird.operators import tracks


def test_tracklist_and_credit(spark):
    media = "array<struct<tracks:array<struct<id:string,title:string,length:long>>>>"
    df = spark.createDataFrame([("r", [([("a", "A", 1500), ("b", "B", 0)],), ([("c", "C", None)],)])], f"rel string, media {media}")
    got = [tuple(r) for r in tracks.tracklist(df, "rel", "media").collect()]
    assert got == [("r", "a", "A", 1.5, 1, 2, 1, 2), ("r", "b", "B", None, 2, 2, 1, 2), ("r", "c", "C", None, 1, 1, 2, 2)]
    artists = spark.createDataFrame([([("X", " & ", "1"), ("Y", "", "2")],), ([],)], "a array<struct<name:string,joinphrase:string,id:string>>")
    assert [tuple(r) for r in artists.select(*tracks.credit(F.col("a"))).collect()] == [("X & Y", "1"), (None, None)]


def test_choose_and_edit(spark):
    schema = "path string, current struct<title:string,genre:string>, candidates array<struct<confidence:double,tags:struct<title:string,genre:string>>>, chosen_index int, confidence double, proposed struct<title:string,genre:string>, field_confidence map<string,double>, method string"
    rows = [("p", ("t", "g"), [(90.0, ("a", "x")), (70.0, ("b", "y"))], 0, 90.0, ("a", "x"), {"title": 90.0}, "text"), ("q", ("t", "g"), None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    a, b = tracks.choose(df, F.lit(True), 1).orderBy("path").collect()
    assert (a.chosen_index, a.confidence, a.proposed.title, a.field_confidence) == (1, 70.0, "b", {"title": 70.0}) and b.chosen_index is None
    assert tracks.choose(df, F.lit(True), 7).orderBy("path").first().chosen_index == 0
    a, b = tracks.edit(df, F.lit(True), {"genre": F.lit("z"), "unknown": F.lit(1)}).orderBy("path").collect()
    assert (a.proposed, a.confidence, a.field_confidence) == (("a", "z"), 90.0, {"title": 90.0, "genre": 100.0, "unknown": 100.0})
    assert (b.proposed, b.confidence, b.method) == (("t", "z"), 100.0, "manual")


def test_small_decisions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tracks.library_root(F.lit("/m/b/c.mp3"), ["/m/a", "/m", "/m/b"])) == "/m"
    assert [one(tracks.cover_size(F.lit(x))) for x in (100, 600, 5000)] == [250, 500, 1200]
    assert one(tracks.same_format(F.lit("M4A"), F.lit("aac"))) and not one(tracks.same_format(F.lit("mp3"), F.lit("aac")))
    assert one(tracks.gap(F.lit(0), F.lit(3))) == float("inf") and one(tracks.gap(F.lit(5), F.lit(3))) == 2.0
    assert one(tracks.conflicts(F.lit("b"), F.lit("a"), [("a", "b")])) and not one(tracks.eligible(F.lit(""), F.lit(None).cast("string"), F.lit("")))
    assert one(tracks.album_key(F.lit(" A "), F.lit("B"), F.lit("/f"))) == "a|b" and one(tracks.album_key(F.lit("A"), F.lit(None).cast("string"), F.lit("/f"))) == "/f"
