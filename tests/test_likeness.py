"""The likeness join against all pairs, and the substring search against a scan."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lyrebird.functions import text
from lyrebird.operators import likeness, substrings
from lyrebird.plans import search


def _names(rng, n):
    words = ["the", "a", "low", "tide", "ferry", "night", "kite", "club", "oar", "choir", "ñandú", "home", "x"]
    out = []
    for _ in range(n):
        name = [rng.choice(words) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            w = rng.randrange(len(name))
            at = rng.randrange(len(name[w]) + 1)
            name[w] = name[w][:at] + rng.choice("aeiouzq") + name[w][at + rng.randint(0, 1) :]
        out.append(" ".join(name))
    return out


def _brute(names, least):
    folded = sorted({text.fold(n) for n in names if n} - {""})
    return {(a, b): text.likeness(a, b) for i, a in enumerate(folded) for b in folded[i + 1 :] if text.likeness(a, b) >= least - 1e-9}


@pytest.mark.parametrize("least", [0.7, 0.8, 0.9, 1.0])
def test_alike_equals_all_pairs(spark, monkeypatch, least):
    names = _names(random.Random(int(least * 10)), 220) + [None, "", "  ", "!!", "Low Tide", "low tide", "LOW  TIDE!", "tide low low", "z" * 3000, "z" * 2990 + "y", "the " * 400]
    # Keys are dealt over tiles from a few entries on.
    monkeypatch.setattr(likeness, "TILE", 16)
    got = likeness.alike(spark.createDataFrame([(n, 1) for n in names], "title string, name int"), "title", least).collect()
    want = _brute(names, least)
    assert {(r["name"], r.other) for r in got} == want.keys() and len(got) == len(want) > 0
    assert all(abs(r.likeness - want[r["name"], r.other]) < 1e-9 for r in got)
    if least < 1:
        times = {}
        for n in names:
            times[text.fold(n)] = times.get(text.fold(n), 0) + 1
        assert all((r.n_names, r.n_others) == (times[r["name"]], times[r.other]) for r in got)


@pytest.mark.parametrize("i, j", [(0, 0), (0, 1)])
def test_a_block_meets_each_two_entries_once(monkeypatch, i, j):
    monkeypatch.setattr(likeness, "ROWS", 7)
    rng, least, rows = np.random.default_rng(i + j), 0.8, []
    centres = rng.integers(0, 256, (4, 30))
    for k in range(240):
        bag = centres[k % 4, : rng.integers(18, 31)] if k % 5 else rng.integers(0, 256, rng.integers(2, 90))
        words = [sum(1 << int(b) % 64 for b in set(bag.tolist()) if b // 64 == w) for w in range(4)]
        rows.append((k // 2, k % 3, [i, j][k // 12 % 2], len(bag), len(bag) - 1, int(rng.integers(0, 6)), words))
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    columns = {c: pa.array([r[at] for r in rows]) for at, c in enumerate(("id", "element", "tile", "n", "length", "at"))}
    columns |= {c: pa.array([signed(r[6][w]) for r in rows], pa.int64()) for w, c in enumerate(likeness.BITMAP)}
    got = likeness._overlapping(least)(pa.table(columns | {"__i": pa.array([i] * 240), "__j": pa.array([j] * 240)})).to_pylist()
    want = []
    for x, a in enumerate(rows):
        for b in rows[x + 1 :]:
            if a[1] == b[1] and a[0] != b[0] and (i == j or a[2] != b[2]):
                need = 1 + (a[4] + b[4]) * (1.5 * least - 1) - 1e-9
                lacks = lambda p, q: sum((v & ~w).bit_count() for v, w in zip(p[6], q[6]))
                if min(a[4], b[4]) >= max(a[4], b[4]) * least / (2 - least) - 1e-9 and min(a[3] - a[5], b[3] - b[5], a[3] - lacks(a, b), b[3] - lacks(b, a)) >= need:
                    want.append((min(a[0], b[0]), max(a[0], b[0])))
    assert len(want) > 100 and sorted((r["a"], r["b"]) for r in got) == sorted(want)


def test_few_candidates(spark):
    rng = random.Random(5)
    names = {" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(4)) for _ in range(1500)}
    near = {n + "s" for n in list(names)[:40]}
    table = spark.createDataFrame(list(enumerate(names | near)), "id long, name string")
    n = likeness.candidates(table, 0.9).count()
    assert 40 <= n < 400  # of 1.2 million pairs


def test_alike_edges(spark):
    assert likeness.alike(spark.createDataFrame([], "n string"), "n", 0.9).count() == 0
    assert likeness.alike(spark.createDataFrame([(None,), ("",), ("one",), ("one",)], "n string"), "n", 0.9).count() == 0
    with pytest.raises(ValueError):
        likeness.candidates(spark.createDataFrame([], "id long, name string"), 0.6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "abc", "b", "ca", "abcd"]), min_size=1, max_size=5), st.lists(st.sampled_from(["ab", "abd", "b", "ca", "bcd"]), min_size=1, max_size=5))
def test_bound_of_the_overlap(x, y):
    """The bound that the join rests on, for the ratio of whole names."""
    a, b = " ".join(x), " ".join(y)
    bag = lambda s: [f" {s} "[i : i + 2] for i in range(len(s) + 1)]
    rest, shared = bag(b), 0
    for g in bag(a):
        if g in rest:
            rest.remove(g)
            shared += 1
    ratio = text.indel_ratio(a, b)
    assert shared >= 1 + (len(a) + len(b)) * (1.5 * ratio - 1) - 1e-9
    assert sorted(bag(a)) == sorted(bag(" ".join(reversed(x))))


ROWS = [(1, "/a/Ferry.mp3", "Night Ferry", None), (2, "/b/x.mp3", "", "Kite"), (3, "/c/y.flac", None, None), (4, "", None, ""), (5, "/d/İz %_\\.ogg", "né𝄞e", "ferry"), (6, "z" * 5000, None, "q")]


def test_substring_search_equals_a_scan(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc long, path string, title string, album string")
    fields = [F.col("path"), F.col("title"), F.col("album")]
    texts = ["ferry", "FERRY.mp3 night", "mp3 k", "e", "", None, "/", "é𝄞", "𝄞", "%_\\", "zzzz", "z" * 4000, "nope", "x.mp3 kite", "y.flac ", "z q", ".m"]
    searches = spark.createDataFrame(list(enumerate(texts)), "s int, q string")
    hay = {r["doc"]: r["h"] for r in df.select("doc", substrings.haystack(fields).alias("h")).collect()}
    want = {(i, d) for i, q in enumerate(texts) if q for d, h in hay.items() if q.lower() in h}
    whole = substrings.index(df, "doc", fields)
    found = lambda postings: sorted(map(tuple, substrings.search(searches, "s", "q", df, "doc", fields, postings).collect()))
    assert found(whole) == sorted(want) and {i for i, _ in want} >= {0, 1, 2, 3, 6, 7, 8, 9, 10, 11, 13, 16}
    only = substrings.asked(searches, "q").select("gram")
    assert found(substrings.index(df, "doc", fields, only)) == sorted(want)
    substrings.write_index(whole, str(tmp_path / "index"))
    assert found(substrings.read_index(spark, str(tmp_path / "index"), only)) == sorted(want)


def test_substring_index_reads_less(spark, tmp_path):
    df = spark.createDataFrame([(i, f"name {i * 7919 % 99991:x} of {i}") for i in range(3000)], "id long, name string")
    path = str(tmp_path / "index")
    substrings.write_index(substrings.index(df, "id", [F.col("name")]), path)
    only = substrings.asked(spark.createDataFrame([("2999",)], "q string"), "q").select("gram")
    part = substrings.read_index(spark, path, only)
    read = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
    assert {r.gram for r in part.select("gram").distinct().collect()} == {"299", "999"}
    assert 0 < len(read) < spark.read.parquet(path).select(F.input_file_name()).distinct().count() / 4


def test_similar_titles(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r.t for r in spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t")).collect()]
    got = {(r["name"], r.other): r.likeness for r in search.similar_titles(spark, sf).collect()}
    want = _brute(rows, 0.9)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
