"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib

import pytest
from cases import documents

from lyrebird.llm.resample import resample

FIELDS = "doc_id long, text string"


def brute(docs, target, percent=10, least_words=20, longest=1, buckets=10_000, seed=2024):
    """Rows of doc_id, n_features, weight and score in the order of their ranks, those without a rank after them."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    own = [(i, words(t), [bucket(g) for g in grams(words(t))]) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in own:
        for b in f:
            s[b] += 1
    for x in target:
        for g in grams(words(x)):
            t[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, w, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(w) >= least_words, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))))
    good = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    k = percent * len(good) // 100
    return [(*r[1:], n + 1) for n, r in enumerate(good[:k])] + [(*r[1:], None) for r in good[k:]] + [(*r[1:], None) for r in rows if not r[0]]


def check(spark, docs, target, **options):
    out = resample(spark.createDataFrame(docs, FIELDS), spark.createDataFrame([(x,) for x in target], "text string"), **options)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(brute(docs, target, **options), key=repr)


def test_draw_of_whole_documents(spark):
    from shared_tables import small

    docs = [(r["doc_id"], r["text"]) for r in small(spark, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in small(spark, "benchmark").collect()]
    check(spark, docs, target)
    check(spark, docs, target, percent=37, least_words=50, longest=3, buckets=500, seed=5)


def test_ties_and_repeated_rows(spark):
    same, other = "w " * 25, "w v " * 13
    docs = [(7, same)] * 30 + [(7, other)] * 5 + [(None, same)] * 40 + [(None, None)] * 3 + [(i, same) for i in range(20)]
    for percent in (1, 10, 33, 50, 77, 100):
        check(spark, docs, ["w w v"], percent=percent)


def test_odd_documents_and_clashing_columns(spark):
    df = documents(spark)
    target = spark.createDataFrame([("the cat and the dog",), (None,), ("",)], "text string")
    got = sorted((tuple(r) for r in resample(df, target, percent=50).collect()), key=repr)
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got == sorted(brute(docs, ["the cat and the dog"], percent=50), key=repr)


@pytest.mark.parametrize("docs", [[], [(1, None), (2, "short")]])
def test_nothing_to_draw(spark, docs):
    check(spark, docs, [])
    check(spark, docs, ["a target"])


def test_rows_are_numbered_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr("lyrebird.llm.resample.ROWS", 7)
    check(spark, [(i, f"a{i % 13} " * 20) for i in range(200)], ["a1 a2"], percent=60)
