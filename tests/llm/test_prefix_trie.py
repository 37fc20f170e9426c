"""The prefix trie against plain Python, in one range and in many."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from shared_tables import small

from lyrebird.llm import prefix_trie
from lyrebird.llm.prefix_trie import prefix_trie as trie

FIELDS = "conv_id long, turn int, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    seq = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, v in seq.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(seq.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ended = ",".join(str(c) for c in sorted(c for c in m if made[c] == p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    out = trie(spark.createDataFrame(rows, FIELDS))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


def made_up(seed, convs, longest=9, kinds=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"][: 1 + t % 2]), rng.choice("abcdé"[:kinds])) for c in range(convs) for t in range(rng.randint(1, longest))]


def test_whole_table(spark):
    df = small(spark, "conversations").select("conv_id", "turn", "role", "text")
    check(spark, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("turns", [3, 20, 100])
def test_ranges_of_ranges(spark, monkeypatch, turns):
    """Few turns a range, so edges of ranges are ranged again, more than once."""
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    check(spark, made_up(turns, 120))


def test_hot_first_turn_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART_BITS", 3)
    same = [(c, t, "user", "hello") for c in range(0, 400, 5) for t in range(2)]
    check(spark, same + [(c, t, "user", "hello" if t == 0 else str(c)) for c in range(1, 200, 5) for t in range(3)])


def test_deep_conversations(spark):
    """Rounds follow from ranges, not from the depth."""
    rows = [(c, t, "user", "x" if t < 700 + c else f"{c}-{t}") for c in (0, 1, 5, 7) for t in range(900)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 1, "assistant", "tie"), (None, 0, "user", "nobody"),
        (5, 0, "user", "long " * 100_000), (6, 0, "user", "gone"), (6, 1, None, "gone too"), (-5, 0, "user", "a"), (-7, 3, "user", "b"), (10, 0, "us", "er:x"), (11, 0, "user", ":x"),
    ]
    check(spark, rows)


def test_no_rows(spark):
    assert trie(spark.createDataFrame([], FIELDS)).count() == 0
    assert trie(spark.createDataFrame([(None, 1, "user", "x")], FIELDS)).count() == 0


def test_extra_columns(spark):
    from pyspark.sql import functions as F

    rows = made_up(3, 20)
    df = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in ("path", "depth", "n", "part", "side", "kind", "turns", "base", "h")})
    assert sorted((tuple(r) for r in trie(df).collect()), key=repr) == brute(rows)
