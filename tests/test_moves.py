"""Files through chains of renames against a replay, entry by entry."""

import random

import pytest

from lyrebird.operators import moves

FIELDS = "seq long, batch int, op string, src string, dest string, before string, after string, ok boolean"


def history(seed, n=120, paths=12):
    """A log of a folder of files, some of whose moves fail, and whose free paths are used again."""
    rng = random.Random(seed)
    at = {f"p{i}": (f"p{i}", 0) for i in range(paths // 2)}  # path to file
    tags, rows, names = {}, [], {}
    for seq in range(1, n + 1):
        src = rng.choice(sorted(at))
        file, op, ok = at[src], rng.choice(["move", "move", "tags", "copy"]), rng.random() > 0.1
        free = [p for p in (f"p{i}" for i in range(paths)) if p not in at]
        dest = rng.choice(free) if op != "tags" and free else None
        if op != "tags" and dest is None:
            op = "tags"
        before, after = (tags.get(file), f"t{seq}") if op == "tags" else (None, None)
        rows.append((seq, seq // 10, op, src, dest, before, after, ok))
        names[seq] = file
        if ok and op == "tags":
            tags[file] = after
        if ok and op == "move":
            at[dest] = at.pop(src)
        if ok and op == "copy":
            at[dest] = (dest, seq)
        # A path that a move leaves is another file's when it is used again; make one there now and then.
        if ok and op == "move" and rng.random() < 0.3:
            at[src] = (src, seq)
    return rows, names, at, tags


@pytest.mark.parametrize("seed", range(3))
def test_each_entry_finds_its_file(spark, seed):
    rows, names, at, tags = history(seed)
    out = moves.files(spark.createDataFrame(rows, FIELDS))
    assert {r["seq"]: (r["origin"], r["born"]) for r in out.collect()} == names
    state = {(r["origin"], r["born"]): (r["path"], r["tags"]) for r in moves.state_at(out).collect()}
    assert {f: state[f] for f in set(names.values())} == {f: (p, tags.get(f)) for p, f in at.items() if f in set(names.values())}


def test_state_as_of_a_batch(spark):
    rows, _, _, _ = history(9)
    out = moves.files(spark.createDataFrame(rows, FIELDS))
    short = moves.files(spark.createDataFrame([r for r in rows if r[0] <= 57], FIELDS))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(moves.state_at(out, 57)) == key(moves.state_at(short))


def test_chains_of_twenty_and_a_swap(spark):
    chain = [(i, 1, "move", f"c{i}", f"c{i + 1}", None, None, True) for i in range(1, 21)]
    swap = [(30, 2, "move", "a", "tmp", None, None, True), (31, 2, "move", "b", "a", None, None, True), (32, 2, "move", "tmp", "b", None, None, True), (33, 2, "tags", "a", None, "old", "new", True), (34, 3, "tags", "c21", None, None, "x", True), (35, 3, "tags", None, None, None, "y", True)]
    out = moves.files(spark.createDataFrame(chain + swap, FIELDS))
    got = {r["seq"]: (r["origin"], r["born"]) for r in out.collect()}
    assert all(got[i] == ("c1", 0) for i in (*range(1, 21), 34)) and (got[32], got[33], got[35]) == (("a", 0), ("b", 0), (None, None))
    undone = moves.undo(out, 2).orderBy("step").collect()
    assert [(r.seq, r.outcome, r.path, r.tags) for r in undone] == [(33, "restored", "a", "old"), (32, "restored", "tmp", None), (31, "restored", "b", None), (30, "restored", "a", None)]
    assert {r.outcome for r in moves.undo(out, 2, undone=True).collect()} == {"skipped"}
    back = moves.undo(out, 1).orderBy("step").collect()
    assert [r.path for r in back] == [f"c{i}" for i in range(20, 0, -1)] and {r.outcome for r in back} == {"restored"}


def replay(rows, names, batch):
    """Where each file is after all, and what undoing the batch does, one entry after the other."""
    at = {}
    for seq, _, op, src, dest, _, _, ok in rows:
        at.setdefault(names[seq], names[seq][0])
        if ok and op == "move":
            at[names[seq]] = dest
    out = []
    for seq, b, op, src, dest, before, _, ok in reversed(rows):
        if b == batch and ok:
            f = names[seq]
            if op == "move" and at[f] == dest:
                at[f] = src
                out.append((seq, "restored", src))
            elif op == "tags" and before is not None:
                out.append((seq, "restored", at[f]))
            else:
                out.append((seq, "skipped", None))
    return out


@pytest.mark.parametrize("seed", (1, 2))
def test_undo_equals_a_replay(spark, seed):
    rows, names, _, _ = history(seed, 60)
    out = moves.files(spark.createDataFrame(rows, FIELDS))
    for batch in (0, 3, 5):
        assert [(r.seq, r.outcome, r.path) for r in moves.undo(out, batch).orderBy("step").collect()] == replay(rows, names, batch)


def test_no_entries(spark):
    out = moves.files(spark.createDataFrame([], FIELDS))
    assert out.count() == 0 and moves.state_at(out).count() == 0 and moves.undo(out, 1).count() == 0
