"""The prefix trie of conversations, by truncation peeling.

Each distinct conversation is a path: the hashes of its turns in a row. Paths are range-partitioned in their order, so
those that begin alike lie together, and each task peels its range: from the greatest depth down, conversations that end at
a depth join the nodes that survive there, their last turn is stripped, and what is equal then is one node; its numbers are
added up on the way. Only nodes on a range's first and last path can go on in other ranges. What such nodes have of their
own is handed on as two paths a range, which are peeled in the same way, until one range is left; their ids then go back to
the ranges, whose nodes wait for their parents'. So the number of Spark jobs follows from the number of ranges and not from
the depth, and a first turn or a prefix that very many conversations share is spread over ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyrebird.llm.shared import discard, materialise, ship

#: Bytes of a turn's hash in a path; turns of a range.
MARK, TURNS = 16, 500_000
#: Conversations of one end are listed in parts of this range of ids, as a power of two.
PART_BITS = 15
EMPTY = hashlib.sha256(b"").hexdigest()
ITEM = "path binary, sizes array<bigint>, at array<int>, n array<bigint>, least array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>, part int, side int"
OUT = f"kind int, conv_id bigint, depth int, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, my_part int, my_side int, to_part int, to_side int, {ITEM}"
NODE, NAME, EDGE = 0, 1, 2


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: (mark, size) of each of a conversation's turns, in their order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    mark = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.select("conv_id", F.struct(place.alias("place"), mark.alias("mark"), F.octet_length("text").cast("long").alias("size")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation with the first h turns of its family's first one in place of its own, h from the id's checksum."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    own = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": h})
    both = own.join(heads, "base", "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(turns.schema["turns"].dataType))
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each path's parts in their order, joined by commas; rows come sorted, and only the state is kept."""
    key, state = None, None
    for batch in parts:
        for path, ids in zip(batch["path"], batch["ids"]):
            if path != key:
                if key is not None:
                    yield pd.DataFrame({"path": [key], "ends": [state.hexdigest()]})
                key, state = path, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if key is not None:
        yield pd.DataFrame({"path": [key], "ends": [state.hexdigest()]})


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """A row a distinct conversation in ITEM's columns, written: how many there are, the smallest id, the digest of the ids.

    Those that are equal are listed in parts by ranges of ids first, so a list is never longer than a part; the digest of
    several parts is fed with them in turn.
    """
    sizes = F.transform("turns", lambda t: t["size"])
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["mark"])), ""))
    rows = conversations.select("conv_id", path.alias("path"), sizes.alias("sizes"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    parts = rows.groupBy("path", F.shiftright("conv_id", PART_BITS).alias("range")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes"), ids.alias("ids"))
    parts = materialise(parts, "trie-parts")
    whole = parts.groupBy("path").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.first("sizes").alias("sizes"), F.min("ids").alias("ids"), F.count("*").alias("parts"))
    whole = materialise(whole, "trie-paths")
    several = whole.where("parts > 1")
    long = parts.join(several.select("path"), "path", "left_semi").select("path", "range", "ids")
    long = long.repartition("path").sortWithinPartitions("path", "range").mapInPandas(_digests, "path binary, ends string")
    one = whole.where("parts = 1").withColumn("ends", F.sha2(F.col("ids").cast("binary"), 256)).drop("ids")
    out = one.unionByName(several.drop("ids").join(long, "path"))
    single = lambda c: F.array(F.coalesce(c, F.lit(0)).cast("long"))
    zero = single(F.lit(0))
    out = out.select(
        "path", "sizes", F.array(F.size("sizes")).alias("at"), single(F.col("n")).alias("n"), F.array("least").alias("least"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.array("ends").alias("ends"),
        F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("side"),
    )
    out = materialise(out, "trie-items")
    discard(parts, whole)
    return out


def _shared(paths: list[bytes]) -> np.ndarray:
    """Turns that each path has in common with the one before; -1 for the first."""
    out = np.full(len(paths), -1, np.int64)
    for i in range(1, len(paths)):
        a, b = paths[i - 1], paths[i]
        m = min(len(a), len(b))
        if a[:m] == b[:m]:
            out[i] = m // MARK
        else:
            differ = np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)
            out[i] = int(differ.argmax()) // MARK
    return out


_NUMBERS = ("n", "least", "kids", "leaves", "saved")
_FAR = np.iinfo(np.int64).max


def peel(items: pd.DataFrame, part: int, last: bool) -> Iterator[pd.DataFrame]:
    """Nodes, names of items' nodes and edges of a range, in OUT's columns; items have ITEM's and come in the order of paths.

    An item adds numbers to nodes on its path, always to that at its end. A node on the first or last path is an edge, unless
    this is the last range of all: it isn't counted here, and what belongs to it alone goes on.
    """
    m = len(items)
    paths = [bytes(x) for x in items["path"]]
    sizes = [np.asarray(x, np.int64) for x in items["sizes"]]
    shared = _shared(paths)
    count = np.fromiter(map(len, items["at"]), np.int64, m)
    of = np.repeat(np.arange(m), count)
    flat = {c: np.concatenate([np.asarray(x, np.int64) for x in items[c]]) for c in ("at", *_NUMBERS)}
    ends = np.concatenate([np.asarray(x, object) for x in items["ends"]])
    order = np.argsort(-flat["at"], kind="stable")
    bounds = np.searchsorted(-flat["at"][order], -np.arange(flat["at"].max(), -2, -1))
    deepest = int(flat["at"].max())
    refs = items["part"].notna().to_numpy()
    ref_part, ref_side = items["part"].fillna(0).to_numpy(np.int64), items["side"].fillna(0).to_numpy(np.int64)
    # The nodes that survive at the depth below: first and last item, numbers, whether they are edges.
    empty = np.empty(0, np.int64)
    alive = {"start": empty, "end": empty, "n": empty, "least": empty, "leaves": empty, "saved": empty, "edge": np.empty(0, bool), "kids": empty, "ends": np.empty(0, object)}
    names: tuple = (empty, empty)  # items whose node at the depth below is asked for, and its place in alive
    edges: dict[int, dict[str, list]] = {0: {}, 1: {}}
    if not last:
        edges = {s: {c: [] for c in ("at", *_NUMBERS, "ends")} for s in ((0, 1) if m > 1 else (0,))}

    def emit(parents: dict | None, group: np.ndarray, depth: int) -> pd.DataFrame:
        """The nodes at depth that are no edges, and names; parents: those one up, and group: each node's place there."""
        done = np.flatnonzero(~alive["edge"])
        out = pd.DataFrame({"kind": np.full(len(done), NODE, np.int32), "conv_id": alive["least"][done], "depth": np.full(len(done), depth, np.int32)})
        for name, c in (("n_convs", "n"), ("n_children", "kids"), ("n_leaves", "leaves"), ("saved_tokens", "saved"), ("ends_sha256", "ends")):
            out[name] = alive[c][done]
        out["my_part"] = out["my_side"] = pd.array([None] * len(done), "Int32")
        if parents is None:
            out["parent"], out["to_part"], out["to_side"] = (pd.array([None] * len(done), t) for t in ("Int64", "Int32", "Int32"))
        else:
            up = group[done]
            edge = parents["edge"][up]
            out["parent"] = pd.array(np.where(edge, 0, parents["least"][up]), "Int64")
            out.loc[edge, "parent"] = None
            out["to_part"], out["to_side"] = pd.array(np.full(len(done), part), "Int32"), pd.array(np.where(parents["start"][up] == 0, 0, 1), "Int32")
            out.loc[~edge, ["to_part", "to_side"]] = None
        item, at = names
        if len(item):
            edge = alive["edge"][at]
            more = pd.DataFrame({"kind": np.full(len(item), NAME, np.int32), "depth": np.full(len(item), depth, np.int32)})
            more["conv_id"] = pd.array(np.where(edge, 0, alive["least"][at]), "Int64")
            more.loc[edge, "conv_id"] = None
            more["my_part"], more["my_side"] = pd.array(ref_part[item], "Int32"), pd.array(ref_side[item], "Int32")
            more["to_part"], more["to_side"] = pd.array(np.full(len(item), part), "Int32"), pd.array(np.where(alive["start"][at] == 0, 0, 1), "Int32")
            more.loc[~edge, ["to_part", "to_side"]] = None
            more = more.assign(**{c: None for c in out if c not in more})[out.columns]
            out = pd.concat([x.astype(object) for x in (out, more)], ignore_index=True)
            out = out.where(out.notna(), None)
        return out

    waiting: list[pd.DataFrame] = []
    held = 0
    for k, depth in enumerate(range(deepest, -1, -1)):
        new = order[bounds[k] : bounds[k + 1]]
        was = len(alive["start"])
        # A child that is an edge brings nothing but itself; it is counted where it is whole.
        whole = ~alive["edge"]
        start = np.concatenate([alive["start"], of[new]])
        end = np.concatenate([alive["end"], of[new]])
        both = {
            "n": np.concatenate([np.where(whole, alive["n"], 0), flat["n"][new]]), "least": np.concatenate([np.where(whole, alive["least"], _FAR), flat["least"][new]]),
            "kids": np.concatenate([whole.astype(np.int64), flat["kids"][new]]), "leaves": np.concatenate([np.where(whole, alive["leaves"], 0), flat["leaves"][new]]),
            "saved": np.concatenate([np.where(whole, alive["saved"], 0), flat["saved"][new]]),
        }
        place = np.argsort(start, kind="stable")
        begins = np.ones(len(place), bool)
        s = start[place]
        begins[1:] = (s[1:] != s[:-1]) & (shared[s[1:]] < depth)
        group = np.empty(len(place), np.int64)
        group[place] = np.cumsum(begins) - 1
        at = np.flatnonzero(begins)
        node = {"start": s[at], "end": np.maximum.reduceat(end[place], at), "least": np.minimum.reduceat(both["least"][place], at)}
        node |= {c: np.add.reduceat(both[c][place], at) for c in ("n", "kids", "leaves", "saved")}
        node["ends"] = np.full(len(at), EMPTY, object)
        told = np.flatnonzero(np.array([x is not None and x != EMPTY for x in ends[new]], bool)) if len(new) else empty
        node["ends"][group[was + told]] = ends[new][told]
        node["edge"] = np.zeros(len(at), bool) if last else (node["start"] == 0) | (node["end"] == m - 1)
        for g in np.flatnonzero(node["edge"]):  # two at most
            into = edges[0 if node["start"][g] == 0 else 1]
            into["at"].append(depth)
            for c in _NUMBERS:
                into[c].append(int(node[c][g]))
            into["ends"].append(node["ends"][g])
        own = ~node["edge"]
        node["leaves"] = np.where(own & (node["kids"] == 0), 1, node["leaves"])
        if depth:
            last_size = np.fromiter((sizes[i][depth - 1] for i in node["start"]), np.int64, len(at))
            node["saved"] = np.where(own, node["saved"] + (node["n"] - 1) * last_size, node["saved"])
        if was:
            waiting.append(emit(node, group[:was], depth + 1))
            held += was
        asked = new[refs[of[new]]] if len(new) else empty
        names = (of[asked], group[was:][refs[of[new]]]) if len(new) else (empty, empty)
        alive = node
        if held > 50_000:
            yield pd.concat(waiting, ignore_index=True)
            waiting, held = [], 0
    waiting.append(emit(None, empty, 0))
    yield pd.concat(waiting, ignore_index=True)
    if not last:
        rows = []
        for side, e in edges.items():
            i = 0 if side == 0 else m - 1
            rows.append({"path": paths[i], "sizes": sizes[i].tolist(), **e, "part": part, "side": side})
        yield pd.DataFrame(rows).assign(kind=EDGE)


_COLUMNS = [x.split(" ")[0] for x in OUT.split(", ")]
_PASSED = [x.split(" ")[0] for x in ITEM.split(", ")]


def _level(items: DataFrame, level: int) -> tuple[DataFrame, bool]:
    """One round of peeling, written; whether it was the last."""
    spark = items.sparkSession
    turns = items.agg(F.sum(F.size("sizes") + 1).alias("t"), F.count("*").alias("n")).first()
    parts = -(-(turns["t"] or 0) // TURNS)
    if level == 0:
        parts = max(parts, min(int(spark.conf.get("spark.sql.shuffle.partitions")), turns["n"]))
    else:
        parts = min(parts, turns["n"] // 4)  # a range hands on two paths at most, so these are halved at least
    last = parts <= 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            for out in peel(pd.concat(got, ignore_index=True), 0 if last else TaskContext.get().partitionId(), last):
                yield out.assign(**{c: None for c in _COLUMNS if c not in out})[_COLUMNS]

    dealt = items.coalesce(1) if last else items.repartitionByRange(parts, "path")
    return materialise(dealt.sortWithinPartitions("path").mapInPandas(run, OUT), f"trie-peeled-{level}"), last


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    Rows are ordered by turn, null first, ties by role and text; null roles and texts are empty, texts whole however long.
    Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own. Conversations
    without turns are members of the root. No rows give no nodes, not even a root. Other columns are not read. What a task
    holds of a conversation are 24 bytes a turn; of a range, those of its distinct conversations.
    """
    spark = conversations.sparkSession
    ship(spark)
    items = distinct_paths(rebuilt(turns_of(conversations), family, most))
    peeled, last = [], False
    while not last:
        out, last = _level(items, len(peeled))
        peeled.append(out)
        items = out.where(F.col("kind") == EDGE).select(*_PASSED)
    names, nodes = None, None
    for out in reversed(peeled):
        node = out.where(F.col("kind") == NODE)
        name = out.where(F.col("kind") == NAME).select("my_part", "my_side", "depth", "conv_id", "to_part", "to_side")
        known = node.where("to_part IS NULL").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        told = name.where("to_part IS NULL").select("my_part", "my_side", "depth", "conv_id")
        if names is not None:
            up = names.select(F.col("my_part").alias("to_part"), F.col("my_side").alias("to_side"), F.col("depth").alias("up"), F.col("conv_id").alias("found"))
            found = node.where("to_part IS NOT NULL").withColumn("up", F.col("depth") - 1).join(up, ["to_part", "to_side", "up"])
            known = known.unionByName(found.select("conv_id", "depth", F.col("found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
            asked = name.where("to_part IS NOT NULL").withColumn("up", F.col("depth")).join(up, ["to_part", "to_side", "up"])
            told = told.unionByName(asked.select("my_part", "my_side", "depth", F.col("found").alias("conv_id")))
        names = told
        nodes = known if nodes is None else nodes.unionByName(known)
    return nodes.withColumn("depth", F.col("depth").cast("long"))
