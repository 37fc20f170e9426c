"""A hashed maximum-entropy language model with a class-factored softmax, and what it makes of each document.

P(word | before) = P(slot | before) * P(word | slot). A slot is a path of DEPTH classes of WIDE each: the end and the most
frequent words have slots of their own, the other words share some by a hash of their ending, so that words never seen
have one too. Every class on the path is a softmax with n-gram features (the word before, the pair before) and skip
features (the second and the third word before), hashed into rows of weights; each node of the tree has its own rows, as
many as its share of the tokens asks. In a shared slot, words have their smoothed counts.

Documents are tokenised once, into blocks: the block's distinct words, and its tokens as numbers of these. Words are
counted by hash bucket, each block gets the counts of its words back, and no vocabulary is held in one place. Weights
start at damped log-ratios of how often a feature met a class, counted over all training tokens; then tasks train them
by gradient steps on their own blocks, and theirs are averaged over a tree, row by row after how often a row was met.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.shared import LOWER, materialise, ship
from lyrebird.llm.tokens import _Seen, small_batches

#: Tokens of a block; bytes of text a bucket of words.
BLOCK, BUCKET_BYTES = 1_000_000, 12_000_000
#: Classes of a node and nodes on a path; slots of the end and of single words, and those that endings share.
WIDE, DEPTH, OWN = 16, 3, 2048
SLOTS, NODES = WIDE**DEPTH, 1 + WIDE + WIDE**2
SHARED, START = SLOTS - OWN, SLOTS
#: Tables of weights (one a feature) and their rows, about: the tables are of one size, whatever the corpus.
TABLES, ROWS = 4, 1 << 16
#: Of the first weights: the share of the log-ratio that each feature gets, and the counts that stand against its own.
SHARES, DAMP = (0.6, 0.6, 0.4, 0.3), 8.0
#: Passes of gradient steps over all training tokens, tokens a step, rate, and rows that are merged at a time.
ROUNDS, STEP, RATE, FAN, CHUNKS = 1, 32768, 0.2, 32, 16
#: No word has a space, so this stands for the end.
END = xxhash.xxh3_64_intdigest(b" ")

_zip, _unzip = (lambda x: zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x))), (lambda x, t: np.frombuffer(zstandard.ZstdDecompressor().decompress(x), t))


def _endings(words: list[bytes]) -> np.ndarray:
    """Which of the shared slots a word has, by its ending."""
    crc = zlib.crc32
    bare = [w.rstrip(b".,;:!?") or w for w in words]
    return np.fromiter((crc(w[-2:]) % SHARED for w in bare), np.uint32, len(bare))


def _block(docs: list[tuple[int | None, bool, list[bytes]]]) -> dict:
    """A block's columns; its words are in the order of their hashes, and the end is one of them."""
    seen = _Seen()
    seen[b" "] = 0
    number = seen.__getitem__
    ids = np.fromiter((x for _, _, w in docs for part in (map(number, w), (0,)) for x in part), np.int64, sum(len(w) + 1 for _, _, w in docs))
    words = list(seen)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    ids = place[ids]
    n = np.array([len(w) + 1 for _, _, w in docs], np.int64)
    held = np.array([h for _, h, _ in docs], bool)
    counts = np.bincount(ids[np.repeat(~held, n)], minlength=len(words)).astype(np.uint32)
    return {"ids": _zip(ids), "sizes": n.tobytes(), "held": held.tobytes(), "known_ids": np.array([i is not None for i, _, _ in docs], bool).tobytes(), "doc_ids": np.array([i or 0 for i, _, _ in docs], np.int64).tobytes(), "hashes": hashes[order].tobytes(), "endings": _zip(_endings(words)[order]), "counts": _zip(counts)}


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size, made, part = [], 0, 0, TaskContext.get().partitionId()

        def row() -> pa.RecordBatch:
            cols = _block(docs)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), *(pa.array([x], pa.binary()) for x in cols.values())], ["block", *cols])

        for batch in small_batches(batches, "text"):
            for i, h, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                docs.append((i, h, (x or "").encode().translate(LOWER).split()))
                size += len(docs[-1][2]) + 1
                if size >= BLOCK:
                    yield row()
                    docs, size, made = [], 0, made + 1
        if docs:
            yield row()

    return docs.mapInArrow(run, "block long, ids binary, sizes binary, held binary, known_ids binary, doc_ids binary, hashes binary, endings binary, counts binary")


def _counts(blocks: DataFrame, bits: int) -> DataFrame:
    """Of each bucket: a row a block (block, bucket, counts of its words there) and one with a null block and totals."""
    buckets = 1 << bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                h, c, e = np.frombuffer(x["hashes"], np.uint64), _unzip(x["counts"], np.uint32), _unzip(x["endings"], np.uint32)
                cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange(buckets + 1, dtype=np.uint64))
                rows = [(int(b), x["block"], h[s:t].tobytes(), _zip(c[s:t]), _zip(e[s:t])) for b, (s, t) in enumerate(zip(cuts, cuts[1:])) if t > s]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "hashes", "counts", "endings"])

    def add(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        values, first, at = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        c = np.concatenate([_unzip(x, np.uint32) for x in group.column("counts").to_pylist()]).astype(np.int64)
        ending = np.concatenate([_unzip(x, np.uint32) for x in group.column("endings").to_pylist()])[first]
        total = np.bincount(at, weights=c, minlength=len(values)).astype(np.int64)  # exact below 2**53
        bounds = np.cumsum([0, *map(len, parts)])
        replies = [_zip(total[at[a:b]]) for a, b in zip(bounds, bounds[1:])]
        known, real = total > 0, values != np.uint64(END)
        by_ending = [np.bincount(ending[known & real], weights=w[known & real], minlength=SHARED) for w in (np.ones(len(values)), total)]
        best = np.lexsort((values, -total))
        best = best[(known & real)[best]][: OWN - 1]
        bucket, n = group.column("bucket")[0].as_py(), len(replies)
        end = int(total[~real].sum())
        stats = _zip(np.concatenate([[known.sum(), total.sum(), end], *by_ending]).astype("<i8"))
        top = _zip(np.array([values[best].view(np.int64), total[best], ending[best].astype(np.int64)]))
        return pa.table({"block": pa.array([*group.column("block").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int32()), "counts": pa.array([*replies, None], pa.binary()), "stats": pa.array([None] * n + [stats], pa.binary()), "top": pa.array([None] * n + [top], pa.binary())})

    dealt = blocks.select("block", "hashes", "counts", "endings").mapInArrow(deal, "bucket int, block long, hashes binary, counts binary, endings binary")
    return dealt.groupBy("bucket").applyInArrow(add, "block long, bucket int, counts binary, stats binary, top binary")


def _merged(counts: DataFrame) -> list:
    """stats and top of all buckets in one row at most, merged over a tree: a task never has more than FAN rows."""

    def add(group: pa.Table) -> pa.Table:
        stats = sum(_unzip(x, "<i8") for x in group.column("stats").to_pylist())
        top = np.concatenate([_unzip(x, np.int64).reshape(3, -1) for x in group.column("top").to_pylist()], axis=1)
        top = top[:, np.lexsort((top[0].view(np.uint64), -top[1]))][:, : OWN - 1]
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "stats": [_zip(stats)], "top": [_zip(top)]})

    rows, left = counts.where("block IS NULL").select("bucket", "stats", "top"), counts.where("block IS NULL").count()
    while left > 1:
        left = -(-left // FAN)
        rows = rows.withColumn("bucket", F.pmod("bucket", F.lit(left)).cast("int")).groupBy("bucket").applyInArrow(add, "bucket int, stats binary, top binary")
    return rows.collect()


class Vocabulary:
    """What all tasks know of the words: totals, the frequent words, and the tree of classes with each node's rows."""

    def __init__(self, rows: list, table_rows: int = ROWS) -> None:
        stats = _unzip(rows[0]["stats"], "<i8") if rows else np.zeros(3 + 2 * SHARED, np.int64)
        top = _unzip(rows[0]["top"], np.int64).reshape(3, -1) if rows else np.zeros((3, 0), np.int64)
        self.types, self.tokens, ends = (int(x) for x in stats[:3])
        types, tokens = stats[3 : 3 + SHARED].copy(), stats[3 + SHARED :].copy()
        np.subtract.at(types, top[2], 1)
        np.subtract.at(tokens, top[2], top[1])
        order = np.argsort(top[0].view(np.uint64))
        self.hashes, self.slot = top[0].view(np.uint64)[order], 1 + order
        used = np.zeros(SLOTS)
        used[0] = used[OWN:] = used[1 : 1 + top.shape[1]] = 1
        seen = np.zeros(SLOTS)
        seen[0], seen[1 : 1 + top.shape[1]], seen[OWN:] = ends, top[1], tokens
        self.of_slot = np.zeros((2, SLOTS))
        self.of_slot[:, OWN:] = types, tokens
        of_nodes = lambda x: np.concatenate([x.reshape(WIDE**d, WIDE, -1).sum(axis=2) for d in range(DEPTH)])
        n, used = of_nodes(seen), np.minimum(of_nodes(used), 1)
        p = (n + 0.5 * used) / np.maximum(n.sum(axis=1) + 0.5 * used.sum(axis=1), 0.5)[:, None]
        self.p, self.bias = p, np.where(used > 0, np.log(np.where(used > 0, p, 1)), np.where(used.any(axis=1), -1e4, 0.0)[:, None]).astype(np.float32)
        mass = n.sum(axis=1)
        self.size = 2 ** np.floor(np.log2(np.maximum(1, table_rows * mass / max(1, mass.sum())))).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.rows = int(self.size.sum())  # of one table

    def slots(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """The slot of each word."""
        out = OWN + endings.astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.slot[at[hit]]
        out[hashes == np.uint64(END)] = 0
        return out

    def log_in_slot(self, slot: np.ndarray, counts: np.ndarray) -> np.ndarray:
        types, tokens = self.of_slot[:, slot]
        return np.where(slot < OWN, 0.0, np.log((counts + 0.5) / (tokens + 0.5 * (types + 1))))

    def path(self, slot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Node and class at each step of the slots' paths."""
        return [(np.full_like(slot, 0), slot >> 8), (1 + (slot >> 8), slot >> 4 & 15), (1 + WIDE + (slot >> 4), slot & 15)]

    def places(self, features: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        """The row of each feature at a node, over all tables."""
        mask, first = self.size[node] - 1, self.first[node]
        return [k * self.rows + first + (f & mask) for k, f in enumerate(features)]

    def start(self, counts: np.ndarray) -> np.ndarray:
        """The first weights, from how often each row met each class."""
        p = np.tile(np.repeat(self.p, self.size, axis=0), (TABLES, 1))
        share = np.repeat(SHARES, self.rows)[:, None]
        ratio = (counts + DAMP * p) / ((counts.sum(axis=1, keepdims=True) + DAMP) * np.where(p > 0, p, 1))
        return (share * np.log(np.where(p > 0, ratio, 1))).astype(np.float32)


def _features(slot: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the TABLES features of each token: the one, the pair, the second and the third before it."""
    place = np.arange(len(slot)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = [np.where(place >= k, np.concatenate([np.full(k, START), slot])[: len(slot)], START) for k in (1, 2, 3)]

    def mixed(*parts: np.ndarray) -> np.ndarray:
        h = np.zeros(len(slot), np.uint64)
        for x in parts:
            h = (h ^ (x.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)

    return np.array([mixed(back[0]), mixed(back[1], back[0]), mixed(back[1]), mixed(back[2])])


def _classes(weights: np.ndarray, bias: np.ndarray, places: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """Probabilities of the node's classes, a row a token."""
    x = np.take(weights, places[0], axis=0)
    for r in places[1:]:
        x += np.take(weights, r, axis=0)
    x += np.take(bias, node, axis=0)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x /= (x @ np.ones(WIDE, np.float32))[:, None]
    return x


def _learn(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, words: Vocabulary, features: np.ndarray, slot: np.ndarray) -> None:
    """One gradient step; the rate of a row falls with the squares of its gradients so far."""
    grad, own = np.zeros((TABLES, words.rows * WIDE)), np.arange(WIDE)
    for node, digit in words.path(slot):
        places = words.places(features, node)
        x = _classes(weights, words.bias, places, node)
        x[np.arange(len(slot)), digit] -= 1
        x = x.astype(np.float64).ravel()
        for k, r in enumerate(places):
            r = r - k * words.rows
            grad[k] += np.bincount((r[:, None] * WIDE + own).ravel(), weights=x, minlength=grad.shape[1])
            met[k * words.rows : (k + 1) * words.rows] += np.bincount(r, minlength=words.rows)
    grad = grad.reshape(-1, WIDE).astype(np.float32)
    squares += np.einsum("ij,ij->i", grad, grad)
    weights -= RATE * grad / np.sqrt(squares)[:, None]


def _training(x: dict, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Features and slots of a block's training tokens."""
    slot = words.slots(np.frombuffer(x["hashes"], np.uint64), _unzip(x["endings"], np.uint32))[_unzip(x["ids"], np.uint32)]
    sizes, held = np.frombuffer(x["sizes"], np.int64), np.frombuffer(x["held"], bool)
    use = np.flatnonzero(np.repeat(~held, sizes))
    return _features(slot, sizes)[:, use], slot[use]


#: A task's counts or changes of weights, in chunks.
_PARTS = "chunk int, task int, met binary, sums binary"


def _reduced(parts: DataFrame, tasks: int, add) -> DataFrame:
    """A row a chunk, merged over a tree: a task never has more than FAN rows of one."""

    def merge(group: pa.Table) -> pa.Table:
        met, sums = add([_unzip(x, np.float32) for x in group.column("met").to_pylist()], group.column("sums").to_pylist())
        return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()], pa.int32()), "task": pa.array([group.column("task")[0].as_py()], pa.int32()), "met": [_zip(met)], "sums": [_zip(sums)]})

    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("task", F.col("task") % tasks).groupBy("chunk", "task").applyInArrow(merge, _PARTS)
    return parts


def _sliced(met: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Both arrays in CHUNKS rows."""
    cuts = np.linspace(0, len(met), CHUNKS + 1).astype(int)
    parts = [(i, TaskContext.get().partitionId(), _zip(met[a:b]), _zip(sums[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*parts), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["chunk", "task", "met", "sums"])


def _first_weights(blocks: DataFrame, words: Vocabulary) -> np.ndarray:
    """How often each row met each class is counted over all training tokens; the weights that follow from it."""
    given = blocks.sparkSession.sparkContext.broadcast(words)  # of a fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, any_ = given.value, None, False
        for batch in batches:
            for x in batch.to_pylist():
                features, slot = _training(x, words)
                n = np.zeros(TABLES * words.rows * WIDE, np.int64) if n is None else n
                any_ |= len(slot) > 0
                for node, digit in words.path(slot):
                    for k, r in enumerate(words.places(features, node)):
                        at = slice(k * words.rows * WIDE, (k + 1) * words.rows * WIDE)
                        n[at] += np.bincount((r - k * words.rows) * WIDE + digit, minlength=words.rows * WIDE)
        if any_:
            yield _sliced(np.zeros(TABLES * words.rows, np.float32), n.reshape(-1, WIDE))

    source = blocks.select("ids", "sizes", "held", "hashes", "endings")
    parts = _reduced(source.mapInArrow(count, _PARTS), source.rdd.getNumPartitions(), lambda met, sums: (met[0], sum(_unzip(x, np.int64) for x in sums)))
    got = {r["chunk"]: _unzip(r["sums"], np.int64) for r in parts.collect()}  # of a fixed size
    counts = np.concatenate([got[i] for i in sorted(got)]) if got else np.zeros(TABLES * words.rows * WIDE, np.int64)
    return words.start(counts.reshape(-1, WIDE))


def _trained(blocks: DataFrame, words: Vocabulary, start: np.ndarray) -> np.ndarray:
    """The weights after one more pass: every task starts from the same ones, and what they changed is averaged."""
    given = blocks.sparkSession.sparkContext.broadcast((words, start))  # of a fixed size

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = given.value
        weights, squares, met = start.copy(), np.ones(len(start), np.float32), np.zeros(len(start), np.float32)
        for batch in batches:
            for x in batch.to_pylist():
                features, slot = _training(x, words)
                for at in range(0, len(slot), STEP):
                    _learn(weights, squares, met, words, features[:, at : at + STEP], slot[at : at + STEP])
        if met.any():
            yield _sliced(met, (weights - start).astype(np.float16))

    def mean(met: list[np.ndarray], sums: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        total, out = np.zeros(len(met[0])), np.zeros((len(met[0]), WIDE))
        for m, x in zip(met, sums):
            total += m
            out += _unzip(x, np.float16).reshape(-1, WIDE) * m[:, None].astype(np.float64)
        return total.astype(np.float32), (out / np.maximum(total, 1)[:, None]).astype(np.float16)

    source = blocks.select("ids", "sizes", "held", "hashes", "endings")
    got = {r["chunk"]: r["sums"] for r in _reduced(source.mapInArrow(train, _PARTS), source.rdd.getNumPartitions(), mean).collect()}  # of a fixed size
    return start + np.concatenate([_unzip(got[i], np.float16) for i in sorted(got)]).reshape(-1, WIDE).astype(np.float32) if got else start


def log_probabilities(words: Vocabulary, weights: np.ndarray, slot: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log P(slot | before) of each token of documents of these sizes."""
    features, out = _features(slot, sizes), np.zeros(len(slot))
    for at in range(0, len(slot), STEP):
        some = slice(at, at + STEP)
        for node, digit in words.path(slot[some]):
            x = _classes(weights, words.bias, words.places(features[:, some], node), node)
            out[some] += np.log(np.maximum(x[np.arange(len(x)), digit], 1e-30))
    return out


def _scores(blocks: DataFrame, counts: DataFrame, words: Vocabulary, weights: np.ndarray) -> DataFrame:
    given = blocks.sparkSession.sparkContext.broadcast((words, weights))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        words, w = given.value
        out = []
        for x in left.to_pylist():
            order = np.argsort(np.asarray(right.column("bucket")))
            found = right.column("counts").to_pylist()
            c = np.concatenate([_unzip(found[int(i)], np.int64) for i in order])
            ids, sizes, held = _unzip(x["ids"], np.uint32), np.frombuffer(x["sizes"], np.int64), np.frombuffer(x["held"], bool)
            slot = words.slots(np.frombuffer(x["hashes"], np.uint64), _unzip(x["endings"], np.uint32))
            first = np.cumsum(sizes) - sizes
            base = np.log10((c + 0.5) / (words.tokens + 0.5 * (words.types + 1)))
            inside = words.log_in_slot(slot, c)[ids] + log_probabilities(words, w, slot[ids], sizes)
            doc_ids, known = np.frombuffer(x["doc_ids"], np.int64), np.frombuffer(x["known_ids"], bool)
            add = lambda v: np.add.reduceat(v, first)  # noqa: E731  no document is without tokens
            out.append(pa.table({"doc_id": pa.array(doc_ids, mask=~known), "held_out": pa.array(held), "n_tokens": pa.array(sizes), "n_known": pa.array(add((c > 0)[ids].astype(np.int64))), "train_tokens": pa.array(np.full(len(sizes), words.tokens)), "base_score": pa.array(add(base[ids])), "score": pa.array(add(inside) / np.log(10))}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    replies = counts.where("block IS NOT NULL").select("block", "bucket", "counts")
    return blocks.drop("counts").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, schema)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Documents whose crc32(doc_id as text) leaves 1 modulo 5 are held out; all others are learnt from, a null id's too.
    Words are lower-cased (A-Z) and split at ASCII white space; an end follows them, so a null or empty text is one
    token. Scores are log10 probabilities. Rows count each, repeated ones too. Without training tokens, the base
    probability is 1 and the slots that are in use are equally likely at each step. What is sent between tasks about words
    is a row a block and bucket, so never more rows than the blocks have distinct words. Other columns of docs are not read. Ids must be integers. Words are
    told apart by 64-bit hashes. An empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = materialise(_blocks(docs), "lm-blocks", compression="none")
    counts = materialise(_counts(blocks, max(3, int(size // BUCKET_BYTES).bit_length())), "lm-counts", compression="none")
    words = Vocabulary(_merged(counts))
    weights = _first_weights(blocks, words)
    for _ in range(rounds):
        weights = _trained(blocks, words, weights)
    return _scores(blocks, counts, words, weights)
