"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A word's subwords are its runs of 1 to 4 characters between marks of its ends, hashed into rows of embeddings; a text is the
mean of the rows of all its subwords, and a softmax of that gives a language. Both are trained by stochastic gradient descent
in numpy, on a bounded sample: of each language's labelled documents about SAMPLE are drawn by a hash, and of each of these a
long and a short window of words, at a hashed place. A part of the sample is kept from training; on it the scores are
calibrated by a temperature, and the least score is found at which the accepted ones are right often enough.

Since means and the softmax's input are linear, embeddings and weights are multiplied into one table of languages once;
tasks look words up in it, each distinct word once, and read whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.shared import ship
from lyrebird.llm.tokens import small_batches

#: Documents of a language in the sample, about; words of a document's two windows; the part that calibrates, one in so many.
SAMPLE, WINDOWS, HELD = 1_000, (48, 6), 5
#: Rows of embeddings and their width; the longest subword.
BUCKETS, WIDTH, LONGEST = 1 << 15, 16, 4
#: Passes, examples of a step, and the size of the first step.
PASSES, STEP, RATE = 6, 32, 8.0
#: How many of the accepted predictions are to be right.
PRECISION = 0.95
#: Words whose sums a task keeps.
CACHE = 200_000
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+").findall


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the words, and where each word's begin (one more at the end)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[word]
    at = np.arange(len(code))
    found, owner = [], []
    h = np.full(len(code), 1469598103934665603, np.uint64)
    for n in range(1, LONGEST + 1):
        fits = np.flatnonzero(at + n <= end)
        h = h[: len(code) - n + 1]
        h = (h ^ code[n - 1 :]) * np.uint64(1099511628211)
        fits = fits[fits < len(h)]
        x = h[fits]
        found.append(((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[fits])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, held and subwords of both windows of each row, which a hash u (0 to 1) places."""
    for batch in batches:
        out = []
        for lang, text, u in zip(batch["lang"], batch["text"], batch["u"]):
            words = words_of(text)
            held = int(u * 1e6) % HELD == 0
            for n in WINDOWS:
                if words:
                    at = int(u * 7919 * len(words)) % max(1, len(words) - n + 1)
                    # A window's words are cut to 64 letters each, so that an example is bounded.
                    ids, _ = subwords([w[:64] for w in words[at : at + n]])
                    out.append((lang, held, np.sort(ids).astype(np.int32).tolist()))
        yield pd.DataFrame(out, columns=["lang", "held", "ids"])


class Model:
    """langs, a table of BUCKETS rows of what a subword adds to each language, and the least score that is accepted."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, least: float) -> None:
        self.langs, self.table, self.bias, self.least = langs, table, bias, least


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(examples: list[tuple[str, bool, list[int]]]) -> Model:
    """The model that the examples (lang, held, subwords) give; they are put in order first, so theirs doesn't matter."""
    examples = sorted(((lang, held, tuple(ids)) for lang, held, ids in examples if len(ids)), key=lambda e: (e[1], e[0], e[2]))
    langs = sorted({e[0] for e in examples})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 0.0)
    y = np.array([langs.index(e[0]) for e in examples])
    held = np.array([e[1] for e in examples])
    ids = [np.array(e[2], np.int64) for e in examples]
    if held.all():
        held[:] = False
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    # Languages weigh alike, however many examples each has.
    balance = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))).astype(np.float32)
    own = np.flatnonzero(~held)
    steps, done = PASSES * -(-len(own) // STEP), 0
    for _ in range(PASSES):
        for batch in np.array_split(rng.permutation(own), -(-len(own) // STEP)):
            rate, done = RATE * (1 - done / steps), done + 1
            flat, size = np.concatenate([ids[i] for i in batch]), np.array([len(ids[i]) for i in batch])
            begin = np.cumsum(size) - size
            mean = np.add.reduceat(table[flat], begin) / size[:, None]
            p = _softmax(mean @ weights + bias)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= balance[y[batch], None] / len(batch)
            down = np.repeat((p @ weights.T / size[:, None]).astype(np.float32), size, axis=0)
            weights -= rate * mean.T @ p
            bias -= 0.1 * rate * p.sum(axis=0)
            order = np.argsort(flat, kind="stable")
            rows, at = np.unique(flat[order], return_index=True)
            table[rows] -= rate * np.add.reduceat(down[order], at)
    table = (table @ weights).astype(np.float32)
    test = np.flatnonzero(held) if held.any() else own
    z = np.stack([table[ids[i]].mean(axis=0) for i in test]) + bias
    fits = [(-np.log(_softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean(), t) for t in np.geomspace(0.1, 10, 81)]
    t = min(fits)[1]
    p = _softmax(z / t)
    right, score = p.argmax(axis=1) == y[test], p.max(axis=1)
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    least = float(score[order[good[-1]]]) if len(good) else 1.0
    return Model(langs, (table / t).astype(np.float32), (bias / t).astype(np.float32), least)


class Predictor:
    """Sums of words by language, each distinct word's once; forgets them all beyond CACHE."""

    def __init__(self, model: Model) -> None:
        self.model, self.seen, self.sums, self.count = model, {}, None, None

    def _learn(self, words: list[str]) -> None:
        """Texts of any length may hold words of any length, so words are hashed in blocks of a million letters."""
        sums, count = [], []
        size = np.cumsum([len(w) for w in words])
        for block in np.split(np.arange(len(words)), np.flatnonzero(np.diff(size // 1_000_000)) + 1):
            ids, at = subwords([words[i] for i in block])
            sums.append(np.add.reduceat(self.model.table[ids].astype(np.float64), at[:-1]))
            count.append(np.diff(at))
        base = len(self.seen)
        self.seen.update(zip(words, range(base, base + len(words))))
        keep = [] if self.sums is None else [self.sums]
        self.sums = np.concatenate([*keep, *sums])
        self.count = np.concatenate([*([] if self.count is None else [self.count]), *count])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        langs = self.model.langs
        parts = [words_of(t) for t in texts]
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, p in enumerate(parts) if p]
        if not langs or not some:
            return out, score
        if len(self.seen) > CACHE:
            self.seen, self.sums, self.count = {}, None, None
        new = list(dict.fromkeys(w for i in some for w in parts[i] if w not in self.seen))
        if new:
            self._learn(new)
        size = np.fromiter((len(parts[i]) for i in some), np.int64, len(some))
        number = self.seen.__getitem__
        at = np.fromiter((x for i in some for x in map(number, parts[i])), np.int64, int(size.sum()))
        begin = np.cumsum(size) - size
        z = np.add.reduceat(self.sums[at], begin) / np.add.reduceat(self.count[at], begin)[:, None] + self.model.bias
        p = _softmax(z)
        score[some] = p.max(axis=1)
        for i, k in zip(some, p.argmax(axis=1)):
            out[i] = langs[k]
        return out, score


def sample(labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """lang, text and u (a hash, 0 to 1) of about `most` rows of each language, all if there are fewer; u places windows."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_007))
    drawn = labelled.withColumn("u", h / 1_000_000_007.0).join(F.broadcast(counts), "lang").where(F.col("u") * F.col("n") < most)
    spread = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000_007)) / 1_000_000_007.0
    return drawn.select("lang", "text", spread.alias("u"))


def fit(labelled: DataFrame, most: int = SAMPLE) -> Model:
    """The model of doc_id, text and lang. Two windows a sampled document come to the driver, of 54 words of 64 letters at
    most: some 14,000 numbers, for about `most` documents a language."""
    ship(labelled.sparkSession)
    rows = sample(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), most)
    got = rows.mapInPandas(_windows, "lang string, held boolean, ids array<int>").collect()
    return train([(r["lang"], r["held"], r["ids"]) for r in got])


def identify_languages(docs: DataFrame, held_out: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every document; learned from those that aren't held out.

    A null text, or one without a letter, is "und" with score 0 and not accepted, and so is every one where no labelled text
    has a letter. Texts are read whole, however long. Score is the calibrated probability of lang_pred; accepted: it reaches
    the least one at which PRECISION of the calibrating examples were right. Rows may repeat, and get equal predictions
    whatever their other columns; a null doc_id is passed through, with held_out as the condition gives (null: false).
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fit(rows.where("NOT held_out").select("doc_id", "text", "lang"), most)
    shared = spark.sparkContext.broadcast((model.langs, model.table, model.bias, model.least))  # 32,768 numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(Model(*shared.value))
        for batch in small_batches(batches, "text"):
            langs, score = predict(batch.column("text").to_pylist())
            accepted = (score >= predict.model.least) & np.array([x != UNKNOWN for x in langs], bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, accepted boolean"
    # A letter is what Unicode says; what the words' pattern takes besides (such as numerals) is no letter by itself.
    plain = rows.select("doc_id", "held_out", F.when(has_letter(F.col("text")), F.col("text")).alias("text"))
    return plain.mapInArrow(run, fields)
