import gc
import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from cases import LONG, TEXTS, documents, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lyrebird.llm import shared
from lyrebird.operators import steps

WORD, BYTE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def encoded(path, texts):
    return [e.ids + [0] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Tokens, packing, storage


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_encode_like_whole_texts(path):
    from lyrebird.llm.tokens import ChunkEncoder

    r = np.random.default_rng(3)
    alphabet = [*" \n\t\r\x0b\x1c\x85\u00a0\u3000abAéÉßΣςİ'!?.,#012½的\u0301🙂<|>-", "<|endoftext|>", "'s", " the", "  ", "don't"]
    texts = ["".join(r.choice(alphabet, r.integers(0, 25))) for _ in range(3000)]
    enc, want = ChunkEncoder(path), encoded(path, texts)
    for part in (slice(0, 1500), slice(1500, 3000)):
        ids, bounds = enc.encode(texts[part])
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x[:-1] for x in want[part]]


def test_new_chunks_are_encoded_together(monkeypatch):
    from lyrebird.llm.tokens import ChunkEncoder

    enc, alone = ChunkEncoder(BYTE), []
    whole = enc._whole
    monkeypatch.setattr(enc, "_whole", lambda texts: alone.extend(texts) or whole(texts))
    texts = ["First " + " ".join(f"w{i}é,\nx{i} {'🙂' * (i % 3)}<|endoftext|>it's" for i in range(900)), "", " ", "\n", " a", "\na\n", "a  b \n c\n\nd ", "a\tb", "b"]
    ids, bounds = enc.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x[:-1] for x in encoded(BYTE, texts)]
    # What begins a text, ends in white space or holds a tab; 1,800 other chunks aren't encoded one by one.
    assert len(enc.seen) > 1800 and len(alone) < 12


def test_cache_forgets_without_a_trace(monkeypatch):
    from lyrebird.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(tokens, "CACHE_KEEPS", 20)
    enc = tokens.ChunkEncoder(WORD)
    for k in range(6):
        texts = [f"w{i} and x{i + k} the" for i in range(40)]
        ids, bounds = enc.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x[:-1] for x in encoded(WORD, texts)]


def test_best_two_fit_uses_every_length_once():
    from lyrebird.llm.packing import best_two_fit

    r = np.random.default_rng(0)
    for trial in range(30):
        cap = int(r.integers(1, 60))
        counts = Counter(r.integers(1, cap + 1, r.integers(0, 400)).tolist())
        got = Counter()
        for bin_, times in best_two_fit(counts, cap):
            assert sum(bin_) <= cap and times > 0
            got.update({k: n * times for k, n in Counter(bin_).items()})
        assert got == counts
    assert sum(n for _, n in best_two_fit({6: 2, 5: 2, 3: 2, 4: 2, 2: 1}, 10)) == 4
    # 7 + 2 leaves a gap of 1; the 2 gives way to two that fill it.
    assert best_two_fit({7: 1, 2: 3, 1: 1}, 10)[0][0] in ([7, 2, 1],)


def test_packing(spark):
    from lyrebird.llm.packing import pack_documents, sequences

    packed = pack_documents(documents(spark), WORD, max_len=64, with_ids=True).cache()
    got = rows(packed)
    want = Counter()
    for (i, _, _), ids in zip(TEXTS, encoded(WORD, [t for _, t, _ in TEXTS])):
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(i, k // 64, k, len(part), crc(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    whole = {r["sequence_id"]: r["ids"] for r in rows(sequences(packed))}
    for s, parts in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in parts:
            assert r["offset"] == at and whole[s][at : at + r["length"]] == r["ids"]
            at += r["length"]
        assert at == len(whole[s]) <= 64
    assert pack_documents(documents(spark).limit(0), WORD).count() == 0


def test_packing_is_near_the_least_number_of_sequences(spark):
    from lyrebird.llm.packing import pack_documents

    packed = pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), WORD, max_len=2048).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.count("*"), F.sum("n")).first()
    assert packed[0] <= 1.01 * math.ceil(packed[1] / 2048) + 1


def test_token_files_have_indexes_and_are_pruned(spark, tmp_path):
    from lyrebird.llm.token_store import read_token_ids, write_token_ids

    path = (tmp_path / "ids").as_uri()
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    write_token_ids(docs, path, BYTE)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for f in spark.read.orc(path).inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe)
            kinds = Counter((s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList())
            assert kinds[(1, "BLOOM_FILTER_UTF8")] == 1 and kinds[(1, "ROW_INDEX")] == 1 and footer.getColumns(1).getKind().toString() == "DIRECT_V2"
            n += stripe.getNumberOfRows()
    assert n == 4000
    one = read_token_ids(spark, path).where("doc_id = 1234")
    assert [r["doc_id"] for r in rows(one)] == [1234] and "EqualTo(doc_id,1234)" in one._jdf.queryExecution().toString()


def test_token_store(spark, tmp_path):
    from lyrebird.llm.token_store import digest, read_token_ids, write_token_ids

    path = (tmp_path / "ids").as_uri()
    write_token_ids(documents(spark), path, BYTE)
    got = sorted(rows(digest(read_token_ids(spark, path))), key=lambda r: r["start"])
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (i, _, _), ids in zip(got, order, encoded(BYTE, [t for _, t, _ in order]), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), crc(ids))
        start += len(ids)
    assert [r["doc_id"] for r in rows(read_token_ids(spark, path).where("doc_id = 6"))] == [6]
    empty = (tmp_path / "none").as_uri()
    write_token_ids(documents(spark).limit(0), empty, BYTE)
    assert read_token_ids(spark, empty).count() == 0


# Personal data


def test_pseudonyms(spark):
    from lyrebird.llm.pii import pseudonyms

    card = "4785380592391139"
    texts = [
        f"card {card} and 4785380592391138 then {card} {card}. {'-'.join(card[i : i + 4] for i in range(0, 16, 4))}", "Mail Hein.19@mail5.example.com, now hein.19@mail5.example.com",
        "+1 (743) 555-3824 ip 152.143.123.131. not 300.1.1.1", "123-45-6789 666-12-1234 2024-02-29 2023-02-29 31/12/1999", None, "", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff Version 2.0.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("n_card", F.lit("clash"))
    a, b, other = ([r["text"] for r in rows(pseudonyms(docs, k).orderBy("doc_id"))] for k in ("k", "k", "other"))
    assert a == b and a[4:] == texts[4:] and other[0] != a[0]
    cards = re.findall(r"\d{16}", a[0])
    assert cards[0] == cards[2] == cards[3] != card and cards[1] == "4785380592391138"
    assert "-".join(cards[0][i : i + 4] for i in range(0, 16, 4)) in a[0]
    digits = [int(x) for x in cards[0]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0 and cards[0][0] == "4"
    mails = re.findall(r"\S+@\S+\.com", a[1])
    assert mails[0] == mails[1] != "hein.19@mail5.example.com" and re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", mails[0])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} ip \d+\.\d+\.\d+\.\d+\. not 300\.1\.1\.1", a[2]) and "555-3824" not in a[2]
    assert "666-12-1234" in a[3] and "2023-02-29" in a[3] and "123-45-6789" not in a[3] and "2024-02-29" not in a[3]


def test_permutations_are_one_to_one(spark):
    from lyrebird.llm.pii import _characters, _integer

    n = spark.range(189 * 7).select(_integer(F.col("id"), "k", "date", (189, 7)).alias("x"))
    assert sorted(r["x"] for r in n.collect()) == list(range(189 * 7))
    c = spark.range(1000).select(_characters(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "phone").alias("x"))
    assert sorted(r["x"] for r in c.collect()) == [f"{i:03d}" for i in range(1000)]


def test_pseudonyms_against_plain_python(spark):
    import brute
    from lyrebird.llm.pii import pseudonyms

    r = np.random.default_rng(7)
    number = lambda n: "".join(map(str, r.integers(0, 10, n)))
    cards = [c + str(-brute._luhn(c + "0") % 10) for c in ("4" + number(14) for _ in range(6))]
    values = [f"Mail.{number(3)}@Host-{number(1)}.example.ORG", f"+49 {number(3)}-{number(3)}-{number(4)}", f"({number(3)}) {number(3)}.{number(4)}", f"{number(3)}-{number(2)}-{number(4)}", "665-01-0001", "899-99-9999", "10.0.0.255", "256.1.1.1"]
    values += [*cards, cards[0][:-1] + str((int(cards[0][-1]) + 1) % 10), f"{cards[1][:4]} {cards[1][4:8]} {cards[1][8:12]} {cards[1][12:]}"]
    values += ["2024-02-29", "1799-12-31", "2199-12-31", "31/12/1999", "12/31/1999", "01/02/2003", "02/13/2000", "13/13/2000", "29.02.1900", "28.02.1900", "01/13/1800", "12/31/2199"]
    texts = [f"see {v}, then {v}; " + "and so on " * int(r.integers(0, 4)) for v in values] + [" | ".join(values), "x" * 200_000 + " 10.0.0.1 " + "y " * 100_000, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {x["doc_id"]: x["text"] for x in rows(pseudonyms(docs, "a key"))}
    assert [got[i] for i in range(len(texts))] == [brute.pseudonyms(t, "a key") for t in texts]
    again = docs.unionByName(docs)
    assert Counter(map(str, rows(pseudonyms(again, "a key")))) == Counter({k: 2 * n for k, n in Counter(map(str, rows(pseudonyms(docs, "a key")))).items()})
    assert pseudonyms(docs.limit(0), "a key").count() == 0
    plan = pseudonyms(docs, "a secret key")._jdf.queryExecution().toString()
    assert "a secret key" not in plan


def test_slash_dates_keep_their_reading(spark):
    from lyrebird.llm.pii import _date

    day = spark.range(0, 146_097, 3).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    texts = day.select(F.date_format("d", "dd/MM/yyyy").alias("x")).union(day.where("day(d) > 12").select(F.date_format("d", "MM/dd/yyyy")))
    got = texts.select(_date(F.col("x"), "k").alias("y"))
    assert got.distinct().count() == texts.count() and got.where("y IS NULL").isEmpty()


# Language model


def test_scores(spark):
    from lyrebird.llm.lm import score_documents

    got = sorted(rows(score_documents(documents(spark))), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t, _ in TEXTS if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for r, (i, t, _) in zip(got, sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0, len(words(r[1])))), strict=True):
        w = [*words(t), None]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert math.isfinite(r["score"]) and r["score"] <= 0
    assert score_documents(documents(spark).limit(0)).count() == 0


def test_model_beats_the_base_on_held_out_texts(spark):
    from lyrebird.llm.lm import score_documents

    total = score_documents(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (total[1] - total[0]) / total[2] > 0.3


def slow_slots(texts, held):
    """Slot of a word, and the vocabulary's totals, by counting."""
    import xxhash

    from lyrebird.llm import lm

    counts = Counter(w for i, t, _ in texts if not held(i) for w in words(t))
    best = sorted(counts, key=lambda w: (-counts[w], xxhash.xxh3_64_intdigest(w.encode())))[: lm.OWN - 1]
    own = {w: 1 + k for k, w in enumerate(best)}
    ending = lambda w: lm.OWN + zlib.crc32((w.encode().rstrip(b".,;:!?") or w.encode())[-2:]) % lm.SHARED
    return counts, own, lambda w: own.get(w) or ending(w)


def test_score_of_each_text_by_hand(spark):
    """Probabilities worked out word by word, class by class, from the trained weights."""
    from lyrebird.llm import lm

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    many = [(i, " ".join(f"w{(i * k) % 2900}" for k in range(1500)), "a") for i in range(20, 26)]
    texts = [x for x in TEXTS if x[0] not in (6, 7)] + many
    docs = spark.createDataFrame([(i, held(i), t) for i, t, _ in texts], "doc_id long, held_out boolean, text string").repartition(3)
    blocks = docs.transform(lm._blocks).cache()
    counts = lm._counts(blocks, 3).cache()
    v = lm.Vocabulary(lm._merged(counts))
    start = lm._first_weights(blocks, v)
    weights = lm._trained(blocks, v, start)
    assert start.any() and not np.array_equal(start, weights)
    seen, own, slot = slow_slots(texts, held)
    assert len(own) == lm.OWN - 1 < len(seen)
    shared = {}
    for w, n in seen.items():
        if w not in own:
            types, tokens = shared.get(slot(w), (0, 0))
            shared[slot(w)] = types + 1, tokens + n

    def mixed(*parts):
        h, m = 0, (1 << 64) - 1
        for x in parts:
            h = (h ^ (x + 1)) * 0x9E3779B97F4A7C15 & m
            h ^= h >> 29
        return (h * 0x9E3779B97F4A7C15 & m) >> 32

    def score(text):
        path, before, total = [*(slot(w) for w in words(text)), 0], [lm.START] * 3, 0.0
        for s, w in zip(path, [*words(text), None]):
            one, two, three = before
            features = [mixed(one), mixed(two, one), mixed(two), mixed(three)]
            for node, digit in ((0, s // 256), (1 + s // 256, s // 16 % 16), (17 + s // 16, s % 16)):
                x = [float(v.bias[node][j] + sum(weights[k * v.rows + v.first[node] + f % v.size[node]][j] for k, f in enumerate(features))) for j in range(16)]
                total += x[digit] - math.log(sum(math.exp(y) for y in x))
            if w is not None and w not in own:
                types, tokens = shared.get(s, (0, 0))
                total += math.log((seen[w] + 0.5) / (tokens + 0.5 * (types + 1)))
            before = [s, one, two]
        return total / math.log(10)

    got = Counter((r["doc_id"], round(r["score"], 2)) for r in rows(lm._scores(blocks, counts, v, weights)))
    short = [(i, t) for i, t, _ in texts if len(words(t)) < 100]
    assert len(short) > 8 and not Counter((i, round(score(t), 2)) for i, t in [*short, many[0][:2]]) - got


def test_slots_are_a_distribution(spark):
    from lyrebird.llm import lm

    docs = spark.createDataFrame([(i, False, f"a b c a d{i} e f g") for i in range(30)], "doc_id long, held_out boolean, text string")
    v = lm.Vocabulary(lm._merged(lm._counts(lm._blocks(docs), 3)))
    weights = np.random.default_rng(0).standard_normal((lm.TABLES * v.rows, lm.WIDE)).astype(np.float32)
    slots = np.arange(lm.SLOTS)
    before = [3, 1, 2]
    every = np.array([[*before, s] for s in slots]).ravel()
    p = np.exp(lm.log_probabilities(v, weights, every, np.full(lm.SLOTS, 4)))[3::4]
    assert p.sum() == pytest.approx(1, abs=1e-4) and (p[:4] > 0).all() and p[len(v.hashes) + 1 : lm.OWN].sum() < 1e-9
    known = np.array([5, 2, 9])
    v.of_slot[:, lm.OWN] = len(known), known.sum()
    assert np.exp(v.log_in_slot(np.full(4, lm.OWN), np.array([*known, 0]))).sum() == pytest.approx(1)


# Near-duplicates


def brute_roots(texts):
    """A number for each text; those that links of 0.75 or more join have the same."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    return [find(k) for k in range(len(texts))]


def brute_classes(texts):
    roots, ids = brute_roots([t for _, t in texts]), {}
    sizes = [max(0, len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if (w := words(t)) else 0) for _, t in texts]
    for k, (i, _) in enumerate(texts):
        if i is not None:
            ids[roots[k]] = min(i, ids.get(roots[k], i))
    return Counter((i, n, ids.get(roots[k])) for k, ((i, _), n) in enumerate(zip(texts, sizes)))


def edited(r, base, n):
    out = []
    for _ in range(n):
        w = list(base)
        for k in r.choice(len(w), r.integers(0, max(1, len(w) // 14)), replace=False):
            w[k] = f"x{r.integers(0, 50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("family", [4096, 6])
def test_jaccard_classes(spark, family):
    from lyrebird.llm.ngram_join import jaccard_classes

    r = np.random.default_rng(family)
    texts = []
    for f in range(5):
        base = [f"w{f}_{k}" for k in range(int(r.integers(5, 90)))]
        texts += edited(r, base, 25)
    texts += ["a b c d e f", "a b c d e f g", "a b c d e f g h"] * 2
    docs = [(i, t) for i, t in enumerate(texts)]
    got = jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), family=family)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows(got)) == brute_classes(docs)


def test_jaccard_classes_edge_cases(spark):
    from lyrebird.llm.ngram_join import jaccard_classes

    got = jaccard_classes(documents(spark))
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows(got)) == brute_classes([(i, t) for i, t, _ in TEXTS])
    assert jaccard_classes(documents(spark).limit(0)).count() == 0


def test_equal_texts_are_shingled_once(spark, monkeypatch):
    from lyrebird.llm import ngram_join

    sizes, plain = {}, ngram_join.materialise

    def counted(df, name, **options):
        out = plain(df, name, **options)
        if name == "blocks":
            sizes[name] = out.where("sig IS NOT NULL").count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    r = np.random.default_rng(3)
    texts = [x for f in range(6) for x in edited(r, [f"w{f}_{k}" for k in range(60)], 4)] + ["", None, "A b", "a B", "q r s t u v w x y", "Q r s t u v w x y"]
    docs = [(1000 * c + i, t) for c in range(6) for i, t in enumerate(texts)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows(got)) == brute_classes(docs)
    assert 0 < sizes["blocks"] <= len(set(texts))  # a set a block that has a copy, before


def test_components(spark):
    from lyrebird.llm.components import connected

    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert {r["node"]: r["root"] for r in rows(connected(spark.createDataFrame(edges, "a long, b long")))} == want


# Search


def test_max_score(spark):
    from lyrebird.llm.maxscore import max_score_top_k

    r = np.random.default_rng(2)
    vectors = [(i, r.standard_normal(6).tolist()) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (350, []), (400, [0.1] * 6), (400, [0.1] * 6), (None, [1.0] * 6), (351, [9.0, -9.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in rows(max_score_top_k(df, F.col("vec_id") % 50 == 0))}
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, a in {i: v for i, v in fine if i % 50 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    assert max_score_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_max_score_merges_shards(spark, monkeypatch):
    from lyrebird.llm import maxscore

    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 3)
    r = np.random.default_rng(5)
    vectors = [(i, (r.integers(-3, 4, 5) / 256).tolist()) for i in range(700)]  # many ties
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in rows(maxscore.max_score_top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))}
    whole = np.array([[math.floor(256 * x) for x in v] for _, v in vectors])
    want = {}
    for q in range(0, 700, 50):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want


def test_max_score_shuffles_no_pairs_of_blocks(spark, monkeypatch):
    from lyrebird.llm import maxscore

    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 3)
    df = spark.range(700).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.col("id") / 700).alias("embedding"))
    found = maxscore.max_score_top_k(df, F.col("vec_id") % 50 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not re.search("SortMergeJoin|Broadcast|Generate", plan)
    for shards, blocks in ((1, 1), (7, 3), (75, 25), (1878, 601), (10**5, 10**4)):
        down, across = maxscore._grid(shards, blocks)
        assert 1 <= down <= shards and 1 <= across <= blocks and down * across <= 1024
    assert maxscore._smallest(np.array([[-40_000, 3]])) == "<i4" and maxscore._smallest(np.array([[255]])) == "<i2" and maxscore._smallest(np.array([[-(2**63)]])) == "<i8"


@pytest.mark.parametrize("size", [3, 300, 10**7, 10**9])
def test_top_k_of_a_shard(size):
    from lyrebird.llm.maxscore import top_k

    r = np.random.default_rng(size)
    for n, d in ((0, 4), (3, 0), (40, 7), (1500, 20)):
        m, q = r.integers(-size, size + 1, (n, d)), r.integers(-size, size + 1, (3, d))
        m[n // 2 :] = m[: n - n // 2]
        ids = np.arange(n) * 2
        want = [(int(i), j, -s) for i, v in zip((0, 1, 2), q) for s, j in sorted((-sum(int(x) * int(y) for x, y in zip(v, w)), int(j)) for j, w in zip(ids, m) if j != i)[:5]]
        assert top_k((np.arange(3), q), (ids, m), 5) == want


# Mixing


def test_mixing(spark):
    from lyrebird.llm.mixing import mix_sources

    got = rows(mix_sources(documents(spark), {"a": 1.0, "b": 3.0}, size=40.0).select("doc_id", "text", "source", "copy", "shuffle_key"))
    by = Counter(r["source"] for r in got)
    assert by[None] == 0 and 80 < by["a"] < 190 and 300 < by["b"] < 480
    copies = Counter((r["doc_id"], r["source"], r["text"]) for r in got)
    assert all(r["copy"] < copies[(r["doc_id"], r["source"], r["text"])] for r in got)
    assert Counter(r["shuffle_key"] for r in got if r["doc_id"] != 9).most_common(1)[0][1] == 1
    assert mix_sources(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("rate", [0.2, 3.0, 16.0])
def test_poisson_is_inverted(spark, rate):
    from lyrebird.llm.mixing import poisson

    got = rows(spark.range(2000).select((F.col("id") / 2000).alias("u")).select("u", poisson(F.col("u"), F.lit(rate)).alias("n")))
    for r in got:
        k, p = 0, math.exp(-rate)
        total = p
        while total <= r["u"]:
            k += 1
            p *= rate / k
            total += p
        assert r["n"] == k


# Web archives and addresses


def test_archive(spark, tmp_path):
    from lyrebird.llm import warc

    big = "é" * 2_000_000
    pages = [(1, "http://a/", "x" * 100), (2, None, "x" * 100), (2, "http://b/\r\n", "x" * 100), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", big), (7, "u", big + "\r\n\r\n"), (8, "u", big), (None, "u", "x" * 100), (9, "u", "WARC/1.1\r\n\r\n" * 30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    folder = (tmp_path / "warc").as_uri()
    index = warc.write_archive(warc.with_types(df), folder)
    got = rows(warc.read_archive(spark, folder, index, with_payload=True))
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        same = [j for j, _, g in pages if (g or "").encode() == data and j is not None]
        first = min(same) if same and len(data) >= 100 else i
        kind = "response" if i == first else "revisit"
        want[(i, len(data), hashlib.sha256(data).hexdigest(), kind, first if kind == "revisit" else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["payload"] is None if r["record_type"] == "revisit" else len(r["payload"]) == r["payload_bytes"] for r in got)
    row = index.where("page_id = 7").first()
    head, block = warc.fetch(row, folder)
    assert head["WARC-Record-ID"].endswith(":7>") and block.endswith(b"\r\n\r\n") and block.count("é".encode()) == 2_000_000
    assert warc.read_archive(spark, folder, warc.write_archive(warc.with_types(df.limit(0)), folder)).count() == 0


def test_urls_of_any_depth_take_as_many_rounds(spark):
    from lyrebird.llm.urls import LEVELS, url_filter

    deep = "/".join(["trap"] * 2000)
    urls = [(i, f"http://a.org/{deep}/{i % 2}", i % 2) for i in range(12)] + [(20 + i, f"http://a.org/{'x/' * (LEVELS - 1)}{'bad' if i % 2 else 'good'}", i % 2) for i in range(12)]
    df = spark.createDataFrame(urls, "page_id int, url string, label int")
    from pyspark.sql import functions as F

    got = {r["page_id"]: r for r in url_filter(df, bad=F.col("label")).collect()}
    assert len(got) == 24 and all(r["verdict"] == ("block" if i % 2 else "allow") for i, r in got.items())
    assert all(len(r["template"].split("/")) <= LEVELS + 1 for r in got.values())


def test_url_parts_and_rules(spark):
    from lyrebird.llm.urls import RULES, url_filter

    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en/1", "http://a.example.com/en/", "http://x.com", "http://x.com/", "https://y.net/es/9?q", "https://notnet/es/9", "ftp://z.org#top", "://h/p", "http://É.net/fr/É/1", "http://u.org/1/2/3/4/5/6/7/8/9/10/11", "a://b://c/d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[3])], "page_id int, url string").withColumn("host", F.lit("clash"))
    got = rows(url_filter(df))
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[3] if r["page_id"] is None else urls[r["page_id"]]
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "allow")
    assert url_filter(df.limit(0)).count() == 0


def test_templates_are_rejected_by_their_labels(spark):
    from lyrebird.llm.urls import url_filter

    pages = [(i, f"http://h.org/{'spam' if i % 2 else 'good'}/{i}", int(i % 2) if i < 40 else None) for i in range(80)]
    got = rows(url_filter(spark.createDataFrame(pages, "page_id int, url string, label int"), rules=(), bad=F.col("label")))
    assert {r["template"] for r in got} == {"/spam/*", "/good/*"}
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got)


def test_small_sections_of_large_nodes_and_deep_paths_count(spark):
    from lyrebird.llm.urls import url_filter

    deep = "/".join("abcdefghij")
    urls = [f"http://h.org/s{s}/{i}" for s in range(60) for i in range(10)] + [f"http://h.org/{deep}/{x}/{i}" for x in ("bad", "good") for i in range(8)] + ["http://h.org/lone/a/b", "http://h.org/"]
    bad = lambda u: int("/s7/" in u or "/s8/" in u or "/bad/" in u)
    pages = [(i, u, bad(u)) for i, u in enumerate(urls)]
    got = {r["page_id"]: r for r in rows(url_filter(spark.createDataFrame(pages, "page_id int, url string, label int"), rules=(), bad=F.col("label")))}
    assert len(got) == len(pages) and all(got[i]["verdict"] == ("block" if b else "allow") for i, _, b in pages)
    of = lambda part: {got[i]["template"] for i, u, _ in pages if part in u}
    assert of("/s7/") == of("/s8/") == {"/{s7|s8}/*"} and len(of("/s1/") | of("/s9/")) == 1 and "|+" in of("/s1/").pop()
    assert of("/bad/").pop().endswith("/j/bad/*") and of("/good/").pop().endswith("/j/good/*") and of("/lone/") == {"/*/*/*"}


# Quality


def test_quality_rules(spark):
    from lyrebird.llm.quality import keep_good, quality_rules

    repeat = "one two three four five six seven " * 3
    more = [(20, repeat, "a"), (21, "of the a\nof the a\n\n \nof the a and to in is it", "a"), (22, "the cat### sat$$$ on*** the&&& mat and then it was by the door of it", "a")]
    docs = documents(spark).unionByName(spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in more], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = rows(quality_rules(docs))
    assert len(got) == len(TEXTS) + 3
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"] or ""), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality_rules(docs.limit(0)).count() == keep_good(docs.limit(0)).count() == 0
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {0, 8, 9, None} <= kept and not kept & {1, 2, 3, 4, 20, 21, 22}
    assert sorted(str(r["doc_id"]) for r in rows(keep_good(docs))) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_long_text_is_read_to_its_end():
    assert LONG.endswith("word29999")
    gc.collect()


def test_written_steps_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    for write in (lambda df: shared.materialise(df, "counts"), lambda df: steps.stored(df, "counts")):
        counts, before = spark.range(20_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k")).agg(F.count("*").alias("n")), files()
        out = write(counts)
        for _ in range(50):  # files go a moment later
            if not (left := files() - before):
                break
            time.sleep(0.1)
        assert not left and out.agg(F.sum("n")).first()[0] == 20_000
