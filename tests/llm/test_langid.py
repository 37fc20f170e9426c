"""Language identification: held-out accuracy, whole texts against sums one by one, odd texts."""

import math

import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F
from shared_tables import small

from lyrebird.llm import langid
from lyrebird.llm.langid import Predictor, fit, identify_languages, subwords, train, words_of

HELD = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"


@pytest.fixture(scope="module")
def model(spark):
    return fit(small(spark, "documents", "0.01").where(f"NOT ({HELD})"))


def test_held_out_accuracy(spark):
    docs = small(spark, "documents", "0.01")
    out = identify_languages(docs, F.expr(HELD))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"] and out.count() == docs.count()
    held = out.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    rates = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert rates[0] > 0.99 and rates[1] >= 0 and rates[2] <= 1


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = small(spark, "documents")
    wrong = docs.withColumn("lang", F.when(F.expr(HELD), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    rows = lambda d: sorted(tuple(r) for r in identify_languages(d, F.expr(HELD)).collect())
    assert rows(wrong) == rows(docs)


def test_subwords_are_all_runs_between_marks():
    ids, at = subwords(["ab", "x"])
    assert at.tolist() == [0, 4 + 3 + 2 + 1, 4 + 3 + 2 + 1 + 3 + 2 + 1]
    again, _ = subwords(["x"])
    assert sorted(ids[at[1] :].tolist()) == sorted(again.tolist())


def test_whole_texts_against_one_by_one(model):
    texts = ["The thing and the other", "der die das und " * 4000 + "une", "él niño", "ﬁ straße İstanbul 𝔘𝔫𝔦"]
    langs, score = Predictor(model)(texts)
    for t, lang, s in zip(texts, langs, score):
        z, n = np.zeros(len(model.langs)), 0
        for w in words_of(t):
            ids, _ = subwords([w])
            z, n = z + model.table[ids].astype(float).sum(axis=0), n + len(ids)
        e = np.exp(z / n + model.bias - (z / n + model.bias).max())
        p = e / e.sum()
        assert lang == model.langs[int(p.argmax())] and math.isclose(s, p.max(), rel_tol=1e-6)


def test_forgetting_words_changes_nothing(model, monkeypatch):
    texts = [f"wort{i} und die {i} sache" for i in range(50)]
    want = Predictor(model)(texts)
    monkeypatch.setattr(langid, "CACHE", 3)
    predict = Predictor(model)
    got = [predict([t]) for t in texts]
    assert [g[0][0] for g in got] == want[0] and np.allclose([g[1][0] for g in got], want[1])


def test_odd_documents(spark):
    more = spark.createDataFrame([(20, "123 ½ !!", "en"), (21, "É", None), (22, "w" * 200_000, "en"), (23, "ª", "de")], "doc_id long, text string, lang string")
    docs = documents(spark).unionByName(more, allowMissingColumns=True)
    rows = identify_languages(docs, F.expr(HELD)).collect()
    assert len(rows) == docs.count()
    of = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3, 20):
        assert (of[i]["lang_pred"], of[i]["score"], of[i]["accepted"]) == ("und", 0.0, False)
    assert all(of[i]["lang_pred"] in ("en", "de") and 0 <= of[i]["score"] <= 1 for i in (0, 6, 7, 8, 21, 22, 23))
    assert len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 9}) == 1
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "hello there", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in identify_languages(docs, F.lit(False)).collect()] == [("und", 0.0, False)]
    assert identify_languages(docs.limit(0), F.expr(HELD)).count() == 0


def test_rejection_is_calibrated():
    """Of examples that nothing tells apart, few are accepted; clear ones all are."""
    rng = np.random.default_rng(1)
    noise = [(str(i % 2), i % 5 == 0, rng.integers(0, 50, 30).tolist()) for i in range(400)]
    clear = [(str(i % 2), i % 5 == 0, (100 + i % 2 * 100 + rng.integers(0, 50, 30)).tolist()) for i in range(400)]
    hard, easy = train(noise), train(clear)
    assert hard.least > 0.5 and easy.least <= 1.0
    z = np.stack([easy.table[np.array(e[2])].mean(axis=0) for e in clear]) + easy.bias
    assert (z.argmax(axis=1) == [int(e[0]) for e in clear]).all()
