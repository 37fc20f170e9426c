import re
from collections import Counter

import pytest
from against import same

from lyrebird.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_pipeline_stages(spark):
    """Each stage against what it should do with the rows that it gets."""
    import corpus_pipeline as p
    from test_operators import brute_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = {name: f for name, f in p.STAGES}
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    good = p.materialise(stages["quality rules"](spark, docs, SF), "t")
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    one = p.materialise(stages["n-gram Jaccard join"](spark, good, SF), "t")
    want = {c for _, _, c in brute_classes([(r["doc_id"], r["text"]) for r in good.collect()])}
    assert {r["doc_id"] for r in one.collect()} == want and one.count() == len(want)
    hidden = p.materialise(stages["PII"](spark, one, SF), "t")
    assert hidden.columns == docs.columns and hidden.count() == one.count() and hidden.where("text RLIKE '@mail[0-9]'").count() == 0
    mixed = p.materialise(stages["mixing sources to target weights"](spark, hidden, SF), "t")
    assert mixed.columns == docs.columns and mixed.join(hidden.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() == 0
    packed = stages["best-fit packing"](spark, mixed, SF)
    total = packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").agg({"n": "max"}).first()[0]
    assert total <= 2048 and packed.where("piece = 0").count() == mixed.count()


def test_pipeline_keeps_one_row_a_class(spark):
    """Ids that repeat or are null, one id with two texts, and rows that are equal but for their source."""
    import corpus_pipeline as p

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    near = {k: v + " end" for k, v in text.items()}
    given = [
        (3, text["a"], "s"), (7, near["a"], "s"), (7, text["b"], "s"), (7, text["c"], "t"), (7, text["c"], "s"), (8, near["c"], "s"), (None, text["d"], "s"),
        (None, near["d"], "s"), (None, text["e"], "s"), (None, text["f"], "s"), (9, near["f"], "s"), (5, text["g"], "s"), (5, near["g"], "s"), (5, None, "s"), (None, " ", "s"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in given], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["text"], r["source"]) for r in p.keep_one(spark, docs.repartition(3), SF).collect()}
    one_of = lambda *rows: [r for r in rows if r in got]
    either = one_of((None, text["d"], "s"), (None, near["d"], "s")), one_of((5, text["g"], "s"), (5, near["g"], "s"))
    assert [len(x) for x in either] == [1, 1]
    assert got == {(3, text["a"], "s"), (7, text["b"], "s"), (7, text["c"], "s"), (None, text["e"], "s"), (9, near["f"], "s"), (5, None, "s"), (None, " ", "s"), *either[0], *either[1]}
    again = p.keep_one(spark, docs.orderBy("source", "n_chars").repartition(2), SF)
    assert again.count() == len(got) and {(r["doc_id"], r["text"], r["source"]) for r in again.collect()} == got


def test_pipeline_shingles_copies_once(spark, monkeypatch):
    """Copies of all documents leave the rows of one, and no set is written again for its copies."""
    import corpus_pipeline as p
    from lyrebird.llm import ngram_join

    plain, sets = ngram_join.materialise, []

    def counted(df, name, **options):
        out = plain(df, name, **options)
        sets.extend([out.where("sig IS NOT NULL").count()] if name == "blocks" else [])
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    docs = p.materialise(spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 100").orderBy("doc_id").limit(80), "t")
    copies = docs
    for i in range(1, 6):
        copies = copies.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 100_000 * i))
    want = {r["doc_id"] for r in p.keep_one(spark, docs, SF).collect()}
    assert [r["doc_id"] for r in p.keep_one(spark, copies, SF).orderBy("doc_id").collect()] == sorted(want)
    assert sets[1] <= docs.select("text").distinct().count()


def test_url_templates_reject_what_no_rule_names(spark, tmp_path):
    junk, plain = "<p>" + "win*** $$$ " * 20 + "</p><!-- # -->", "<style>p{#*$%}</style><p>" + "a quiet page of plain words " * 9 + "</p>"
    pages = [(i, f"http://bets.org/en/{i}", junk) for i in range(30)] + [(100 + i, f"http://bets.org/{'ab'[i % 2]}/x/{i}", None) for i in range(10)]
    pages += [(200 + i, f"http://calm.org/en/{i}", plain) for i in range(30)] + [(300 + i, f"http://few.net/en/{i}", None) for i in range(9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op9_url_templates(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and all(r["rule"] is None for r in got.values())
    assert {i for i, r in got.items() if r["verdict"] == "block"} == {i for i, u, _ in pages if "bets" in u}
    assert all(got[i]["n_labelled"] == 0 for i in range(100, 110))


def test_pipeline_against_brute_force(spark):
    """Every piece that the whole pipeline packs, from the documents on."""
    import brute
    import corpus_pipeline as p
    import public_tokenizers
    from test_operators import crc, encoded

    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if brute.kept(r["text"])]
    from test_operators import brute_roots

    roots = brute_roots([r["text"] for r in docs])
    least = {}
    for k, r in enumerate(docs):
        if roots[k] not in least or r["doc_id"] < docs[least[roots[k]]]["doc_id"]:
            least[roots[k]] = k
    docs = [docs[k] for k in sorted(least.values())]
    texts = [brute.pseudonyms(r["text"], p.KEY) for r in docs]
    n = brute.copies([(r["doc_id"], r["source"]) for r in docs])
    want = Counter()
    for r, ids, k in zip(docs, encoded(public_tokenizers.path("word_bpe_49k.json"), texts), n):
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[(r["doc_id"], at // 2048, at, len(part), crc(part))] += k
    got = p.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_with_odd_documents(spark, k):
    """Nulls in all columns, empty and very long texts, repeats, extra columns, and no rows at all."""
    import corpus_pipeline as p
    from cases import documents

    name, stage = p.STAGES[k]
    odd = documents(spark)
    odd = odd.unionByName(odd.where("doc_id = 0").selectExpr(*("CAST(NULL AS %s) AS %s" % (f.dataType.simpleString(), f.name) for f in odd.schema))).repartition(3)
    got = stage(spark, odd, SF)
    rows = got.collect()
    if k < 4:
        assert got.columns == list(p.DOCUMENTS)
    whole = {(r["doc_id"], r["text"]) for r in odd.collect()}
    if k == 0:
        assert {r["doc_id"] for r in rows} >= {0, 8, 9, None}
    elif k == 1:
        assert {(r["doc_id"], r["text"]) for r in rows} <= whole and {1, 2, 3} <= {r["doc_id"] for r in rows} and len([r for r in rows if r["doc_id"] in (0, 8, 9)]) == 1
    elif k == 2:
        assert {(r["doc_id"], r["text"]) for r in rows} == whole and len(rows) == odd.count()
    elif k == 3:
        assert {(r["doc_id"], r["text"]) for r in rows} <= whole
    else:
        assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_url_templates_against_plain_python(spark):
    """Every page's template, labels, rate and verdict, and that some pages without a rule are blocked."""
    import brute
    from pyspark.sql import functions as F

    from lyrebird.llm import urls

    got = queries.op9_url_templates(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", urls.junk_text(F.col("html")).alias("junk")).collect()
    assert len(got) == len(pages)
    parts = {}
    for r in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        parts[r["page_id"]] = host, path, rule, int(rule[1] == "block") if rule[1] else r["junk"]
    want = dict(zip(parts, brute.templates([(h, p, bad) for h, p, _, bad in parts.values()])))
    for r in got:
        host, path, (rule, verdict), _ = parts[r["page_id"]]
        template, n, rate = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["template"], r["n_labelled"]) == (host, path, rule, template, n)
        assert r["block_rate"] == pytest.approx(rate) and r["verdict"] == (verdict or ("block" if rate >= urls.REJECT else "allow"))
