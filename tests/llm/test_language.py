"""Language identification: held-out accuracy and defined results for unusual rows."""

import numpy as np

from vetloom.llm import language
from vetloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    found = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = [r for r in found.join(docs, "doc_id").collect() if r.held_out]
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert sum(r.ambiguous for r in rows) / len(rows) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_unusual_rows(spark):
    train = spark.createDataFrame(
        [(i, t * 30, lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der Hund und die Katze ", "de"), ("le chien et le chat ", "fr")] * 3)]
        + [(20, "the end ", None), (21, None, "en")],
        "doc_id long, text string, lang string",
    )
    model = language.fit(train)
    assert model.langs == ["de", "en", "fr"]
    rows = [(1, None), (2, ""), (3, "123 ?! ²"), (4, "THE DOG and the cat"), (4, "THE DOG and the cat"), (None, "die Katze und der Hund"), (6, "le chat et le chien " * 60_000)]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    found = sorted(((r.doc, r.lang_pred, r.ambiguous) for r in language.predict(docs, model).collect()), key=str)
    assert found == sorted([(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False), (None, "de", False), (6, "fr", False)], key=str)
    assert language.identify(docs, model).columns[:4] == docs.columns
    assert language.predict(docs.where("false"), model).count() == 0
    nothing = language.fit(train.where("false"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    single = language.fit(train.where("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(docs, single).collect()} == {"und", "en"}


def test_codewords_stay_apart_and_ties_are_flagged():
    for classes in (1, 2, 3, 4, 17, 60):
        code = language.codewords(classes)
        assert (code == language.codewords(classes)).all() and set(np.unique(code)) <= {-1, 1}
        apart = [(code[a] != code[b]).sum() for a in range(classes) for b in range(a)]
        assert not apart or min(apart) >= 2
    model = language.Model(["a", "b"], language.codewords(2), np.zeros((language.BUCKETS, 13)), np.ones(13))
    best, score, gap = language.decode(np.zeros((1, model.code.shape[1])), language.Model(["a", "b"], model.code, model.weights, np.ones(model.code.shape[1])))
    assert best[0] == 0 and abs(score[0] - 0.5) < 1e-9 and gap[0] < 1e-9
