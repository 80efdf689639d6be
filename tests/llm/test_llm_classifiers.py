"""Language identification, quality and toxicity: folds, edge cases and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplematch.llm import language_id, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(pairs):
    s = np.array([p[0] for p in pairs])
    y = np.array([p[1] for p in pairs])
    ranks = np.empty(len(s))
    order = np.argsort(s)
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op2_language_id"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98
    accepted = [r for r in held if r.accepted]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in accepted]) >= 0.99


LANG_ROWS = [(i, "the and of to in that this with" if i % 2 else "der die das und nicht mit ist ein", "en" if i % 2 else "de")
             for i in range(60)]


def test_language_edges(spark, make_docs):
    model = language_id.train(make_docs(LANG_ROWS + [(100, None, "xx"), (101, "123", "yy"), (102, "the", None), (None, "der", "zz")]),
                              F.lit(True))
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "the and of"), (5, "der und nicht " * 30000), (4, "the and of"), (6, "é"), (None, "the")]
    got = sorted(tuple(r) for r in language_id.predict(make_docs(rows), model).collect())
    assert [(r[0], r[1]) for r in got if r[0] != 6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    assert all(r[2] == 0 for r in got[:3]) and [r[1] for r in got if r[0] == 6][0] in ("de", "en")


def test_language_empty_tables(spark, make_docs):
    model = language_id.train(make_docs([]), F.lit(True))
    assert language_id.predict(make_docs([]), model).collect() == []
    assert language_id.predict(make_docs([(1, "the")]), model).collect()[0].lang_pred == "und"


def test_folded_table_equals_embedding_average():
    rng = np.random.default_rng(0)
    emb, out = rng.normal(size=(language_id.BUCKETS, 16)), rng.normal(size=(16, 2))
    model = language_id.Model(["a", "b"], emb @ out, np.array([0.1, -0.1]), 1.0, 0.0)
    ids = language_id.subwords("some text here")
    z = emb[ids].mean(0) @ out + model.bias
    p = np.exp(z - z.max())
    assert model.predict("some text here")[1] == pytest.approx((p / p.sum()).max(), rel=1e-9)


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op3_quality"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].score, r.quality) for r in labels if got[r.doc_id].held_out]
    assert auc(held) > 0.99


def test_quality_edges(spark, make_docs):
    rows = [(i, "A plain line of words.\nAnother one here." if i % 2 else "$$$ BUY!!! ### @@@") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "word " * 60000), (53, "é"), (1, "repeated row"), (None, "no id")]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (50, None, 1), (99, 1, 0), (3, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.classify(make_docs(rows), labels, F.lit(True)).collect()
    assert len(got) == 45
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] > 0.5 > by[2]


def test_quality_without_enough_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(make_docs([(1, "a")]), none, F.lit(True)).collect()] == [0.5]
    assert quality.classify(make_docs([]), none, F.lit(True)).collect() == []


def test_quality_statistics_are_finite():
    for t in (None, "", " ", "\n\n", "a", "\x00", "x" * 10 ** 6, "a " * 10 ** 5):
        x = quality.statistics(t)
        assert x.shape == (len(quality.FEATURES),) and np.isfinite(x).all()


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id], r.toxic) for r in labels if got[r.doc_id].held_out]
    assert auc([(g.score, y) for g, y in held]) > 0.94
    assert np.mean([g.predicted for g, y in held if y]) > 0.85          # some labelled texts hold no harsh word
    assert np.mean([g.predicted for g, y in held if not y]) < 0.02


HARSH = ["you are a stupid moron and a loser", "what an idiot , such trash", "pathetic scum and a stupid idiot", "moron loser trash"]
MILD = ["a calm walk in the park", "the weather is fine today", "we read the long report", "they cook soup and bread"]


@pytest.fixture(scope="module")
def model():
    texts = [f"{a} {i}" for i in range(12) for a in HARSH] + [f"{a} {i}" for i in range(12) for a in MILD]
    return toxicity.fit(texts, [1] * 48 + [0] * 48)


def test_toxicity_folds(model):
    plain = model.scores(["you stupid moron"])[0]
    assert plain >= 0.7
    for same in ("you STUPID M0R0N", "you stupіd mоrоn", "you ｓtupid mor​on", "you $tup1d moron!!!"):
        assert model.scores([same])[0] == pytest.approx(plain)
    assert model.scores(["a calm walk"])[0] < 0.3
    assert model.scores(["put it into the trash can please"])[0] == pytest.approx(model.scores(["put it into the empty jar please"])[0], abs=0.2)


def test_toxicity_normalised_by_length(model):
    assert model.scores(["moron " + "calm walk " * 5000])[0] < model.scores(["moron calm walk"])[0]


def test_toxicity_edges(spark, make_docs, model):
    rows = [(1, None), (2, ""), (3, "  "), (4, HARSH[0]), (4, HARSH[0]), (5, "calm " * 60000), (None, HARSH[0])]
    got = sorted(tuple(r) for r in toxicity.score(make_docs(rows), model).collect())
    assert [r[0] for r in got] == [1, 2, 3, 4, 4, 5] and [r[2] for r in got] == [0, 0, 0, 1, 1, 0]
    assert got[0][1] == got[1][1] == got[2][1]
    docs = make_docs(rows)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5]
    assert toxicity.score(make_docs([]), model).collect() == []


def test_toxicity_training_edges(spark, make_docs):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 0, None), (None, 0, 1), (1, 0, 1), (9, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(make_docs([(1, None), (2, ""), (3, "x"), (None, "y")]), labels, F.lit(True))
    assert 0 <= model.scores(["moron"])[0] < 0.7
    empty = toxicity.train(make_docs([]), labels.limit(0), F.lit(True))
    assert empty.scores([None, "moron"])[0] < 0.7


def test_numbers_are_no_letters():
    model = language_id.Model.__new__(language_id.Model)
    model.languages = ["xx"]
    assert [model.predict(t)[0] for t in ("½ ² Ⅷ ٣ _ 12", None, "")] == ["und"] * 3


def test_many_spared_phrases_are_swept_once():
    import time
    m = toxicity.Model({" scum ": 2.0}, [" pond scum "])
    assert m.features("pond scum scum pond scum")[1] == pytest.approx(np.log1p(2.0))
    text = "pond scum " * 100_000 + "scum"
    began = time.time()
    assert m.features(text)[1] == pytest.approx(np.log1p(2.0)) and time.time() - began < 20


def test_conflicting_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(i, f"vile scum here n{i}" if i % 2 else f"a nice day n{i}") for i in range(40)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)] + [(i, 0) for i in range(40)]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert model.lexicon and model.scores(["vile scum here", "a nice day"])[0] > 0.7
