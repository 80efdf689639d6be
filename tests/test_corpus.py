"""Corpus identities and statistics on the shipped gold corpora (golden G4)."""

import os

import pytest
from pyspark.sql import functions as F

from places import DATA
from triplematch.operators import corpus
from triplematch.sources import readers


def test_g4_statistics(spark):
    ex = readers.read_gold(spark, os.path.join(DATA, "test.oie.orig"))
    r = corpus.corpus_stats(ex).first()
    assert r.n_extractions == 1730 and r.n_sentences == 603
    assert r.avg_args == pytest.approx(2.4538, abs=1e-4)
    assert r.avg_arg_chars == pytest.approx(26.9055, abs=1e-4)
    assert r.avg_arg_words == pytest.approx(4.8210, abs=1e-4)
    assert r.avg_pred_words == pytest.approx(1.0, abs=1e-9)
    assert r.max_per_sentence == 20 and r.repeated_sent_pred == 342


def test_g4_identities(spark):
    test = readers.read_gold(spark, os.path.join(DATA, "test.oie.orig"))
    news = readers.read_gold(spark, os.path.join(DATA, "propbank.test.oie.orig"))
    wiki = readers.read_gold(spark, os.path.join(DATA, "wiki1.test.oie.orig"))
    both = corpus.union_corpora(news, wiki, ["ord", "index"])
    a = sorted((r.ord, r.sent, r.pred, tuple(r.args)) for r in both.collect())
    b = sorted((r.ord, r.sent, r.pred, tuple(r.args)) for r in test.collect())
    assert a == b
    binary = readers.read_gold(spark, os.path.join(DATA, "binary", "test.oie.orig"))
    j = test.alias("t").join(binary.alias("b"), "ord")
    assert j.filter(F.slice("t.args", 1, 2) != F.col("b.args")).count() == 0 and j.count() == 1730
    sents = readers.read_sentences(spark, os.path.join(DATA, "test.oie.sent"))
    d = corpus.distinct_sentences(test)
    assert d.count() == 603 and d.join(sents, "sent", "left_anti").count() == 0
    assert corpus.split_to_corpus(test, sents).count() == 1730


def test_tabbed_round_trip(spark, tmp_path):
    ex = readers.read_gold(spark, os.path.join(DATA, "propbank.test.oie.orig"))
    out = str(tmp_path / "tab")
    corpus.write_lines(corpus.tabbed_lines(ex.withColumn("confidence", F.lit(0.5))), out)
    back = readers.read_tabbed(spark, out)
    assert back.count() == 737
    a = sorted((r.sent, r.pred, tuple(r.args)) for r in ex.collect())
    b = sorted((r.sent, r.pred, tuple(r.args)) for r in back.collect())
    assert a == b
