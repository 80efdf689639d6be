"""BIO decoding against golden G1 (the shipped prediction CoNLL sample)."""

import os

import pytest
from pyspark.sql import functions as F

from places import DATA
from triplematch.operators import bio

CONLL = os.path.join(DATA, "rnnie_propbank_test.sample.conll")


@pytest.fixture(scope="module")
def decoded(spark):
    blocks = bio.read_conll_blocks(spark, CONLL)
    kept = bio.keep_last_per_predicate(blocks)
    return bio.decode_blocks(kept).orderBy("ord").collect(), blocks


def test_label_counts(spark, decoded):
    _, blocks = decoded
    counts = dict(blocks.select(F.explode("labels").alias("l")).groupBy("l").count().collect())
    assert counts == {"O": 313, "A0-B": 31, "A0-I": 42, "A1-B": 12, "A1-I": 21, "A2-B": 10, "A2-I": 39,
                      "A3-I": 4, "P-B": 19}


def test_g1_rows(decoded):
    rows, _ = decoded
    assert len(rows) == 14
    got = [(r.sent.split(" ")[:2], r.pred, round(r.confidence, 6)) for r in rows]
    want = [
        (["They", "claim"], "claim", 0.762467), (["They", "claim"], "have", 0.741212),
        (["They", "claim"], "busted", 0.774097), (["The", "effect"], "is", 0.896038),
        (["The", "effect"], "have", 0.818185), (["The", "effect"], "been", 0.795458),
        (["The", "effect"], "barred", 0.808894), (["The", "effect"], "were", 0.657744),
        (["The", "effect"], "filed", 0.808153), (["The", "effect"], "proceed", 0.893998),
        (["In", "1988"], "fled", 0.788656), (["In", "1988"], "were", 0.682653),
        (["In", "1988"], "charged", 0.660224), (["In", "1988"], "embezzled", 0.335784),
    ]
    for (s, p, c), (ws, wp, wc) in zip(got, want):
        assert s == ws and p == wp
        assert c == pytest.approx(wc, abs=2e-6)
    by_pred = {(r.sent[:6], r.pred): r.args for r in rows}
    assert by_pred[("They c", "claim")] == ["poltergeists", "other spooks in hundreds of houses"]
    assert by_pred[("They c", "busted")] == ["spooks", "hundreds of houses", "the country"]
    # the trailing span that reaches the last token is dropped (legacy behaviour)
    assert by_pred[("The ef", "barred")][-1] == "because of the one - year"
    fled = by_pred[("In 198", "fled")]
    assert len(fled) == 11 and fled[0] == "In 1988"
    assert fled[-1] == "embezzled more than $ 100 million from their homeland"
    assert by_pred[("In 198", "embezzled")] == ["racketeering", "mail fraud", "in", "more than $ 100 million",
                                                "their homeland"]


def test_non_legacy_splits_and_flushes(spark):
    df = spark.createDataFrame(
        [(["a", "b", "c", "d"], ["A0-B", "A1-B", "O", "A2-B"], [0.5, 0.5, 1.0, 0.5])],
        "words array<string>, labels array<string>, probs array<double>")
    legacy = df.select(bio.decode_bio("words", "labels", "probs", legacy=True).alias("d")).first().d
    fixed = df.select(bio.decode_bio("words", "labels", "probs", legacy=False).alias("d")).first().d
    assert legacy.args == ["a b"] and legacy.confidence == pytest.approx(0.5)
    assert fixed.args == ["a", "b", "d"]


def test_conll_round_trip(spark, tmp_path):
    blocks = bio.read_conll_blocks(spark, CONLL)
    out = str(tmp_path / "conll")
    bio.write_conll(blocks, out, ["block_id"])
    again = bio.read_conll_blocks(spark, out)
    a = sorted((r.sent, r.pred_idx, tuple(r.labels), tuple(r.probs)) for r in blocks.collect())
    b = sorted((r.sent, r.pred_idx, tuple(r.labels), tuple(r.probs)) for r in again.collect())
    assert a == b


def test_token_f1_and_one_hot(spark):
    pairs = spark.createDataFrame([("A0-B", "A0-B"), ("O-x", "O"), ("A1-I", "O"), ("O", "A1-I")], "y string, yhat string")
    r = bio.token_f1(pairs).first()
    assert r.micro_f1 == pytest.approx(0.5)
    # labels A0-B (f=1), O (p=1/2, r=1/2 -> 1/2), A1-I (0) -> macro 0.5
    assert r.macro_f1 == pytest.approx(0.5)
    oh = spark.createDataFrame([("b",)], "l string").select(bio.one_hot("l", ["a", "b", "c"]).alias("v")).first().v
    assert oh == [0.0, 1.0, 0.0]
    am = spark.createDataFrame([([0.1, 0.7, 0.7],)], "p array<double>").select(
        bio.argmax_label("p", ["a", "b", "c"]).alias("t")).first().t
    assert (am.label, am.prob) == ("b", 0.7)
