"""Caller-supplied builders (H2, H3), top-n classes (T2), question sets (A14, A15) and the pointers of the dependency rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from triplematch.operators import bio, construct as C, dependency


def test_confidence_builders(spark):
    df = spark.createDataFrame([(0, ["v", "a", "b", "c"], ["P-B", "A0-B", "A0-I", "O"], [0.9, 0.5, 0.25, 0.1]),
                                (0, ["v", "x"], ["P-B", "O"], [0.9, 0.5])],
                               "pred_idx int, words array<string>, labels array<string>, probs array<double>")
    out = bio.decode_blocks(df, calc_prob={"lowest": F.array_min, "product": bio.product_prob, "mean": bio.mean_prob}).collect()
    assert [(r.args, r.lowest, r.product, r.mean) for r in out] == [(["a b"], 0.25, 0.125, 0.375)]
    assert [r.confidence for r in bio.decode_blocks(df).collect()] == [0.375]


def test_metric_builders(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(500)]
    got = bio.token_metrics(spark.createDataFrame(rows, "y string, yhat string"),
                            [*bio.METRICS.items(), ("labels", lambda: F.count(F.lit(1)))]).first()
    per = {}
    for k in "abcd":
        tp, t, p = sum(r == (k, k) for r in rows), sum(y == k for y, _ in rows), sum(h == k for _, h in rows)
        pr, rc = (tp / p if p else 0.0), (tp / t if t else 0.0)
        per[k] = (pr, rc, 2 * pr * rc / (pr + rc) if pr + rc else 0.0, t)
    assert got.micro_f1 == pytest.approx(sum(a == b for a, b in rows) / 500, abs=1e-6) and got.labels == 4
    for name, i in (("macro_precision", 0), ("macro_recall", 1), ("macro_f1", 2)):
        assert got[name] == pytest.approx(sum(v[i] for v in per.values()) / 4, abs=1e-6)
    assert got.weighted_f1 == pytest.approx(sum(v[2] * v[3] for v in per.values()) / 500, abs=1e-6)
    f1 = bio.token_f1(spark.createDataFrame(rows, "y string, yhat string")).first()
    assert f1.macro_f1 == got.macro_f1 and f1.micro_f1 == got.micro_f1


def test_top_classes(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5, 0.1],), ([],)], "p array<double>")
    got = [[(t.label, t.prob) for t in r.t] for r in df.select(bio.top_classes("p", 3, ["a", "b", "c", "d"]).alias("t")).collect()]
    assert got == [[("b", 0.5), ("c", 0.5), ("a", 0.2)], []]
    assert [t.label for t in df.select(bio.top_classes("p", 9).alias("t")).first().t] == [1, 2, 0, 3]


def test_question_sets_keep_members_as_rows(spark):
    n = 3000
    ex = spark.range(n).select(F.col("id").alias("ex_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(
        F.array((F.col("id") % 5).cast("string"))).alias("questions"))
    sets, members = C.question_sets(ex)
    want = {}
    for i in range(n):
        s = ("a", "b") if i % 3 else (str(i % 5),)
        want.setdefault(s, []).append(i)
    assert [(r.set_id, tuple(r.question_set), r["count"]) for r in sets.orderBy("set_id").collect()] == [
        (k, s, len(m)) for k, (s, m) in enumerate(want.items())]
    got = {}
    for r in members.collect():
        got.setdefault(r.set_id, []).append(r.ex_id)
    assert [sorted(got[k]) for k in sorted(got)] == list(want.values())
    assert all(not f.dataType.simpleString().startswith("array") for f in members.schema)


def test_encodings_by_first_sight(spark):
    qs = ["who _ _ act _ _ _ ?", "what did _ act _ _ _ ?", "who _ x act _ _ _ ?", "who might _ acts _ _ _ ?"]
    df = spark.createDataFrame(list(enumerate(qs)), "ord long, question string")
    got = C.question_encodings(df, mask=[True, False, True, False, True, True, True]).orderBy("id").collect()
    assert [(r.encoding, r.id, r["count"]) for r in got] == [("who _ _ _ _ _ _", 0, 2), ("what _ _ _ _ _ _", 1, 1), ("who _ x _ _ _ _", 2, 1)]


def test_pointers_against_a_scan_and_their_cost(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(0, n + 1) for _ in range(n)], [rng.choice(["ATT", "SBV", "VOB", "COO"]) for _ in range(n)])
            for n in [1, 2, 3, 8, 20] * 12] + [([], [])]
    df = spark.createDataFrame(rows, "h array<int>, r array<string>")
    got = df.select("h", "r", dependency._pointer(F.col("h"), F.col("r"), ["ATT", "SBV"], False).alias("a"),
                    dependency._pointer(F.col("h"), F.col("r"), ["VOB"], True).alias("v")).collect()
    for row in got:
        for kinds, pick, out in ((("ATT", "SBV"), min, row.a), (("VOB",), max, row.v)):
            want = [pick([k + 1 for k, (h, r) in enumerate(zip(row.h, row.r)) if h == t and r in kinds], default=0)
                    for t in range(1, len(row.h) + 1)]
            assert out == want

    def seconds(n):
        one = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * 7919) % n + 1).alias("h"),
                                    F.array_repeat(F.lit("ATT"), n).alias("r"))
        best = 9e9
        for _ in range(3):
            began = time.time()
            one.select(F.array_max(dependency._pointer(F.col("h"), F.col("r"), ["ATT"], False))).collect()
            best = min(best, time.time() - began)
        return best
    short, long = seconds(4000), seconds(64_000)
    assert long < 40 * max(short, 0.2)          # a scan per token would cost 256 times as much
