"""Sinks and the triple-file parser."""

import os

from pyspark.sql import functions as F

from places import DATA
from triplematch.operators import evaluate as ev
from triplematch.sources import readers, sinks


def test_cut_triples_variants(spark):
    line = "like|||i|||the book*#*a|||b|||c|||d|||e*#*x||||||z"
    df = spark.createDataFrame([(line,)], "v string")
    r = df.select(readers.cut_triples("v", "keep_empty").alias("k"), readers.cut_triples("v", "drop_empty").alias("d"),
                  readers.cut_triples("v", "collapse").alias("c")).first()
    assert r.k == [["like", "i", "the book"], ["a", "b", "c", "d", "e"], ["x", "", "z"]]
    assert r.d == [["like", "i", "the book"], ["a", "b", "c", "d", "e"], ["x", "z"]]
    assert r.c == [["like", "i", "the book"], ["a b c d e"], ["x", "z"]]
    back = df.select(sinks.triples_text(readers.cut_triples("v", "keep_empty")).alias("t")).first().t
    assert back == line


def test_curve_file_round_trip(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (1, 0.2)], "y int, score double")
    curve = ev.pr_curve(scored)
    out = str(tmp_path / "curve")
    sinks.write_curve(curve, out)
    back = readers.read_pr_files(spark, [os.path.join(out, f) for f in sorted(os.listdir(out)) if f.startswith("part-")])
    got = [(r.precision, r.recall) for r in back.orderBy("pt").collect()]
    want = sorted(((r.precision, r.recall, -(r.threshold if r.threshold is not None else 9)) for r in curve.collect()),
                  key=lambda t: (t[1], t[2]))
    assert got == [(p, r) for p, r, _ in want]
    assert got[0] == (1.0, 0.0) and got[-1][1] == 1.0


def test_training_conll_round_trip(spark, tmp_path):
    from triplematch.operators import construct as C

    ex = spark.createDataFrame([("NA ran fast", "ran", [1], 1, ["A0-B", "P-B", "O"], 0),
                                ("dogs bark", "bark", [1], 1, ["A0-B", "P-B"], 1)],
                               "sent string, pred string, pred_indices array<int>, head_pred_index int, "
                               "labels array<string>, ord long")
    rows = C.training_conll_rows(ex)
    out = str(tmp_path / "train")
    sinks.write_training_conll(rows, out)
    back = readers.read_training_conll(spark, out)
    a = sorted(tuple(r) for r in rows.select(*sinks.TRAINING_COLUMNS).collect())
    b = sorted(tuple(r) for r in back.select(*sinks.TRAINING_COLUMNS).collect())
    assert a == b and ("NA" in [r.word for r in back.collect()])
