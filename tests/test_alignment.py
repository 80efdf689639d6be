"""Soft alignment over Arrow batches: the same values as the Column form, in parts, with vectors, without edit distances in lambdas."""

import random

import pytest
from pyspark.sql import functions as F

from triplematch.functions import edit
from triplematch.functions.similarity import best_alignments, soft_align, word_similarity
from triplematch.operators import vectors


def _lists(rng, n, words):
    return [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 30]))] for _ in range(n)]


def _want(spark, rows, sim=None):
    flat = [(i, k, x, y) for i, (a, b) in enumerate(rows) for k, x in enumerate(a) for y in b]
    df = spark.createDataFrame(flat, "i int, k int, x array<string>, y array<string>")
    tokens = (lambda c: c) if sim is None else sim
    got = df.select("i", "k", soft_align(tokens("x"), tokens("y"), word_similarity if sim else None).alias("s")).collect()
    out = {}
    for r in got:
        out.setdefault((r.i, r.k), []).append(r.s)
    return [[None if None in out[i, k] else max(out[i, k]) for k in range(len(a))] for i, (a, _) in enumerate(rows)]


@pytest.mark.parametrize("cells,table", [(1 << 21, 4096), (64, 4096), (1 << 21, 20), (64, 10)])
def test_batches_align_as_rows(spark, monkeypatch, cells, table):
    rng = random.Random(7)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    rows = [(_lists(rng, rng.randrange(1, 5), words), _lists(rng, rng.randrange(1, 5), words)) for _ in range(25)] + [([["a"], []], [["b"]])]
    monkeypatch.setattr(edit, "CELLS", cells)
    monkeypatch.setattr(edit, "TABLE", table)
    distances = edit.Distances()
    got = [edit.best_of(a, b, {}, distances) for a, b in rows]
    for g, w in zip(got, _want(spark, rows)):
        assert g == pytest.approx(w, abs=1e-12)
    assert edit.best_of([["a"]], [["b"], []], {}, distances) == [None] and edit.best_of(None, [["a"]], {}, distances) is None
    assert edit.best_of([["a"]], [], {}, distances) == [None]


def test_vectors_travel_with_the_row(spark):
    rng = random.Random(8)
    words = [f"w{i}{'x' * (i % 4)}" for i in range(12)]
    vecs = {w: [1.0, 0.0] if i % 2 else [0.6, -0.8] for i, w in enumerate(words[:8])}
    rows = [([[rng.choice(words) for _ in range(5)]], [[rng.choice(words) for _ in range(4)]]) for _ in range(20)]
    df = spark.createDataFrame([(i, a[0], b[0]) for i, (a, b) in enumerate(rows)], "k int, qw array<string>, aw array<string>")
    table = spark.createDataFrame(list(vecs.items()), "word string, v array<double>")
    scored = vectors.score_with_vectors(df, ["k"], F.col("qw"), F.col("aw"), table, lambda best: F.get(best(F.array("qw"), F.array("aw")), 0), "s")
    known = F.create_map(*[x for w, v in vecs.items() for x in (F.lit(w), F.array(*map(F.lit, v)))])
    want = _want(spark, rows, lambda c: F.transform(c, lambda w: F.struct(w.alias("w"), F.try_element_at(known, w).alias("v"))))
    got = {r.k: r.s for r in scored.collect()}
    assert [[got[i]] for i in range(len(rows))] == [pytest.approx(w, abs=1e-12) for w in want]


def test_dialogue_queries_measure_no_distance_in_lambdas(spark):
    from triplematch.plans.registry import load_all

    for name in ("dialogue_score", "score_summary", "dialogue_vectors_v3"):
        plan = load_all()[name].fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "levenshtein" not in plan and "_sims" not in plan
