"""Golden values G5/G6 for word similarity, copy penalty and triple scores."""

import pytest
from pyspark.sql import functions as F

from triplematch.functions.similarity import edit_similarity, punish, soft_align, triple_score
from triplematch.operators.scoring import score_v1, score_v2, score_v3


def one(spark, col, data, schema):
    return spark.createDataFrame(data, schema).select(col.alias("x")).collect()


def test_edit_similarity(spark):
    rows = spark.createDataFrame(
        [("cat", "cat"), ("cat", "cats"), ("cat", "dog"), ("like", "likes"), ("book", "books")], "a string, b string"
    ).select(edit_similarity("a", "b").alias("s")).collect()
    got = [round(r.s, 6) for r in rows]
    assert got == [0.995055, 0.978026, 0.0, 0.983675, 0.983675]


def test_punish(spark):
    rows = spark.createDataFrame([(0.5,), (0.95,), (0.96,), (1.0,)], "s double").select(punish("s").alias("p")).collect()
    assert [round(r.p, 6) for r in rows] == [0.5, 0.95, 0.93, 0.85]


def test_triple_scores(spark):
    df = spark.createDataFrame(
        [([["like", "i", "the book"]], [["likes", "he", "books"], ["read", "she", "the book"]])],
        "q array<array<string>>, a array<array<string>>",
    )
    r = df.select(
        triple_score(F.col("q")[0], F.col("a")[0]).alias("t1a"),
        triple_score(F.col("q")[0], F.col("a")[1]).alias("t1b"),
        score_v1("q", "a").alias("v1"),
        score_v1("q", "a", apply_punish=False).alias("v1raw"),
        score_v2("q", "a").alias("v2"),
    ).first()
    assert r.t1a == pytest.approx(0.977126, abs=2e-6)
    assert r.t1b == pytest.approx(0.697424, abs=2e-6)
    assert r.v1raw == pytest.approx(0.977126, abs=2e-6)
    assert r.v1 == pytest.approx(0.895748, abs=2e-6)
    assert r.v2 == pytest.approx(0.838593, abs=2e-6)


def test_identical_pair_is_penalised(spark):
    df = spark.createDataFrame([([["like", "i"]], [["like", "i"]])], "q array<array<string>>, a array<array<string>>")
    assert df.select(score_v1("q", "a").alias("v")).first().v == pytest.approx(0.859890, abs=2e-6)


def test_empty_lists_give_null(spark):
    df = spark.createDataFrame([(["a"], []), ([], ["b"])], "a array<string>, b array<string>")
    assert [r.s for r in df.select(soft_align("a", "b").alias("s")).collect()] == [None, None]


def test_repeated_words_match_full_matrix(spark):
    """The distinct-word matrix with multiplicities equals the brute-force mean over all words."""
    import math

    def sim(x, y):
        import numpy as np
        m = max(len(x), len(y))
        # plain Levenshtein
        prev = list(range(len(y) + 1))
        for i, cx in enumerate(x, 1):
            cur = [i]
            for j, cy in enumerate(y, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (cx != cy)))
            prev = cur
        d = (m - prev[-1]) / m
        return (1 / (1 + math.exp(-6 * d)) - 0.5) * 2

    def brute(a, b):
        k = min(len(a), len(b))
        la = sorted((max(sim(x, y) for y in b) for x in a), reverse=True)[:k]
        lb = sorted((max([0.0] + [sim(x, y) for x in a]) for y in b), reverse=True)[:k]
        return (sum(la) / k + sum(lb) / k) / 2

    cases = [
        (["the", "cat", "the", "cat", "sat"], ["a", "cat", "sat", "sat", "sat", "the", "mat"]),
        (["x"] * 7 + ["yy"], ["yy", "zz", "x"]),
        (["solo"], ["solo", "solo", "other"]),
    ]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    got = [r.s for r in df.select(soft_align("a", "b").alias("s")).collect()]
    for (a, b), g in zip(cases, got):
        assert g == pytest.approx(brute(a, b), abs=1e-9)


def test_streamed_path_equals_matrix_path(spark, monkeypatch):
    """Forcing the no-matrix path gives the same T1 values."""
    from triplematch.functions import similarity

    cases = [(["the", "cat", "sat", "the"], ["a", "cat", "mat", "sat", "sat"]), (["x"], ["xy", "x", "z"])]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    full = [r.s for r in df.select(similarity.soft_align("a", "b").alias("s")).collect()]
    monkeypatch.setattr(similarity, "MATRIX_LIMIT", 0)
    streamed = [r.s for r in df.select(similarity.soft_align("a", "b").alias("s")).collect()]
    assert streamed == full


def test_empty_gate_and_invalid_bucket(spark):
    from triplematch.operators import scoring

    df = spark.createDataFrame([(0, [["like", "i"]], [["", ""]]), (1, [["like", "i"]], [["like", "i"]]),
                                (2, [["go"]], [["went"]])],
                               "pair_id int, q_triples array<array<string>>, a_triples array<array<string>>")
    s = scoring.score_pairs(df, gate="empty")
    got = {r.pair_id: r.score for r in s.collect()}
    assert got[0] == -1.0 and round(got[1], 6) == 0.85989
    hist = {r.bucket: (r.n, r.ratio) for r in scoring.score_histogram(s).collect()}
    assert hist[-1] == (1, round(1 / 3, 6)) and sum(n for n, _ in hist.values()) == 3
    assert set(hist) == set(range(-1, 11))
