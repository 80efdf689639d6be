"""Importance resampling against a plain re-statement; the quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from triplematch.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, n=1):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=10, min_words=20, n=1, buckets=10000, seed=2024):
    rows = [r for r in rows if r[0] is not None]
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in words(t, n)[1])
    s, t = counts(x for _, x in rows), counts(target)
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, (d, x) in enumerate(rows):
        w, f = words(x, n)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
                for b in (zlib.crc32(v.encode()) % buckets for v in f)]
        weight = math.floor(sum(gain) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def some_rows(n, seed=3):
    rng = random.Random(seed)
    bag = ["Alpha", "beta", "ÉTÉ", "日本", "gamma7", "x-y", "the", "of", "\tand\n", "q!"]
    return [(i, " ".join(rng.choice(bag) for _ in range(rng.randrange(60)))) for i in range(n)]


TARGET = ["alpha alpha beta", None, "", "ÉTÉ of the gamma7 unseen"]


@pytest.mark.parametrize("percent,min_words,n", [(10, 20, 1), (100, 0, 1), (0, 20, 1), (33, 5, 2)])
def test_against_brute_force(spark, make_docs, percent, min_words, n):
    rows = some_rows(300) + [(1000, None), (1001, ""), (None, "alpha " * 30), (1002, "alpha,beta " * 40000), (1003, "a" * 3000000),
                             (-7, "\x00 !"), (1004, "beta"), (1004, "alpha " * 25)]
    target = spark.createDataFrame([(t, "x") for t in TARGET], "text string, bucket string")
    got = resampling.resample(make_docs(rows), target, percent, min_words, n)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, TARGET, percent, min_words, n)


def test_repeated_rows_and_ties_draw_the_exact_number(spark, make_docs):
    rows = [(5, "word " * 30)] * 100 + [(6, "word " * 30)] * 20
    got = resampling.resample(make_docs(rows), spark.createDataFrame([("word",)], "text string"), 25).collect()
    ranks = sorted(r.rank for r in got if r.rank)
    assert len(got) == 120 and ranks == list(range(1, 31))
    assert [(r.doc_id, r.rank) for r in got] and sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(
        str(b[:4]) for b in brute(rows, ["word"], 25))


def test_quickselect_over_many_rounds(spark):
    keys = spark.range(5000).select((-(F_mod(997))).alias("order_1"), F_mod(7).alias("doc_id"), "id")
    keys = keys.withColumnRenamed("id", "row")
    want = sorted(tuple(r) for r in keys.collect())
    for k in (1, 2, 2500, 4999, 5000):
        assert resampling.select_kth(keys, k, pivots=3) == want[k - 1]
    assert resampling.select_kth(keys, 0) is None


def F_mod(m):
    from pyspark.sql import functions as F
    return F.col("id") % m


def test_pieces_of_a_text_change_nothing(monkeypatch):
    raw = ("One two-three ÉTÉ 日本 " * 50).encode()
    for n in (1, 3):
        whole = sorted(b for _, x in resampling.feature_buckets(raw, n) for b in x)
        with monkeypatch.context() as m:
            m.setattr(resampling, "PIECE", 11)
            assert sorted(b for _, x in resampling.feature_buckets(raw, n) for b in x) == whole


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(make_docs([]), none).collect() == []
    got = resampling.resample(make_docs([(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in got) == [(1, 2, None), (2, 0, None)]
