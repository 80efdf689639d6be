import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triplematch.llm import packing, topk

SIZE = 1024


def brute_topk(rows, k, is_query):
    ok = {}
    for i, e in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e):
            v = [int(np.floor(1024.0 * x)) for x in e]
            ok[i] = max(ok.get(i, v), v)
    out = []
    for q in ok:
        if is_query(q):
            s = sorted(((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


def run_topk(spark, rows, k=10, every=5):
    df = spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id long, embedding array<float>, norm int, score double")
    got = topk.exact_topk(df, F.col("vec_id") % every == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    rows = [(i, (rng.normal(size=8) * rng.lognormal(0, 1)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, (centre + 0.01 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(150)]   # one hot bucket
    rows += [(500 + i, rows[7][1]) for i in range(40)]                                                           # ties
    rows += [(600, None), (605, [0.1, None] + [0.0] * 6), (610, [float("nan")] * 8), (615, [float("inf")] + [0.0] * 7),
             (None, [0.5] * 8), (620, [0.0] * 8), (625, []), (7, rows[7][1]), (630, [1.0, 2.0]), (635, [2.0, 1.0])]
    assert run_topk(spark, rows) == brute_topk(rows, 10, lambda i: i % 5 == 0)


def test_topk_small_and_empty(spark):
    assert run_topk(spark, []) == []
    assert run_topk(spark, [(5, [1.0, 2.0])]) == []
    rows = [(0, [1.0, -2.0]), (1, [-1.0, -2.0]), (2, [0.0, 0.0])]
    assert run_topk(spark, rows) == brute_topk(rows, 10, lambda i: i % 5 == 0)
    assert run_topk(spark, [(1, [1.0, 2.0])]) == []


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    for _ in range(40):
        v = rng.integers(-300, 300, (200, 6))
        q = rng.integers(-300, 300, (3, 6))
        s = q @ v.T
        theta = np.sort(s, 1)[:, -4].astype(float)
        got = {(a, b): c for a, b, c in topk.search_block(q, np.array([1000, 1001, 1002]), theta, v, np.arange(200), 4)}
        for i in range(3):
            for j in np.lexsort((np.arange(200), -s[i]))[:4]:
                assert got[1000 + i, j] == s[i, j]


TEXTS = ["", "One. Two three. " * 400, "no stop at all " * 900, "a  b   c\n\n  d ", "tail   ", " lead", "x<|endoftext|>y", "it's 12 ok?\nYes!",
         "é 　z \x85 q", "\x00nul byte", "word", "A sentence here. " * 3]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_library(library):
    enc = packing.Encoder()
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [x.tolist() for x in enc.batch(TEXTS)] == want
    assert [x.tolist() for x in enc.batch(TEXTS[::-1], group=1)] == want[::-1]


def test_ids_equal_the_library_on_odd_text(library, monkeypatch):
    rng = np.random.default_rng(5)
    parts = [" ", "  ", " a", "The", "n't", "12", "\n", " \n", "\t", "\x85", "\xa0", "\u3000", "\x1f", "\x00", "é", "日本", "😀", "...", "'s", " <|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30), p=[.2] + [.8 / 19] * 19)) for _ in range(600)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    enc = packing.Encoder()
    assert [x.tolist() for x in enc.batch(texts)] == want
    monkeypatch.setattr(packing, "GROUP", 40)          # small groups, and texts longer than a group
    assert [x.tolist() for x in enc.batch(texts)] == want
    assert list(enc.batch([])) == []


def test_each_distinct_word_of_a_batch_is_encoded_once():
    """However many rare words there are: the work follows the distinct words, and nothing stays in memory."""
    words = [f"w{i:06d}" for i in range(700_000)]
    texts = [" ".join(words[a:a + 1000]) for a in range(0, len(words), 1000)]
    enc = packing.Encoder()
    fast, seen = enc.fast, []

    class Counting:
        def encode_ordinary(self, text):
            seen.append(len(text))
            return fast.encode_ordinary(text)
    enc.fast = Counting()
    held = set(vars(enc))
    got = list(enc.batch(texts + texts))
    assert sum(seen) < 1.05 * sum(map(len, texts))
    assert all((a == b).all() for a, b in zip(got[:700], got[700:]))
    assert set(vars(enc)) == held and not any(isinstance(v, dict) for v in vars(enc).values())


def check_pieces(rows, texts, library):
    """Round trip: every id of every document in exactly one piece, sequences gapless and of at most 1024."""
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(ids)
    for d, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    pad = total = 0
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        n = 0
        for p in pieces:
            assert p.offset == n
            n += p.length
        assert n <= SIZE
        total += n
        pad += 0 if n & (n - 1) == 0 else SIZE - n
    return pad, total


def test_packing_round_trip(spark, make_docs, library):
    texts = {i: t for i, t in enumerate(TEXTS * 6)} | {500: None, 501: "long word. " * 60000}
    got = packing.pack(make_docs([*texts.items(), (None, "no id")]).repartition(3), block=4).collect()
    pad, total = check_pieces(got, texts, library)
    assert pad < 0.02 * total + 3 * SIZE


def test_packing_repeated_rows_and_empty(spark, make_docs):
    got = packing.pack(make_docs([(1, "same row"), (1, "same row"), (2, "x")]).coalesce(1)).collect()
    assert [r.doc_id for r in got] == [1, 1, 2] and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert packing.pack(make_docs([])).collect() == []


def test_packing_real_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pad, total = check_pieces(packing.pack(docs).collect(), texts, library)
    assert pad < 0.03 * total


def test_ids_column(spark, make_docs):
    r = packing.pack(make_docs([(1, "word")]), with_ids=True).collect()[0]
    assert zlib.crc32(bytes(r.ids)) == r.ids_crc32


def test_cuts_against_plain_dynamic_programme():
    """Without hard cuts the planner is an exact minimum over the allowed bounds."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = 16
        bounds = np.unique(np.cumsum(rng.integers(1, 9, 25))).tolist()
        costs = rng.integers(0, 3, len(bounds)).tolist()
        pos = [0, *bounds]
        best = [0] + [10 ** 9] * len(bounds)
        for j in range(1, len(pos)):
            for i in range(j):
                n = pos[j] - pos[i]
                if n <= size:
                    exact = n & (n - 1) == 0 and (n == size or j == len(bounds) or costs[j - 1] == 0)
                    best[j] = min(best[j], best[i] + (0 if exact else size - n) + costs[j - 1])
        cuts = packing.plan_cuts(bounds, costs, size, 10 ** 6)
        assert set(cuts) <= set(bounds) and cuts[-1] == bounds[-1]
        paid, last = 0, 0
        for c in cuts:
            n = c - last
            assert 0 < n <= size
            k = costs[bounds.index(c)]
            exact = n & (n - 1) == 0 and (n == size or c == bounds[-1] or k == 0)
            paid += (0 if exact else size - n) + k
            last = c
        assert paid == best[-1]
