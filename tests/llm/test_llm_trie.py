"""Prefix trie against a plain re-statement over Python tuples."""

import hashlib
import random
import re
import zlib

import pytest

from triplematch.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, e long, rep string, words int"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for c in by:
        by[c] = [(r, t) for _, r, t in sorted(by[c])]
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -((-c) % 20))
        built[c] = by.get(base, [])[:h] + own[h:]
    if not built:
        return []
    members, kids = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids.get(k, []))
        ended = sorted(c for c in members[k] if len(built[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids.get(k, [])), leaves[k],
                    saved[k], hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(seed, convs, length, texts):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "user", "assistant", None]), rng.choice(texts))
            for c in convs for t in range(rng.randrange(length))]


CASES = {
    "few texts": some_rows(1, range(150), 9, ["a", "a", "a", "b c", "", None, "é日 x"]),
    "long paths": [(c, t, "u", "same" if t != c % 37 else "other") for c in range(60) for t in range(40)],
    "gaps and nulls": [(c, t, "u", f"w {(t or 0) % 3}") for c in range(-45, 45, 3) for t in (None, 5, 9, 1000, 10**12)],
    "prefixes of one": [(c, t, "u", f"w{t} and {t}") for c in range(20, 60) for t in range(c - 18)],
    "one turn each": [(c, 0, "u", "x") for c in range(50)] + [(None, 0, "u", "x")],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    rows = CASES[case]
    got = prefix_trie.trie(frame(spark, rows))
    assert got.columns == COLS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = CASES["long paths"] + [(200 + c, t, "u", "q") for c in range(30) for t in range(12)]
    got = prefix_trie.trie(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_fattest(spark):
    from pyspark.sql import functions as F
    pairs = [(a, b) for a in range(0, 40) for b in range(0, 70)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in got.collect():
        assert f == (max(range(a + 1, b + 1), key=lambda x: x & -x) if a < b else None)


def test_empty_table(spark):
    got = prefix_trie.trie(frame(spark, []))
    assert got.columns == COLS and got.collect() == []
