import hashlib
import re

from triplematch.llm import exact_dedup


def brute(rows):
    groups = {}
    for d, t in rows:
        if d is not None:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0]))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out)


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, "  "), (7, "x" * 70 + "y"), (8, "x" * 70 + "z"),
        (9, "é é"), (10, "éé"), (None, "a b"), (11, "word " * 50000), (12, "word" * 50000), (13, "a b"), (14, "\x1ca"),
        (2, "ab"), (-5, "ab")]


def test_against_brute_force(spark, make_docs):
    got = exact_dedup.exact_dedup(make_docs(ROWS), digest_all=True)
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.columns == cols
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS)


def test_survivors_only_are_hashed(spark, make_docs):
    rows = [(1, "alpha"), (2, "alpha"), (3, "a text of another length")]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(make_docs(rows)).collect()}
    assert got[1].keep_id == got[2].keep_id == 1 and got[3].keep_id == 3
    assert got[1].text_sha256 and got[3].text_sha256 is None


def test_stage_keeps_one_of_each_group_and_all_columns(spark, make_docs):
    docs = make_docs(ROWS)
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    want = sorted({r[0] for r in brute(ROWS) if r[3]})
    assert sorted(r.doc_id for r in got.collect()) == want


def test_empty_table(spark, make_docs):
    assert exact_dedup.exact_dedup(make_docs([])).collect() == []
    assert exact_dedup.keep_one(make_docs([])).collect() == []


def test_no_python_in_the_plan(spark, make_docs):
    plan = exact_dedup.exact_dedup(make_docs(ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
