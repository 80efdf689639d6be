"""Dependency rules against golden G7 and a few hand-checked arc sets."""

from pyspark.sql import functions as F

from triplematch.operators import dependency as dep


def _run(spark, rows):
    df = spark.createDataFrame(rows, "text_id long, sent_no long, words array<string>, heads array<int>, rels array<string>")
    return [(tuple(r.triple), r.e1_loc, r.e2_loc) for r in dep.extract(df).orderBy("text_id", "sent_no", "rel_pos", "item").collect()]


def test_g7_smoke_sentence(spark):
    got = _run(spark, [(1, 0, ["你", "喜欢", "那个", "衣服", "吗"], [2, 0, 4, 2, 2], ["SBV", "HED", "ATT", "VOB", "RAD"])])
    assert got == [(("喜 欢", "你", "那个 衣服"), 0, 2)]


def test_no_or_many_roots_skip_but_advance_offset(spark):
    rows = [
        (1, 0, ["a", "b"], [0, 0], ["HED", "HED"]),          # two roots: skipped, still 2 tokens
        (1, 1, ["x", "y", "z"], [2, 0, 2], ["SBV", "HED", "VOB"]),
        (1, 2, ["q"], [0], ["ROOT"]),                        # no HED: skipped
    ]
    assert _run(spark, rows) == [(("y", "x", "z"), 2, 4)]


def test_coordinated_objects_and_nearest_preceding_subject(spark):
    # w1 <-ADV- w2(HED); objects: w3 VOB of w2, w4 VOB of w3 (chain), w5 COO of w4 (the chain end)
    rows = [(7, 0, ["w1", "go", "to", "town", "city"], [2, 0, 2, 3, 4], ["ADV", "HED", "VOB", "VOB", "COO"])]
    got = _run(spark, rows)
    # subject falls back to the nearest preceding child (w1); first object spans to the VOB chain end
    assert got[0] == (("g o", "w1", "to town"), 0, 2)
    # the COO item of the chain end: prefix [leftmost(item), first VOB) is empty, then [item, chain end]
    assert got[1] == (("g o", "w1", "city"), 0, 0)


def test_long_sentence_and_cycle():
    import time

    from triplematch.functions.arcs import sentence_triples

    n = 20_000
    heads = [2, 0] + [i if i % 2 else 2 for i in range(2, n)]
    rels = ["SBV", "HED"] + ["ATT" if i % 2 else "COO" for i in range(2, n)]
    begin = time.time()
    got = sentence_triples(["w"] * n, heads, rels)
    assert time.time() - begin < 5 and len(got) == 1 + rels.count("COO")
    # 3 and 4 head each other: a walk takes as many steps as the sentence has tokens
    cyclic = sentence_triples(["a", "b", "c", "d"], [2, 0, 4, 3], ["SBV", "HED", "ATT", "ATT"])
    assert [(t["rel"], t["e1"], t["e2"], t["e1_loc"], t["e2_loc"]) for t in cyclic] == [("b", "a", "", 0, None)]
    assert sentence_triples(["a", "b"], [2, 1], ["ATT", "ATT"]) is None and sentence_triples(None, [0], ["HED"]) is None


def test_rules_run_in_batches(spark):
    df = spark.createDataFrame([(["a"], [0], ["HED"])], "w array<string>, h array<int>, r array<string>")
    plan = df.select(dep.arcs_triples("w", "h", "r"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "sequence" not in plan
