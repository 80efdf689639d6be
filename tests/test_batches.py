"""Blocks decoded, labelled and compared over Arrow batches: the same values as row by row, without interpreted lambdas."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from triplematch.operators import bio, tagger
from triplematch.operators import evaluate as ev
from triplematch.plans import bio as bio_plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _table(spark, tmp_path):
    rows = [(1, "a b a c d e f a b. c c c c c c c"), (2, None), (None, "x y z"), (3, ""), (4, " ".join(f"w{i % 7}" for i in range(60)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_blocks_decode_alike_in_batches_and_rows(spark):
    rows = [(["a", None, "c", "d"], ["A0-B", "A0-I", "O", "A1-B"], [0.1, 0.2, 0.3, 0.7], 0), ([], [], [], 0), (None, None, None, 0),
            (["a", "b", "c"], ["A0-B", "A0-B", "A1-I"], [0.5, None, 0.5], 1), (["a", "b"], ["O", "P-B"], [0.5, 0.5], 1)]
    df = spark.createDataFrame(rows, "words array<string>, labels array<string>, probs array<double>, pred_idx int")
    for legacy in (True, False):
        want = df.select(bio.decode_bio("words", "labels", "probs", legacy).alias("d")).filter(F.size("d.args") > 0)
        got = bio.decode_blocks(df, legacy)
        cols = ["args", "confidence", "arg_indices"]
        assert sorted(got.select(*cols).collect(), key=str) == sorted(want.select(*[F.col(f"d.{c}") for c in cols]).collect(), key=str)


def test_document_queries_run_no_lambda_per_token(spark, tmp_path):
    d = _table(spark, tmp_path)
    for query in (bio_plan.bio_extractions, bio_plan.token_f1, bio_plan.token_metrics):
        assert "lambdafunction" not in _plan(query(spark, d))
    got = bio_plan.document_blocks(spark, d).select("tid", "sent_no", "ord", "pred_idx").collect()
    assert (1, 1, 3, 3) not in [tuple(r) for r in got] and all(r.tid in (1, 4) for r in got)


def test_chunks_change_nothing(spark, tmp_path, monkeypatch):
    names = ["tid", "sent_no", "pred_idx", "labels"]
    words = [f"w{i % 9}" for i in range(90)]
    batch = pa.RecordBatch.from_pydict({"tid": [5, 6], "sent_no": pa.array([0, 1], pa.int32()), "sent": [" ".join(words)] * 2, "words": [words] * 2})
    whole = [r for b in bio_plan._tag_records([batch], names, {"": 0}, True) for r in b.to_pylist()]
    monkeypatch.setattr(bio_plan, "CHUNK", 100)
    parts = list(bio_plan._tag_records([batch], names, {"": 0}, True))
    assert len(parts) > 1 and [r for b in parts for r in b.to_pylist()] == whole and max(b.num_rows for b in parts) <= 2


def test_last_blocks_keep_first_and_last_place():
    first, last = bio.last_blocks(pa.array(["a", "b", "a", "a"]), np.array([0, 0, 0, 1]))
    assert sorted(zip(first.tolist(), last.tolist())) == [(0, 2), (1, 1), (3, 3)]


def test_matchers_agree_in_batches_and_rows(spark):
    rows = [("a", ["b c d", "e f"], ["b c d e", "a"]), ("a", ["x"], ["y"]), ("a", ["a a a", "b b"], ["a a b", "b b a a"]), ("a", [], ["b"]),
            ("ab", ["c d e f g"], ["c d e f g"])]
    df = spark.createDataFrame(rows, "pred string, args array<string>, other array<string>")
    ref, ex = F.struct("pred", "args"), F.struct("pred", F.col("other").alias("args"))
    r, h = (F.split(ev.bow(x["pred"], x["args"]), " ") for x in (ref, ex))
    got = df.select(ev.batch_coverage(r, h).alias("cov"), ev.batch_bleu(r, h).alias("bleu"), ev.arg_match(ref, ex, coverage=ev.batch_coverage).alias("arg"))
    want = df.select(ev._coverage(r, h).alias("cov"), ev.bleu(r, h).alias("bleu"), ev.arg_match(ref, ex).alias("arg"))
    for a, b in zip(got.collect(), want.collect()):
        assert (round(a.cov, 12), round(a.bleu, 12), a.arg) == (round(b.cov, 12), round(b.bleu, 12), b.arg)


def test_greedy_walk_takes_the_first_unused_match():
    kind = pa.list_(pa.int32())
    got = ev._assign(pa.array([[1, 2, 1, 1], [1]], kind), pa.array([[2, 1, 2], None], kind),
                     pa.array([[[True, True], [False, True]], None], pa.list_(pa.list_(pa.bool_())))).to_pylist()
    assert got == [{"taken": [0, 2, 1], "unused": [], "missed": [3]}, None]


def test_windows_keep_every_token(spark):
    def predict(batch):
        return pd.DataFrame({"labels": [[str(v) for v in x] for x in batch["f"]], "probs": [[v / 2 for v in x] for x in batch["f"]]})

    df = spark.createDataFrame([(1, list(range(1, 8))), (2, []), (3, [9])], "k long, f array<int>")
    out = tagger.tag_sentences(df, predict, 3, ["f"], ["k"])
    assert "MapInArrow" in _plan(out) and "lambdafunction" not in _plan(out)
    assert [(r.k, r.labels, r.probs) for r in out.orderBy("k").collect()] == [
        (1, [str(i) for i in range(1, 8)], [i / 2 for i in range(1, 8)]), (2, [], []), (3, ["9"], [4.5])]


def test_words_are_encoded_per_group(spark):
    """a sentence is encoded in the stream of its group, repeated keys each by itself; tokens are not regrouped by key."""
    rows = [(k, s, " ".join(f"W{(k * 7 + s * 3 + i * i) % 23}" for i in range(1 + (k + s) % 9))) for k in range(40) for s in range(6)]
    rows += [(3, 1, "w1 Unknown W2"), (None, 1, "w1"), (2, None, "w1"), (5, 50, None)]
    df = spark.createDataFrame(rows, "k long, s int, sent string")
    vocab = spark.createDataFrame([(f"w{i}", i + 1) for i in range(22)], "word string, word_index long")
    want = sorted((k, s, t, [int(w[1:]) + 1 if w[1:].isdigit() and int(w[1:]) < 22 else 0 for w in t.split(" ")])
                  for k, s, t in rows if k is not None and s is not None and t is not None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("3", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        by_expression = tagger.encode(df, vocab, ["k", "s"], F.split("sent", " "))
        by_column = tagger.encode(df.withColumn("words", F.split("sent", " ")), vocab, ["k", "s"]).drop("words")
        for got in (by_expression, by_column):
            assert sorted((r.k, r.s, r.sent, r.word_inputs) for r in got.collect()) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" not in _plan(by_expression)
    none = tagger.encode(df, vocab.filter("false"), ["k", "s"], F.split("sent", " ")).collect()
    assert len(none) == len(want) and not any(any(r.word_inputs) for r in none)


def test_blocks_match_in_a_stream_as_collected(spark, monkeypatch):
    """the match of sorted blocks equals that of collected lists, and no list of a key's extractions is built."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(900):
        sent = rng.choice(["a b c", "ab c", "a.b c", "x y", "", "the end", "th eend"])
        args = [[rng.choice("abcdxy") for _ in range(rng.randrange(1, 4))] if rng.random() < .8 else [] for _ in range(2)]
        rows.append((i // 7, i % 7, rng.randrange(3), sent, rng.choice("abx"), *args, round(rng.random(), 3)))
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, sent_no int, pos int, sent string, pred string, args0 array<string>, args1 array<string>, confidence1 double")
    order = F.struct("doc_id", "sent_no", "pos")
    gold = df.filter("size(args0) > 0").select("sent", "pred", F.col("args0").alias("args"), order.alias("ord"), order.alias("index"))
    found = df.filter("size(args1) > 0").select("sent", "pred", F.col("args1").alias("args"), F.col("confidence1").alias("confidence"), order.alias("ord"))
    want = ev.greedy_match(gold, found).collect()
    got = ev.match_blocks(df.withColumn("key", ev.sentence_key("sent")))
    assert "collect_list" not in _plan(got)

    def parts(table):
        return (sum(r.gold_n for r in table), sum(r.gold_n for r in table if not r.has_pred), sorted((x.y, x.score) for r in table for x in r.y),
                sorted(tuple(x) for r in table for x in r.errors))
    assert parts(got.collect()) == parts(want) and len(parts(want)[2]) > 200
    whole = parts(got.collect())
    monkeypatch.setattr(ev, "CHUNK", 5)
    cols = ["key", "doc_id", "sent_no", "pos", "sent", "gold", "found", "confidence1"]
    plain = sorted((r.key, r.doc_id, r.sent_no, r.pos, r.sent, *(" ".join([r.pred, *a]) if a else None for a in (r.args0, r.args1)), r.confidence1)
                   for r in df.withColumn("key", ev.sentence_key("sent")).collect())
    batch = pa.RecordBatch.from_pydict({c: [r[i] for r in plain] for i, c in enumerate(cols)})
    cut = [b for b in ev._match_stream([batch.slice(0, 100), batch.slice(100)])]
    table = [r for b in cut for r in b.to_pylist()]
    assert len(cut) > 1 and max(len(r["y"]) for r in table) == 5
    assert (sum(r["gold_n"] for r in table), sum(r["gold_n"] for r in table if not r["has_pred"]), sorted((x["y"], x["score"]) for r in table for x in r["y"]),
            sorted(tuple(x.values()) for r in table for x in r["errors"])) == whole
