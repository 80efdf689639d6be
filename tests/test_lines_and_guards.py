"""Line numbers over large and multi-part inputs, and inputs at the edge of each operator's domain."""

import pytest
from pyspark.sql import functions as F

from triplematch.operators import bio, construct as C, evaluate as ev, scoring
from triplematch.operators.windows import next_order, number_by, number_sorted, previous_row, read_numbered, sorted_runs
from triplematch.sources import readers

N = 300_000


@pytest.fixture(params=["true", "false"], ids=["aqe", "no_aqe"])
def aqe(spark, request):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", old)


def write_parts(tmp_path, lines, sizes):
    """Part files of unequal size, so that the order by size differs from the order by name."""
    folder = tmp_path / "parts"
    folder.mkdir()
    at = 0
    for i, n in enumerate(sizes):
        (folder / f"part-{i:05d}.txt").write_text("".join(x + "\n" for x in lines[at:at + n]))
        at += n
    assert at == len(lines)
    return str(folder)


def test_read_tabbed_keeps_every_line(spark, tmp_path, aqe):
    p = tmp_path / "big.tsv"
    p.write_text("".join("\n" if i % 7 == 0 else f"sentence {i}\t0.5\tpred {i}\targ {i}\n" for i in range(N)))
    got = readers.read_tabbed(spark, str(p)).select("sent", "pred", "ord", "index").collect()
    want = [i for i in range(N) if i % 7]
    assert len(got) == len(want)
    assert sorted((r["index"], r.ord, r.sent, r.pred) for r in got) == [
        (k, i, f"sentence {i}", f"pred {i}") for k, i in enumerate(want)]


def test_part_files_number_in_name_order(spark, tmp_path, aqe):
    sizes = [500, 20_000, 3, 9_000, 12_000, 497]
    lines = [f"line {i}\t" + "x" * (i % 50) for i in range(sum(sizes))]
    folder = write_parts(tmp_path, lines, sizes)
    got = sorted((r.line_no, r.value) for r in read_numbered(spark, folder).collect())
    assert got == list(enumerate(lines))
    gold = readers.read_gold(spark, folder).select("ord", "sent").collect()
    assert sorted((r.ord, r.sent) for r in gold) == [(i, f"line {i}") for i in range(len(lines))]


def test_splits_of_one_file(spark, tmp_path):
    p = tmp_path / "one.txt"
    p.write_text("".join(f"{i}\n" for i in range(50_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert all(r.line_no == int(r.value) for r in read_numbered(spark, str(p)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_zip_of_two_multi_part_files(spark, tmp_path):
    n = 30_000
    for side, sizes in (("q", [100, 9000, 20_900]), ("a", [20_000, 50, 9_950])):
        (tmp_path / side).mkdir()
        write_parts(tmp_path / side, [f"{side}{i}" for i in range(n)], sizes)
    q = read_numbered(spark, str(tmp_path / "q" / "parts")).withColumnRenamed("value", "q")
    a = read_numbered(spark, str(tmp_path / "a" / "parts")).withColumnRenamed("value", "a")
    got = scoring.zip_by_position(q, a).select(F.substring("q", 2, 9) == F.substring("a", 2, 9)).collect()
    assert len(got) == n and all(r[0] for r in got)


def test_conll_blocks_in_order_and_with_crlf(spark, tmp_path):
    def block(i):
        return [f"0\tword{i}\t0\tP-B\t0.5", f"1\targ{i}\t0\tA0-B\t0.25"]

    lines = [x for i in range(9000) for x in [*block(i), ""]]
    folder = write_parts(tmp_path, lines, [3, 15_000, 30, 9000, 2967])
    got = [(r.block_id, r.sent) for r in bio.read_conll_blocks(spark, folder).select("block_id", "sent").collect()]
    assert [s for _, s in sorted(got)] == [f"word{i} arg{i}" for i in range(9000)]
    crlf = tmp_path / "crlf.conll"
    crlf.write_bytes("\r\n".join(lines[:9]).encode())
    assert sorted(r.sent for r in bio.read_conll_blocks(spark, str(crlf)).collect()) == [f"word{i} arg{i}" for i in range(3)]


def test_training_rows_keep_every_run(spark, aqe):
    n = 200_000
    ex = spark.range(n).select(
        F.concat(F.lit("word "), (F.col("id") % 1000).cast("string")).alias("sent"), F.lit("word").alias("pred"),
        F.array(F.lit(0)).alias("pred_indices"), F.lit(0).alias("head_pred_index"),
        F.array(F.lit("P-B"), F.lit("O")).alias("labels"), (F.col("id") * 3).alias("ord"))
    rows = C.training_conll_rows(ex)
    got = rows.agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"), F.max("run_id").alias("last"),
                   F.countDistinct("sent_id").alias("sents"), F.max("sent_id").alias("last_sent")).first()
    assert tuple(got) == (2 * n, n, n - 1, 1000, 999)
    assert rows.select("sent_id", "run_id").distinct().filter(F.col("run_id") % 1000 != F.lit(0)).count() > 0


def test_numbering_helpers(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).alias("k"))
    want = {k: i for i, k in enumerate(sorted(r.k for r in df.collect()))}
    for out in (number_by(df, "k", "n", block=64), number_sorted(df, "k", "n")):
        assert {r.k: r.n for r in out.collect()} == want
    words = spark.createDataFrame([("b",), ("a",), ("ç",), ("aa",)], "w string")
    assert {r.w: r.n for r in number_sorted(words, "w", "n").collect()} == {"a": 0, "aa": 1, "b": 2, "ç": 3}
    assert number_sorted(words.limit(0), "w", "n").collect() == []


def test_ranges_stay_balanced_when_one_key_holds_half_of_the_rows(spark):
    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.col("id") / n).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # small ranges are merged otherwise
    try:
        sizes = [r["count"] for r in sorted_runs(df, F.col("k")).groupBy("_run").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 2 * n / len(sizes)
    rows = number_sorted(df, ["k", "id"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(n)) and [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)
    prev = previous_row(df, F.col("id"), [F.col("k"), F.col("id")], "before").collect()
    at = {r.id: r.before for r in prev}
    assert all(at[b.id] == a.id for a, b in zip(rows, rows[1:])) and at[rows[0].id] is None


def test_curve_and_auc_with_half_of_the_points_at_one_recall(spark):
    rows = [(1, 0.99)] + [(0, i / 5000) for i in range(1, 4000)] + [(1, i / 5000 + 1e-5) for i in range(3000, 3050)]
    df = spark.createDataFrame(rows, "y int, score double")
    curve = ev.pr_curve(df)
    tp, n, pts = 0, 0, []
    for y, _ in sorted(rows, key=lambda r: -r[1]):
        tp, n = tp + y, n + 1
        pts.append((tp / n, tp / 51))
        if tp == 51:
            break
    got = [(r.precision, r.recall) for r in curve.filter("threshold IS NOT NULL").orderBy(F.col("threshold").desc()).collect()]
    assert got == pts
    pts = sorted([(r, i, p) for i, (p, r) in enumerate(pts)] + [(0.0, -1, 1.0)])
    want = sum((b[0] - a[0]) * (b[2] + a[2]) / 2 for a, b in zip(pts, pts[1:]))
    assert ev.auc(curve).first().auc == pytest.approx(want, abs=1e-12)


def test_curve_keeps_a_null_group(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.2)]
    df = spark.createDataFrame([(s, y, c) for s in ("a", None) for y, c in rows], "system string, y int, score double")
    mult = spark.createDataFrame([("a", 0.5), (None, 0.5)], "system string, multiplier double")
    curve = ev.pr_curve(df, by=["system"], multiplier=mult)
    got = {}
    for r in curve.collect():
        got.setdefault(r.system, set()).add((r.threshold, r.precision, r.recall, r.tp, r.n))
    assert got[None] == got["a"] and len(got["a"]) == 4
    areas = {r.system: r.auc for r in ev.auc(curve, by=["system"]).collect()}
    assert areas[None] == areas["a"] > 0


def test_next_turn_skips_gaps(spark):
    rows = [("c", 0, "user", "q0"), ("c", 5, "assistant", "a5"), ("c", 9000, "user", "q9000"), ("c", 20_001, "assistant", "a20001"),
            ("c", 20_002, "user", "last"), ("d", 3, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {(r.q, r.a) for r in scoring.pair_turns(df).collect()}
    assert got == {("q0", "a5"), ("q9000", "a20001")}
    nxt = {(r.conv_id, r.turn): r.n for r in next_order(df, "conv_id", "turn", "n").collect()}
    assert nxt == {("c", 0): 5, ("c", 5): 9000, ("c", 9000): 20_001, ("c", 20_001): 20_002, ("c", 20_002): None, ("d", 3): None}


def test_fuzzy_limit_counts_words_and_takes_all_their_positions(spark):
    def fuzzy(a, b):
        return F.when(b.startswith(a), F.lit(90)).otherwise(F.lit(0))

    df = spark.createDataFrame([("dogs x dogs y dogs z",)], "s string")
    got = df.select(C.locate_phrase(F.array(F.lit("dog")), F.split("s", " "), fuzzy, limit=1)).first()[0]
    assert got == [[0], [2], [4]]


def test_bleu_of_short_texts(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a"], ["a"]), ([], ["a"]), (["a"], []), (list("abcd"), list("abcd"))],
                               "r array<string>, h array<string>")
    assert [x[0] for x in df.select(ev.bleu("r", "h")).collect()] == pytest.approx([0.0, 0.0, 0.0, 0.0, 1.0])


def test_curve_without_a_positive(spark):
    scored = spark.createDataFrame([(0, 0.9), (0, 0.4)], "y int, score double")
    curve = ev.pr_curve(scored)
    got = sorted((r.threshold is None, r.precision, r.recall) for r in curve.collect())
    assert got == [(False, 0.0, 0.0), (False, 0.0, 0.0), (True, 1.0, 0.0)]
    assert ev.auc(curve).first().auc == 0.0
    none = spark.createDataFrame([], "gold_n int, has_pred boolean, errors array<long>")
    assert ev.recall_multiplier(none).first().multiplier is None


def test_empty_block_and_empty_product(spark):
    one = spark.range(1)
    empty = F.array().cast("array<string>")
    r = one.select(bio.decode_bio(empty, empty, F.array().cast("array<double>")).alias("d")).first().d
    assert list(r.args) == [] and r.confidence is None
    assert one.select(C.product(F.array().cast("array<array<int>>")).alias("p")).first().p == []


def test_qasrl_with_crlf_and_a_predicate_without_questions(spark, tmp_path):
    text = "X_7\t2\nthe dog runs\n2\truns\t1\nwho\t_\t_\truns\t_\t_\t_\t?\tthe dog\n1\tdog\t0\n\nX_8\t1\na cat\n1\tcat\t0\n"
    p = tmp_path / "q.txt"
    p.write_bytes(text.replace("\n", "\r\n").encode())
    got = {r.sent_id: r for r in C.read_qasrl(spark, str(p)).collect()}
    assert got[7].sent == "the dog runs" and [len(x.questions) for x in got[7].preds] == [1, 0]
    assert [len(x.questions) for x in got[8].preds] == [0]
    ex = C.qasrl_extractions(C.read_qasrl(spark, str(p))).collect()
    assert [(r.sent_id, r.qa[0].a) for r in ex] == [(7, "the dog")]


def test_matrix_guard_multiplies_as_long(spark):
    from triplematch.functions.similarity import soft_align

    df = spark.createDataFrame([(["a"], ["a"])], "a array<string>, b array<string>")
    assert "bigint" in df.select(soft_align("a", "b"))._jdf.queryExecution().analyzed().toString()


def test_checkpoint_folder_must_be_shared_on_a_cluster(monkeypatch):
    from triplematch import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Spark:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Spark())


def test_blocks_are_decoded_once(spark):
    from triplematch.plans.registry import load_all

    for name, folds in (("bio_extractions", 1), ("matchers", 2)):
        plan = load_all()[name].fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("arg_indices, transform") <= folds or plan.count("confidence, aggregate") <= folds


def test_histogram_scores_once(spark):
    from triplematch.plans.registry import load_all

    plans = {n: load_all()[n].fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
             for n in ("score_histogram", "dialogue_extracted_v1")}
    assert plans["score_histogram"].count("levenshtein") <= plans["dialogue_extracted_v1"].count("levenshtein")
