"""System-output readers on synthesised lines (two or three per format)."""

import pytest

from triplematch.sources import readers


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def _rows(df):
    return [(r.sent, r.pred, list(r.args), r.confidence) for r in df.orderBy("ord").collect()]


def test_ollie(spark, tmp_path):
    path = _write(tmp_path, "ollie.txt", "confidence\targ1\trel\targ2\tenabler\tattribution\ttext\n"
                  "0.9\tJohn\tlikes\tMary\t\t\tJohn likes Mary .\n0.4\tMary\tis\thappy\t\t\tMary is happy .\n")
    assert _rows(readers.read_ollie(spark, path)) == [
        ("John likes Mary .", "likes", ["John", "Mary"], 0.9), ("Mary is happy .", "is", ["Mary", "happy"], 0.4)]


def test_reverb_joins_sentence_numbers(spark, tmp_path):
    sents = _write(tmp_path, "sents.txt", "First sentence .\nSecond one here .\n")
    cols = lambda n, a1, r, a2, c: "\t".join(["f", str(n), a1, r, a2, "x", "x", "x", "x", "x", "x", str(c)])
    path = _write(tmp_path, "reverb.txt", cols(2, "Second", "one", "here", 0.7) + "\n" + cols(1, "First", "is", "sentence", 0.2) + "\n")
    got = _rows(readers.read_reverb(spark, path, sents))
    assert got == [("Second one here .", "one", ["Second", "here"], 0.7), ("First sentence .", "is", ["First", "sentence"], 0.2)]


def test_stanford(spark, tmp_path):
    line = "\t".join(["a", "b", "John", "likes", "Mary", "x", "x", "x", "x", "x", "x", "0.8", "John likes Mary ."])
    assert _rows(readers.read_stanford(spark, _write(tmp_path, "st.txt", line + "\n"))) == [
        ("John likes Mary .", "likes", ["John", "Mary"], 0.8)]


def test_clausie_forward_fill_and_minmax(spark, tmp_path):
    text = ("John likes Mary .\n"
            "1\t\"John\"\t\"likes\"\t\"Mary\"\t0.5\n"
            "Dogs bark .\n"
            "2\t\"Dogs\"\t\"bark\"\t\"\"\t1.0\n"
            "3\t\"Dogs\"\t\"do\"\t\"bark\"\t0.75\n")
    got = _rows(readers.read_clausie(spark, _write(tmp_path, "cl.txt", text)))
    eps = 1e-3
    norm = lambda c: ((c - 0.5) + eps) / (1.0 - 0.5 + 2 * eps)
    assert [g[:3] for g in got] == [("John likes Mary .", "likes", ["John", "Mary"]),
                                    ("Dogs bark .", "bark", ["Dogs", ""]), ("Dogs bark .", "do", ["Dogs", "bark"])]
    assert [g[3] for g in got] == pytest.approx([norm(0.5), norm(1.0), norm(0.75)])


def test_openie4_skips_incomplete(spark, tmp_path):
    el = lambda s: f"SimpleArgument({s},List([0, 4)))"
    good = "\t".join(["0.93", "", el("John"), el("likes"), el("Mary"), "John likes Mary ."])
    bad = "\t".join(["0.5", "", el("Dogs"), el("bark"), "", "Dogs bark ."])
    assert _rows(readers.read_openie4(spark, _write(tmp_path, "o4.txt", good + "\n" + bad + "\n"))) == [
        ("John likes Mary .", "likes", ["John", "Mary"], 0.93)]


def test_props_every_second_column(spark, tmp_path):
    line1 = "\t".join(["2.0", "John gave Mary a book .", "gave", "x", "John", "x", "Mary", "x", "a book"])
    line2 = "\t".join(["4.0", "Dogs bark .", "bark", "x", "Dogs"])
    got = _rows(readers.read_props(spark, _write(tmp_path, "pr.txt", line1 + "\n\n" + line2 + "\n")))
    eps = 1e-3
    assert [g[:3] for g in got] == [("John gave Mary a book .", "gave", ["John", "Mary", "a book"]),
                                    ("Dogs bark .", "bark", ["Dogs"])]
    assert [g[3] for g in got] == pytest.approx([eps / (2 + 2 * eps), (2 + eps) / (2 + 2 * eps)])


def test_tabbed_index_counts_non_blank(spark, tmp_path):
    path = _write(tmp_path, "tab.txt", "S1 .\t0.5\tp\ta\tb\n\nS2 .\t0.25\tq\tc\n")
    df = readers.read_tabbed(spark, path)
    got = [(r.sent, r.confidence, r.pred, list(r.args), r["index"]) for r in df.orderBy("ord").collect()]
    assert got == [("S1 .", 0.5, "p", ["a", "b"], 0), ("S2 .", 0.25, "q", ["c"], 1)]


def test_question_distribution_and_vectors(spark, tmp_path):
    qd = readers.read_question_dist(spark, _write(tmp_path, "qd.json", '{"who _ _": {"0": 5, "2": 1}, "what _ _": {"1": 3}}'))
    assert sorted(tuple(r) for r in qd.collect()) == [("what _ _", 1, 3), ("who _ _", 0, 5), ("who _ _", 2, 1)]
    vec = readers.read_word_vectors(spark, _write(tmp_path, "v.txt", "cat 0.5 1.0\ndog 1 0\n"))
    assert [(r.word, r.word_index, list(r.vec)) for r in vec.orderBy("word_index").collect()] == [
        ("cat", 1, [0.5, 1.0]), ("dog", 2, [1.0, 0.0])]


def test_pairs_range_and_validity(spark, tmp_path):
    path = _write(tmp_path, "pairs.txt", " q0 \t a0 \nno tab here\nq2\ta2\textra\nq3\ta3\n")
    learned = [(r.pair_id, r.q, r.a) for r in readers.read_pairs(spark, path).orderBy("pair_id").collect()]
    assert learned == [(0, "q0", "a0"), (2, "q2", "a2"), (3, "q3", "a3")]
    rule = [r.pair_id for r in readers.read_pairs(spark, path, exact=True).collect()]
    assert sorted(rule) == [0, 3]
    sliced = [r.pair_id for r in readers.read_pairs(spark, path, begin=1, end=3).collect()]
    assert sliced == [2]


def test_score_and_auc_lines(spark):
    from triplematch.sources import sinks

    df = spark.createDataFrame([(0.5, [["a", "b"]], [["c"]])], "score double, q array<array<string>>, a array<array<string>>")
    assert sinks.score_lines(df).first().value == "0.5"
    assert sinks.score_lines(df, q="q", a="a").first().value == "0.5\ta|||b\tc"
    aucs = spark.createDataFrame([("sysA", 0.25)], "system string, auc double")
    assert sinks.auc_lines(aucs).first().value == "sysA\t0.25"


def test_pairs_with_a_blank_side(spark, tmp_path):
    path = tmp_path / "pairs.txt"
    path.write_text("q0\ta0\n \ta1\nq2\t  \nq3\ta3\tmore\n")
    rows = lambda **kw: [tuple(r) for r in readers.read_pairs(spark, str(path), **kw).orderBy("pair_id").collect()]
    assert rows() == [(0, "q0", "a0"), (1, "", "a1"), (2, "q2", ""), (3, "q3", "a3")]
    assert rows(drop_blank=True) == [(0, "q0", "a0"), (3, "q3", "a3")]
    assert rows(drop_blank=True, exact=True) == [(0, "q0", "a0")]


def test_element_text(spark):
    from triplematch.functions.text import element_text

    df = spark.sql("SELECT ' a b ' AS s, named_struct('text', ' a b\t', 'indices', array(1)) AS t, "
                   "named_struct('words', array('a', 'b'), 'indices', array(1, 2)) AS g")
    assert tuple(df.select(element_text("s"), element_text("t", "tuple"), element_text("g", "argument")).first()) == (" a b ", "a b", "a b")
