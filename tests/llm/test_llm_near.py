"""Jaccard join and substring dedup against brute force; licence scan and mixing edges; the pipeline."""

import hashlib
import re

import numpy as np
import pytest

from triplematch.llm import jaccard_join, licenses, mixing, queries, substring_dedup

WORD = r"[^\x20\x09-\x0D]+"


def brute_components(rows, words, percent):
    sets = {}
    for d, t in rows:
        if d is None:
            continue
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(d, []).append(frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words
                                      else frozenset([tuple(w)] if w else []))
    label = {d: d for d in sets}
    while True:
        before = dict(label)
        for a in sets:
            for b in sets:
                if a != b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return sorted((d, len(x), label[d]) for d in sets for x in sets[d])


def near_rows(seed, n=90):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocab, 70)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(base[int(rng.integers(6))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
        if rng.random() < 0.3:
            w = w[:int(rng.integers(55, 71))]
        rows.append((i + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, make_docs, words, percent):
    rows = near_rows(words) + [(200, None), (201, ""), (202, "One two"), (203, "one  TWO"), (204, "two one"), (205, "x y z"), (206, "X\ty z"),
                               (207, "alone"), (208, "É a b c"), (209, "é a b c"), (None, "x y z"), (205, "x y z"),
                               (210, "very long " * 20000), (211, "very long " * 20001)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(make_docs(rows), words, percent).collect())
    assert got == brute_components(rows, words, percent)


def test_jaccard_chain_and_stage(spark, make_docs):
    words = [f"t{i}" for i in range(60)]
    rows = [(10 - i, " ".join(words[i:i + 50])) for i in range(8)]      # each links to the next only
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(make_docs(rows), 3, 90).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, 3, 90)}
    docs = make_docs(rows + [(3, rows[7][1])])
    kept = jaccard_join.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_stage_keeps_different_texts_of_one_doc_id(spark, make_docs):
    near, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "nop")
    docs = make_docs([(1, near), (5, near + " end", "en"), (5, other, "fr"), (5, other, "de"), (5, third), (7, third + " x"), (8, "solo"),
                      (None, "no id")])
    for d in (docs, docs.repartition(5)):
        kept = jaccard_join.keep_one(d, 3, 90)
        assert kept.columns == docs.columns
        got = sorted((r.doc_id, r.text, r.lang or "") for r in kept.collect())
        assert [(r[0], r[1]) for r in got] == sorted([(1, near), (5, other), (5, third), (8, "solo")])
        assert {r[2] for r in got if r[1] == other} <= {"fr", "de"}
    assert len({tuple(sorted(map(str, jaccard_join.keep_one(docs.repartition(n), 3, 90).collect()))) for n in (1, 3)}) == 1


def test_jaccard_empty(spark, make_docs):
    assert jaccard_join.jaccard_components(make_docs([])).collect() == []
    assert [tuple(r) for r in jaccard_join.jaccard_components(make_docs([(1, None)])).collect()] == [(1, 0, 1)]


def test_jaccard_writes_prefixes_once(spark, make_docs, monkeypatch):
    written, real = [], jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df: written.append(set(df.columns)) or real(df))
    rows = near_rows(4, 30)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(make_docs(rows), 5, 80).collect())
    assert got == brute_components(rows, 5, 80)
    assert sum("tokens" in c for c in written) == 1
    assert [c for c in written if "shared" in c] == [{"token", "gid", "n", "pos", "shared"}]


@pytest.mark.parametrize("repeat", [False, True])
def test_stage_shuffles_only_rows_that_may_go(spark, make_docs, repeat):
    ids = [int(i) for i in np.random.default_rng(8).permutation(200) + 1]
    rows = [(i, " ".join(f"{i // 2 if i < 20 else i}x{k}" for k in range(60))) for i in ids]
    docs = make_docs(rows + [(500, "twice"), (500, "other words")] * repeat).coalesce(1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs, 5, 80).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [r for r in rows if r[0] >= 20 or r[0] % 2 == 0 or r[0] == 1]
    assert got[:len(want)] == want              # in the order of the input: these rows met no exchange
    assert sorted(got[len(want):]) == [(500, "other words"), (500, "twice")] * repeat


def test_shingle_counts_of_any_size(spark, make_docs):
    rows = [(i, f"a b c d{i % 3}") for i in range(300)] + [(400 + i, f"e{i} f g") for i in range(5)]
    counts = np.zeros(jaccard_join.SKETCH, np.int64)
    for _, t in rows:
        np.add.at(counts, jaccard_join._cell(jaccard_join.shingles(t, 3)), 1)
    docs = make_docs(rows).repartition(1)
    assert counts.max() == 300
    assert (jaccard_join.frequency_classes(docs, 3) == np.floor(2 * np.log2(np.maximum(counts, 1)))).all()


def test_parity_bitmap_never_prunes_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = rng.integers(0, 2 ** 63, 80).astype(np.uint64)
        y = np.concatenate((x[:60], rng.integers(0, 2 ** 63, 15).astype(np.uint64)))
        odd = [np.bincount((g & np.uint64(511)).astype(int), minlength=512) & 1 for g in (x, y)]
        assert (odd[0] != odd[1]).sum() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_op10_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op10_jaccard_join"](spark, "/root/testdata/sf0.001").collect())
    assert got == brute_components([tuple(r) for r in docs], 3, 90)


def brute_spans(rows, k=20):
    seen, out = set(), []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = re.findall(WORD, t or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            h = tuple(w[i:i + k])
            if h in seen:
                gone[i:i + k] = [True] * k
            seen.add(h)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def got_spans(docs, **kw):
    rows = substring_dedup.dedup_spans(docs, **kw).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)


def test_substring_against_brute_force(spark, make_docs):
    rng = np.random.default_rng(6)
    vocab = [f"v{i}" for i in range(300)]
    shared = [list(rng.choice(vocab, int(n))) for n in (19, 20, 21, 45, 120)]
    rows = []
    for i in range(60):
        w = list(rng.choice(vocab, int(rng.integers(0, 80))))
        for _ in range(int(rng.integers(0, 3))):
            s = shared[int(rng.integers(5))]
            a = int(rng.integers(0, 5))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = s[a:]
        rows.append((i * 3 - 20, "  ".join(w)))
    rows += [(500, None), (501, ""), (502, "same " * 100), (503, "a b " * 5000), (504, "b a " * 300), (None, rows[0][1]),
             (505, "é Case case " * 15), (506, " ".join(shared[4])), (507, "\n".join(shared[4]))]
    assert got_spans(make_docs(rows)) == brute_spans(rows)
    assert got_spans(make_docs(rows).repartition(7), core=6) == brute_spans(rows)


def test_substring_repeated_rows_and_empty(spark, make_docs):
    long = " ".join(f"u{i}" for i in range(40))
    got = got_spans(make_docs([(1, long), (1, long), (2, long)]))
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, 40)]
    assert substring_dedup.dedup_spans(make_docs([])).collect() == []


def test_substring_one_id_with_two_texts(spark, make_docs):
    long, other = " ".join(f"u{i}" for i in range(300)), " ".join(f"t{i}" for i in range(3))
    rows = [(7, long), (7, other), (7, other), (8, long), (8, ""), (9, " ".join(f"u{i}" for i in range(250, 300)))]
    got = got_spans(make_docs(rows))
    assert sorted((r[0], r[1], r[2]) for r in got) == [(7, 3, 0), (7, 3, 0), (7, 300, 0), (8, 0, 0), (8, 300, 300), (9, 50, 50)]


def test_word_proofs_are_a_polynomial_over_a_prime_field():
    from triplematch.llm.common import mix64
    raw, m = "one é two\n\n one x".encode(), substring_dedup._PRIME
    want = [sum((b + 1) * pow(substring_dedup._BASE, i, m) for i, b in enumerate(w)) % m ^ len(w) << 32 for w in raw.split()]
    assert (substring_dedup.word_proofs(raw) == mix64(np.array(want, np.uint64))).all()


def test_equal_word_hashes_remove_nothing(spark, make_docs):
    from triplematch.llm.common import word_hashes
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))     # a polynomial modulo 2^64 can't tell these two apart
    b = a.translate(str.maketrans("ab", "ba"))
    assert word_hashes(a.encode()) == word_hashes(b.encode())
    head, tail = " ".join(f"h{i}" for i in range(10)), " ".join(f"t{i}" for i in range(10))
    x, y = f"{head} {a} {tail}", f"{head} {b} {tail}"
    docs = [(1, x), (2, y), (3, f"{y} end"), (4, f"w {x} v")]
    got = got_spans(make_docs(docs))
    assert got == brute_spans(docs)
    assert [r[2] for r in got] == [0, 0, 21, 21]


def test_op6_on_the_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op6_substring_dedup"](spark, "/root/testdata/sf0.001").collect())
    assert got == brute_spans(docs)


def test_license_scan(spark, make_docs):
    mit = licenses.MIT_TEXT.replace("MIT License\n", "MIT Licence\n\nCopyright (c) 2020 A. Nyone\n", 1).upper()
    rows = [(1, mit), (2, "Text.\nLICENCED under the apache licence,  version 2.0!\nmore"), (3, None), (4, ""), (5, "nothing here"),
            (6, "Released under the MIT License.\nReleased under the MIT License\nSPDX-License-Identifier: GPL-3.0"),
            (7, "we talk about the MIT License here"), (None, "MIT License"), (8, "MIT License"), (8, "MIT License"), (9, "x\n" * 50000)]
    got = {r.doc_id: (r.document_license, r.notices, r.n_notices) for r in licenses.scan(make_docs(rows)).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "Apache-2.0", 1)
    assert got[3] == got[4] == got[5] == got[7] == got[9] == (None, "", 0)
    assert got[6] == (None, "GPL-3.0,MIT", 3) and got[8] == ("MIT", "MIT", 2) and None not in got
    assert licenses.scan(make_docs([])).collect() == []


def test_mixing_meets_target_weights(spark, make_docs):
    rows = [(i, "x" * 100, "en", "big" if i % 10 else "small") for i in range(4000)]
    got = mixing.mix(make_docs(rows), weights={"big": 1.0, "small": 3.0})
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert n["big"] / 4000 == pytest.approx(0.25, abs=0.03) and n["small"] / 4000 == pytest.approx(0.75, abs=0.05)
    again = mixing.mix(make_docs(rows).repartition(5), weights={"big": 1.0, "small": 3.0})
    key = lambda df: sorted((r.doc_id, r.copy, r.order_key) for r in df.select("doc_id", "copy", "order_key").collect())
    assert key(got) == key(again)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_counts_are_poisson(spark, make_docs):
    rows = [(i, "x" * 10, "en", "rare" if i % 50 == 0 else "rest") for i in range(20000)]
    got = mixing.mix(make_docs(rows), weights={"rare": 0.5, "rest": 0.5}).filter("source = 'rare'").groupBy("doc_id").count().collect()
    counts = np.array([r["count"] for r in got])
    assert len(counts) == 400 and counts.mean() == pytest.approx(25, abs=1) and counts.var() == pytest.approx(25, rel=0.3)


def test_mixing_edges(spark, make_docs):
    rows = [(1, None, "en", None), (2, "", "en", "a"), (None, "x", "en", "a"), (3, "text", None, "a"), (3, "text", None, "a"), (4, "y" * 100000, "en", "b")]
    got = mixing.mix(make_docs(rows))
    assert set(r.doc_id for r in got.collect()) <= {2, 3, 4}
    assert got.filter("copy IS NULL").count() == 0
    assert mixing.mix(make_docs([])).collect() == []
    assert mixing.mix(make_docs([(1, None), (2, "")])).collect() == []


def test_pipeline(spark, library=None):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from triplematch.llm import toxicity
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "source_mixing", "packing"]
    # brute force of each stage on what the one before kept
    from triplematch.llm.common import crc_mod
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), ~(crc_mod("doc_id", 3) == 1))
    kept = [d for d in docs if model.scores([d[1]])[0] < 0.7]
    best = {}
    for d in kept:
        k = re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")
        best[k] = min(best.get(k, d), d, key=lambda x: (-len(x[1] or ""), x[0]))
    kept = sorted(best.values())
    firsts = {d for d, _, c in brute_components([k[:2] for k in kept], 5, 80) if d == c}
    kept = [d for d in kept if d[0] in firsts]
    frame = spark.createDataFrame(kept, "doc_id long, text string, source string")
    copies = {}
    for r in mixing.mix(frame).select("doc_id").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    rows = cp.run(spark, sf).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {d[0]: d[1] or "" for d in kept}
    assert got == {d: n * (len(tok.encode(text[d], add_special_tokens=False).ids) + 1) for d, n in copies.items()}


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline as cp
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.collect() == []
    assert cp.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect() == []


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline
    cols = ["_source", "_pieces", "_cdf", "copy", "order_key", "a.b", "_sha"]
    rows = [(i, f"text {i // 2} of some words here", "web" if i % 3 else "books", *(f"{c}{i}" for c in cols)) for i in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *cols])
    want = {r[0]: r for r in rows}
    for stage in (corpus_pipeline.mix_sources, corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, "")
        got = out.collect()
        assert out.columns == docs.columns and got and all(tuple(r) == want[r.doc_id] for r in got)
