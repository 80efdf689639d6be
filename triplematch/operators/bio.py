"""BIO-tagged tokens to extractions and triples.

A tagged block is one (sentence, predicate) with aligned ``words / labels / probs`` arrays. Tables of blocks
are decoded over Arrow batches, whose tokens are numpy arrays: no window, no shuffle, and a very long
sentence costs one linear pass; :func:`decode_bio` is the same as a Column, for use inside lambdas. Only reading a
CoNLL text file needs a grouping step (token lines -> blocks), keyed by block id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from triplematch.functions.text import _c, binary_triple, consolidate_label, let

ColumnOrName = Column | str


def _role(label: Column) -> Column:
    return F.split(label, "-")[0]


def mean_prob(probs: Column) -> Column:
    """The mean of an array of probabilities; NULL when there are none."""
    return F.aggregate(probs, F.lit(0.0), lambda acc, x: acc + x) / F.when(F.size(probs) > 0, F.size(probs))


def product_prob(probs: Column) -> Column:
    return F.when(F.size(probs) > 0, F.aggregate(probs, F.lit(1.0), lambda acc, x: acc * x))


def decode_bio(words: ColumnOrName, labels: ColumnOrName, probs: ColumnOrName, legacy: bool = True,
               calc_prob: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """E1 + A6 over one block. Returns ``struct<args: array<string>, confidence: double>``.

    H2: ``calc_prob`` maps names to builders that make a number from the array of the ``A`` tokens' probabilities; each
    becomes a field of its own in place of ``confidence`` (default: ``{"confidence": mean_prob}``).

    Legacy: every maximal run of labels starting with ``A`` is one argument (a new ``-B`` or a role
    change does not split it), and a run that reaches the last token is not emitted, although its
    probabilities still count. ``legacy=False`` also splits on ``-B`` and on role changes and keeps
    the final run. The confidence is the mean probability of all ``A`` tokens (NULL when none).

    Runs are found as index arrays (run starts, run ends) with ``filter`` and paired with
    ``zip_with``: linear in the block length, no per-token accumulator.
    """
    builders = calc_prob or {"confidence": mean_prob}

    def body(s: Column) -> Column:
        w, lab, pr = s["w"], s["l"], s["p"]
        n = F.size(lab)

        def is_a(i: Column) -> Column:
            return F.element_at(lab, i).startswith("A")

        def splits_at(i: Column) -> Column:
            """True when token i (1-based, i >= 2, both i-1 and i are A) opens a new argument."""
            if legacy:
                return F.lit(False)
            cur, prev = F.element_at(lab, i), F.element_at(lab, i - 1)
            return cur.endswith("-B") | (F.split(cur, "-")[0] != F.split(prev, "-")[0])

        idx = F.transform(lab, lambda x, i: i + 1)  # empty for an empty block
        starts = F.filter(idx, lambda i: is_a(i) & F.when(i == 1, F.lit(True)).otherwise(~is_a(i - 1) | splits_at(i)))
        ends = F.filter(idx, lambda i: is_a(i) & F.when(i == n, F.lit(True)).otherwise(~is_a(i + 1) | splits_at(i + 1)))
        spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        if legacy:
            spans = F.filter(spans, lambda sp: sp["b"] < n)
        a_probs = F.filter(pr, lambda x, i: F.element_at(lab, i + 1).startswith("A"))
        conf = let(a_probs, lambda ap: F.struct(*[f(ap).alias(name) for name, f in builders.items()]))
        return let(F.struct(spans.alias("sp"), conf.alias("conf")), lambda b: let(b["sp"], lambda sp: F.struct(
            F.transform(sp, lambda x: F.array_join(F.slice(w, x["a"], x["b"] - x["a"] + 1), " ")).alias("args"),
            *[b["conf"][name].alias(name) for name in builders],
            F.transform(sp, lambda x: F.sequence(x["a"] - 1, x["b"] - 1)).alias("arg_indices"))))

    return let(F.struct(_c(words).alias("w"), _c(labels).alias("l"), _c(probs).alias("p")), body)


def ends_of(lengths: np.ndarray) -> pa.Array:
    """Offsets of an Arrow list array whose lists have these lengths."""
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())


def token_slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ...`` of several slices of a flat array, one slice after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def decode_arrays(words: pa.ListArray, labels: pa.ListArray, probs: pa.ListArray, legacy: bool = True) -> dict[str, pa.Array]:
    """E1 + A6 for many blocks at once, as :func:`decode_bio` decodes one: ``args, confidence, arg_indices`` and
    ``a_probs``, the probabilities of the ``A`` tokens. A block without lists has no arguments."""
    n = pc.fill_null(pc.list_value_length(labels), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for other in (words, probs):
        if not np.array_equal(n, pc.fill_null(pc.list_value_length(other), 0).to_numpy(zero_copy_only=False)):
            raise ValueError("words, labels and probs of a block differ in length")
    starts = np.cumsum(n) - n
    block = np.repeat(np.arange(len(n)), n)
    some = n > 0
    first, last = np.zeros(len(block), bool), np.zeros(len(block), bool)
    first[starts[some]] = True
    last[(starts + n - 1)[some]] = True
    coded = labels.flatten().dictionary_encode()
    kinds = [k or "" for k in coded.dictionary.to_pylist()] + [""]
    code = pc.fill_null(coded.indices, len(kinds) - 1).to_numpy(zero_copy_only=False)
    is_a = np.array([k.startswith("A") for k in kinds])[code]
    opens, closes = is_a.copy(), is_a.copy()
    apart = ~is_a
    if not legacy:
        roles = {r: i for i, r in enumerate(dict.fromkeys(k.split("-")[0] for k in kinds))}
        role = np.array([roles[k.split("-")[0]] for k in kinds])[code]
        new = np.array([k.endswith("-B") for k in kinds])[code]
        new[1:] |= role[1:] != role[:-1]
    opens[1:] &= first[1:] | apart[:-1] | (False if legacy else new[1:])
    closes[:-1] &= last[:-1] | apart[1:] | (False if legacy else new[1:])
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes)
    if legacy:
        kept = ~last[hi]
        lo, hi = lo[kept], hi[kept]
    per_block = ends_of(np.bincount(block[lo], minlength=len(n)))
    at = token_slices(lo, hi - lo + 1)
    texts = words.flatten().take(pa.array(at))
    sizes = hi - lo + 1
    if texts.null_count:                                   # a missing word leaves no blank
        there = pc.is_valid(texts).to_numpy(zero_copy_only=False)
        sizes = np.bincount(np.repeat(np.arange(len(lo)), sizes)[there], minlength=len(lo))
        texts = texts.drop_null()
    args = pc.binary_join(pa.ListArray.from_arrays(ends_of(sizes), texts), " ")
    places = pa.ListArray.from_arrays(ends_of(hi - lo + 1), pa.array(at - starts[block[at]], pa.int32()))
    flat = probs.flatten().filter(pa.array(is_a))
    of = block[is_a]
    known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    count = np.bincount(of, minlength=len(n))
    total = np.bincount(of, weights=np.where(known, flat.to_numpy(zero_copy_only=False), 0.0), minlength=len(n))   # left to right
    void = (count == 0) | (np.bincount(of, weights=~known, minlength=len(n)) > 0)
    return {"args": pa.ListArray.from_arrays(per_block, args), "confidence": pa.array(total / np.maximum(count, 1), pa.float64(), mask=void),
            "arg_indices": pa.ListArray.from_arrays(per_block, places), "a_probs": pa.ListArray.from_arrays(ends_of(count), flat)}


def decode_records(batches: Iterator[pa.RecordBatch], names: list[str], legacy: bool = True, words: str = "words",
                   labels: str = "labels", probs: str = "probs", pred_idx: str = "pred_idx") -> Iterator[pa.RecordBatch]:
    """The blocks with >= 1 argument and their ``pred, args, confidence, arg_indices, a_probs``; ``names`` are the columns to give."""
    for batch in batches:
        cols = dict(zip(batch.schema.names, batch.columns))
        found = decode_arrays(cols[words], cols[labels], cols[probs], legacy)
        size = pc.list_value_length(cols[words])
        at = pc.add(pc.subtract(pc.cumulative_sum(pc.fill_null(size, 0)), pc.fill_null(size, 0)), cols[pred_idx])
        cols |= found
        some = pc.greater(pc.list_value_length(found["args"]), 0)
        if "pred" in names:
            at = pc.if_else(pc.and_(some, pc.less(cols[pred_idx], size)), at, None)
            cols["pred"] = batch.column(batch.schema.names.index(words)).flatten().take(at)
        yield pa.RecordBatch.from_arrays([cols[c] for c in names], names).filter(some)


def decode_blocks(blocks: DataFrame, legacy: bool = True, words: str = "words", labels: str = "labels",
                  probs: str = "probs", pred_idx: str = "pred_idx",
                  calc_prob: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """E1/E2 for a DataFrame of blocks: adds ``pred``, ``args``, ``confidence`` (or the columns that ``calc_prob`` names, H2);
    keeps blocks with >= 1 argument."""
    fields = decoded_fields(blocks.schema, calc_prob is not None)
    names = [f.name for f in fields]
    found = blocks.mapInArrow(lambda it: decode_records(it, names, legacy, words, labels, probs, pred_idx), StructType(fields))
    return with_confidence(found, calc_prob)


def decoded_fields(schema: StructType, own: bool = False) -> list[StructField]:
    """Fields of decoded blocks: those of the blocks and the decoder's, which replace fields of the same name."""
    new = [StructField("pred", StringType()), StructField("args", ArrayType(StringType())),
           StructField("a_probs", ArrayType(DoubleType())) if own else StructField("confidence", DoubleType()),
           StructField("arg_indices", ArrayType(ArrayType(IntegerType())))]
    by_name = {f.name: f for f in new}
    return [by_name.pop(f.name, f) for f in schema.fields] + list(by_name.values())


def with_confidence(found: DataFrame, calc_prob: dict[str, Callable[[Column], Column]] | None) -> DataFrame:
    """H2: the columns that ``calc_prob`` names, from the array of the ``A`` tokens' probabilities."""
    if calc_prob is None:
        return found
    return found.withColumns({name: f(F.col("a_probs")) for name, f in calc_prob.items()}).drop("a_probs")


def last_blocks(words: pa.Array, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U3 for many sentences at once: of candidates (``words``, ascending by sentence and position) that share sentence and
    word, the number of the first and of the last one, as :func:`last_block_per_predicate_word` in one row."""
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = sentence * (code.max(initial=0) + 1) + code
    first = np.unique(key, return_index=True)[1]
    last = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]
    return first, last


def last_block_per_predicate_word(words: ColumnOrName, candidates: ColumnOrName) -> Column:
    """U3 inside a sentence row: of candidate predicate positions sharing a word, keep the last one,
    ordered by the first position of that word. Returns ``array<struct<first, pred_idx>>``."""
    return let(F.struct(_c(words).alias("w"), _c(candidates).alias("c")), lambda s: F.transform(
        F.filter(s["c"], lambda p, i: ~F.exists(
            F.slice(s["c"], i + 2, F.size(s["c"])),
            lambda q: F.element_at(s["w"], q + 1) == F.element_at(s["w"], p + 1))),
        lambda p: F.struct(
            F.array_min(F.filter(s["c"], lambda q: F.element_at(s["w"], q + 1) == F.element_at(s["w"], p + 1)))
            .alias("first"),
            p.alias("pred_idx"))))


def triples_from_extractions(pred: ColumnOrName, args: ColumnOrName) -> Column:
    """``[pred, arg1, arg2]`` (fewer when the extraction has fewer arguments)."""
    return binary_triple(pred, args)


# ---------------------------------------------------------------- CoNLL text


def conll_block_text(words: ColumnOrName, labels: ColumnOrName, probs: ColumnOrName, pred_idx: ColumnOrName) -> Column:
    """K4: one block as ``word_ind \\t word \\t pred_ind \\t label \\t prob`` lines."""
    p = _c(pred_idx)
    lines = F.transform(F.arrays_zip(_c(words).alias("w"), _c(labels).alias("l"), _c(probs).alias("p")),
                        lambda t, i: F.concat_ws("\t", i.cast("string"), t["w"], p.cast("string"), t["l"],
                                                 t["p"].cast("string")))
    return F.array_join(lines, "\n")


def write_conll(blocks: DataFrame, path: str, order: list[str]) -> None:
    """K4: write blocks separated by a blank line, in ``order`` (one ordered text output)."""
    text = conll_block_text("words", "labels", "probs", "pred_idx")
    (blocks.select(*order, F.concat(text, F.lit("\n")).alias("value"))
           .orderBy(*order).select("value").write.mode("overwrite").text(path))


def read_conll_blocks(spark: SparkSession, path: str) -> DataFrame:
    """S9 + W4: read a prediction CoNLL file as blocks.

    Records are runs of non-blank lines (either line ending); ``block_id`` increases in (file name,
    position) order, so it is an order key over a folder of part files too (not dense).
    Returns ``block_id, sent, words, labels, probs, pred_idx, pred``.
    """
    from triplematch.sources.readers import read_records

    rows = F.transform("lines", lambda ln: F.split(ln, "\t"))
    b = read_records(spark, path).select("block_id", rows.alias("r"))
    b = b.select(
        "block_id",
        F.transform("r", lambda x: F.get(x, 1)).alias("words"),
        F.transform("r", lambda x: F.get(x, 3)).alias("labels"),
        F.transform("r", lambda x: F.get(x, 4).cast("double")).alias("probs"),
        F.get(F.transform("r", lambda x: F.get(x, 2).cast("int")), 0).alias("pred_idx"),
        F.transform("r", lambda x: F.get(x, 0).cast("int")).alias("word_idx"),
    )
    pred_word = F.try_element_at(F.filter(F.arrays_zip("word_idx", "words"), lambda t: t["word_idx"] == F.col("pred_idx")), F.lit(-1))["words"]
    return b.select("block_id", F.array_join("words", " ").alias("sent"), "words", "labels", "probs", "pred_idx",
                    pred_word.alias("pred"))


def keep_last_per_predicate(blocks: DataFrame, sent: str = "sent", pred: str = "pred", order: str = "block_id") -> DataFrame:
    """U3 over block rows: for each (sentence, predicate word) keep the last block; ``ord`` keeps the
    position of the first one (dictionary semantics). One aggregation keyed by (sentence, word)."""
    cols = [c for c in blocks.columns if c not in (sent, pred)]
    return (blocks.groupBy(sent, pred)
                  .agg(F.max_by(F.struct(*cols), F.col(order)).alias("_last"), F.min(order).alias("ord"))
                  .select(sent, pred, "ord", *[F.col(f"_last.{c}").alias(c) for c in cols if c != order]))


# ---------------------------------------------------------------- label statistics


def label_classes(labels: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels with their 0-based id (the distinct set is tiny)."""
    from pyspark.sql import Window

    d = labels.select(label).distinct()
    return d.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("label_id"))


def one_hot(label: ColumnOrName, classes: list[str]) -> Column:
    """one-hot vector of a label over the class list."""
    return F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.when(c == _c(label), 1.0).otherwise(0.0))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def label_precision() -> Column:
    return _ratio(F.col("tp"), F.col("n_pred"))


def label_recall() -> Column:
    return _ratio(F.col("tp"), F.col("n_true"))


def label_f1() -> Column:
    return _ratio(2 * label_precision() * label_recall(), label_precision() + label_recall())


#: Metric builders (H3): aggregates over one row per label with ``tp``, ``n_true`` and ``n_pred``.
METRICS: dict[str, Callable[[], Column]] = {
    "micro_f1": lambda: F.sum("tp") / F.sum("n_true"),
    "macro_f1": lambda: F.avg(label_f1()),
    "macro_precision": lambda: F.avg(label_precision()),
    "macro_recall": lambda: F.avg(label_recall()),
    "weighted_f1": lambda: F.sum(label_f1() * F.col("n_true")) / F.sum("n_true"),
}


def token_metrics(pairs: DataFrame, metrics: list[tuple[str, Callable[[], Column]]], y: str = "y", yhat: str = "yhat",
                  consolidate: bool = True) -> DataFrame:
    """H3: one row with a column per (name, builder), all from one confusion table.

    A builder returns an aggregate over the labels' counts ``tp``, ``n_true``, ``n_pred`` (see :data:`METRICS`); a label
    absent on one side has 0 there. Values are rounded to six digits.
    """
    per = label_counts(pairs, y, yhat, consolidate)
    return per.agg(*[F.round(f(), 6).alias(name) for name, f in metrics])


def _confusion(pairs: DataFrame, y: str, yhat: str, consolidate: bool) -> DataFrame:
    """Counts by pair of labels. Labels are consolidated in the few counted rows, not per token."""
    raw = pairs.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    if not consolidate:
        return raw
    return raw.groupBy(consolidate_label("y").alias("y"), consolidate_label("yhat").alias("yhat")).agg(F.sum("n").alias("n"))


def label_counts(pairs: DataFrame, y: str = "y", yhat: str = "yhat", consolidate: bool = True) -> DataFrame:
    """label, tp, n_true, n_pred: the confusion table (one aggregation with map-side partial counts) by label."""
    conf = _confusion(pairs, y, yhat, consolidate)
    sides = F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                             F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit")),
                    F.struct(F.col("yhat").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                             F.lit(0).cast("long").alias("hit")))
    return conf.select(F.explode(sides).alias("s")).groupBy(F.col("s.label").alias("label")).agg(
        F.sum("s.hit").alias("tp"), F.sum("s.t").alias("n_true"), F.sum("s.p").alias("n_pred"))


def token_f1(pairs: DataFrame, y: str = "y", yhat: str = "yhat", consolidate: bool = True) -> DataFrame:
    """Token-level micro F1 (= accuracy) and macro F1 over consolidated labels.

    The confusion table is one aggregation with map-side partial counts; per-label figures come
    from it (labels absent on one side score 0, as in the usual macro average).
    """
    per = label_counts(pairs, y, yhat, consolidate)
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)
    per = per.select("label", p.alias("p"), r.alias("r"), "tp", "n_true")
    f = F.when((F.col("p") + F.col("r")) > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return per.agg(
        F.round(F.sum("tp") / F.sum("n_true"), 6).alias("micro_f1"),
        F.round(F.avg(f), 6).alias("macro_f1"),
        F.count(F.lit(1)).alias("n_labels"),
        F.sum("n_true").alias("n_tokens"),
    )


def argmax_label(probs: ColumnOrName, classes: list[str]) -> Column:
    """T2 top-1: ``struct<label, prob>`` of the most probable class (first on ties)."""
    best = F.array_max(F.transform(_c(probs), lambda p, i: F.struct(p.alias("p"), (-i).alias("ni"))))
    return F.struct(F.element_at(F.array(*[F.lit(c) for c in classes]), 1 - best["ni"]).alias("label"),
                    best["p"].alias("prob"))


def top_classes(probs: ColumnOrName, n: int, classes: list[str] | None = None) -> Column:
    """The ``n`` most probable classes as ``array<struct<label, prob>>``, falling, first class on ties; with ``classes``
    the label is the class's name, else its 0-based number. Fewer classes than ``n`` give all of them."""
    ranked = F.slice(F.sort_array(F.transform(_c(probs), lambda p, i: F.struct(p.alias("p"), (-i).alias("ni"))), asc=False), 1, n)
    names = F.array(*[F.lit(c) for c in classes]) if classes else None
    return F.transform(ranked, lambda t: F.struct(
        (F.element_at(names, 1 - t["ni"]) if classes else -t["ni"]).alias("label"), t["p"].alias("prob")))


def replay_predictions(sentences: DataFrame, stored: DataFrame, sent: str = "sent", preds: str = "preds") -> DataFrame:
    """Attach stored ``(pred, labels)`` lists to sentences by their space-joined text; a
    sentence without stored predictions gets an empty list (left join on the sentence text)."""
    out = sentences.join(stored.select(sent, preds), sent, "left")
    empty = F.array().cast(stored.schema[preds].dataType)
    return out.withColumn(preds, F.coalesce(F.col(preds), empty))


def sentences_by_run(tokens: DataFrame, run: str = "run_id", order: str = "word_id") -> DataFrame:
    """Token rows regrouped into one row per ``run_id``, tokens in ``word_id`` order
    (one aggregation keyed by the run; a run is one sentence)."""
    cols = [c for c in tokens.columns if c not in (run,)]
    g = tokens.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order]))).alias("t"))
    return g.select(run, *[F.col(f"t.{c}").alias(c) for c in cols])
