"""Sources (S1-S8, S10, S12-S20): every reader returns a DataFrame with an explicit order column.

Extraction readers return the D8 shape ``sent, pred, args, confidence, head_pred_index, ord, index``
(``ord`` = running extraction number in file order; ``index`` = the number the format defines:
line number for gold files, running non-blank line number for tabbed files).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplematch.functions import fixed
from triplematch.operators.windows import forward_fill, number_by, read_numbered


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of a text file or a folder of them, numbered densely in (file name, position) order."""
    return read_numbered(spark, path, "line_no")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``block_id, lines``: runs of non-blank lines, separated by blank ones; ``block_id`` ascends in file order.

    The line reader handles both line endings. A record's id is the number of the last blank line before it,
    carried forward over the numbered lines; one aggregation gathers its lines, in order.
    """
    d = read_lines(spark, path).withColumn("_blank", F.trim(F.col("value")) == "")
    d = forward_fill(d.withColumn("_edge", F.when(F.col("_blank"), F.col("line_no"))), "line_no", "_edge", "_rec")
    g = d.filter(~F.col("_blank")).groupBy(F.coalesce("_rec", F.lit(-1)).alias("block_id")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("l"))
    return g.select("block_id", F.col("l.value").alias("lines"))


def _fields(value: str = "value") -> Column:
    # Python's line.strip().split('\t'): strip all surrounding whitespace, then split on tabs
    return F.split(F.regexp_replace(F.col(value), r"^(?U)\s+|(?U)\s+$", ""), "\t")


def _extractions(df: DataFrame, sent: Column, pred: Column, args: Column, confidence: Column,
                 index: Column, head: Column | None = None) -> DataFrame:
    return df.select(
        sent.alias("sent"), pred.alias("pred"), args.cast("array<string>").alias("args"),
        confidence.cast("double").alias("confidence"),
        (head if head is not None else F.lit(None)).cast("int").alias("head_pred_index"),
        F.col("line_no").alias("ord"), index.cast("long").alias("index"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``sent \\t pred \\t arg ...``; confidence 1; index = 0-based line number."""
    d = read_lines(spark, path).withColumn("f", _fields())
    return _extractions(d, F.col("f")[0], F.get(F.col("f"), 1), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))),
                        F.lit(1.0), F.col("line_no"))


def read_tabbed(spark: SparkSession, path: str) -> DataFrame:
    """``sent \\t prob \\t pred \\t arg ...``; blank lines skipped; index counts non-blank lines."""
    d = read_lines(spark, path).filter(F.trim(F.col("value")) != "")
    d = number_by(d, "line_no", "ex_index").withColumn("f", _fields())
    return _extractions(d, F.col("f")[0], F.get(F.col("f"), 2), F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))),
                        F.get(F.col("f"), 1), F.col("ex_index"))


def read_ollie(spark: SparkSession, path: str) -> DataFrame:
    """S3: header line skipped; ``confidence, arg1, rel, arg2, enabler, attribution, text``."""
    d = read_lines(spark, path).filter(F.col("line_no") > 0).withColumn("f", _fields())
    f = F.col("f")
    return _extractions(d, F.get(f, 6), F.get(f, 2), F.array(F.get(f, 1), F.get(f, 3)), F.get(f, 0), F.col("line_no"))


def read_reverb(spark: SparkSession, path: str, sentences_path: str) -> DataFrame:
    """S4 + J8: args at columns 2-4, confidence column 11, sentence = line ``col1 - 1`` of a sentence file."""
    sents = read_lines(spark, sentences_path).select(F.col("line_no").alias("sent_no"),
                                                      F.trim(F.col("value")).alias("sent_text"))
    d = read_lines(spark, path).withColumn("f", _fields())
    f = F.col("f")
    d = d.withColumn("sent_no", F.get(f, 1).cast("long") - 1).join(sents, "sent_no", "inner")
    return _extractions(d, F.col("sent_text"), F.get(f, 3), F.array(F.get(f, 2), F.get(f, 4)), F.get(f, 11), F.col("line_no"))


def read_stanford(spark: SparkSession, path: str) -> DataFrame:
    """arg1/rel/arg2 at columns 2-4, confidence column 11, sentence column 12."""
    d = read_lines(spark, path).withColumn("f", _fields())
    f = F.col("f")
    return _extractions(d, F.get(f, 12), F.get(f, 3), F.array(F.get(f, 2), F.get(f, 4)), F.get(f, 11), F.col("line_no"))


def _strip_outer(c: Column) -> Column:
    """Python ``s[1:-1]``."""
    return F.substring(c, 2, F.greatest(F.length(c) - 2, F.lit(0)).cast("int"))


def read_clausie(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """S6 + W5 (+ A5): a one-column line sets the current sentence; a five-column line is an
    extraction whose first three columns lose their first and last character."""
    d = read_lines(spark, path).withColumn("f", _fields())
    d = d.withColumn("_sent", F.when(F.size("f") == 1, F.col("f")[0]))
    d = forward_fill(d, "line_no", "_sent", "sent")
    d = d.filter(F.size("f") == 5)
    f = F.col("f")
    out = _extractions(d, F.col("sent"), _strip_outer(f[2]), F.array(_strip_outer(f[1]), _strip_outer(f[3])),
                       f[4], F.col("line_no"), head=F.lit(-1))
    return min_max_confidence(out) if normalize else out


def read_openie4(spark: SparkSession, path: str) -> DataFrame:
    """S7 + P7: confidence column 0; columns 2-4 must all be non-empty; each element is the text
    between the first ``(`` and the first ``,List(``; sentence column 5."""
    d = read_lines(spark, path).withColumn("f", _fields())
    f = F.col("f")
    d = d.filter((F.coalesce(F.get(f, 2), F.lit("")) != "") & (F.coalesce(F.get(f, 3), F.lit("")) != "")
                 & (F.coalesce(F.get(f, 4), F.lit("")) != ""))

    def inner(c: Column) -> Column:
        start = F.instr(c, "(") + 1
        return F.substring(c, start, F.instr(c, ",List(") - start)

    return _extractions(d, F.get(f, 5), inner(f[3]), F.array(inner(f[2]), inner(f[4])), f[0], F.col("line_no"),
                        head=F.lit(-1))


def read_props(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """S8 (+ A5): ``confidence, text, rel``, then an argument at every second column from index 4."""
    d = read_lines(spark, path).filter(F.trim(F.col("value")) != "").withColumn("f", _fields())
    f = F.col("f")
    args = F.filter(f, lambda x, i: (i >= 4) & (i % 2 == 0))
    out = _extractions(d, F.get(f, 1), F.get(f, 2), args, f[0], F.col("line_no"))
    return min_max_confidence(out) if normalize else out


def min_max_confidence(df: DataFrame, by: list[str] | None = None, eps: float = fixed.MINMAX_EPS) -> DataFrame:
    """A5: ``((c - min) + eps) / (max - min + 2 eps)`` over the whole file (or per ``by`` group).
    One aggregate, attached through a scalar subquery (or a join on the group key)."""
    by = list(by or [])
    c = F.col("confidence")
    if by:
        mm = df.groupBy(*by).agg(F.min(c).alias("_mn"), F.max(c).alias("_mx"))
        d = df.join(mm, by, "left")
        mn, mx = F.col("_mn"), F.col("_mx")
        return d.withColumn("confidence", ((c - mn) + eps) / (mx - mn + 2 * eps)).drop("_mn", "_mx")
    mn = df.select(F.min(c)).scalar()
    mx = df.select(F.max(c)).scalar()
    return df.withColumn("confidence", ((c - mn) + eps) / (mx - mn + 2 * eps))


READERS = {
    "gold": read_gold,
    "tab": read_tabbed,
    "ollie": read_ollie,
    "stanford": read_stanford,
    "clausie": read_clausie,
    "openie4": read_openie4,
    "props": read_props,
}


def read_extractions(spark: SparkSession, path: str, fmt: str, **opts) -> DataFrame:
    """Dispatch by format name (``reverb`` needs ``sentences_path``)."""
    if fmt == "reverb":
        return read_reverb(spark, path, **opts)
    return READERS[fmt](spark, path, **opts)


# ---------------------------------------------------------------- other sources


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """S14 / test.oie.sent: one stripped sentence per line with its line number."""
    return read_lines(spark, path).select("line_no", F.trim(F.col("value")).alias("sent"))


def read_pairs(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None,
               min_fields: int = 2, exact: bool = False, drop_blank: bool = False) -> DataFrame:
    """S13 + P1 + P2: ``q \\t a`` lines (optionally lines begin <= i < end); rule variant needs exactly
    two fields (``exact``), learned variant at least two; both sides stripped. ``drop_blank`` leaves out pairs with a
    blank side (meant, but never done, by the reproduced scripts: off by default); the others keep their numbers."""
    d = read_lines(spark, path)
    if begin is not None:
        d = d.filter(F.col("line_no") >= begin)
    if end is not None:
        d = d.filter(F.col("line_no") < end)
    f = F.split(F.col("value"), "\t")
    d = d.withColumn("f", f).filter((F.size("f") == 2) if exact else (F.size("f") >= min_fields))
    strip = lambda c: F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")
    d = d.select(F.col("line_no").alias("pair_id"), strip(F.col("f")[0]).alias("q"), strip(F.col("f")[1]).alias("a"))
    return d.filter((F.col("q") != "") & (F.col("a") != "")) if drop_blank else d


def cut_triples(text: Column | str, variant: str = "drop_empty") -> Column:
    """``t1*#*t2`` with elements joined by ``|||``.

    ``drop_empty`` drops empty elements; ``keep_empty`` keeps them; ``collapse`` also drops empty
    elements and joins a triple of more than three elements into one element.
    """
    t = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(F.trim(t), r"\*#\*"), lambda s: F.split(s, r"\|\|\|"))
    if variant == "keep_empty":
        return parts
    dropped = F.transform(parts, lambda tr: F.filter(tr, lambda e: e != ""))
    if variant == "drop_empty":
        return dropped
    if variant == "collapse":
        return F.transform(dropped, lambda tr: F.when(F.size(tr) > 3, F.array(F.array_join(tr, " "))).otherwise(tr))
    raise ValueError(variant)


def read_triple_file(spark: SparkSession, path: str, variant: str = "drop_empty") -> DataFrame:
    """S15 file form: ``text \\t triples`` per line -> ``pair_id, text, triples, n_long``."""
    d = read_lines(spark, path)
    f = F.split(F.col("value"), "\t")
    raw = F.coalesce(F.get(f, 1), F.lit(""))
    return d.select(F.col("line_no").alias("pair_id"), F.get(f, 0).alias("text"),
                    cut_triples(raw, variant).alias("triples"),
                    F.size(F.filter(cut_triples(raw, "drop_empty"), lambda tr: F.size(tr) > 3)).alias("n_long"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """One float per line (many shard files allowed)."""
    return spark.read.text(path).select(F.trim(F.col("value")).cast("double").alias("score"),
                                        F.input_file_name().alias("file"))


def read_pr_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``Precision \\t Recall`` files; system = file name up to its first dot; ``pt`` = row order."""
    frames = []
    for p in paths:
        d = read_lines(spark, p).filter(F.col("line_no") > 0)
        f = F.split(F.col("value"), "\t")
        name = p.rsplit("/", 1)[-1].split(".", 1)[0]
        frames.append(d.select(F.lit(name).alias("system"), (F.col("line_no") - 1).alias("pt"),
                               f[0].cast("double").alias("precision"), f[1].cast("double").alias("recall")))
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr)
    return out


def read_word_vectors(spark: SparkSession, path: str, glove: bool = True) -> DataFrame:
    """Text vectors ``word v1 v2 ...`` (the word2vec text header line is skipped when not glove);
    vocabulary index from 1 in file order, 0 is reserved for unknown words."""
    d = read_lines(spark, path)
    if not glove:
        d = d.filter(F.col("line_no") > 0)
    parts = F.split(F.trim(F.col("value")), " +")
    return d.select((F.col("line_no") + (1 if glove else 0)).alias("word_index"), parts[0].alias("word"),
                    F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vec"))


def read_question_dist(spark: SparkSession, path: str) -> DataFrame:
    """``{question: {slot: count}}`` JSON -> ``gen_question, slot INT, cnt LONG`` rows."""
    d = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,map<string,bigint>>")
    e = d.select(F.explode(m).alias("gen_question", "slots"))
    e = e.select("gen_question", F.explode("slots").alias("slot", "cnt"))
    return e.select("gen_question", F.col("slot").cast("int").alias("slot"), "cnt")


def read_training_conll(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated training CoNLL with header; "NA" stays a word (no null value)."""
    schema = ("word_id INT, word STRING, pred STRING, pred_id STRING, head_pred_id INT, sent_id INT, "
              "run_id INT, label STRING")
    return (spark.read.option("sep", "\t").option("header", True).option("quote", "")
            .option("nullValue", "\u0000").schema(schema).csv(path))
