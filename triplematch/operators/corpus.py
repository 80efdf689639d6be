"""Corpus operators: statistics, distinct sentences, unions, splits, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplematch.functions.text import escape_tabs
from triplematch.session import write_table


def corpus_stats(ex: DataFrame, sent: str = "sent", pred: str = "pred", args: str = "args") -> DataFrame:
    """A12 + A13 as one chain of aggregations over the extractions (read once).

    Partial sums per (sentence, predicate), then per sentence, then one global row -- each level
    much smaller than the last, with map-side partial aggregation. ``avg_arg_chars`` is what the
    reference reports as "words / argument" (it measures string length); ``avg_arg_words`` is the
    true word count; ``avg_prop_len`` keeps the reference's mix of predicate words and argument
    characters.
    """
    pred_words = F.size(F.split(F.col(pred), " "))
    arg_chars = F.aggregate(F.col(args), F.lit(0).cast("long"), lambda acc, a: acc + F.length(a))
    arg_words = F.aggregate(F.col(args), F.lit(0).cast("long"), lambda acc, a: acc + F.size(F.split(a, " ")))
    per_pair = ex.groupBy(sent, pred).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size(args)).alias("n_args"), F.sum(arg_chars).alias("arg_chars"),
        F.sum(arg_words).alias("arg_words"), F.sum(pred_words).alias("pred_words"))
    per_sent = per_pair.groupBy(sent).agg(
        F.sum("rows").alias("rows"), F.sum("n_args").alias("n_args"), F.sum("arg_chars").alias("arg_chars"),
        F.sum("arg_words").alias("arg_words"), F.sum("pred_words").alias("pred_words"),
        F.sum(F.when(F.col("rows") > 1, F.col("rows") - 1).otherwise(0)).alias("repeated"))
    n = F.sum("rows")
    return per_sent.agg(
        n.alias("n_extractions"),
        F.round(F.sum("n_args") / n, 6).alias("avg_args"),
        F.round(F.sum("arg_chars") / F.sum("n_args"), 6).alias("avg_arg_chars"),
        F.round(F.sum("arg_words") / F.sum("n_args"), 6).alias("avg_arg_words"),
        F.round(F.sum("pred_words") / n, 6).alias("avg_pred_words"),
        F.round((F.sum("pred_words") + F.sum("arg_chars")) / n, 6).alias("avg_prop_len"),
        F.count(F.lit(1)).alias("n_sentences"),
        F.max("rows").alias("max_per_sentence"),
        F.sum("repeated").alias("repeated_sent_pred"),
    )


def distinct_sentences(ex: DataFrame, sent: str = "sent") -> DataFrame:
    """The distinct sentences of a corpus."""
    return ex.select(sent).distinct()


def union_corpora(first: DataFrame, second: DataFrame, ids: list[str]) -> DataFrame:
    """``first`` then ``second``, the id columns of ``second`` moved past the maxima of ``first``
    (one scalar aggregate per id column, no join). ``first`` is written, as it feeds the maxima and the union."""
    first, out = write_table(first, "first_corpus"), second
    for c in ids:
        base = first.select(F.coalesce(F.max(c), F.lit(-1)) + 1).scalar()
        out = out.withColumn(c, F.col(c) + base)
    return first.unionByName(out)


def split_to_corpus(ex: DataFrame, sentences: DataFrame, sent: str = "sent") -> DataFrame:
    """Keep the extractions whose sentence is in the corpus sentence list (left semi join;
    the sentence list is a separate table and is hash-partitioned like the extractions)."""
    keys = sentences.select(F.trim(F.col(sent)).alias(sent)).distinct()
    return ex.join(keys, sent, "left_semi")


def tabbed_lines(ex: DataFrame) -> DataFrame:
    """``sent \\t confidence \\t pred \\t arg1 \\t arg2 ...`` text lines."""
    return ex.select(F.concat_ws("\t", "sent", F.col("confidence").cast("string"), "pred",
                                 F.array_join("args", "\t")).alias("value"))


def gold_lines(ex: DataFrame) -> DataFrame:
    """K6: ``sent \\t pred \\t args`` with tabs inside the sentence escaped."""
    return ex.select(F.concat_ws("\t", escape_tabs("sent"), "pred", F.array_join("args", "\t")).alias("value"))


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write text lines (ordered when ``order`` is given)."""
    d = lines.orderBy(*order).select("value") if order else lines
    d.write.mode("overwrite").text(path)
