"""Sinks (K1-K12): text forms as DataFrames of ``value`` lines, and writers.

Every ``*_lines`` function returns a DataFrame, so a caller can write it (text, Parquet) or keep
transforming it; the writers order output only where the format is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplematch.functions.text import _c

TRIPLE_SEP = "*#*"
ELEMENT_SEP = "|||"


def triples_text(triples: Column | str) -> Column:
    """K1 value: triples joined by ``*#*``, elements by ``|||``."""
    return F.array_join(F.transform(_c(triples), lambda t: F.array_join(t, ELEMENT_SEP)), TRIPLE_SEP)


def triple_lines(df: DataFrame, text: str = "text", triples: str = "triples") -> DataFrame:
    """K1: ``text \\t t1*#*t2`` lines."""
    return df.select(F.concat_ws("\t", F.col(text), triples_text(triples)).alias("value"))


def score_lines(df: DataFrame, score: str = "score", q: str | None = None, a: str | None = None) -> DataFrame:
    """K2: the bare score, or ``score \\t q_triples \\t a_triples``."""
    cols = [F.col(score).cast("string")]
    if q and a:
        cols += [triples_text(q), triples_text(a)]
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def curve_lines(curve: DataFrame) -> DataFrame:
    """K8: ``Precision \\t Recall`` rows ordered by recall (the header is added by the writer)."""
    return curve.select("recall", F.col("threshold"), F.concat_ws("\t", F.col("precision").cast("string"),
                                                                   F.col("recall").cast("string")).alias("value"))


def write_curve(curve: DataFrame, path: str) -> None:
    """K8: one ordered file with a header line."""
    spark = curve.sparkSession
    header = spark.createDataFrame([(-1.0, None, "Precision\tRecall")], "recall double, threshold double, value string")
    lines = header.unionByName(curve_lines(curve))
    (lines.orderBy(F.col("recall"), F.col("threshold").desc_nulls_first()).select("value")
          .coalesce(1).write.mode("overwrite").text(path))  # a curve has one row per distinct score


def error_lines(errors: DataFrame, index: str = "index") -> DataFrame:
    """K9: one gold index per line."""
    return errors.select(F.col(index).cast("string").alias("value"))


def auc_lines(aucs: DataFrame, system: str = "system") -> DataFrame:
    """``system \\t auc`` rows (write ordered by auc)."""
    return aucs.select("auc", F.concat_ws("\t", F.col(system), F.col("auc").cast("string")).alias("value"))


def write_text(lines: DataFrame, path: str, order: list | None = None) -> None:
    d = lines.orderBy(*order) if order else lines
    d.select("value").write.mode("overwrite").text(path)


TRAINING_COLUMNS = ["word_id", "word", "pred", "pred_id", "head_pred_id", "sent_id", "run_id", "label"]


def write_training_conll(rows: DataFrame, path: str) -> None:
    """K5: tab-separated training CoNLL, rows in (run, word) order over part files in name order, each
    with a header; no quoting and no null marker, so words such as "NA" stay words when read back."""
    (rows.select(*TRAINING_COLUMNS).orderBy("run_id", "word_id")
         .write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "")
         .option("escape", "").csv(path))
