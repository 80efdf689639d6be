"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplematch.llm.common import BLANKS, cut, fresh, id_text, maybe_member, member_bitmap, own_columns


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``: six byte-wise replacements, no regex engine."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def exact_dedup(docs: DataFrame, prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting the blanks. Of equal texts the row with the most code points
    in the original text stays, then the one with the smallest doc_id.

    1. One scan computes the normalised length and a hash of its first ``prefix_chars`` characters. Counted per
       (length, prefix), map-side first, only numbers are shuffled; lengths seen once fall out, then prefixes
       seen once.
    2. The surviving (length, prefix) groups become a bitmap of fixed size. A second scan hashes the full content
       only of rows that may be in a surviving group. Texts are never shuffled.
    3. Rows are grouped by full SHA-256. The group table is aggregated map-side and joined back; a group that
       holds a third of all rows is one row there, and its members are a plain join side that AQE splits.

    ``digest_all`` also hashes the other rows (their ``text_sha256`` is null otherwise); it changes no verdict.
    Null texts count as empty and equal one another. Rows without a doc_id are left out. Rows that repeat a
    doc_id and text count as members of their group each and share the verdict. Empty input: no rows.
    """
    rows = id_text(docs)
    norm = normalised(F.col("text"))
    probe = rows.select("doc_id", "text", F.length(norm).alias("_len"),
                        F.xxhash64(F.left(norm, F.lit(prefix_chars))).alias("_prefix"))
    by_prefix = probe.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    by_length = by_prefix.groupBy("_len").agg(F.sum("_n").alias("_n_len")).filter("_n_len > 1")
    surviving = (by_prefix.filter("_n > 1").join(by_length, "_len", "left_semi")
                 .select(F.xxhash64("_len", "_prefix").alias("_key")))
    flagged = maybe_member(probe.withColumn("_key", F.xxhash64("_len", "_prefix")), "_key",
                           member_bitmap(surviving, "_key"))
    full = text_digest(F.col("text"))
    hashed = cut(flagged.select("doc_id", F.length("text").alias("_points"), F.col("_maybe"),
                                (full if digest_all else F.when(F.col("_maybe"), full)).alias("text_sha256")))
    members = hashed.filter("_maybe")
    groups = members.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct(F.col("_points"), (-F.col("doc_id")).alias("_neg"))).alias("_top"))
    # written before the join: then both join sides are plain shuffles, and AQE splits the members of a hot group
    groups = cut(groups.select("text_sha256", "group_size", (-F.col("_top._neg")).alias("keep_id")))
    joined = members.join(groups, "text_sha256")
    alone = hashed.filter("NOT _maybe").select("doc_id", "text_sha256", F.lit(1).cast("long").alias("group_size"),
                                               F.col("doc_id").alias("keep_id"))
    cols = ["doc_id", "keep_id", "group_size", "text_sha256"]
    out = joined.select(cols).unionByName(alone.select(cols))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
                      "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept (the pipeline's stage).

    The verdicts come from :func:`exact_dedup`. A row is matched by doc_id and digest; rows that repeat both are
    reduced to one.
    """
    verdicts = exact_dedup(docs, digest_all=True)
    key = fresh(docs, "_sha")
    keyed = docs.withColumn(key, text_digest(F.coalesce(F.col("text"), F.lit(""))))
    stay = verdicts.filter("kept").select("doc_id", F.col("text_sha256").alias(key))
    return keyed.join(stay, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).select(*own_columns(docs))


ORACLE = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
     s AS (SELECT doc_id, length(t) AS points,
                  sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM n),
     g AS (SELECT text_sha256, count(*) AS group_size, max(points) AS points FROM s GROUP BY 1),
     k AS (SELECT s.text_sha256, min(s.doc_id) AS keep_id FROM s JOIN g ON s.text_sha256 = g.text_sha256
           AND s.points = g.points GROUP BY 1)
SELECT s.doc_id, k.keep_id, g.group_size, s.doc_id = k.keep_id AS kept, s.text_sha256
FROM s JOIN g ON s.text_sha256 = g.text_sha256 JOIN k ON s.text_sha256 = k.text_sha256
"""
