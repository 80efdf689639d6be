"""Deterministic stand-in for a sequence tagger over table text.

The library takes tagger output as input (E3 accepts any caller-supplied model). To run the
extraction and evaluation families on the driver tables, labels and probabilities are derived
from integer arithmetic on (text id, sentence number, token position, predicate position, seed),
which Spark and the DuckDB oracles compute identically. Nothing is sampled or capped: every
sentence of every text is tagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplematch.functions.text import let

# --- fixed values: label alphabet indexed by the label code (0-9) ---
LABELS = ["O", "O", "O", "A0-B", "A0-I", "A1-B", "A1-I", "A2-B", "A2-I", "O"]
SENT_SPLIT = "[.!?\n]"


def sentences(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Split each text on ``. ! ? newline``; keep non-blank sentences with their position."""
    parts = df.select(F.col(id_col).alias("tid"), F.posexplode(F.split(F.col(text_col), SENT_SPLIT)).alias("sent_no", "raw"))
    toks = F.split(F.trim(F.col("raw")), " +")
    return (parts.filter(F.trim(F.col("raw")) != "")
                 .select("tid", "sent_no", toks.alias("words"))
                 .withColumn("sent", F.array_join("words", " ")))


def is_predicate(tid: Column, sent_no: Column, p: Column) -> Column:
    return ((tid * 3 + sent_no * 5 + p * 7) % 6) == 0


def label_code(tid: Column, sent_no: Column, i: Column, p: Column, seed: int) -> Column:
    return (tid * 7 + sent_no * 3 + i * 13 + p * 5 + seed * 11) % 10


def prob(tid: Column, sent_no: Column, i: Column, p: Column, seed: int) -> Column:
    return (((tid * 11 + sent_no * 7 + i * 17 + p * 3 + seed * 13) % 97) + 1) / 98.0


def tag_blocks(sents: DataFrame, seed: int = 0) -> DataFrame:
    """One row per (sentence, predicate candidate): ``words, labels, probs`` arrays (D6 as a block)."""
    tid, sno = F.col("tid"), F.col("sent_no")
    preds = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda p: is_predicate(tid, sno, p))
    blocks = sents.select("tid", "sent_no", "sent", "words", F.explode(preds).alias("pred_idx"))
    lab = F.array(*[F.lit(x) for x in LABELS])
    p = F.col("pred_idx")
    idx = F.sequence(F.lit(0), F.size("words") - 1)
    labels = F.transform(idx, lambda i: F.when(i == p, F.lit("P-B")).otherwise(
        F.element_at(lab, (label_code(tid, sno, i, p, seed) + 1).cast("int"))))
    probs = F.transform(idx, lambda i: prob(tid, sno, i, p, seed))
    return blocks.select("tid", "sent_no", "sent", "words", "pred_idx",
                         labels.alias("labels"), probs.alias("probs"))


# ---------------------------------------------------------------- SQL twins for the oracles


def sql_sentences(table: str, id_col: str, text_col: str = "text") -> str:
    return f"""
    SELECT {id_col} AS tid, sent_no, words, array_to_string(words, ' ') AS sent FROM (
      SELECT {id_col}, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS sent_no, unnest(parts) AS raw
      FROM (SELECT {id_col}, string_split_regex({text_col}, '[.!?\\n]') AS parts FROM {table})
    ) s, LATERAL (SELECT string_split_regex(trim(raw), ' +') AS words)
    WHERE trim(raw) <> ''"""


def sql_blocks(sents_cte: str, seed: int = 0) -> str:
    labs = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
    code = f"((tid * 7 + sent_no * 3 + i * 13 + pred_idx * 5 + {seed} * 11) % 10)"
    pr = f"((((tid * 11 + sent_no * 7 + i * 17 + pred_idx * 3 + {seed} * 13) % 97) + 1) / 98.0)"
    return f"""
    SELECT tid, sent_no, sent, words, pred_idx,
      list_transform(range(len(words)), lambda i: CASE WHEN i = pred_idx THEN 'P-B' ELSE {labs}[{code} + 1] END) AS labels,
      list_transform(range(len(words)), lambda i: {pr}) AS probs
    FROM (
      SELECT tid, sent_no, sent, words, unnest(list_filter(range(len(words)),
             lambda p: (tid * 3 + sent_no * 5 + p * 7) % 6 = 0)) AS pred_idx
      FROM {sents_cte}
    )"""


def text_triples(tid: Column, text: Column, seed: int = 0) -> Column:
    """Row-local E1+E2 over a whole text: every sentence, every kept predicate block, decoded into
    binary triples ``[pred, arg1, arg2]`` in (sentence, first predicate position) order.

    The same result as sentences -> tag_blocks -> keep-last -> decode, without exploding rows, so
    texts keep their partitioning (no shuffle) and a long text is one linear pass per block.
    """
    from triplematch.operators.bio import decode_bio, last_block_per_predicate_word

    lab = F.array(*[F.lit(x) for x in LABELS])
    sents = F.filter(
        F.transform(F.split(text, SENT_SPLIT), lambda raw, sno: F.struct(
            sno.cast("long").alias("sno"), F.split(F.trim(raw), " +").alias("words"),
            (F.trim(raw) != "").alias("keep"))),
        lambda s: s["keep"])

    def per_sentence(s: Column) -> Column:
        words, sno = s["words"], s["sno"]
        cands = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: is_predicate(tid, sno, p))
        kept = F.array_sort(last_block_per_predicate_word(words, cands))

        def per_block(k: Column) -> Column:
            p = k["pred_idx"]
            idx = F.sequence(F.lit(0), F.size(words) - 1)
            labels = F.transform(idx, lambda i: F.when(i == p, F.lit("P-B")).otherwise(
                F.element_at(lab, (label_code(tid, sno, i, p, seed) + 1).cast("int"))))
            probs = F.transform(idx, lambda i: prob(tid, sno, i, p, seed))
            return let(decode_bio(words, labels, probs)["args"], lambda args: F.when(
                F.size(args) > 0, F.concat(F.array(F.element_at(words, p + 1)), F.slice(args, 1, 2))))

        return F.filter(F.transform(kept, per_block), lambda t: t.isNotNull())

    return F.flatten(F.transform(sents, per_sentence))


def sql_text_triples(table: str, tid_expr: str, seed: int = 0) -> str:
    """SQL twin of :func:`text_triples`: ``tid, triples`` for every text that has at least one."""
    labs = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
    code = f"((tid * 7 + sent_no * 3 + i * 13 + pred_idx * 5 + {seed} * 11) % 10)"
    return f"""
    t_src AS (SELECT {tid_expr} AS tid, text FROM {table}),
    t_sents AS ({sql_sentences('t_src', 'tid')}),
    t_cand AS (
      SELECT tid, sent_no, words, unnest(list_filter(range(len(words)),
             lambda p: (tid * 3 + sent_no * 5 + p * 7) % 6 = 0)) AS pred_idx FROM t_sents),
    t_kept AS (
      SELECT tid, sent_no, words, words[pred_idx + 1] AS pred, max(pred_idx) AS pred_idx, min(pred_idx) AS ord
      FROM t_cand GROUP BY tid, sent_no, words, words[pred_idx + 1]),
    t_tok AS (
      SELECT tid, sent_no, pred_idx, len(words) AS n, i, words[i + 1] AS w,
             CASE WHEN i = pred_idx THEN 'P-B' ELSE {labs}[{code} + 1] END AS l
      FROM t_kept, LATERAL (SELECT unnest(range(len(words))) AS i)),
    t_isl AS (
      SELECT *, sum(CASE WHEN starts_with(l, 'A') THEN 0 ELSE 1 END)
               OVER (PARTITION BY tid, sent_no, pred_idx ORDER BY i ROWS UNBOUNDED PRECEDING) AS island
      FROM t_tok),
    t_runs AS (
      SELECT tid, sent_no, pred_idx, min(i) AS start_i, max(i) AS end_i, max(n) AS n, string_agg(w, ' ' ORDER BY i) AS arg
      FROM t_isl WHERE starts_with(l, 'A') GROUP BY tid, sent_no, pred_idx, island),
    t_ex AS (
      SELECT tid, sent_no, pred_idx, list(arg ORDER BY start_i) AS args FROM t_runs WHERE end_i < n - 1 GROUP BY ALL),
    t_triples AS (
      SELECT k.tid, list(list_concat([k.pred], list_slice(e.args, 1, 2)) ORDER BY k.sent_no, k.ord) AS triples
      FROM t_kept k JOIN t_ex e USING (tid, sent_no, pred_idx) GROUP BY k.tid)"""
