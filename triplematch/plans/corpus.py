"""Corpus family over decoded document extractions and the ``benchmark`` passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplematch.operators import corpus
from triplematch.plans import bio as bio_plan
from triplematch.plans import tagging
from triplematch.plans.registry import register
from triplematch.session import table


def _ex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio_plan.document_extractions(spark, sf_dir, seed=0)


STATS_SQL = f"""
WITH {bio_plan._decode_sql(0)},
e AS (SELECT b.sent, b.pred, ex.args FROM blocks b JOIN ex USING (tid, sent_no, pred_idx)),
per AS (SELECT sent, pred, len(args) AS n_args,
          list_sum(list_transform(args, lambda a: length(a))) AS arg_chars,
          list_sum(list_transform(args, lambda a: len(string_split(a, ' ')))) AS arg_words,
          len(string_split(pred, ' ')) AS pred_words FROM e),
ps AS (SELECT sent, count(*) AS c FROM e GROUP BY sent),
pp AS (SELECT sent, pred, count(*) AS c FROM e GROUP BY sent, pred)
SELECT count(*) AS n_extractions, round(avg(n_args), 6) AS avg_args,
       round(sum(arg_chars) / sum(n_args), 6) AS avg_arg_chars, round(sum(arg_words) / sum(n_args), 6) AS avg_arg_words,
       round(avg(pred_words), 6) AS avg_pred_words, round(avg(pred_words + arg_chars), 6) AS avg_prop_len,
       (SELECT count(*) FROM ps) AS n_sentences, (SELECT max(c) FROM ps) AS max_per_sentence,
       (SELECT sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END) FROM pp) AS repeated_sent_pred
FROM per
"""


@register("corpus_stats", "A12 A13", STATS_SQL)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(_ex(spark, sf_dir))


DISTINCT_SQL = f"""
WITH sents AS ({tagging.sql_sentences('documents', 'doc_id')})
SELECT DISTINCT sent FROM sents
"""


@register("distinct_sentences", "U1", DISTINCT_SQL)
def distinct_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = tagging.sentences(table(spark, sf_dir, "documents", spread_on="doc_id"), "doc_id")
    return corpus.distinct_sentences(sents)


SPLIT_SQL = f"""
WITH {bio_plan._decode_sql(0)},
bsent AS ({tagging.sql_sentences('benchmark', 'item_id')})
SELECT b.tid AS doc_id, b.sent_no, b.pred_idx, b.pred
FROM blocks b JOIN ex USING (tid, sent_no, pred_idx)
WHERE b.sent IN (SELECT trim(sent) FROM bsent)
"""


@register("corpus_split", "J9", SPLIT_SQL)
def corpus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench_sents = tagging.sentences(table(spark, sf_dir, "benchmark"), "item_id")
    kept = corpus.split_to_corpus(_ex(spark, sf_dir), bench_sents)
    return kept.select(F.col("tid").alias("doc_id"), "sent_no", "pred_idx", "pred")


UNION_SQL = f"""
WITH {bio_plan._decode_sql(0)},
d AS (SELECT 'documents' AS source, b.tid AS text_id, b.sent_no, b.pred_idx, b.pred
      FROM blocks b JOIN ex USING (tid, sent_no, pred_idx)),
bsents AS ({tagging.sql_sentences('benchmark', 'item_id')}),
bcand AS (SELECT tid, sent_no, sent, words, unnest(list_filter(range(len(words)),
          lambda p: (tid * 3 + sent_no * 5 + p * 7) % 6 = 0)) AS pred_idx FROM bsents),
bkept AS (SELECT tid, sent_no, words, words[pred_idx + 1] AS pred, max(pred_idx) AS pred_idx
          FROM bcand GROUP BY tid, sent_no, words, words[pred_idx + 1]),
btok AS (SELECT tid, sent_no, pred_idx, len(words) AS n, i, words[i + 1] AS w,
          CASE WHEN i = pred_idx THEN 'P-B' ELSE {'[' + ', '.join(repr(x) for x in tagging.LABELS) + ']'}[((tid * 7 + sent_no * 3 + i * 13 + pred_idx * 5) % 10) + 1] END AS l
         FROM bkept, LATERAL (SELECT unnest(range(len(words))) AS i)),
bisl AS (SELECT *, sum(CASE WHEN starts_with(l, 'A') THEN 0 ELSE 1 END)
          OVER (PARTITION BY tid, sent_no, pred_idx ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM btok),
bruns AS (SELECT tid, sent_no, pred_idx, max(i) AS end_i, max(n) AS n FROM bisl WHERE starts_with(l, 'A')
          GROUP BY tid, sent_no, pred_idx, island),
bex AS (SELECT DISTINCT tid, sent_no, pred_idx FROM bruns WHERE end_i < n - 1),
bb AS (SELECT 'benchmark' AS source, k.tid + (SELECT max(text_id) + 1 FROM d) AS text_id, k.sent_no, k.pred_idx, k.pred
       FROM bkept k JOIN bex USING (tid, sent_no, pred_idx))
SELECT * FROM d UNION ALL SELECT * FROM bb
"""


@register("corpus_union", "U2", UNION_SQL)
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ex(spark, sf_dir).select(F.lit("documents").alias("source"), F.col("tid").alias("text_id"),
                                     "sent_no", "pred_idx", "pred")
    bench = bio_plan.document_extractions(spark, sf_dir, seed=0, source="benchmark", id_col="item_id").select(
        F.lit("benchmark").alias("source"), F.col("tid").alias("text_id"), "sent_no", "pred_idx", "pred")
    # ids of the second corpus continue after the largest id of the first
    return corpus.union_corpora(docs, bench, ["text_id"])


TRAINING_SQL = f"""
WITH {bio_plan._decode_sql(0)},
r AS (SELECT tid, sent_no, pred_idx, start_i, end_i,
             row_number() OVER (PARTITION BY tid, sent_no, pred_idx ORDER BY start_i) AS k
      FROM runs WHERE end_i < n - 1),
el AS (SELECT tid, sent_no, pred_idx, 0 AS k, pred_idx AS lo, pred_idx AS hi FROM ex
       UNION ALL SELECT tid, sent_no, pred_idx, k, start_i, end_i FROM r),
t AS (SELECT b.tid, b.sent_no, b.pred_idx, i FROM blocks b JOIN ex USING (tid, sent_no, pred_idx),
        LATERAL (SELECT unnest(range(len(b.words))) AS i)),
best AS (SELECT t.tid, t.sent_no, t.pred_idx, t.i, arg_min(struct_pack(k := el.k, lo := el.lo), struct_pack(l := el.hi - el.lo, k := el.k)) AS e
         FROM t LEFT JOIN el ON el.tid = t.tid AND el.sent_no = t.sent_no AND el.pred_idx = t.pred_idx AND t.i BETWEEN el.lo AND el.hi
         GROUP BY ALL),
lab AS (SELECT tid, sent_no, pred_idx, i,
          CASE WHEN e.k IS NULL THEN 'O' ELSE (CASE WHEN e.k = 0 THEN 'P' ELSE 'A' || (e.k - 1) END) ||
               (CASE WHEN e.lo = i THEN '-B' ELSE '-I' END) END AS label FROM best)
SELECT tid AS doc_id, sent_no, pred_idx, string_agg(label, ' ' ORDER BY i) AS labels FROM lab GROUP BY ALL
"""


@register("training_conll", "E11 W1", TRAINING_SQL)
def training_conll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11 over decoded extractions: the predicate position and the argument spans the decoder
    found are the elements; every token is labelled from the shortest element containing it."""
    from triplematch.operators import construct as C

    ex = _ex(spark, sf_dir)
    elements = F.concat(F.array(F.array(F.col("pred_idx"))), F.col("arg_indices"))
    labels = C.bio_labels(F.size("words"), elements)
    return ex.select(F.col("tid").alias("doc_id"), "sent_no", "pred_idx", F.array_join(labels, " ").alias("labels"))
