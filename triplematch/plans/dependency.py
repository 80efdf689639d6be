"""Dependency-rule family over document sentences with deterministic arcs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplematch.operators import dependency as dep
from triplematch.plans import tagging
from triplematch.plans.registry import register
from triplematch.session import table

# --- fixed values: relation alphabets of the stand-in parser (left of the root, right of the root) ---
LEFT_RELS = ["ATT", "ATT", "SBV", "ADV"]
RIGHT_RELS = ["VOB", "ATT", "COO", "VOB", "ADV"]


RELS = ["ATT", "SBV", "ADV", "VOB", "COO", "HED", "ROOT"]


def _arcs(tid: Column, sno: Column, n: Column) -> Column:
    """Stand-in parser output for an n-token sentence, over Arrow batches: ``struct<heads, rels>``. Without a text id the rules
    that look at it don't apply, and relations picked by it are null."""
    lefts, rights = (np.array([RELS.index(x) for x in xs]) for xs in (LEFT_RELS, RIGHT_RELS))
    code = RELS.index

    @F.arrow_udf("struct<heads:array<int>,rels:array<string>>")
    def arcs(tids: pa.Array, numbers: pa.Array, sizes: pa.Array) -> pa.Array:
        size = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        n, i = size[row], np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
        known = pc.is_valid(tids).to_numpy(zero_copy_only=False)[row]
        t = pc.fill_null(tids, 0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        s = numbers.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        r = (n + 1) // 2
        to_root = known & (i < r - 1) & ((t + i) % 6 == 0)
        coordinate = known & (i > r + 1) & ((t + s + i) % 7 == 0)
        head = np.select([i == r, to_root, i < r, coordinate], [0, r, i + 1, r], i - 1)
        top = np.where(known & ((t + s) % 11 == 0), code("ROOT"), code("HED"))
        rel = np.select([i == r, to_root, i == r - 1, i < r, coordinate, i == r + 1],
                        [top, code("ADV"), code("SBV"), lefts[(t + i) % 4], code("COO"), code("VOB")], rights[(t + s + i) % 5])
        picked = ~to_root & ~coordinate & (np.abs(i - r) > 1)
        rels = pa.array(RELS).take(pa.array(rel, mask=picked & ~known))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(head, pa.int32())), pa.ListArray.from_arrays(ends, rels)],
                                          ["heads", "rels"])
    return arcs(tid, sno, n)


def parsed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = tagging.sentences(table(spark, sf_dir, "documents", spread_on="doc_id"), "doc_id")
    arcs = sents.select(F.col("tid").alias("text_id"), "sent_no", "words", _arcs(F.col("tid"), F.col("sent_no"), F.size("words")).alias("arcs"))
    return arcs.select("text_id", "sent_no", "words", "arcs.heads", "arcs.rels")


def _sql_arcs() -> str:
    lefts = "[" + ", ".join(f"'{x}'" for x in LEFT_RELS) + "]"
    rights = "[" + ", ".join(f"'{x}'" for x in RIGHT_RELS) + "]"
    return f"""
    sents AS ({tagging.sql_sentences('documents', 'doc_id')}),
    sz AS (SELECT tid, sent_no, words, len(words) AS n, (len(words) + 1) // 2 AS r FROM sents),
    arcs AS (
      SELECT tid, sent_no, i AS idx,
        CASE WHEN i = r THEN 0 WHEN i < r - 1 AND (tid + i) % 6 = 0 THEN r WHEN i < r THEN i + 1
             WHEN i > r + 1 AND (tid + sent_no + i) % 7 = 0 THEN r ELSE i - 1 END AS head,
        CASE WHEN i = r THEN (CASE WHEN (tid + sent_no) % 11 = 0 THEN 'ROOT' ELSE 'HED' END)
             WHEN i < r - 1 AND (tid + i) % 6 = 0 THEN 'ADV' WHEN i = r - 1 THEN 'SBV'
             WHEN i < r THEN {lefts}[(tid + i) % 4 + 1]
             WHEN i > r + 1 AND (tid + sent_no + i) % 7 = 0 THEN 'COO' WHEN i = r + 1 THEN 'VOB'
             ELSE {rights}[(tid + sent_no + i) % 5 + 1] END AS rel
      FROM sz, LATERAL (SELECT unnest(range(1, n + 1)) AS i))"""


DEP_SQL = f"""
WITH RECURSIVE {_sql_arcs()},
minatt AS (SELECT tid, sent_no, head AS parent, min(idx) AS child FROM arcs WHERE rel IN ('ATT', 'SBV') GROUP BY ALL),
maxvob AS (SELECT tid, sent_no, head AS parent, max(idx) AS child FROM arcs WHERE rel = 'VOB' GROUP BY ALL),
att_walk(tid, sent_no, start, cur, d) AS (
  SELECT tid, sent_no, idx, idx, 0 FROM arcs
  UNION ALL
  SELECT w.tid, w.sent_no, w.start, m.child, w.d + 1 FROM att_walk w
  JOIN minatt m ON m.tid = w.tid AND m.sent_no = w.sent_no AND m.parent = w.cur),
vob_walk(tid, sent_no, start, cur, d) AS (
  SELECT tid, sent_no, idx, idx, 0 FROM arcs
  UNION ALL
  SELECT w.tid, w.sent_no, w.start, m.child, w.d + 1 FROM vob_walk w
  JOIN maxvob m ON m.tid = w.tid AND m.sent_no = w.sent_no AND m.parent = w.cur),
fatt AS (SELECT tid, sent_no, start, arg_max(cur, d) AS far FROM att_walk GROUP BY ALL),
fvob AS (SELECT tid, sent_no, start, arg_max(cur, d) AS far FROM vob_walk GROUP BY ALL),
sent AS (
  SELECT a.tid, a.sent_no, any_value(sz.words) AS words,
         list(a.head ORDER BY a.idx) AS heads, list(a.rel ORDER BY a.idx) AS rels,
         list(fa.far ORDER BY a.idx) AS fa, list(fv.far ORDER BY a.idx) AS fv
  FROM arcs a JOIN sz USING (tid, sent_no)
  JOIN fatt fa ON fa.tid = a.tid AND fa.sent_no = a.sent_no AND fa.start = a.idx
  JOIN fvob fv ON fv.tid = a.tid AND fv.sent_no = a.sent_no AND fv.start = a.idx
  GROUP BY a.tid, a.sent_no),
offs AS (SELECT tid, sent_no, coalesce(sum(n) OVER (PARTITION BY tid ORDER BY sent_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sz),
valid AS (
  SELECT s.*, o.off, list_filter(range(1, len(s.heads) + 1), lambda i: s.rels[i] = 'HED') AS roots
  FROM sent s JOIN offs o USING (tid, sent_no)),
relx AS (
  SELECT *, roots[1] AS root FROM valid WHERE len(roots) = 1),
rel_rows AS (
  SELECT tid, sent_no, words, heads, rels, fa, fv, off,
    unnest(list_concat([root], list_filter(range(1, len(heads) + 1), lambda i: heads[i] = root AND rels[i] = 'COO'))) AS rel,
    generate_subscripts(list_concat([root], list_filter(range(1, len(heads) + 1), lambda i: heads[i] = root AND rels[i] = 'COO')), 1) - 1 AS rel_pos
  FROM relx),
rel2 AS (
  SELECT *, coalesce(list_filter(range(1, len(heads) + 1), lambda i: heads[i] = rel AND rels[i] = 'SBV')[-1],
                     list_max(list_filter(range(1, rel), lambda i: heads[i] = rel))) AS lft,
         list_filter(range(1, len(heads) + 1), lambda i: heads[i] = rel AND rels[i] = 'VOB') AS rgt
  FROM rel_rows),
rel3 AS (
  SELECT *, CASE WHEN lft IS NULL THEN '' ELSE array_to_string(words[fa[lft]:lft], ' ') END AS e1,
         CASE WHEN lft IS NULL THEN NULL ELSE off + fa[lft] - 1 END AS e1_loc,
         fv[rgt[1]] AS rext FROM rel2),
items AS (
  SELECT *, CASE WHEN len(rgt) = 0 THEN [NULL::BIGINT] ELSE list_concat(rgt,
           list_filter(range(1, len(heads) + 1), lambda i: heads[i] = rext AND rels[i] = 'COO')) END AS its FROM rel3),
itm AS (SELECT *, unnest(its) AS it, generate_subscripts(its, 1) - 1 AS k FROM items)
SELECT tid AS text_id, sent_no, rel_pos, k AS item,
  array_to_string(list_value(array_to_string(string_split(words[rel], ''), ' '), e1,
    CASE WHEN it IS NULL THEN ''
         WHEN k = 0 THEN array_to_string(words[fa[it]:rext], ' ')
         ELSE array_to_string(list_concat(words[fa[it]:rgt[1] - 1], words[it:fv[it]]), ' ') END), ' ||| ') AS triple,
  e1_loc,
  CASE WHEN it IS NULL THEN NULL WHEN k = 0 THEN off + fa[it] - 1 ELSE 0 END AS e2_loc
FROM itm
"""


@register("dependency_triples", "X1 X2 X3 X4 X5 X6 X7 J10 J11 W6 F24 D5", DEP_SQL)
def dependency_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dep.extract(parsed_sentences(spark, sf_dir))
    return out.select("text_id", "sent_no", "rel_pos", "item", F.array_join("triple", " ||| ").alias("triple"),
                      "e1_loc", "e2_loc")
