"""Rule-based triples from dependency arcs.

A parsed sentence is one row with 1-based aligned arrays ``words, heads, rels`` (the parser is an
input, not part of the library). Every rule is evaluated inside the row:

* child lookups (J10) are one table of the sentence's arcs by head;
* the two closures (J11: follow the smallest ATT/SBV child, follow the largest VOB child) keep the
  end of every chain they walked, so a sentence costs its tokens and its output -- no join per hop
  and no shuffle. Sentences come in Arrow batches (``functions.arcs``);
* the global token offset of a sentence inside its text (W6) is an exclusive prefix sum.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplematch.functions.arcs import sentence_triples
from triplematch.functions.text import _c, let, spaced_chars

ColumnOrName = Column | str


def _pointer(heads: Column, rels: Column, kinds: list[str], last: bool) -> Column:
    """For every token k: its first (or last) child among ``kinds`` children, or 0 when it has none.

    The arcs of those kinds are sorted by (head, child) once; the first (last) arc of each head is kept, and zeros fill the
    gaps between the heads. So the cost is that of a sort, not a scan of all tokens per token.
    """
    n = F.size(heads)
    arcs = F.array_sort(F.filter(F.transform(heads, lambda h, i: F.struct(
        F.when((h >= 1) & (h <= n) & F.get(rels, i).isin(*kinds), h).otherwise(0).alias("h"), (i + 1).alias("k"))), lambda a: a["h"] > 0))

    def pick(a: Column) -> Column:
        other = (lambda i: F.get(a, i + 1)) if last else (lambda i: F.get(a, i - 1))
        return F.filter(a, lambda x, i: F.coalesce(F.when(i >= (0 if last else 1), other(i)["h"]), F.lit(0)) != x["h"])

    def fill(one: Column) -> Column:
        parts = F.transform(one, lambda x, i: F.concat(F.array_repeat(F.lit(0), x["h"] - 1 - F.when(
            i > 0, F.get(one, i - 1)["h"]).otherwise(0)), F.array(x["k"])))
        tail = F.array_repeat(F.lit(0), n - F.coalesce(F.get(one, F.size(one) - 1)["h"], F.lit(0)))
        return F.when(F.size(one) == 0, F.array_repeat(F.lit(0), n)).otherwise(F.concat(F.flatten(parts), tail))

    return let(let(arcs, pick), fill)


def arcs_triples(words: ColumnOrName, heads: ColumnOrName, rels: ColumnOrName, offset: ColumnOrName | None = None,
                 spaced_relation: bool = True) -> Column:
    """X2-X7 for one sentence: ``array<struct<rel_pos, item, triple array<string>, e1_loc, e2_loc>>``,
    or NULL when the sentence does not have exactly one HED arc (the sentence is skipped)."""
    off = F.lit(0) if offset is None else _c(offset)
    kind = "array<struct<rel_pos:int,item:int,rel:string,e1:string,e2:string,e1_loc:bigint,e2_loc:bigint>>"

    @F.arrow_udf(kind)
    def found(w: pa.Array, h: pa.Array, r: pa.Array) -> pa.Array:
        rows = map(sentence_triples, w.to_pylist(), h.to_pylist(), r.to_pylist())
        return pa.array(rows, pa.list_(pa.struct([("rel_pos", pa.int32()), ("item", pa.int32()), ("rel", pa.string()), ("e1", pa.string()),
                                                  ("e2", pa.string()), ("e1_loc", pa.int64()), ("e2_loc", pa.int64())])))

    return F.transform(found(_c(words), _c(heads), _c(rels)), lambda x: F.struct(
        x["rel_pos"].alias("rel_pos"), x["item"].alias("item"),
        F.array(spaced_chars(x["rel"]) if spaced_relation else x["rel"], x["e1"], x["e2"]).alias("triple"),
        (x["e1_loc"] + off).cast("long").alias("e1_loc"),
        F.when(x["item"] == 0, x["e2_loc"] + off).otherwise(x["e2_loc"]).cast("long").alias("e2_loc")))


def sentence_offsets(sentences: DataFrame, text: str, order: str, n_words: str) -> Column:
    """Tokens of the text's earlier sentences (failed sentences still advance the offset)."""
    w = Window.partitionBy(text).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n_words).over(w), F.lit(0))


def arcs_to_sentences(arcs: DataFrame, text: str = "text_id", sent: str = "sent_no") -> DataFrame:
    """X1 input side: token rows ``(text, sent, idx, word, head, rel)`` -> one row per sentence with
    ordered arrays (one aggregation keyed by sentence; a sentence is bounded by its length)."""
    g = arcs.groupBy(text, sent).agg(F.array_sort(F.collect_list(F.struct("idx", "word", "head", "rel"))).alias("t"))
    return g.select(text, sent, F.col("t.word").alias("words"), F.col("t.head").alias("heads"),
                    F.col("t.rel").alias("rels"))


def extract(sentences: DataFrame, text: str = "text_id", sent: str = "sent_no", offsets: Column | None = None,
            spaced_relation: bool = True) -> DataFrame:
    """X1-X7 for sentence rows: one output row per triple.

    The rules run on each sentence row where it was read (offset 0), before the only shuffle, which
    is the W6 prefix sum of sentence lengths per text; the global offset is added afterwards to the
    subject location and to the first object's location (later objects keep 0).
    """
    t = sentences.withColumn("n_words", F.size("words")).withColumn(
        "_t", arcs_triples("words", "heads", "rels", None, spaced_relation)).drop("words", "heads", "rels")
    off = offsets if offsets is not None else sentence_offsets(t, text, sent, "n_words")
    t = t.withColumn("offset", off)
    out = t.filter(F.col("_t").isNotNull()).select(text, sent, "offset", F.explode("_t").alias("x"))
    return out.select(text, sent, "x.rel_pos", "x.item", "x.triple",
                      (F.col("x.e1_loc") + F.col("offset")).alias("e1_loc"),
                      F.when(F.col("x.item") == 0, F.col("x.e2_loc") + F.col("offset")).otherwise(F.col("x.e2_loc"))
                      .alias("e2_loc"))


def head_words(words: ColumnOrName, heads: ColumnOrName, root: str = "ROOT") -> Column:
    """Each token's syntactic head word (1-based heads, 0 = root), inside the sentence row."""
    return let(_c(words), lambda w: F.transform(_c(heads), lambda h: F.when(h == 0, F.lit(root))
                                                .otherwise(F.try_element_at(w, h))))
