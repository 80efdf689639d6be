"""Dialogue-scoring queries over the ``conversations`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplematch.operators import scoring
from triplematch.plans import sqlfrag as q
from triplematch.plans import tagging
from triplematch.plans.registry import register
from triplematch.session import table, write_table


def _empty_triples():
    return F.array().cast("array<array<string>>")


def fallback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn + next assistant turn; no extractor output, so both sides take the P3 pseudo-triple."""
    pairs = scoring.pair_turns(table(spark, sf_dir, "conversations"))
    df = pairs.select("conv_id", "turn", "q", "a", _empty_triples().alias("q_triples"), _empty_triples().alias("a_triples"))
    df = scoring.with_fallback(df, "q_triples", "q")
    return scoring.with_fallback(df, "a_triples", "a")


def dialogue_scores(spark: SparkSession, sf_dir: str, mode: str = "v1") -> DataFrame:
    df = fallback_pairs(spark, sf_dir)
    extra = {}
    if mode == "v3":
        df = df.withColumn("q_words", F.split(F.col("q"), " ")).withColumn("a_words", F.split(F.col("a"), " "))
        extra = {"q_words": "q_words", "a_words": "a_words"}
    df = scoring.score_pairs(df, mode=mode, **extra)
    return df


# ---------------------------------------------------------------- flagship


def _pairs_sql() -> str:
    return """
    pairs AS (
      SELECT q.conv_id, q.turn, q.text AS q, a.text AS a
      FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
      WHERE q.role = 'user' AND a.role = 'assistant'
    )"""


DIALOGUE_SCORE_SQL = f"""
WITH {_pairs_sql()},
w AS (SELECT conv_id, turn, {q.words('q')} AS qw, {q.words('a')} AS aw FROM pairs)
SELECT conv_id, turn, round({q.punish(q.t1('qw', 'aw'))}, 6) AS score FROM w
"""


@register("dialogue_score", "W7 P3 S13 J5 J6 T1 F3 F5 F6 A7", DIALOGUE_SCORE_SQL)
def dialogue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dialogue_scores(spark, sf_dir, "v1")
    return df.select("conv_id", "turn", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- extracted triples (tagged turns)

TURN_TID = "conv_id * 100000 + turn"


def turns_with_triples(spark: SparkSession, sf_dir: str, seed: int = 0) -> DataFrame:
    conv = table(spark, sf_dir, "conversations", spread_on="conv_id")
    return conv.withColumn("triples", tagging.text_triples(F.col("conv_id") * 100000 + F.col("turn"), F.col("text"), seed))


def extracted_pairs(spark: SparkSession, sf_dir: str, fallback: bool = True) -> DataFrame:
    pairs = scoring.pair_turns(turns_with_triples(spark, sf_dir), carry=["triples"])
    if fallback:
        pairs = scoring.with_fallback(pairs, "q_triples", "q")
        pairs = scoring.with_fallback(pairs, "a_triples", "a")
    return pairs


def _extracted_sql(fallback: bool = True) -> str:
    def side(alias: str) -> str:
        t = f"coalesce({alias}_t.triples, [])"
        if fallback:
            return f"CASE WHEN len({t}) = 0 THEN [{q.plain_words(alias + '.text')}] ELSE {t} END"
        return t

    return f"""
    {tagging.sql_text_triples('conversations', TURN_TID)},
    xpairs AS (
      SELECT qc.conv_id, qc.turn, qc.text AS q, ac.text AS a, {side('qc')} AS qtr, {side('ac')} AS atr
      FROM conversations qc JOIN conversations ac ON ac.conv_id = qc.conv_id AND ac.turn = qc.turn + 1
      LEFT JOIN t_triples qc_t ON qc_t.tid = qc.conv_id * 100000 + qc.turn
      LEFT JOIN t_triples ac_t ON ac_t.tid = ac.conv_id * 100000 + ac.turn
      WHERE qc.role = 'user' AND ac.role = 'assistant')"""


def _sql_v1(qt: str, at: str) -> str:
    inner = q.t1(q.words("array_to_string(t1_, ' ')"), q.words("array_to_string(t2_, ' ')"), tag="v1")
    return f"list_avg(list_transform({qt}, lambda t1_: list_max(list_transform({at}, lambda t2_: {inner}))))"


def _sql_elements(triples: str) -> str:
    return f"list_transform(flatten({triples}), lambda e_: {q.plain_words('e_')})"


def _sql_v2(qt: str, at: str) -> str:
    inner = q.t1(q.words("array_to_string(e1_, ' ')"), q.words("array_to_string(e2_, ' ')"), tag="v2")
    best = f"list_transform({_sql_elements(qt)}, lambda e1_: list_max(list_transform({_sql_elements(at)}, lambda e2_: {inner})))"
    k = f"least(len(flatten({qt})), len(flatten({at})))"
    return f"list_avg(list_slice(list_sort({best}, 'DESC'), 1, {k}))"


V1_SQL = f"""
WITH {_extracted_sql()}
SELECT conv_id, turn, len(qtr) AS n_q_triples, len(atr) AS n_a_triples,
       round({q.punish(_sql_v1('qtr', 'atr'))}, 6) AS score FROM xpairs
"""


@register("dialogue_extracted_v1", "E2 P3 P4 S13 W7 J6 T1 A7 F6 H8", V1_SQL)
def dialogue_extracted_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scoring.score_pairs(extracted_pairs(spark, sf_dir), mode="v1")
    return df.select("conv_id", "turn", F.size("q_triples").alias("n_q_triples"),
                     F.size("a_triples").alias("n_a_triples"), F.round("score", 6).alias("score"))


V2_SQL = f"""
WITH {_extracted_sql()}
SELECT conv_id, turn, round({q.punish(_sql_v2('qtr', 'atr'))}, 6) AS score FROM xpairs
"""


@register("dialogue_extracted_v2", "J7 A8 F6", V2_SQL)
def dialogue_extracted_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scoring.score_pairs(extracted_pairs(spark, sf_dir), mode="v2")
    return df.select("conv_id", "turn", F.round("score", 6).alias("score"))


V3_SQL = f"""
WITH {_extracted_sql(fallback=False)}
SELECT conv_id, turn, round({q.punish(
    f"CASE WHEN len(qtr) = 0 OR len(atr) = 0 THEN {q.t1(q.words('q'), q.words('a'), tag='raw')} ELSE {_sql_v2('qtr', 'atr')} END")}, 6) AS score
FROM xpairs
"""


@register("dialogue_extracted_v3", "A9 F5 F22", V3_SQL)
def dialogue_extracted_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = extracted_pairs(spark, sf_dir, fallback=False)
    df = df.withColumn("q_words", tagging_words("q")).withColumn("a_words", tagging_words("a"))
    df = scoring.score_pairs(df, mode="v3", q_words="q_words", a_words="a_words")
    return df.select("conv_id", "turn", F.round("score", 6).alias("score"))


def tagging_words(col: str):
    from triplematch.functions.text import whitespace_words

    return whitespace_words(F.col(col))


GATED_SQL = f"""
WITH {_extracted_sql()}
SELECT conv_id, turn, round(CASE WHEN len(atr[1]) > 3 THEN 0.0 ELSE {q.punish(_sql_v1('qtr', 'atr'))} END, 6) AS score
FROM xpairs
"""


@register("dialogue_gated", "P6 A20", GATED_SQL)
def dialogue_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scoring.score_pairs(extracted_pairs(spark, sf_dir), mode="v1", gate="long")
    return df.select("conv_id", "turn", F.round("score", 6).alias("score"))


HIST_SQL = f"""
WITH {_extracted_sql()},
s AS (SELECT {q.punish(_sql_v1('qtr', 'atr'))} AS score FROM xpairs),
b AS (SELECT CASE WHEN score < 0 THEN -1 ELSE CAST(trunc(score * 10) AS INTEGER) END AS bucket FROM s WHERE score IS NOT NULL),
g AS (SELECT range::INTEGER AS bucket FROM range(-1, 11)),
c AS (SELECT g.bucket, count(b.bucket) AS n FROM g LEFT JOIN b USING (bucket) GROUP BY g.bucket)
SELECT bucket, n, round(n / (SELECT count(*) FROM b), 6) AS ratio FROM c WHERE bucket >= 0 OR n > 0
"""


@register("score_histogram", "A10", HIST_SQL)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scoring.score_pairs(extracted_pairs(spark, sf_dir), mode="v1")
    return scoring.score_histogram(df)


SUMMARY_SQL = f"""
WITH {_extracted_sql()},
s AS (
  SELECT 'v1' AS system, {q.punish(_sql_v1('qtr', 'atr'))} AS score, len(qtr[1]) > 3 OR len(atr[1]) > 3 AS fb FROM xpairs
  UNION ALL
  SELECT 'v2', {q.punish(_sql_v2('qtr', 'atr'))}, len(qtr[1]) > 3 OR len(atr[1]) > 3 FROM xpairs)
SELECT system, count(*) AS n_pairs, count(score) AS n_scored,
       sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) AS n_high,
       round(sum(CASE WHEN score >= 0.6 THEN 1 ELSE 0 END) / count(score), 6) AS high_rate,
       round(sum(score), 6) AS score_sum, round(avg(score), 6) AS score_mean,
       sum(CASE WHEN fb THEN 1 ELSE 0 END) AS n_fallback
FROM s GROUP BY system
"""


@register("score_summary", "A11 A20", SUMMARY_SQL)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = extracted_pairs(spark, sf_dir)
    fb = (F.col("q_triples_is_fallback") | F.col("a_triples_is_fallback")).alias("fallback")
    # one row holds both scores, so the triples are extracted and paired once
    both = scoring.score_pairs(scoring.score_pairs(pairs, mode="v1", out="v1"), mode="v2", out="v2").select("v1", "v2", fb)
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("system"), F.col(m).alias("score")) for m in ("v1", "v2")]))
    return scoring.score_summary(both.select(one.alias("s"), "fallback").select("s.system", "s.score", "fallback"),
                                 by=["system"], fallback="fallback")


# ---------------------------------------------------------------- word vectors (embeddings table)


def conversation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplematch.functions.text import lower_words
    from triplematch.operators import vectors

    words = table(spark, sf_dir, "conversations").select(F.explode(lower_words("text")).alias("word"))
    vocab = vectors.vocabulary(words)
    return write_table(vectors.vectors_from_embeddings(vocab, table(spark, sf_dir, "embeddings")), "vectors")


def _vectors_sql() -> str:
    uv = "list_transform(embedding, lambda e_: CAST(e_ AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda z_: CAST(z_ AS DOUBLE) * CAST(z_ AS DOUBLE)))))"
    low = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w_: w_ <> '')"
    fold = lambda c: f"translate({c}, '{q.ACCENTED}', '{q.STAND_INS}')"
    return f"""
    vw AS (SELECT DISTINCT unnest({low}) AS word FROM conversations),
    vocab AS (SELECT word, row_number() OVER (ORDER BY word) AS word_index FROM vw),
    vv AS (SELECT v.word, {uv} AS u FROM vocab v JOIN embeddings e ON e.vec_id + 1 = v.word_index),
    pp AS (
      SELECT qc.conv_id, qc.turn, {low.replace('text', 'qc.text')} AS qw, {low.replace('text', 'ac.text')} AS aw
      FROM conversations qc JOIN conversations ac ON ac.conv_id = qc.conv_id AND ac.turn = qc.turn + 1
      WHERE qc.role = 'user' AND ac.role = 'assistant'),
    qx AS (SELECT conv_id, turn, unnest(qw) AS w, generate_subscripts(qw, 1) AS i, len(qw) AS nq, len(aw) AS na FROM pp),
    ax AS (SELECT conv_id, turn, unnest(aw) AS w, generate_subscripts(aw, 1) AS j FROM pp),
    m AS (
      SELECT qx.conv_id, qx.turn, qx.i, ax.j, qx.nq, qx.na,
        CASE WHEN u1.u IS NOT NULL AND u2.u IS NOT NULL THEN list_dot_product(u1.u, u2.u)
             ELSE {q.sim(fold('qx.w'), fold('ax.w'))} END AS s
      FROM qx JOIN ax USING (conv_id, turn)
      LEFT JOIN vv u1 ON u1.word = qx.w LEFT JOIN vv u2 ON u2.word = ax.w),
    rowm AS (SELECT conv_id, turn, i, max(s) AS v, any_value(least(nq, na)) AS k FROM m GROUP BY ALL),
    colm AS (SELECT conv_id, turn, j, greatest(0.0, max(s)) AS v, any_value(least(nq, na)) AS k FROM m GROUP BY ALL),
    la AS (SELECT conv_id, turn, avg(v) AS la FROM (
             SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC) AS r FROM rowm) WHERE r <= k GROUP BY ALL),
    lb AS (SELECT conv_id, turn, avg(v) AS lb FROM (
             SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC) AS r FROM colm) WHERE r <= k GROUP BY ALL)"""


VECTORS_SQL = f"""
WITH {_vectors_sql()}
SELECT pp.conv_id, pp.turn, round({q.punish('(la.la + lb.lb) / 2.0')}, 6) AS score
FROM pp LEFT JOIN la USING (conv_id, turn) LEFT JOIN lb USING (conv_id, turn)
"""


@register("dialogue_vectors", "J4 J14 F4 H6 W1 T1 A7", VECTORS_SQL)
def dialogue_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triplematch.functions.similarity import punish
    from triplematch.functions.text import lower_words
    from triplematch.operators import vectors

    pairs = scoring.pair_turns(table(spark, sf_dir, "conversations"))
    pairs = pairs.select("conv_id", "turn", lower_words("q").alias("qw"), lower_words("a").alias("aw"))
    scored = vectors.score_with_vectors(pairs, ["conv_id", "turn"], F.col("qw"), F.col("aw"), conversation_vectors(spark, sf_dir),
                                        lambda best: punish(F.get(best(F.array("qw"), F.array("aw")), 0)), "score")
    return scored.select("conv_id", "turn", F.round("score", 6).alias("score"))


# The extracted triples scored with vectors (H6 in A7-A9). The oracle looks both words up for every word pair.


def _vector_scores_sql(score: str, fallback: bool = True) -> str:
    uv = "list_transform(embedding, lambda e_: CAST(e_ AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda z_: CAST(z_ AS DOUBLE) * CAST(z_ AS DOUBLE)))))"
    pair = q.sim("@x", "@y")
    looked_up = score
    for tag in ("v1", "v2", "raw"):
        x, y = f"x{tag}_", f"y{tag}_"
        edit = pair.replace("@x", x).replace("@y", y)
        looked_up = looked_up.replace(edit, f"(CASE WHEN vm[{x}] IS NOT NULL AND vm[{y}] IS NOT NULL THEN list_dot_product(vm[{x}], vm[{y}]) ELSE {edit} END)")
    return f"""
    WITH {_extracted_sql(fallback)},
    vw AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w_: w_ <> '')) AS word FROM conversations),
    vocab AS (SELECT word, row_number() OVER (ORDER BY word) AS word_index FROM vw),
    vm AS MATERIALIZED (
      SELECT map(list(translate(word, '{q.ACCENTED}', '{q.STAND_INS}') ORDER BY word), list({uv} ORDER BY word)) AS vm
      FROM vocab JOIN embeddings e ON e.vec_id + 1 = word_index)
    SELECT conv_id, turn, round({q.punish(looked_up)}, 6) AS score FROM xpairs, vm"""


def _vector_scores(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    df, extra = extracted_pairs(spark, sf_dir, fallback=mode != "v3"), {}
    if mode == "v3":
        df = df.withColumn("q_words", tagging_words("q")).withColumn("a_words", tagging_words("a"))
        extra = {"q_words": "q_words", "a_words": "a_words"}
    df = scoring.score_pairs(df, mode=mode, vectors=conversation_vectors(spark, sf_dir), key=["conv_id", "turn"], **extra)
    return df.select("conv_id", "turn", F.round("score", 6).alias("score"))


@register("dialogue_vectors_v1", "H6 A7 F4 J4 J6", _vector_scores_sql(_sql_v1("qtr", "atr")))
def dialogue_vectors_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_scores(spark, sf_dir, "v1")


@register("dialogue_vectors_v2", "H6 A8 F4 J4 J7", _vector_scores_sql(_sql_v2("qtr", "atr")))
def dialogue_vectors_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_scores(spark, sf_dir, "v2")


@register("dialogue_vectors_v3", "H6 A9 F4 J4", _vector_scores_sql(
    f"CASE WHEN len(qtr) = 0 OR len(atr) = 0 THEN {q.t1(q.words('q'), q.words('a'), tag='raw')} ELSE {_sql_v2('qtr', 'atr')} END", False))
def dialogue_vectors_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_scores(spark, sf_dir, "v3")


# ---------------------------------------------------------------- triple files (K1 -> S15)

TRIPLE_FILE_SQL = f"""
WITH {_extracted_sql()},
lines AS (
  SELECT conv_id, turn, q || chr(9) || array_to_string(list_transform(qtr, lambda t_: array_to_string(t_, '|||')), '*#*') AS line
  FROM xpairs),
parsed AS (
  SELECT conv_id, turn, line,
         list_transform(string_split(trim(split_part(line, chr(9), 2)), '*#*'), lambda s_: string_split(s_, '|||')) AS keep
  FROM lines)
SELECT conv_id, turn, md5(line) AS line_md5,
       len(keep) AS n_triples,
       len(list_filter(keep, lambda t_: len(list_filter(t_, lambda e_: e_ <> '')) > 3)) AS n_long,
       list_sum(list_transform(keep, lambda t_: len(list_filter(t_, lambda e_: e_ = '')))) AS n_empty
FROM parsed
"""


@register("triple_file", "K1 S15 A20 P3", TRIPLE_FILE_SQL)
def triple_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 lines for the question side (text + extracted or fallback triples), parsed back by S15."""
    from triplematch.sources import readers, sinks

    pairs = extracted_pairs(spark, sf_dir)
    lines = pairs.select("conv_id", "turn", F.concat_ws("\t", "q", sinks.triples_text("q_triples")).alias("line"))
    raw = F.coalesce(F.get(F.split("line", "\t"), 1), F.lit(""))
    keep = readers.cut_triples(raw, "keep_empty")
    dropped = readers.cut_triples(raw, "drop_empty")
    return lines.select(
        "conv_id", "turn", F.md5("line").alias("line_md5"), F.size(keep).alias("n_triples"),
        F.size(F.filter(dropped, lambda t: F.size(t) > 3)).alias("n_long"),
        F.aggregate(keep, F.lit(0).cast("bigint"), lambda acc, t: acc + F.size(F.filter(t, lambda e: e == ""))).alias("n_empty"))
