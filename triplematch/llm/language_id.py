"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14      # rows of the embedding table
DIM = 16
PER_LANGUAGE = 1200    # expected bound of training documents per language (whole texts)
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)             # ASCII letters to lower case, other ASCII to blank
_FOLD[:128] = 32
for _c in range(26):
    _FOLD[97 + _c] = _FOLD[65 + _c] = 97 + _c


def subwords(text: str) -> np.ndarray:
    """Hashed ids of all 2-, 3- and 4-byte grams of the whole text, ASCII-folded, word edges as blanks."""
    b = _FOLD[np.frombuffer((" " + text + " ").encode("utf-8", "replace"), np.uint8)]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)      # one blank between words
    c = b[keep].astype(np.uint32)
    if len(c) < 4:
        c = np.concatenate((c, np.full(4 - len(c), 32, np.uint32)))
    two = (c[:-1] << np.uint32(8)) | c[1:]
    three = (two[:-1] << np.uint32(8)) | c[2:]
    four = (three[:-1] << np.uint32(8)) | c[3:]
    shift = np.uint32(32 - 14)
    return np.concatenate(((two * np.uint32(0x9E3779B1)) >> shift, (three * np.uint32(0x85EBCA6B)) >> shift,
                           (four * np.uint32(0xC2B2AE35)) >> shift))


@dataclass
class Model:
    """``table`` is embeddings times softmax weights: the mean of its rows over a text's subwords, plus ``bias``,
    are the logits. That product is exact, since averaging and the softmax's linear part commute."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        counts = np.bincount(subwords(text), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        z = (counts[used] @ self.table[used] / counts.sum() + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.reject_below)


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 0.5, seed: int = 7,
        precision: float = 0.99) -> Model:
    """SGD over (language, subword ids, counts). A tenth of the examples is held back: on it the temperature is
    chosen by likelihood, and the rejection threshold as the lowest score from which accepted predictions reach
    ``precision``."""
    languages = sorted({e[0] for e in examples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(e[0]) for e in examples])
    order = rng.permutation(len(examples))
    n_cal = len(examples) // 10
    cal, train = order[:n_cal], order[n_cal:]
    share = np.bincount(y[train], minlength=len(languages)).astype(float)
    weight = np.where(share > 0, share.mean() / np.maximum(share, 1), 0)[y]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            x[i, examples[r][1]] = examples[r][2] / examples[r][2].sum()
        return x

    emb = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        rng.shuffle(train)
        step = rate * (1 - epoch / epochs)
        for a in range(0, len(train), 32):
            rows = train[a:a + 32]
            x = dense(rows)
            h = x @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = (p * weight[rows, None] / len(rows)).astype(np.float32)
            back = g @ out.T
            out -= step * 20 * (h.T @ g)
            bias -= step * g.sum(0)
            emb -= step * 200 * (x.T @ back)
    table = (emb @ out).astype(np.float64)
    if len(cal) == 0:
        return Model(languages, table, bias.astype(np.float64), 1.0, 0.0)
    z = dense(cal).astype(np.float64) @ table + bias

    def softmax(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    grid = np.geomspace(0.02, 20, 60)
    losses = [-np.log(np.maximum(softmax(t)[np.arange(len(cal)), y[cal]], 1e-12)).mean() for t in grid]
    best = float(grid[int(np.argmin(losses))])
    p = softmax(best)
    score, right = p.max(1), p.argmax(1) == y[cal]
    by = np.argsort(-score)
    reached = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= precision
    reject = float(score[by][np.flatnonzero(reached)[-1]]) if reached.any() else 1.0
    return Model(languages, table, bias.astype(np.float64), best, reject)


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the rows of ``docs`` where ``learn`` holds, lang is not null and the text has a letter.

    Training rows are a sample: per language about ``per_language`` documents, picked by a hash of doc_id (all if
    there are fewer), each with its whole text. Counting languages is one map-side aggregation. The subword counts
    of the sample go to one task that trains; the bound on the sample bounds that task. Only the model returns.
    """
    pool = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    share = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("lang").alias("_lang"), (F.lit(float(per_language)) / F.col("n")).alias("_share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row per language to learn, as the model itself has: small, and a join by shuffle would deal out all texts
    # by language
    sample = pool.join(F.broadcast(share), (F.col("lang") == F.col("_lang")) & (draw < F.col("_share"))).select("doc_id", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.unique(subwords(t), return_counts=True) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in ids], pa.binary()),
                 pa.array([n.astype("<i4").tobytes() for _, n in ids], pa.binary())], ["doc_id", "lang", "ids", "counts"])

    def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort(key=lambda r: (r[0], r[1]))
        if rows:
            model = fit([(r[1], np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = (sample.mapInArrow(features, "doc_id long, lang string, ids binary, counts binary")
              .repartition(1).mapInArrow(learner, "model binary").collect())
    return pickle.loads(fitted[0][0]) if fitted else fit([])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row with a doc_id: doc_id, lang_pred, score, accepted.

    ``score`` is the calibrated probability of the predicted language; ``accepted`` is false where it is below the
    rejection threshold. A null text, or one without any letter, is ``und`` with score 0. Repeated rows are
    predicted each; a tie goes to the language that sorts first. Only the text is an input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
