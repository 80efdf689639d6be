"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplematch.llm.common import cut

# Byte classes counted in one pass over the text.
_CLASSES = ["lower", "upper", "digit", "blank", "line", "sentence", "comma", "bar", "bang", "symbol", "high"]
_CLASS = np.zeros((256, len(_CLASSES)))
for _b in range(256):
    _ch = chr(_b)
    _k = ("high" if _b >= 128 else "lower" if "a" <= _ch <= "z" else "upper" if "A" <= _ch <= "Z" else
          "digit" if _ch.isdigit() else "line" if _ch == "\n" else "blank" if _ch in " \t\r\x0b\f" else
          "sentence" if _ch == "." else "comma" if _ch in ",;:" else "bar" if _ch == "|" else
          "bang" if _ch in "!?" else "symbol")
    _CLASS[_b, _CLASSES.index(_k)] = 1

FEATURES = [*_CLASSES, "log_bytes", "word_length", "distinct_words", "top_word", "short_words", "long_words",
            "repeated_lines", "line_words", "capital_words", "marked_words"]


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of the whole text: class shares as log odds, counts as logarithms, all of order 1.
    Every denominator has a one added, so that an empty text has values too."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    n = len(raw)
    words = raw.split()
    m = len(words)
    tally = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, m)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    firsts = [w[0] for w in words]
    lasts = np.frombuffer(bytes([w[-1] for w in words]), np.uint8)

    def odds(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (whole - part + 0.5)))

    other = [np.log1p(n), np.log((n + 1) / (m + 1)), odds(len(tally), m), odds(max(tally.values(), default=0), m),
             odds(int((sizes <= 2).sum()), m), odds(int((sizes >= 14).sum()), m),
             odds(len(lines) - len(set(lines)), len(lines)), np.log((m + 1) / (len(lines) + 1)),
             odds(sum(65 <= f <= 90 for f in firsts), m),
             odds(float(_CLASS[lasts][:, [_CLASSES.index("bang"), _CLASSES.index("symbol")]].sum()) if m else 0.0, m)]
    return np.concatenate(([odds(c, n) for c in counts], other))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text, one row per input row with a doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [statistics(t) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(xs) if xs else np.zeros(0), pa.float64())
            at = pa.array(np.arange(len(xs) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, flat)], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Per class the mean, the inverse Cholesky factor of its shrunk covariance (cached) and the log determinant."""

    means: list[np.ndarray]
    inverse_factors: list[np.ndarray]
    log_dets: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, for rows of statistics."""
        if len(self.means) < 2:
            return np.zeros(len(x))
        d = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * ld
             for m, f, ld in zip(self.means, self.inverse_factors, self.log_dets)]
        return squash(d[1] - d[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_ratio(x) + self.offset, -35, 35)))


def squash(r: np.ndarray) -> np.ndarray:
    """Signed logarithm: keeps the order of log ratios and bounds the leverage of far outliers."""
    return np.sign(r) * np.log1p(np.abs(r))


def train(stats: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", shrink: float = 0.1,
          ridge: float = 1e-3) -> Discriminant:
    """Fits the discriminant on all labelled rows where ``learn`` (of doc_id) holds.

    Tasks emit their class counts, sums and outer products; Spark adds them up element by element, so what
    reaches the driver is two classes of fixed size whatever the input. The class covariances shrink towards the
    pooled diagonal. A second such pass bins the log ratios per class (fixed bins) and a logistic curve over the
    bins calibrates the score. Labels other than 0 and 1 and null labels are left out; with fewer than two
    classes, or fewer than two rows in one, every score is the share of class 1 (one half without rows).
    """
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
           .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn).dropDuplicates(["doc_id", "y"]))
    rows = cut(stats.join(lab, "doc_id").select("y", "x"))
    p = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
        for batch in batches:
            y = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(-1, p)
            for c in (0, 1):
                part = x[y == c]
                n[c] += len(part)
                s[c] += part.sum(0)
                q[c] += part.T @ part
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1]), pa.array([np.concatenate(([n[c]], s[c], q[c].ravel())).tolist() for c in (0, 1)],
                                        pa.list_(pa.float64()))], ["y", "m"])

    added = (rows.mapInArrow(moments, "y long, m array<double>").select("y", F.posexplode("m").alias("k", "v"))
             .groupBy("y", "k").agg(F.sum("v").alias("v")).collect())     # 2 * (1 + p + p * p) numbers
    m = np.zeros((2, 1 + p + p * p))
    for r in added:
        m[r["y"], r["k"]] = r["v"]
    n = m[:, 0]
    if n.min() < 2:
        prior = (n[1] + 1) / (n.sum() + 2)
        return Discriminant([], [], [], 0.0, float(np.log(prior / (1 - prior))))
    means = [m[c, 1:1 + p] / n[c] for c in (0, 1)]
    covs = [m[c, 1 + p:].reshape(p, p) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = sum(n[c] * np.diag(covs[c]) for c in (0, 1)) / n.sum()
    model = Discriminant(means, [], [])
    for c in (0, 1):
        cov = (1 - shrink) * covs[c] + np.diag(shrink * pooled + ridge)
        factor = np.linalg.cholesky(cov)
        model.inverse_factors.append(np.linalg.solve(factor, np.eye(p)))
        model.log_dets.append(2 * float(np.log(np.diag(factor)).sum()))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = model.log_ratio(np.asarray(batch.column(1).flatten()).reshape(-1, p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(np.round(r * 10), -200, 200).astype(np.int64))], ["y", "bin"])

    bins = rows.mapInArrow(binned, "y int, bin long").groupBy("y", "bin").count().collect()   # at most 802 rows
    model.slope, model.offset = logistic(np.array([r["bin"] / 10 for r in bins]), np.array([r["y"] for r in bins]),
                                         np.array([r["count"] for r in bins], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted one-variable logistic regression by Newton steps with a small ridge."""
    a = np.stack((x, np.ones_like(x)), 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -35, 35)))
        g = a.T @ (w * (q - y)) + 1e-3 * beta
        h = (a * (w * q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        beta = beta - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score(stats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) for every row of statistics."""
    p = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.asarray(batch.column(1).flatten()).reshape(-1, p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row with a doc_id. Null and empty texts are scored like any text.

    The statistics of all texts are computed once and written to the shared checkpoint folder (about 170 bytes a
    document); training and scoring read those. Repeated rows are scored each. Empty input: no rows.
    """
    stats = cut(document_statistics(docs))
    return score(stats, train(stats, labels, learn), threshold)
