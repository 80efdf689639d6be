"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 3000         # expected bound of training documents per label (whole texts)
PREFIXES = (4, 5, 6, 7)  # lengths of word beginnings that may enter the lexicon, besides whole words
COVER = 3                # a toxic training document counts as covered when this many entries hit it

# Letters of other scripts that look like Latin ones, digits and signs written for letters, and
# invisible characters. 1, l, i and | fold into one letter, as writers use them for one another.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
              "ӏ": "i", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
              "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "i", "ⅰ": "i"}
SIGNS = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a harsh word is harmless, besides those learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "sore loser")

_TABLE = {ord(k): v for k, v in (HOMOGLYPHS | SIGNS).items()}
_TABLE |= {ord(c): None for c in INVISIBLE}
for _i in range(26):                                     # full-width letters and digits
    _TABLE[0xFF41 + _i] = _TABLE.get(97 + _i, chr(97 + _i))
for _i in range(10):
    _TABLE[0xFF10 + _i] = SIGNS.get(str(_i), str(_i))
_LOOSE = re.compile(r"[$@](?!\w)")                       # signs that stand for no letter: nothing follows
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Lower case, look-alikes and digit substitutions folded, one blank around every word."""
    s = _LOOSE.sub(" ", (text or "").lower()).translate(_TABLE)
    return f" {_GAP.sub(' ', s).strip()} "


@dataclass
class Model:
    lexicon: dict[str, float]                            # pattern (a blank marks a word edge) -> weight
    exceptions: list[str]
    beta: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))
    _machine: object = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            m = ahocorasick.Automaton()
            for p, w in self.lexicon.items():
                m.add_word(p, (len(p), w))
            for p in self.exceptions:
                if p not in self.lexicon:
                    m.add_word(p, (len(p), None))
            m.make_automaton()
            self._machine = m
        return self._machine

    def features(self, text: str | None) -> tuple[float, float, float]:
        """1, log of the summed weights, log of the summed weights per hundred words. Of the entries that begin at
        one word the heaviest counts once; hits inside an exception phrase don't count."""
        s = fold(text)
        total = 0.0
        if self.lexicon:
            found: dict[int, float] = {}
            spared: list[tuple[int, int]] = []
            for end, (n, w) in self.machine().iter(s):
                start = end - n + 1
                if w is None:
                    spared.append((start, end))
                else:
                    found[start] = max(w, found.get(start, 0.0))
            total = 0.0
            sweep, reach = iter(sorted(spared)), -1            # spared phrases by start, and how far those begun reach
            begun = next(sweep, None)
            for at, w in sorted(found.items()):
                while begun and begun[0] <= at:
                    reach, begun = max(reach, begun[1]), next(sweep, None)
                if at >= reach:
                    total += w
        words = s.count(" ") - 1
        return 1.0, float(np.log1p(total)), float(np.log1p(100 * total / (max(words, 0) + 10)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -35, 35)))


def entries(words: set[str]) -> set[str]:
    """The lexicon entries that a document with these distinct folded words would support."""
    out = {f" {w} " for w in words if len(w) >= 3}
    for n in PREFIXES:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


def fit(texts: list[str], labels: list[int], min_odds: float = 2.0) -> Model:
    """Chooses entries and weights, then calibrates.

    An entry's weight is the smoothed log odds of its document frequencies in the two classes; those below
    ``min_odds`` are out. Entries are taken greedily by how many toxic documents they newly cover (COVER times
    each), ties to fewer clean documents, then to the longer entry, until a new entry would cover under half a
    percent. So copies of one toxic text, whose every word looks toxic, add nothing once it is covered. Two-word
    phrases around an entry that occur in at least two clean documents and no toxic one become exceptions.
    """
    distinct = {}
    for t, y in zip(texts, labels):
        distinct[fold(t), y] = t
    folded, ys = [k[0] for k in distinct], np.array([k[1] for k in distinct], int)
    raw = list(distinct.values())
    n1, n0 = int(ys.sum()), int((1 - ys).sum())
    model = Model({}, [])
    if not n1 or not n0:
        return model
    toxic, clean = Counter(), Counter()
    sets = [entries(set(s.split())) for s in folded]
    for e, y in zip(sets, ys):
        if y:
            toxic.update(e)
    least = max(3, round(0.005 * n1))
    often = {e for e, n in toxic.items() if n >= min(least, n1)}
    for e, y in zip(sets, ys):
        if not y:
            clean.update(e & often)

    def odds(e: str) -> float:
        return float(np.log((toxic[e] + 0.5) / (n1 + 1)) - np.log((clean[e] + 0.5) / (n0 + 1)))

    good = {e: odds(e) for e in often if odds(e) >= min_odds}
    where: dict[str, list[int]] = {e: [] for e in good}
    for i, (e, y) in enumerate(zip(sets, ys)):
        if y:
            for x in e & good.keys():
                where[x].append(i)
    need = np.where(ys == 1, COVER, 0)
    while where:
        gain = {e: int((need[i] > 0).sum()) for e, i in where.items()}
        best = max(gain, key=lambda e: (gain[e], -clean[e], len(e), e))
        if gain[best] < least:
            break
        model.lexicon[best] = good[best]
        need[where.pop(best)] -= 1
        where = {e: i for e, i in where.items() if gain[e] >= least and not e.startswith(best.rstrip() if not best.endswith(" ") else best)}
    known = {f" {fold(p).strip()} " for p in EXCEPTIONS}
    starts = tuple(model.lexicon)
    phrases: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for s, y in zip(folded, ys):
        ws = s.split()
        marked = [i for i, w in enumerate(ws) if f" {w} ".startswith(starts)] if starts else []
        phrases[int(y)].update({f" {a} {b} " for i in marked for a, b in
                                ([(ws[i - 1], ws[i])] if i else []) + ([(ws[i], ws[i + 1])] if i + 1 < len(ws) else [])})
    known |= {p for p, n in phrases[0].items() if n >= 2 and not phrases[1][p]}
    model.exceptions = sorted(known)
    x = np.array([model.features(t) for t in raw])
    beta = np.array([-2.0, 1.0, 1.0])
    w = np.where(ys == 1, 0.5 * len(ys) / n1, 0.5 * len(ys) / n0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        g = x.T @ (w * (p - ys)) + 0.1 * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        beta = beta - np.clip(np.linalg.solve(h, g), -2, 2)
    model.beta = beta
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled rows where ``learn`` (of doc_id) holds. A doc_id labelled both ways is toxic.

    Training rows are a sample: about ``per_class`` documents of each label, picked by a hash of doc_id (all if
    there are fewer), with whole texts. The labels table is narrow and is sampled before it meets the texts; the
    sample is bounded by ``per_class``, which is why its ids may be broadcast and one task may train.
    """
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
           .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    share = {r["y"]: per_class / r["count"] for r in lab.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = lab.filter((draw < F.lit(float(share.get(1, 0)))) & (F.col("y") == 1)
                        | (draw < F.lit(float(share.get(0, 0)))) & (F.col("y") == 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(
        F.broadcast(picked), "doc_id").select("doc_id", "text", "y")

    def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1] or ""))
        if got:
            model = fit([r[1] for r in got], [r[2] for r in got])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = rows.repartition(1).mapInArrow(learner, "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else Model({}, [])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold), one row per input row with a doc_id.

    Null and empty texts hold no words and get the score of a text without hits. Repeated rows are scored each.
    Only the text is an input. Row-local: no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept. Rows without a doc_id go."""
    @F.pandas_udf("double")
    def toxic_score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return docs.filter(F.col("doc_id").isNotNull() & (toxic_score(F.col("text").cast("string")) < F.lit(threshold)))
