"""Text quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its
score: P(grade <= k) = sigmoid(threshold k - score).  Features are words, word shapes, and bucketed
measures of repetition, all hashed.  The model is fitted on the driver from a bounded sample
(PER_GRADE rows a grade); scoring reads every text in full, once, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .toxicity import fold

PER_GRADE = 2000
BUCKETS, EPOCHS, BATCH, RATE, SEED = 1 << 16, 12, 32, 0.1, 3
#: The tail that selects: P(grade >= SELECT) >= TAIL.
SELECT, TAIL = 1, 0.5
REMEMBERED = 300_000

_MARKS = re.compile(r"[^\w\s]")


def _bucket(kind: str, x: str) -> int:
    return zlib.crc32(f"{kind}\0{x}".encode("utf-8", "surrogatepass")) % BUCKETS


def shape(word: str) -> str:
    """Case and classes of a word's characters, runs shortened: "Thedn***" → "Xx*2"."""
    letters = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    out = re.sub(r"X{2,}", "XX", re.sub(r"x+", "x", re.sub(r"9+", "9", letters)))
    return re.sub(r"([^\w\s])\1+", r"\g<1>2", out)


class Pairs(dict):
    """Word → number; `rows` has its word and shape buckets."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int]] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.rows)
        self.rows.append((_bucket("word", word.lower()), _bucket("shape", shape(word))))
        return n


def measures(text: str, ids: np.ndarray) -> list[int]:
    """Buckets of what a whole text shows: repeated words and lines, marks, length."""
    n = max(1, len(ids))
    lines = text.split("\n")
    found = {
        "same": int(20 * float((ids[1:] == ids[:-1]).sum()) / n),
        "distinct": int(10 * len(np.unique(ids)) / n),
        "lines": int(10 * len(set(lines)) / len(lines)),
        "length": min(14, n.bit_length()) if len(ids) else -1,
        "marks": min(20, int(10 * len(_MARKS.findall(text)) / n)),
        "letters": int(len(text) / n) if n > 1 else 0,
    }
    return [_bucket(k, str(min(v, 40))) for k, v in found.items()]


def features(text: str, known: Pairs) -> tuple[np.ndarray, list[int]]:
    words = text.split()
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return ids, measures(text, ids)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every k but the last."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def fit(sample: list[tuple[str, int]], grades: int, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adagrad on the negative log likelihood of the grades, grades in equal numbers."""
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(BUCKETS), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1))
    by = [b for g in range(grades) if (b := [i for i, (_, y) in enumerate(sample) if y == g])]
    if len(by) < 2:
        return model
    known = Pairs()
    docs = []
    for text, _ in sample:
        ids, extra = features(text, known)
        rows = np.array([known.rows[i] for i in ids.tolist()], np.int64).reshape(-1, 2)
        at, n = np.unique(rows.ravel(), return_counts=True)
        docs.append((np.concatenate([at, extra]).astype(np.int64), np.concatenate([n / max(1, len(ids)), np.ones(len(extra))])))
    seen, seen_t = np.full(BUCKETS, 1e-3), np.full(grades - 1, 1e-3)
    for _ in range(epochs):
        order = np.concatenate([np.resize(rng.permutation(b), max(map(len, by))) for b in by])
        rng.shuffle(order)
        for i in order.tolist():
            (at, x), y = docs[i], sample[i][1]
            f = model.below(np.array([model.weights[at] @ x]))[0]
            f = np.concatenate([[0.0], f, [1.0]])
            slope, p = f * (1 - f), max(f[y + 1] - f[y], 1e-9)
            g = (slope[y + 1] - slope[y]) / p
            np.add.at(seen, at, (g * x) ** 2)
            np.add.at(model.weights, at, -RATE * g * x / np.sqrt(seen[at]))
            t = np.zeros(grades + 1)
            t[y + 1] -= slope[y + 1] / p
            t[y] += slope[y] / p
            seen_t += t[1:-1] ** 2
            model.thresholds = np.maximum.accumulate(model.thresholds - RATE * t[1:-1] / np.sqrt(seen_t))
    return model


def grade(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 bad quality, 1 good but toxic, 2 good.  Rows without a quality of 0 or 1 have no grade."""
    y = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", y.alias("grade")).where("grade is not null")


def train(docs: DataFrame, graded: DataFrame, grades: int = 3, per_grade: int = PER_GRADE) -> Model:
    """Fits on at most per_grade rows of each grade, by the hash of doc_id and without the held-out third."""
    own = graded.where((fold(F.col("doc_id")) != 1) & F.col("grade").between(0, grades - 1))
    picked = own.where("grade = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
    for g in range(1, grades):
        picked = picked.unionByName(own.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade))
    few = picked.dropDuplicates(["doc_id"])  # grades * per_grade rows at most
    rows = texts(docs).join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(grades * per_grade).collect()
    return fit([(r["text"], r["grade"]) for r in rows], grades)


def score(docs: DataFrame, model: Model, select: int = SELECT, tail: float = TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail, kept) per row of docs: the mean grade, P(grade >= select), and whether it reaches `tail`.

    A null or empty text is scored by its measures alone; repeated rows score alike; other columns
    are left out; an empty table gives an empty one.
    """

    def run(batches):
        known, weights = Pairs(), np.zeros(0)
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 64):
                if len(known.rows) > REMEMBERED:
                    known, weights = Pairs(), np.zeros(0)
                own = [features(x.as_py(), known) for x in batch.column(1).slice(lo, 64)]
                if len(known.rows) > len(weights):
                    weights = np.concatenate([weights, model.weights[np.array(known.rows[len(weights) :], np.int64)].sum(1)])
                out += [(weights[ids].sum() / len(ids) if len(ids) else 0.0) + model.weights[extra].sum() for ids, extra in own]
            above = 1 - model.below(np.array(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(above[:, select - 1])], ["doc_id", "expected_grade", "tail"])

    return texts(docs).mapInArrow(run, "doc_id long, expected_grade double, tail double").withColumn("kept", F.col("tail") >= tail)
