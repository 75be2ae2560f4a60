"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings.  Filters of
several widths slide over the whole text, the maximum of each over all places feeds a logistic
output.  The model is fitted on the driver from a bounded sample of labelled rows (PER_LABEL a
label, taken by the hash of doc_id); scoring reads every text in full, once, without a shuffle.
Thresholds by language are calibrated on all labelled rows that the fit hasn't seen, by a histogram
of their scores; the score itself knows text only.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, trimmed

#: Labelled rows of each label that the fit may read.
PER_LABEL = 3000
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 18, 8, 6, (1, 2, 3)
#: Beginnings of a word that share weights between its forms.
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.05, 7
#: Batches of the shortest fit: small samples take more epochs.
LEAST_BATCHES = 400
#: Documents of the sample that a bucket must stand in to have an embedding: what only one holds says nothing of others.
LEAST_DOCS = 3
#: Share of the log odds that embeddings start with.
ODDS = 0.2
PREDICT = 0.7
#: One labelled row in so many is never fitted, so that small tables have rows to calibrate with.
CALIBRATE = 6
#: Ranges of scores that thresholds are chosen from.
BINS = 1000
#: Labelled rows that may be broadcast; beyond it all texts are scored and the scores joined by a shuffle.
BROADCAST_IDS = 500_000
#: Words that a task remembers: workers stay, and with them what they hold, beside those of other stages.
REMEMBERED = 60_000

_WORD = re.compile(r"\w+")


def buckets(word: str) -> list[int]:
    raw = word.encode("utf-8", "surrogatepass")
    return [zlib.crc32(raw, 1) % (BUCKETS - 1) + 1, *(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % (BUCKETS - 1) + 1 if len(word) >= n else 0 for n in PREFIXES)]


class Words(dict):
    """Word → its number; `rows` has the buckets of each, from number 0 or from where they were last taken out.

    Number 0 stands for no word.
    """

    def __init__(self):
        super().__init__()
        self.rows = [[0] * (1 + len(PREFIXES))]

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        self.rows.append(buckets(word))
        return n

    def of(self, text: str) -> np.ndarray:
        """Numbers of a text's words, then as many of no word as the widest filter reaches beyond the last."""
        own = _WORD.findall(text.lower())
        out = np.zeros(max(1, len(own)) + max(WIDTHS) - 1, np.int32)
        out[: len(own)] = np.fromiter(map(self.__getitem__, own), np.int32, len(own))
        return out


@dataclass
class Model:
    embeddings: np.ndarray
    filters: list[np.ndarray]  # by width: width x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def projected(self, rows: np.ndarray) -> np.ndarray:
        """What each word adds at each tap of each filter."""
        taps = np.concatenate([f.transpose(1, 0, 2).reshape(SIZE, -1) for f in self.filters], 1)
        return (self.embeddings[rows].sum(1) @ taps).astype(np.float32)

    def score(self, words: np.ndarray, starts: np.ndarray, projected: np.ndarray) -> np.ndarray:
        """Scores of texts that stand one after the other in `words`, each from its start."""
        ends = np.append(starts[1:], len(words)) - (max(WIDTHS) - 1)
        step, place = np.ones(len(words), bool), []
        for k in range(max(WIDTHS) - 1):
            step[ends + k] = False
        at = np.flatnonzero(step)
        bounds = np.searchsorted(at, starts)
        column = 0
        for width in WIDTHS:
            z = projected[words[at], column : column + FILTERS].copy()
            column += FILTERS
            for k in range(1, width):
                z += projected[words[at + k], column : column + FILTERS]
                column += FILTERS
            place.append(np.maximum.reduceat(z, bounds, 0))
        h = np.maximum(np.concatenate(place, 1) + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.out + self.shift, -30, 30)))


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adagrad over balanced batches; the gradient of a maximum goes to the place that holds it."""
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    model = Model(np.zeros((BUCKETS, SIZE), np.float32), [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS], np.full(n, 0.01, np.float32), rng.uniform(0.2, 0.6, n).astype(np.float32) * np.where(np.arange(n) % 3 == 2, -1, 1), 0.0)
    by = [[i for i, (_, y) in enumerate(sample) if y == v] for v in (0, 1)]
    if not by[0] or not by[1]:
        model.shift = 3.0 if by[1] else -3.0
        return model
    known = Words()
    docs = [known.of(t) for t, _ in sample]
    rows = np.array(known.rows, np.int32)
    held = np.zeros((2, BUCKETS))
    for own, (_, y) in zip(docs, sample):
        held[y, np.unique(rows[own])] += 1
    rare = held.sum(0) < LEAST_DOCS
    rare[0] = True
    # The first component starts as the log odds of a label by the documents that hold the bucket, the others at 0.
    odds = np.log((held[1] + 1) / (len(by[1]) + 2)) - np.log((held[0] + 1) / (len(by[0]) + 2))
    model.embeddings[:, 0] = np.where(rare, 0, ODDS * odds)
    for f in model.filters:
        f[0, 0] = np.abs(f[0, 0])
    epochs = max(epochs, -(-LEAST_BATCHES * BATCH // (2 * max(map(len, by)))))
    seen = [np.full(x.shape, 1e-2, np.float32) for x in (*model.filters, model.bias, model.out)]
    seen_e, seen_s = np.full(BUCKETS, 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = np.concatenate([rng.permutation(np.resize(rng.permutation(b), max(map(len, by)))) for b in by]).reshape(2, -1).T.ravel()
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            y = np.array([sample[i][1] for i in own], np.float32)
            words = np.concatenate([docs[i] for i in own])
            starts = np.cumsum([0, *(len(docs[i]) for i in own)])[:-1]
            ends = np.append(starts[1:], len(words)) - (max(WIDTHS) - 1)
            x = model.embeddings[rows[words]].sum(1)
            pooled, places = [], []
            for f, width in zip(model.filters, WIDTHS):
                z = x @ f[0]
                for k in range(1, width):
                    z[:-k] += x[k:] @ f[k]
                top = np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, ends)])
                places.append(top)
                pooled.append(np.take_along_axis(z, top, 0))
            a = np.concatenate(pooled, 1) + model.bias
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.shift, -30, 30)))
            g = (p - y) / len(own)
            da = np.outer(g, model.out) * (a > 0)
            grads: list[np.ndarray] = []
            touched, values = [], []
            for j, (f, width, top) in enumerate(zip(model.filters, WIDTHS, places)):
                d = da[:, j * FILTERS : (j + 1) * FILTERS]
                df = np.empty_like(f)
                for k in range(width):
                    df[k] = np.einsum("bf,bfd->df", d, x[top + k])
                    touched.append(rows[words[top + k]].reshape(-1, rows.shape[1]))
                    values.append((d[:, :, None] * f[k].T).reshape(-1, SIZE))
                grads.append(df)
            grads += [da.sum(0), h.T @ g]
            for w, s, d in zip((*model.filters, model.bias, model.out), seen, grads):
                s += d * d
                w -= RATE * d / np.sqrt(s)
            gs = float(g.sum())
            seen_s += gs * gs
            model.shift -= RATE * gs / seen_s**0.5
            ids, back = np.unique(np.concatenate(touched), return_inverse=True)
            back, v = back.reshape(-1, rows.shape[1]), np.concatenate(values)
            total = np.zeros((len(ids), SIZE), np.float32)
            for c in range(rows.shape[1]):
                np.add.at(total, back[:, c], v)
            total[rare[ids]] = 0
            seen_e[ids] += (total * total).mean(1)
            model.embeddings[ids] -= RATE * total / np.sqrt(seen_e[ids])[:, None]
    return model


def scores(model: Model, values: list[str], known: Words, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of some texts, and the array that the words' projections stand in; it grows with the words that are new."""
    docs = [known.of(t) for t in values]
    new, every = len(known.rows), len(known) + 1
    if every > len(projected):
        more = np.empty((max(every, 2 * len(projected)), projected.shape[1]), np.float32)
        more[: every - new] = projected[: every - new]
        projected = more
    if new:
        projected[every - new : every] = model.projected(np.array(known.rows, np.int32))
        known.rows.clear()
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    return model.score(np.concatenate(docs), starts, projected), projected


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, by 3: rows of 1 are held out; a null doc_id counts as 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(1)).cast("int")


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, apart) without the held-out rows, one a doc_id; rows that are apart are never fitted."""
    apart = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string")).cast("binary")) % CALIBRATE == 0
    own = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 1))
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), F.first(apart).alias("apart"))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> list[tuple[str, int, int]]:
    """At most `per_label` texts of each label for the fit: text, label and doc_id."""
    own = labelled(labels).where("not apart")
    picked = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    few = picked[0].unionByName(picked[1])  # 2 * per_label rows at most
    rows = texts(docs).join(F.broadcast(few), "doc_id")
    return [(r["text"], r["toxic"], r["doc_id"]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * per_label).collect()]


def histogram(docs: DataFrame, labels: DataFrame, model: Model, fitted: list[int]) -> list[tuple[str, int, int, int, int]]:
    """(lang, toxic, bin, n, all) over every labelled row that is neither held out nor fitted: rows of each of BINS
    ranges of scores, and all rows of that language and label, also the fitted ones."""
    spark = docs.sparkSession
    own = labelled(labels)
    few = own.count() <= BROADCAST_IDS
    ids = spark.createDataFrame(pa.table({"doc_id": pa.array(fitted, pa.int64())})).distinct().withColumn("fitted", F.lit(True))
    rows = texts(docs, F.col("lang").cast("string").alias("lang")).where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull())
    if few:  # else all of them are scored, so that no text is shuffled
        rows = rows.join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi")
    scored = score(rows, model).select("doc_id", "lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    joined = scored.join(F.broadcast(own) if few else own, "doc_id").join(F.broadcast(ids), "doc_id", "left")
    fitted_bin = F.when(F.col("fitted"), -1).otherwise(F.col("bin")).alias("bin")
    got = [tuple(r) for r in joined.groupBy("lang", "toxic", fitted_bin).agg(F.count("*").alias("n")).collect()]
    every: dict[tuple[str, int], int] = {}
    for lang, y, _, n in got:
        every[lang, y] = every.get((lang, y), 0) + n
    return [(lang, y, at, n, every[lang, y]) for lang, y, at, n in got if at >= 0]


def calibrated(rows: list[tuple[str, int, int, int, int]]) -> dict[str, float]:
    """The threshold of best F1 by language, at the mix of labels that all rows have; none for a language with fewer than 5 rows of a label."""
    out = {}
    for lang in sorted({r[0] for r in rows}):
        n, every, bins = [0, 0], [0, 0], {}
        for _, y, at, k, total in (r for r in rows if r[0] == lang):
            n[y] += k
            every[y] = total
            bins.setdefault(at, [0, 0])[y] += k
        if min(n) < 5:
            continue
        weight = [every[y] / n[y] for y in (0, 1)]
        left, best, below = list(n), (0.0, PREDICT), -1
        for at in sorted(bins):
            hits, said = left[1] * weight[1], left[0] * weight[0] + left[1] * weight[1]
            if (f1 := 2 * hits / (every[1] + said)) > best[0]:
                best = (f1, (at + below + 1) / 2 / BINS)
            left = [left[y] - bins[at][y] for y in (0, 1)]
            below = at
        out[lang] = best[1]
    return out


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fits on the sample and calibrates each language's threshold on all other labelled rows that aren't held out (best F1; PREDICT where a language has fewer than 5 of a label there)."""
    rows = sample(docs, labels, per_label)
    model = fit([(t, y) for t, y, _ in rows])
    if "lang" in docs.columns and rows:
        model.thresholds = calibrated(histogram(docs, labels, model, [x for *_, x in rows]))
    return model


def score(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("score", "threshold", "toxic")) -> DataFrame:
    """Every row of docs with `score`, `threshold` (its language's) and `toxic` (score >= threshold).

    All columns stay as they are, but for ones of these three names, which are replaced; `names` gives
    others.  A null
    or empty text has no words and the score of none.  Rows that repeat score alike.
    """
    new, limit, flag = names
    docs = docs.drop(*names)
    if "lang" in docs.columns:
        cases = F.lit(PREDICT)
        for lang, t in sorted(model.thresholds.items()):
            cases = F.when(F.col("lang") == lang, F.lit(float(t))).otherwise(cases)
    else:
        cases = F.lit(PREDICT)
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches):
        known, projected = Words(), np.zeros((0, FILTERS * sum(WIDTHS)), np.float32)
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 64):
                if len(known) > REMEMBERED:
                    known = Words()
                s, projected = scores(model, [x.as_py() or "" for x in batch.column(at).slice(lo, 64)], known, projected)
                out.extend(s.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*columns, new])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(trimmed(run), f"{kinds}, `{new}` double").withColumn(limit, cases).withColumn(flag, (F.col(new) >= F.col(limit)).cast("int"))
