"""Filters, k-means, and confidence-weighted linear learners over (instance_id, label, x array<double>)."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S


def long(df: DataFrame) -> DataFrame:
    """(instance_id, label, i, v): a row a value, i from 0."""
    return df.select("instance_id", "label", F.posexplode("x").alias("i", "v"))


def minmax(df: DataFrame) -> DataFrame:
    """x scaled to 0..1 by each feature's own smallest and largest value; a constant feature is 0."""
    ends = long(df).groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high")).agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("ends"))  # a row a feature
    scaled = F.zip_with("x", "ends", lambda v, e: S.rounded(S.ratio(v - e["low"], e["high"] - e["low"])))
    return df.crossJoin(F.broadcast(ends)).withColumn("x", scaled).drop("ends")


def merge(df: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """For each pair (a, b) of features the product in place of a; the b's go once all products are made."""
    gone = [b for _, b in pairs]
    factors: dict[int, list[int]] = {}
    for a, b in pairs:
        factors.setdefault(a, []).append(b)

    def value(v, i):
        out = v
        for a, own in factors.items():
            by = F.lit(1.0)
            for b in own:
                by = by * F.col("x")[b]
            out = F.when(i == a, v * by).otherwise(out)
        return F.struct(S.rounded(out).alias("v"), i.alias("i"))

    return df.withColumn("x", F.transform(F.filter(F.transform("x", value), lambda s: ~s["i"].isin(gone)), lambda s: s["v"]))


def strengthen(df: DataFrame, features: list[int], factor: float = 2.0, weaken: list[int] | tuple = (), divisor: float = 4.0) -> DataFrame:
    return df.withColumn("x", F.transform("x", lambda v, i: F.when(i.isin(features), v * factor).when(i.isin(list(weaken)) if weaken else F.lit(False), v / divisor).otherwise(v)))


def delete(df: DataFrame, features: list[int]) -> DataFrame:
    return df.withColumn("x", F.transform(F.filter(F.transform("x", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: ~s["i"].isin(features)), lambda s: s["v"]))


def flip(df: DataFrame, features: list[int]) -> DataFrame:
    return df.withColumn("x", F.transform("x", lambda v, i: S.rounded(F.when(i.isin(features), 1 - v).otherwise(v))))


def binned(df: DataFrame, bins: int = 10) -> DataFrame:
    """x in 0..1 as one-hot bins, `bins` places a feature; 1 is in the last."""
    one = lambda v: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.when(F.least(F.floor(v * bins), F.lit(bins - 1)) == b, 1).otherwise(0))
    return df.withColumn("x", F.flatten(F.transform("x", one)))


def scored(df: DataFrame, kind: str = "norm", feature: int = 0) -> DataFrame:
    """(instance_id, label, score) by the norm, sum or product of x, or one feature."""
    how = {"norm": S.norm(F.col("x")), "sum": S.total(F.col("x")), "product": S.product(F.col("x")), "single": F.col("x")[feature]}[kind]
    return df.select("instance_id", "label", S.rounded(how).alias("score"))


def votes(df: DataFrame, bins: dict[int, list[int]], n: int = 30) -> DataFrame:
    """(instance_id, label, score): of the features with listed bins, how many have their value there, aligned by instance."""
    one = lambda i, own: F.least(F.floor(F.col("x")[i] * n), F.lit(n - 1)).isin(own).cast("int")
    return df.select("instance_id", "label", sum((one(i, own) for i, own in sorted(bins.items())), F.lit(0)).cast("double").alias("score"))


def filtered(scores: DataFrame, threshold: float, below: bool = True) -> DataFrame:
    """(instance_id, label, score, predicted): an event where the score is at most (else at least) the threshold."""
    hit = F.col("score") <= threshold if below else F.col("score") >= threshold
    return scores.withColumn("predicted", hit.cast("int"))


def histogram(scores: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, positive, negative, precision, recall, f1) over equal bins of the scores, zero-filled, cumulative from the lowest.

    Recall is by the actual positives.  Ends and totals are one row; the bins are a fixed number.
    """
    from pyspark.sql import Window

    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("label").alias("all"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("score") - F.col("low")) / width), F.lit(bins - 1))).cast("int")
    own = scores.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(own, "bin", "left").select("bin", F.coalesce("p", F.lit(0)).alias("positive"), F.coalesce("q", F.lit(0)).alias("negative"))
    w = Window.orderBy("bin")
    run = every.crossJoin(F.broadcast(ends.select("all"))).withColumn("cp", F.sum("positive").over(w)).withColumn("cq", F.sum("negative").over(w))
    precision, recall = S.ratio(F.col("cp"), F.col("cp") + F.col("cq")), S.ratio(F.col("cp"), F.col("all"))
    return run.select("bin", "positive", "negative", S.rounded(precision).alias("precision"), S.rounded(recall).alias("recall"), S.rounded(S.f1(precision, recall)).alias("f1"))


def class_centroids(df: DataFrame, key: str = "label") -> DataFrame:
    """(key, i, mean, n): a mean vector for each class or cluster."""
    return df.select(key, F.posexplode("x").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def positive_features(df: DataFrame) -> DataFrame:
    """(i): features whose mean is larger among label 1, all of them looked at."""
    c = class_centroids(df).groupBy("i").agg(F.max(F.when(F.col("label") == 1, F.col("mean"))).alias("a"), F.max(F.when(F.col("label") == 0, F.col("mean"))).alias("b"))
    return c.where("a > b").select("i")


def _assigned(df: DataFrame, centers: list[list[float]]) -> DataFrame:
    d = [S.rounded(S.distance(F.col("x"), F.array(*map(F.lit, c))), 9) for c in centers]
    best = F.array_min(F.array(*(F.struct(x.alias("d"), F.lit(k).alias("k")) for k, x in enumerate(d))))
    return df.withColumn("cluster", best["k"])


def kmeans(df: DataFrame, seeds: list[int], rounds: int | None = None) -> DataFrame:
    """df with `cluster`, by Lloyd's rounds from the instances `seeds`, until no centre moves, or after `rounds` where that is given.

    Only the centres, seeds times features, come to the driver; each round is one aggregate over the
    table, so df should be persisted.  Centres that move by less than 1e-9 stand still.  A cluster that loses all its members keeps its centre; ties go to the first centre.
    """
    first = {r["instance_id"]: list(r["x"]) for r in df.where(F.col("instance_id").isin(seeds)).select("instance_id", "x").collect()}
    centers = [first[s] for s in seeds if s in first]
    if not centers:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    for _ in count() if rounds is None else range(rounds):
        rows = class_centroids(_assigned(df, centers), "cluster").collect()
        new = [list(c) for c in centers]
        for r in rows:
            new[r["cluster"]][r["i"]] = r["mean"]
        if max(abs(a - b) for x, y in zip(new, centers) for a, b in zip(x, y)) < 1e-9:
            break
        centers = new
    return _assigned(df, centers)


def event_cluster(clustered: DataFrame) -> DataFrame:
    """clustered with `predicted`: 1 in the cluster whose being the events makes fewer errors."""
    wrong = lambda c: F.count_if((F.col("cluster") == c) != (F.col("label") == 1))
    pick = clustered.agg(wrong(0).alias("a"), wrong(1).alias("b")).select(F.when(F.col("a") <= F.col("b"), 0).otherwise(1).alias("events"))
    return clustered.crossJoin(F.broadcast(pick)).withColumn("predicted", (F.col("cluster") == F.col("events")).cast("int")).drop("events")


# Confidence-weighted learning (diagonal covariance, variance update of 2008): rows change the model in
# order, so one task reads them; the model has two numbers a feature.


class Weights:
    def __init__(self, n: int, c: float = 0.01, variance: float = 1.0):
        self.mean, self.var, self.c = np.zeros(n), np.full(n, variance), c

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> bool:
        """Reads one row y in (-1, 1); whether it was a mistake."""
        m, v = y * float(self.mean[at] @ x), float(self.var[at] @ (x * x))
        wrong = m <= 0
        if v > 0:
            b = 1 + 2 * self.c * m
            gamma = (-b + np.sqrt(max(0.0, b * b - 8 * self.c * (m - self.c * v)))) / (4 * self.c * v)
            if gamma > 0:
                self.mean[at] += gamma * y * self.var[at] * x
                self.var[at] = 1 / (1 / self.var[at] + 2 * gamma * self.c * x * x)
        return wrong


def _with_bias(x) -> np.ndarray:
    return np.concatenate([[1.0], np.asarray(x, float)])


def cw_binary(df: DataFrame, c: float = 0.01, variance: float = 1.0, epochs: int = 1, average: bool = False) -> DataFrame:
    """(feature, mean, variance, mistakes): the model after reading the rows by instance_id; feature 0 is the bias.

    average=True gives the mean of the weights over the last epoch instead of their last state.
    Rows go to one task, sorted by Spark and read as a stream; it keeps only the model.
    """
    rows = df.select("instance_id", "label", "x")

    def run(batches):
        held = [b for b in batches] if epochs > 1 else batches
        model, mistakes, total, seen = None, 0, None, 0
        for epoch in range(epochs):
            for pdf in held:
                for y, x in zip(pdf["label"], pdf["x"]):
                    x = _with_bias(x)
                    model = model or Weights(len(x), c, variance)
                    at = np.flatnonzero(x)
                    mistakes += model.learn(at, x[at], 1 if y == 1 else -1)
                    if average and epoch == epochs - 1:
                        total = model.mean.copy() if total is None else total + model.mean
                        seen += 1
        if model is not None:
            yield pd.DataFrame({"feature": np.arange(len(model.mean)), "mean": total / seen if average else model.mean, "variance": model.var, "mistakes": mistakes})

    return rows.repartitionByRange(1, "instance_id").sortWithinPartitions("instance_id").mapInPandas(run, "feature int, mean double, variance double, mistakes long")


def weights_array(model: DataFrame) -> DataFrame:
    """One row: the means by feature."""
    return model.agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "mean"))), lambda s: s["mean"]).alias("weights"))


def cw_predict(df: DataFrame, model: DataFrame) -> DataFrame:
    """(instance_id, label, margin, predicted)."""
    margin = S.dot(F.concat(F.array(F.lit(1.0)), "x"), F.col("weights"))
    return df.crossJoin(F.broadcast(weights_array(model))).select("instance_id", "label", S.rounded(margin).alias("margin"), (S.sign(margin) == 1).cast("int").alias("predicted"))


def cw_multiclass(df: DataFrame, k: int = 1, c: float = 0.01, variance: float = 1.0, start: DataFrame | None = None) -> DataFrame:
    """(class, feature, mean, variance): a block of weights a class, learnt against the k best wrong classes of each row, k below the number of classes; `start` is a model to go on from."""
    rows = df.select("instance_id", F.col("label").cast("int").alias("label"), "x")
    classes = sorted(r["label"] for r in rows.select("label").distinct().collect())  # one a class
    warm = [tuple(r) for r in start.select("class", "feature", "mean", "variance").collect()] if start is not None else []
    place = {y: i for i, y in enumerate(classes)}
    most = max(0, min(k, len(classes) - 1))

    def run(batches):
        model, n = None, 0
        for pdf in batches:
            for y, x in zip(pdf["label"], pdf["x"]):
                x = _with_bias(x)
                if model is None:
                    n = len(x)
                    model = Weights(n * len(classes), c, variance)
                    for cls, f, m, v in warm:
                        if cls in place and f < n:
                            model.mean[place[cls] * n + f], model.var[place[cls] * n + f] = m, v
                at, own = np.flatnonzero(x), place[y]
                margins = model.mean.reshape(-1, n) @ x
                for wrong in sorted((j for j in range(len(classes)) if j != own), key=lambda j: (-margins[j], j))[:most]:
                    model.learn(np.concatenate([own * n + at, wrong * n + at]), np.concatenate([x[at], -x[at]]), 1)
        if model is not None:
            yield pd.DataFrame({"class": np.repeat(classes, n), "feature": np.tile(np.arange(n), len(classes)), "mean": model.mean, "variance": model.var})

    return rows.repartitionByRange(1, "instance_id").sortWithinPartitions("instance_id").mapInPandas(run, "class int, feature int, mean double, variance double")


def cw_multiclass_predict(df: DataFrame, model: DataFrame) -> DataFrame:
    """(instance_id, label, predicted, margin): the class of the largest margin, the smaller of equals."""
    blocks = model.groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "mean"))), lambda s: s["mean"]).alias("w")).agg(F.sort_array(F.collect_list(F.struct("class", "w"))).alias("blocks"))
    margins = F.transform("blocks", lambda b: F.struct(S.rounded(S.dot(F.concat(F.array(F.lit(1.0)), F.col("x")), b["w"])).alias("margin"), (-b["class"]).alias("c")))
    best = F.array_max(margins)
    return df.crossJoin(F.broadcast(blocks)).select("instance_id", "label", (-best["c"]).alias("predicted"), best["margin"].alias("margin"))


def reweighted(df: DataFrame, model: DataFrame) -> DataFrame:
    """x times the learnt weights, without the bias."""
    return df.crossJoin(F.broadcast(weights_array(model))).withColumn("x", F.zip_with("x", F.slice("weights", 2, F.greatest(F.size("weights") - 1, F.lit(1))), lambda v, w: S.rounded(v * w))).drop("weights")


def kmeans_cw(df: DataFrame, seeds: list[int], rounds: int = 15) -> DataFrame:
    """Clusters label the rows, a learner reads the labels, its weights scale the features, and again."""
    own, last = df, None
    out = event_cluster(kmeans(own, seeds))
    for _ in range(rounds):
        guess = out.select("instance_id", F.col("predicted").alias("label"), "x")
        model = cw_binary(guess).select("feature", "mean")
        rows = [tuple(r) for r in model.collect()]  # one a feature
        if rows == last:  # the same labels gave the same weights: nothing changes any more
            break
        last = rows
        fixed = df.sparkSession.createDataFrame(rows, "feature int, mean double")
        held, own = own, minmax(reweighted(df, fixed)).persist()  # read once a round of kmeans()
        out = event_cluster(kmeans(own, seeds))
        if held is not df:
            held.unpersist()
    return out
