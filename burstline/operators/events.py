"""Worth of units, and events ranked by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T


def subgrams(units: DataFrame) -> DataFrame:
    """(unit, n, gram): the grams that units consist of, and how many words a unit has."""
    own = units.select("unit").distinct().withColumn("w", F.split("unit", "[ _]"))
    return own.select("unit", F.size("w").alias("n"), F.explode(T.subgrams(F.col("w"))).alias("gram"))


def newsworthiness(units: DataFrame, anchors: DataFrame, unify: bool = False) -> DataFrame:
    """(unit, worth): of a word exp(p), else the largest exp(p) - 1 over its sub-grams; 0 for what no link holds.

    unify=True takes exp(p) - 1 for words too.
    """
    own = units.select("unit").distinct()
    sub = subgrams(units)
    value = F.exp("prob") - (1 if unify else F.when(F.col("n") > 1, 1.0).otherwise(0.0))
    worth = sub.join(anchors.select("gram", "prob"), "gram").withColumn("v", value).groupBy("unit").agg(F.max("v").alias("worth"))
    return own.join(worth, "unit", "left").select("unit", S.rounded(F.coalesce("worth", F.lit(0.0))).alias("worth"))


def measured(clusters: DataFrame, edges: DataFrame, top: DataFrame, worth: DataFrame) -> DataFrame:
    """(window_id, event_id, n_nodes, n_edges, worth_sum, sim_sum, mu): mu is the mean worth times the sum of similarities over the units."""
    nodes = clusters.join(top.select("window_id", "seg_id", "unit"), ["window_id", "seg_id"]).join(worth, "unit")
    a = nodes.groupBy("window_id", "event_id").agg(F.count("*").alias("n_nodes"), S.rounded(F.sum("worth")).alias("worth_sum"))
    b = edges.groupBy("window_id", "event_id").agg(F.count("*").alias("n_edges"), S.rounded(F.sum("sim")).alias("sim_sum"))
    both = a.join(b, ["window_id", "event_id"], "left").fillna({"n_edges": 0, "sim_sum": 0.0})
    return both.withColumn("mu", S.rounded(F.col("worth_sum") / F.col("n_nodes") * F.col("sim_sum") / F.col("n_nodes")))


def ranked(measured_: DataFrame, tau: float | None = None) -> DataFrame:
    """Events of mu > 0 with ratio (the window's largest mu over theirs) and rank, the best first; tau keeps ratios below it."""
    own = measured_.where("mu > 0").withColumn("ratio", S.rounded(F.max("mu").over(Window.partitionBy("window_id")) / F.col("mu")))
    if tau is not None:
        own = own.where(F.col("ratio") < tau)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("window_id").orderBy("ratio", "event_id")))


def report(ranked_: DataFrame, clusters: DataFrame, edges: DataFrame, top: DataFrame, worth: DataFrame) -> DataFrame:
    """(window_id, rank, ratio, n_nodes, n_edges, by_degree, by_worth): units of each event in both orders, joined by |."""
    ends = edges.select("window_id", F.explode(F.array("seg_i", "seg_j")).alias("seg_id")).groupBy("window_id", "seg_id").agg(F.count("*").alias("degree"))
    nodes = clusters.join(top.select("window_id", "seg_id", "unit"), ["window_id", "seg_id"]).join(worth, "unit").join(ends, ["window_id", "seg_id"], "left").fillna({"degree": 0})
    order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col(c)).alias("k"), "unit"))), lambda x: x["unit"]), "|")
    lists = nodes.groupBy("window_id", "event_id").agg(order("degree").alias("by_degree"), order("worth").alias("by_worth"))
    return ranked_.join(lists, ["window_id", "event_id"]).select("window_id", "rank", "ratio", "n_nodes", "n_edges", "by_degree", "by_worth")


def ratio_histogram(ranked_: DataFrame, most: int = 10) -> DataFrame:
    """(bin, n, cumulative) of whole ratios up to `most`."""
    from .stats import cumulative

    return cumulative(ranked_.where(F.col("ratio") <= most).groupBy(F.floor("ratio").cast("int").alias("bin")).agg(F.count("*").alias("n")), "bin", "n")


def size_distribution(ranked_: DataFrame) -> DataFrame:
    return ranked_.groupBy("n_nodes").agg(F.count("*").alias("n"))
