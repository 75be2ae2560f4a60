"""Which units appear unusually often in a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from . import stats


def burst_scores(df: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(window_id, unit, f, u, ps, expected, sigma, pb, wb) of units above their expected count.

    The counts by window and unit are shared by ps and the scores; totals are one row a window, made of df if not given.
    """
    totals = stats.window_totals(df) if totals is None else totals
    counts = stats.unit_counts(df)
    ps = stats.unit_ps(counts, totals)
    own = counts.join(totals, "window_id").join(ps, "unit")
    own = own.withColumn("expected", S.expected(F.col("n_tweets"), F.col("ps"))).where(F.col("f") > F.col("expected"))
    own = own.withColumn("sigma", S.deviation(F.col("n_tweets"), F.col("ps"))).withColumn("pb", S.burst_probability(F.col("f"), F.col("expected"), F.col("sigma")))
    return own.withColumn("wb", S.burst_weight(F.col("pb"), F.col("u"))).select("window_id", "unit", "f", "u", *(S.rounded(F.col(c)).alias(c) for c in ("ps", "expected", "sigma", "pb", "wb")))


def top_units(scored: DataFrame, k: int = 200) -> DataFrame:
    """The k units of largest wb of each window with seg_id from 0; ties to the smaller unit."""
    order = Window.partitionBy("window_id").orderBy(F.desc("wb"), "unit")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("seg_id", F.col("rank") - 1).drop("rank")


def slang_filtered(units: DataFrame, slang: DataFrame) -> DataFrame:
    """units without those any word of which is slang."""
    bad = units.select("unit", F.explode(F.split("unit", "[ _]")).alias("slang")).join(slang.select("slang"), "slang").select("unit").distinct()
    return units.join(bad, "unit", "left_anti")


def event_segment_df(df: DataFrame, top: DataFrame) -> DataFrame:
    """(window_id, seg_id, unit, f, u, n_tweets, n_users): counts of the bursty units with their window's totals."""
    counts = stats.unit_counts(df.join(top.select("window_id", "unit"), ["window_id", "unit"], "left_semi"))
    return counts.join(stats.window_totals(df), "window_id").join(top.select("window_id", "unit", "seg_id"), ["window_id", "unit"]).select("window_id", "seg_id", "unit", "f", "u", "n_tweets", "n_users")
