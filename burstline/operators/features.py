"""What messages show, and the feature vectors of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T


def social(df: DataFrame) -> DataFrame:
    """(tweet_id, user_id, window_id, hour, rt, men, reply, url, tag, past) of each message, read once."""
    raw = T.split_spaces(F.col("text"))
    return df.select(
        "tweet_id",
        "user_id",
        "window_id",
        "hour",
        T.is_retweet(F.col("text")).alias("rt"),
        F.contains("text", F.lit("@")).alias("men"),
        T.is_reply(F.col("text")).alias("reply"),
        F.contains("text", F.lit("http")).alias("url"),
        F.array_join(T.hashtags(F.col("text")), " ").alias("tag"),
        F.array_join(T.past_words(F.transform(raw, lambda t: F.lower(t))), " ").alias("past"),
    )


def hour_histogram(df: DataFrame, m: int = 12) -> DataFrame:
    """(window_id, part, n): messages by hour modulo m."""
    return df.groupBy("window_id", (F.col("hour") % m).alias("part")).agg(F.count("*").alias("n"))


def event_messages(df: DataFrame, clusters: DataFrame, top: DataFrame, least: int = 1) -> DataFrame:
    """(window_id, event_id, tweet_id, user_id) of messages that hold at least `least` of an event's units."""
    units = clusters.join(top.select("window_id", "seg_id", "unit"), ["window_id", "seg_id"]).select("window_id", "event_id", "unit")
    held = df.join(units, ["window_id", "unit"]).groupBy("window_id", "event_id", "tweet_id", "user_id").agg(F.count_distinct("unit").alias("held"))
    return held.where(F.col("held") >= least).drop("held")


def event_features(events: DataFrame, messages: DataFrame, social_: DataFrame, totals: DataFrame) -> DataFrame:
    """The 13 features of each event of `events` (ranked, with n_nodes, n_edges, worth_sum, sim_sum, mu):

    f01 mu, f02 units, f03 edges by units, f04 mean similarity, f05 share of the window's messages,
    f06 share of its users, f07 to f11 shares of messages that are retweets, mention, reply, link
    or have a tag, f12 tags a message, f13 past words a message.
    """
    # Messages without social features count for f05 and f06 only.
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda t: t != ""))
    own = messages.join(social_.select("tweet_id", "rt", "men", "reply", "url", "tag", "past"), "tweet_id", "left")
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    agg = own.groupBy("window_id", "event_id").agg(
        F.count_distinct("tweet_id").alias("tweets"),
        F.count_distinct("user_id").alias("users"),
        *(S.rounded(share(c)).alias(f) for f, c in (("f07", "rt"), ("f08", "men"), ("f09", "reply"), ("f10", "url"))),
        S.rounded(F.coalesce(F.avg((F.col("tag") != "").cast("double")), F.lit(0.0))).alias("f11"),
        S.rounded(F.coalesce(F.avg(words("tag").cast("double")), F.lit(0.0))).alias("f12"),
        S.rounded(F.coalesce(F.avg(words("past").cast("double")), F.lit(0.0))).alias("f13"),
    )
    base = events.join(agg, ["window_id", "event_id"]).join(totals, "window_id")
    return base.select(
        "window_id",
        "event_id",
        F.col("mu").alias("f01"),
        F.col("n_nodes").cast("double").alias("f02"),
        S.rounded(F.col("n_edges") / F.col("n_nodes")).alias("f03"),
        S.rounded(S.ratio(F.col("sim_sum"), F.col("n_edges"))).alias("f04"),
        S.rounded(F.col("tweets") / F.col("n_tweets")).alias("f05"),
        S.rounded(F.col("users") / F.col("n_users")).alias("f06"),
        *(f"f{i:02d}" for i in range(7, 14)),
    )


def repeated_stems(clusters: DataFrame, top: DataFrame, stemmed: DataFrame) -> DataFrame:
    """(window_id, event_id, dup): of an event's distinct stems, the share that stands in several units. stemmed: (word, stem)."""
    words = clusters.join(top.select("window_id", "seg_id", "unit"), ["window_id", "seg_id"]).select("window_id", "event_id", F.explode(F.split("unit", "[ _]")).alias("word"))
    counts = words.join(stemmed, "word").groupBy("window_id", "event_id", "stem").agg(F.count("*").alias("n"))
    return counts.groupBy("window_id", "event_id").agg(S.rounded(F.avg((F.col("n") > 1).cast("double"))).alias("dup"))


def frequent_hits(tags: DataFrame, tag_list: DataFrame, prefix_list: DataFrame, suffix_list: DataFrame) -> DataFrame:
    """(window_id, event_id, ftg, prf, sfx): hits of an event's distinct tags and their distinct affixes in the frequent lists, by its tags.

    tags: (window_id, event_id, tag).  Affixes count once, so that prf and sfx may exceed 1; events without tags are left out.
    """
    own = tags.distinct()
    key = ["window_id", "event_id"]
    n = own.groupBy(key).agg(F.count("*").alias("n"))
    hits = [
        own.join(tag_list.select("tag"), "tag", "left_semi").groupBy(key).agg(F.count("*").alias("ftg")),
        own.select(*key, F.explode(T.prefixes(F.col("tag"))).alias("affix")).distinct().join(prefix_list.select("affix"), "affix", "left_semi").groupBy(key).agg(F.count("*").alias("prf")),
        own.select(*key, F.explode(T.suffixes(F.col("tag"))).alias("affix")).distinct().join(suffix_list.select("affix"), "affix", "left_semi").groupBy(key).agg(F.count("*").alias("sfx")),
    ]
    every = reduce(lambda a, b: a.join(b, key, "left"), hits, n)
    return every.select(*key, *(S.rounded(F.coalesce(c, F.lit(0)) / F.col("n")).alias(c) for c in ("ftg", "prf", "sfx")))


def wide_features(base: DataFrame, dups: DataFrame, hits: DataFrame) -> DataFrame:
    """The 17 features: the 13, of which f01 to f04 by their window's maximum, with f14 repeated stems and f15 to f17 frequent hits."""
    from pyspark.sql import Window

    w = Window.partitionBy("window_id")
    key = ["window_id", "event_id"]
    own = base.join(dups, key, "left").join(hits, key, "left")
    scaled = [S.rounded(S.ratio(F.col(f), F.max(f).over(w))).alias(f) for f in ("f01", "f02", "f03", "f04")]
    rest = [F.coalesce(F.col(c), F.lit(0.0)).alias(f) for f, c in (("f14", "dup"), ("f15", "ftg"), ("f16", "prf"), ("f17", "sfx"))]
    return own.select(*key, *scaled, *(f"f{i:02d}" for i in range(5, 14)), *rest)
