"""Hashtags: counts, frequent affixes, and lists pruned by their beginnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tag_counts(tags: DataFrame) -> DataFrame:
    """(tag, tf, df) of lower-cased ASCII tags."""
    own = tags.withColumn("tag", F.lower("tag")).where(~F.col("tag").rlike("[^ -~]"))
    return own.groupBy("tag").agg(F.count("*").alias("tf"), F.count_distinct("tweet_id").alias("df"))


def merged(segmented: DataFrame, tags: DataFrame) -> DataFrame:
    """segmented (tweet_id, segments) with the tags of each message appended, also where it has none."""
    lists = tags.groupBy("tweet_id").agg(F.sort_array(F.collect_set(F.lower("tag"))).alias("tags"))
    return segmented.join(lists, "tweet_id", "left").withColumn("segments", F.concat("segments", F.coalesce("tags", F.array().cast("array<string>")))).drop("tags")


def affix_weights(counts: DataFrame, by_tf: bool = True) -> DataFrame:
    """(kind, affix, weight): sum of tf, or number of tags, by prefix and by suffix."""
    both = F.concat(F.transform(T.prefixes(F.col("tag")), lambda a: F.struct(F.lit("prefix").alias("kind"), a.alias("affix"))), F.transform(T.suffixes(F.col("tag")), lambda a: F.struct(F.lit("suffix").alias("kind"), a.alias("affix"))))
    own = counts.select("tf", F.explode(both).alias("a"))
    return own.groupBy("a.kind", "a.affix").agg((F.sum("tf") if by_tf else F.count("*")).alias("weight"))


def pruned(weights: DataFrame, least_weight: int = 200, least_length: int = 3) -> DataFrame:
    """Affixes of enough weight and length that aren't one character over and over."""
    return weights.where((F.col("weight") >= least_weight) & (F.length("affix") >= least_length) & ~T.one_character(F.col("affix")))


def keep_shortest(df: DataFrame, column: str = "affix", *by: str) -> DataFrame:
    """Strings of which no other string of the set is a proper beginning.

    Each string meets its own beginnings by equality: no pairs of strings, and no order over the whole set.
    """
    own = df.select(*by, column).distinct()
    short = own.select(*by, F.col(column).alias("_short"))
    body = F.col(column)
    starts = own.where(F.length(body) > 1).select(*by, column, F.explode(F.transform(F.sequence(F.lit(1), F.length(body) - 1), lambda i: F.substring(body, F.lit(1), i))).alias("_short"))
    covered = starts.join(short, [*by, "_short"], "left_semi").select(*by, column).distinct()
    return df.join(covered, [*by, column], "left_anti")


def keep_longest(df: DataFrame, column: str = "affix", *by: str) -> DataFrame:
    """Strings that no other string of the set begins with."""
    own = df.select(*by, column).distinct()
    body = F.col(column)
    starts = own.where(F.length(body) > 1).select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.length(body) - 1), lambda i: F.substring(body, F.lit(1), i))).alias(column)).distinct()
    return df.join(starts, [*by, column], "left_anti")


def frequent(counts: DataFrame, key: str, weight: str, k: int = 2000) -> DataFrame:
    """The k keys of largest weight, lower-cased; ties to the smaller key."""
    return counts.select(F.lower(key).alias(key), weight).groupBy(key).agg(F.max(weight).alias(weight)).orderBy(F.desc(weight), key).limit(k)


def ordered(counts: DataFrame, *by) -> DataFrame:
    return counts.orderBy(*by)


def longest_by_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """The longest string of each group; ties to the smaller."""
    order = Window.partitionBy(group).orderBy(F.length(column).desc(), column)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
