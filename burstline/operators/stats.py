"""Counts over (tweet_id, unit, user_id, window_id, hour) tables.

Distinct counts go through partial aggregates; a unit that a third of all messages hold is reduced
where it is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scores import rounded

#: Texts whose words are counted at once.
ROWS = 256


def window_totals(df: DataFrame) -> DataFrame:
    """(window_id, n_tweets, n_users): distinct messages and users of each window."""
    return df.groupBy("window_id").agg(F.count_distinct("tweet_id").alias("n_tweets"), F.count_distinct("user_id").alias("n_users"))


def cumulative_users(df: DataFrame) -> DataFrame:
    """(window_id, new_users, users): users seen up to each window; each counts in the first window it writes in."""
    first = df.groupBy("user_id").agg(F.min("window_id").alias("window_id")).groupBy("window_id").agg(F.count("*").alias("new"))
    windows = df.select("window_id").distinct().join(first, "window_id", "left").withColumn("new_users", F.coalesce("new", F.lit(0)))
    return windows.select("window_id", "new_users", F.sum("new_users").over(Window.orderBy("window_id")).alias("users"))


def unit_counts(df: DataFrame) -> DataFrame:
    """(window_id, unit, f, u): distinct messages and users of each unit in each window."""
    return df.groupBy("window_id", "unit").agg(F.count_distinct("tweet_id").alias("f"), F.count_distinct("user_id").alias("u"))


def unit_df(df: DataFrame) -> DataFrame:
    """(unit, df): distinct messages."""
    return df.groupBy("unit").agg(F.count_distinct("tweet_id").alias("df"))


def unit_ps(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(unit, ps): mean share of messages over the windows that hold the unit."""
    return counts.join(totals, "window_id").groupBy("unit").agg(F.avg(F.col("f") / F.col("n_tweets")).alias("ps"))


def unit_tf_df(df: DataFrame) -> DataFrame:
    """(window_id, unit, tf, df)."""
    return df.groupBy("window_id", "unit").agg(F.count("*").alias("tf"), F.count_distinct("tweet_id").alias("df"))


def above_thresholds(counts: DataFrame, column: str, thresholds: tuple[int, ...] = (0, 1, 10, 100, 1000)) -> DataFrame:
    """(threshold, n, share): units whose count exceeds each threshold."""
    sums = counts.agg(F.count("*").alias("all"), *(F.count_if(F.col(column) > t).alias(f"t{t}") for t in thresholds))
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n")) for t in thresholds)))
    return sums.select("all", pairs.alias("p")).select("p.threshold", "p.n", rounded(F.col("p.n") / F.nullif(F.col("all"), F.lit(0))).alias("share"))


def common_values(counts: DataFrame, column: str, k: int = 50) -> DataFrame:
    """(value, n): the k values that occur most often; ties to the smaller value."""
    return counts.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def vocabulary(df: DataFrame) -> DataFrame:
    """(window_id, words, n_tweets, share): distinct units, and the window's share of all messages in hundredths."""
    per = df.groupBy("window_id").agg(F.count_distinct("unit").alias("words"), F.count_distinct("tweet_id").alias("n_tweets"))
    every = per.agg(F.sum("n_tweets").alias("all"))
    return per.crossJoin(every).select("window_id", "words", "n_tweets", F.round(100 * F.col("n_tweets") / F.col("all"), 2).alias("share"))


def word_counts(df: DataFrame) -> DataFrame:
    """(tweet_id, lang, word, n): lower-cased words of each row of df (tweet_id, lang, tokens of ASCII), once a row."""
    schema = T.StructType([df.schema["tweet_id"], df.schema["lang"], *T._parse_datatype_string("word string, n long")])
    kind = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ids, langs, lists = (c.slice(lo, ROWS) for c in batch.columns)
                enc = pc.ascii_lower(lists.flatten()).dictionary_encode()
                row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).fill_null(0).to_numpy())
                words = max(1, len(enc.dictionary))
                pairs, n = np.unique(row * words + enc.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at = pa.array(pairs // words)
                yield pa.RecordBatch.from_arrays([ids.take(at), langs.take(at), enc.dictionary.take(pa.array(pairs % words)), pa.array(n.astype(np.int64))], schema=kind)

    return df.select("tweet_id", "lang", "tokens").mapInArrow(run, schema)


def length_histogram(df: DataFrame, length: Column, cap: int | None = None) -> DataFrame:
    """(length, n); lengths from `cap` on count as one."""
    return df.groupBy((F.least(length, F.lit(cap)) if cap else length).alias("length")).agg(F.count("*").alias("n"))


def corpus(df: DataFrame) -> DataFrame:
    """One row: messages, users, tokens, vocabulary, mean tokens of a message, and how many are empty. df has tokens."""
    one = df.agg(F.count("*").alias("n_tweets"), F.count_distinct("user_id").alias("n_users"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n_tokens"), rounded(F.avg(F.size("tokens"))).alias("mean_tokens"), F.count_if(F.size("tokens") == 0).alias("n_empty"))
    words = df.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("n_words"))
    return one.crossJoin(words)


def cumulative(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with `cumulative`, the running sum of value by key over every whole number in between, however sparse."""
    span = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias(key))
    return span.join(df, key, "left").select(key, F.coalesce(value, F.lit(0)).alias(value)).withColumn("cumulative", F.sum(value).over(Window.orderBy(key)))
