"""Canonical tables: messages, units and grams, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def unit_events(self) -> DataFrame:
        """(tweet_id, unit, user_id, window_id, hour) of every event: units that users name in day windows."""
        e = self.events
        return e.select(F.col("event_id").alias("tweet_id"), F.get_json_object("props", "$.k").alias("unit"), "user_id", F.date_format("ts", "yyyy-MM-dd").alias("window_id"), F.hour("ts").alias("hour"))

    def tweets(self) -> DataFrame:
        """(tweet_id, text, lang, tokens, user_id, window_id, hour) of every document, whole texts."""
        d = self.documents
        i = F.col("doc_id")
        return d.select(i.alias("tweet_id"), "text", "lang", "source", T.words(F.col("text")).alias("tokens"), (i % 97).alias("user_id"), (i % 15 + 1).alias("window_id"), (F.floor(i / 15) % 24).cast("int").alias("hour"))

    def turns(self) -> DataFrame:
        """The same of every turn of the conversations; a conversation is a user."""
        c = self.conversations
        i = F.col("conv_id")
        return c.select((i * 1000 + F.col("turn")).alias("tweet_id"), "text", T.words(F.col("text")).alias("tokens"), i.alias("user_id"), (i % 15 + 1).alias("window_id"), (F.col("turn") * 3 % 24).cast("int").alias("hour"))

    def turn_words(self) -> DataFrame:
        """(tweet_id, user_id, window_id, hour, unit) of every word of every turn, repeats included."""
        return self.turns().select("tweet_id", "user_id", "window_id", "hour", F.explode("tokens").alias("unit"))

    def anchors(self) -> DataFrame:
        """(page_id, anchor) of every link text of the pages, lower-cased and trimmed."""
        found = F.regexp_extract_all("html", F.lit("<a [^>]*>([^<]*)</a>"), F.lit(1))
        return self.pages.select("page_id", F.explode(found).alias("a")).select("page_id", F.lower(F.trim("a")).alias("anchor")).where("anchor <> ''")

    def tags(self) -> DataFrame:
        """(tweet_id, window_id, tag) from the names of parts, which stand in for hashtags."""
        p = self.part
        return p.select(F.col("p_partkey").alias("tweet_id"), (F.col("p_partkey") % 15 + 1).alias("window_id"), F.concat(F.lit("#"), F.lower(F.replace("p_name", F.lit(" "), F.lit("")))).alias("tag"), F.col("p_size").cast("long").alias("weight"))

    def vectors(self) -> DataFrame:
        """(instance_id, label, x array<double>) of labelled documents: six measures of a text."""
        words = T.words(F.col("text"))
        n = F.greatest(F.size("w"), F.lit(1)).cast("double")
        chars = F.greatest(F.length("text"), F.lit(1)).cast("double")
        measures = F.array(
            F.length("text").cast("double"),
            F.size("w").cast("double"),
            F.size(F.array_distinct("w")) / n,
            F.length(F.regexp_replace("text", "[^0-9]+", "")) / chars,
            F.length(F.regexp_replace("text", "[^A-Z]+", "")) / chars,
            F.length(F.regexp_replace("text", "[a-zA-Z0-9 ]+", "")) / chars,
        )
        # Texts are measured where they are read; only six numbers of each meet the labels.
        measured = self.documents.withColumn("w", words).select("doc_id", measures.alias("x"))
        return measured.join(self.labels, "doc_id").select(F.col("doc_id").alias("instance_id"), F.col("quality").alias("label"), "x")


def window_of(path: Column) -> Column:
    """The window of a file: the last two characters of its name, without an ending."""
    return F.regexp_extract(path, r"([^/.]{2})(?:\.[A-Za-z]+)*$", 1)


#: DuckDB's words for the same tables.
SQL = {
    "ue": "ue AS (SELECT event_id AS tweet_id, json_extract_string(props, '$.k') AS unit, user_id, strftime(ts, '%Y-%m-%d') AS window_id, hour(ts) AS hour FROM events)",
    "tweets": "tweets AS (SELECT doc_id AS tweet_id, text, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens, doc_id % 97 AS user_id, doc_id % 15 + 1 AS window_id, (doc_id // 15) % 24 AS hour FROM documents)",
    "turns": "turns AS (SELECT conv_id * 1000 + turn AS tweet_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens, conv_id AS user_id, conv_id % 15 + 1 AS window_id, turn * 3 % 24 AS hour FROM conversations)",
    "tw": "tw AS (SELECT tweet_id, user_id, window_id, hour, unnest(tokens) AS unit FROM turns)",
    "anchors": "anchors AS (SELECT page_id, anchor FROM (SELECT page_id, lower(trim(unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)))) AS anchor FROM pages) WHERE anchor <> '')",
    "tags": "tags AS (SELECT p_partkey AS tweet_id, p_partkey % 15 + 1 AS window_id, '#' || lower(replace(p_name, ' ', '')) AS tag, CAST(p_size AS BIGINT) AS weight FROM part)",
    "vectors": """vectors AS (SELECT instance_id, label, [CAST(length(text) AS DOUBLE), CAST(len(w) AS DOUBLE), len(list_distinct(w)) / n, length(regexp_replace(text, '[^0-9]', '', 'g')) / chars,
      length(regexp_replace(text, '[^A-Z]', '', 'g')) / chars, length(regexp_replace(text, '[a-zA-Z0-9 ]', '', 'g')) / chars] AS x
      FROM (SELECT doc_id AS instance_id, quality AS label, text, w, CAST(greatest(len(w), 1) AS DOUBLE) AS n, CAST(greatest(length(text), 1) AS DOUBLE) AS chars
            FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents JOIN labels USING (doc_id))))""",
}


def sql(*names: str) -> str:
    """WITH RECURSIVE and the named tables, for more to follow after a comma."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
