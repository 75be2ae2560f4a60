"""Readers of the text formats that the stages exchange; each gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import window_of

USER = "struct<id_str:string,created_at:string,location:string,lang:string,statuses_count:long,favourites_count:long,listed_count:long,friends_count:long,followers_count:long,screen_name:string,name:string,description:string>"
ENTITIES = "struct<user_mentions:array<struct<id_str:string,screen_name:string>>,hashtags:array<struct<text:string>>,urls:array<struct<url:string,expanded_url:string>>>"
MESSAGE = f"id_str string, text string, created_at string, lang string, retweet_count long, retweeted boolean, favorited boolean, in_reply_to_status_id_str string, entities {ENTITIES}, user {USER}, _bad string"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Messages from lines of JSON.  Blank lines are skipped; `_bad` holds a line that is no JSON object."""
    clean = T.collapse(F.trim(F.col(column)))
    body = F.from_json(clean, MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.trim(F.col(column)) != "").withColumn("_m", body).select(*(c for c in lines.columns if c != column), "_m.*")


def messages(parsed_: DataFrame) -> DataFrame:
    """The message attributes, null where missing; rows without an id go."""
    return parsed_.where("_bad is null and id_str is not null").select("id_str", "text", "created_at", T.message_time(F.col("created_at")).alias("created"), "lang", "retweet_count", "retweeted", "favorited", "in_reply_to_status_id_str", "entities", "user")


def users(parsed_: DataFrame) -> DataFrame:
    """The user attributes of messages that have a user with an id."""
    return parsed_.where("_bad is null and user.id_str is not null").select(F.col("id_str").alias("message_id"), "user.*")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, missing): how often each attribute, also a nested one, is null."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(columns))))
    return counts.select(pairs.alias("p")).select("p.*")


def json_messages(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): one a line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def gram_values(spark: SparkSession, path: str) -> DataFrame:
    """(gram, value, n, window_id) from lines "value gram" or "value TAB gram"; the first value of a gram by file name stands."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    cut = F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)\s*$", 0) != ""
    own = lines.where(cut).select(F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)\s*$", 2).alias("gram"), F.expr("try_cast(regexp_extract(value, '^\\\\s*(\\\\S+)', 1) as double)").alias("v"), "file")
    return own.where("v is not null and gram <> ''").groupBy("gram", window_of(F.col("file")).alias("window_id")).agg(F.min_by("v", "file").alias("value")).withColumn("n", F.size(F.split("gram", "[ _]")))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(tweet_id, text, window_id) from lines "id text" or "id TAB text"."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("value rlike '^\\\\S+\\\\s'")
    return lines.select(F.regexp_extract("value", r"^(\S+)\s+(.*)$", 1).alias("tweet_id"), F.regexp_extract("value", r"^(\S+)\s+(.*)$", 2).alias("text"), window_of(F.col("file")).alias("window_id"))


def segmented(spark: SparkSession, path: str) -> DataFrame:
    """(tweet_id, score, segments, window_id) from lines of id, score and segments joined by |, with TABs between."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p"), F.col("_metadata.file_path").alias("file")).where(F.size("p") >= 3)
    return lines.select(F.col("p")[0].alias("tweet_id"), F.col("p")[1].cast("double").alias("score"), F.filter(F.split(F.col("p")[2], r"\|"), lambda s: s != "").alias("segments"), window_of(F.col("file")).alias("window_id"))


def slang(spark: SparkSession, path: str) -> DataFrame:
    """(slang, word) from lines "slang  -   word"."""
    return spark.read.text(path).where("value like '%  -   %'").select(F.trim(F.split("value", "  -   ")[0]).alias("slang"), F.trim(F.split("value", "  -   ")[1]).alias("word"))


def tagged(spark: SparkSession, path: str) -> DataFrame:
    """(tweet_id, tags) from lines "id TAB #a #b", tags lower-cased."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    return lines.select(F.col("p")[0].alias("tweet_id"), T.split_spaces(F.lower(F.col("p")[1])).alias("tags"))


def weighted(spark: SparkSession, path: str) -> DataFrame:
    """(item, weight) from lines "item TAB weight", items lower-cased."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    return lines.select(F.lower(F.col("p")[0]).alias("item"), F.col("p")[1].cast("double").alias("weight"))


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.monotonically_increasing_id())


def _label(value: Column) -> Column:
    return F.when(F.regexp_replace(value, r"^\+", "").cast("double") == 1, 1).otherwise(0)


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    """(line, label 0/1, features map<int,double>) from lines "label index:value ..."; -1 is 0."""
    lines = _numbered(spark.read.text(path).where("trim(value) <> ''"))
    parts = T.split_spaces(F.col("value"))
    pairs = F.map_from_entries(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.split(p, ":")[0].cast("int"), F.split(p, ":")[1].cast("double"))))
    return lines.select("line", _label(parts[0]).alias("label"), pairs.alias("features"))


def arff(spark: SparkSession, path: str) -> DataFrame:
    """(line, label, x) from the rows after @data; the last column is the class."""
    lines = _numbered(spark.read.text(path).where("not value rlike '^\\\\s*([@%]|$)'"))
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    return lines.select("line", F.element_at(parts, -1).alias("label"), F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.cast("double")).alias("x"))


def training_rows(spark: SparkSession, path: str, form: int = 3) -> DataFrame:
    """(line, label, features map<string,double>): form 1 has tokens, 2 index:value, 3 name:value.  # starts a comment, ||| ends the features."""
    body = F.trim(F.substring_index(F.substring_index("value", "#", 1), "|||", 1))
    lines = _numbered(spark.read.text(path).withColumn("value", body).where("value <> ''"))
    parts = T.split_spaces(F.col("value"))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    if form == 1:
        pairs = F.transform(F.array_distinct(rest), lambda p: F.struct(p, F.lit(1.0)))
    else:
        pairs = F.transform(rest, lambda p: F.struct(F.regexp_extract(p, "^(.*):[^:]*$", 1), F.regexp_extract(p, ":([^:]*)$", 1).cast("double")))
    return lines.select("line", parts[0].alias("label"), F.map_from_entries(pairs).alias("features"))


def labelled_events(spark: SparkSession, path: str) -> DataFrame:
    """(event_key, label) from heads "X###Event DD_N ratio: ...", the number padded."""
    head = r"^([A-Z])#+Event (\d+)_(\d+) ratio"
    lines = spark.read.text(path).where(F.col("value").rlike(head))
    return lines.select(F.concat_ws("_", F.regexp_extract("value", head, 2), T.padded(F.regexp_extract("value", head, 3))).alias("event_key"), F.regexp_extract("value", head, 1).alias("label"))


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, label) from one digit a line."""
    return _numbered(spark.read.text(path).where("value <> ''")).select("line", F.substring("value", 1, 1).cast("int").alias("label"))


def model(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, value) of a stored linear model."""
    return spark.read.schema("section string, key string, value double").parquet(path)
