"""Day windows over arriving messages: rows of a day before the one that is open are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def late_dropped(df: DataFrame, arrival: str, time: str) -> DataFrame:
    """df without the rows whose day lies before the latest day that arrived until them.

    Works in two steps, so that no task sees the whole order: the latest day of each of many
    ranges of arrivals, and the running latest within a range.
    """
    day = F.to_date(time)
    own = df.withColumn("_day", day)
    spans = own.withColumn("_span", F.floor(F.col(arrival) / 4096))
    tops = spans.groupBy("_span").agg(F.max("_day").alias("_top"))
    before = tops.select("_span", F.max("_top").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("_day").over(Window.partitionBy("_span").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0))
    run = spans.join(before, "_span", "left").withColumn("_open", F.greatest(inside, F.coalesce("_before", inside)))
    return run.where("_day >= _open").select(*df.columns)


def day_counts(stream: DataFrame, time: str = "ts", late: str = "0 seconds", length: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, *keys, n, value): messages of each day window; a closed day takes no more rows.  Also over batch tables."""
    own = stream.withWatermark(time, late) if stream.isStreaming else stream
    counted = own.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n", "value")


def seen_users(stream: DataFrame, user: str = "user_id", time: str = "ts", late: str = "30 days") -> DataFrame:
    """The first message of each user, by state that lasts as long as the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([user])


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drives a streaming DataFrame over all that is there and returns what it put out."""
    spark = df.sparkSession
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def partitioned_sink(stream: DataFrame, path: str, checkpoint: str, time: str = "ts"):
    """Starts a stream that appends to one folder a day; files appear whole, and a restart goes on from the checkpoint."""
    own = stream.withColumn("event_date", F.to_date(time))
    return own.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("event_date").trigger(availableNow=True).start()
