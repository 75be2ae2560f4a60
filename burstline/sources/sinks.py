"""Writers of the stages' results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_window(df: DataFrame, path: str, column: str = "window_id") -> None:
    """Parquet with a folder for each window; rows of one window may be written by several tasks."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def lines(df: DataFrame, path: str, *columns: str, by: str = "\t") -> None:
    """One text line a row, columns joined; arrays by |."""
    kinds = dict(df.dtypes)
    text = F.concat_ws(by, *(F.array_join(c, "|") if kinds[c].startswith("array") else F.col(c).cast("string") for c in columns))
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def grams(df: DataFrame, path: str) -> None:
    """Distinct grams, a folder for each window."""
    df.select("window_id", "gram").distinct().write.mode("overwrite").partitionBy("window_id").text(path)


def segmented(df: DataFrame, path: str) -> None:
    lines(df, path, "tweet_id", "score", "segments")


def unit_values(df: DataFrame, path: str, value: str) -> None:
    """"value TAB unit" in the order of the units."""
    lines(df.orderBy("unit"), path, value, "unit")


def event_segments(df: DataFrame, path: str) -> None:
    """"f TAB wb TAB unit" of each window in the order of seg_id."""
    text = F.concat_ws("\t", F.col("f").cast("string"), F.col("wb").cast("string"), "unit")
    df.orderBy("window_id", "seg_id").select("window_id", text.alias("value")).write.mode("overwrite").partitionBy("window_id").text(path)


def libsvm(df: DataFrame, path: str, signed: bool = False) -> None:
    """"label index:value ..." from (label, x), indices from 1; signed writes -1 for 0."""
    pairs = F.array_join(F.transform("x", lambda v, i: F.concat_ws(":", (i + 1).cast("string"), v.cast("string"))), " ")
    label = F.when(F.col("label") > 0, "+1").otherwise("-1") if signed else F.col("label").cast("string")
    df.select(F.concat_ws(" ", label, pairs).alias("value")).write.mode("overwrite").text(path)


def arff_lines(df: DataFrame, names: list[str], relation: str = "events") -> DataFrame:
    """(part, value): head and rows of an ARFF file from (label, x)."""
    spark = df.sparkSession
    head = [f"@relation {relation}", *(f"@attribute {n} numeric" for n in names), "@attribute class {0,1}", "@data"]
    top = spark.createDataFrame([(0, i, h) for i, h in enumerate(head)], "part int, line long, value string")
    rows = df.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("line"), F.concat_ws(",", F.array_join(F.transform("x", lambda v: v.cast("string")), ","), F.col("label").cast("string")).alias("value"))
    return top.unionByName(rows)


def splits(df: DataFrame, dev: list, test: list, day: str = "window_id") -> DataFrame:
    """df with `split`: dev, test or train by day."""
    return df.withColumn("split", F.when(F.col(day).isin(dev), "dev").when(F.col(day).isin(test), "test").otherwise("train"))


def model(df: DataFrame, path: str) -> None:
    df.select("section", "key", "value").write.mode("overwrite").parquet(path)
