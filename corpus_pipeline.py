"""The training-data pipeline: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), docs being a stored table with the columns of `documents`, and
returns a DataFrame, which is written and read again for the next.  Null texts pass every stage but
packing as they are; there they are documents without tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm import minhash, packing, pii, substrings, toxicity
from burstline.llm.common import session, table, written

#: Ids that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    longest = max(docs.columns, key=len)
    names = tuple(f"{longest}_{x}" for x in ("score", "threshold", "toxic"))  # docs has none of them
    return toxicity.score(docs, model, names).where(F.col(names[2]) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; rows of one doc_id count as one document."""
    session(spark)
    gone = written(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id holds too."""
    session(spark)
    return substrings.without(docs, substrings.repeats(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows."""
    session(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 1024."""
    session(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("personal data", redact),
    ("packing", pack),
]

#: Trained scores and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
