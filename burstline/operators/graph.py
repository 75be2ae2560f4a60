"""Similarity of bursty units, neighbours, and greedy clusters.

A window has at most K bursty units (the top-K of the burst operator), which bounds pairs,
neighbour lists and the arrays of the fold, whatever the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scores as S
from ..functions import text as T

#: Lots of features of a part of the day, which one task counts one after the other.
SALTS = 4


def subwindow_totals(df: DataFrame, m: int = 12) -> DataFrame:
    """(window_id, m, n): distinct messages of each part of a day."""
    return df.groupBy("window_id", T.subwindow(F.col("hour"), m).alias("m")).agg(F.count_distinct("tweet_id").alias("n"))


def _part_rows(messages: DataFrame, segs: dict, m: int) -> DataFrame:
    """Rows (window_id, m, salt, feature, idf, words, segs), dealt by window and part of the day: the features of a part with their idf, then its messages that hold a unit, cut by feature.

    messages: (tweet_id, window_id, hour, tokens); rows of one tweet_id are one message.  segs: seg_id by unit, by window.
    A message goes out once a salt with its words there, and never once a pair of unit and word.
    """
    part = T.subwindow(F.col("hour"), m).alias("m")
    salt = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(SALTS)).cast("int")
    own = messages.where(F.size("tokens") > 0).select("tweet_id", "window_id", part, "tokens")
    n = own.agg(F.count_distinct("tweet_id").alias("n_all"))
    seen = own.select("tweet_id", "window_id", "m", F.explode(F.array_distinct("tokens")).alias("feature")).groupBy("feature").agg(F.count_distinct("tweet_id").alias("df"), F.collect_set(F.struct("window_id", "m")).alias("parts"))  # the parts of all windows at most
    none = F.array().cast("array<string>")
    features = seen.crossJoin(F.broadcast(n)).select(F.explode("parts").alias("p"), "feature", S.idf(F.col("n_all"), F.col("df")).alias("idf")).select("p.window_id", "p.m", salt(F.col("feature")).alias("salt"), "feature", "idf", none.alias("words"), F.array().cast("array<int>").alias("segs"))
    schema = features.schema

    def deal(batches):
        for batch in batches:
            out = []
            for rows in batch.column(0).to_pylist():
                words, held = [[] for _ in range(SALTS)], {}
                for r in rows:
                    known = segs.get(r["window_id"], {})
                    for t in r["tokens"]:
                        words[zlib.crc32(t.encode()) % SALTS].append(t)
                    held.setdefault((r["window_id"], r["m"]), set()).update(known[t] for t in set(r["tokens"]) if t in known)
                out += [(*key, k, None, None, w, sorted(x)) for key, x in held.items() if x for k, w in enumerate(words)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=kinds)

    whole = own.groupBy("tweet_id").agg(F.collect_list(F.struct("window_id", "m", "tokens")).alias("rows")).select("rows")  # of one message
    kinds = to_arrow_schema(schema)
    both = features.unionByName(whole.mapInArrow(deal, schema))
    count = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return both.repartition(count, "window_id", "m").sortWithinPartitions("window_id", "m", "salt", F.col("idf").isNull())


def _parts(batches, k: int):
    """(window_id, m, salt, features, idf, tf, messages by unit) of rows dealt by _part_rows(): tf is k units times the features of a salt."""
    key, index, idf, tf, held = None, {}, [], None, None
    for batch in batches:
        for window, m, salt, feature, value, words, segs in zip(*(c.to_pylist() for c in batch.columns)):
            if (window, m, salt) != key:
                if tf is not None:
                    yield *key, list(index), np.array(idf), tf, held
                key, index, idf, tf = (window, m, salt), {}, [], None
            if feature is not None:
                index[feature] = len(idf)
                idf.append(value)
                continue
            if tf is None:
                tf, held = np.zeros((k, len(idf))), np.zeros(k)
            held[segs] += 1
            if words:
                at, n = np.unique([index[w] for w in words], return_counts=True)
                tf[np.ix_(segs, at)] += n
    if tf is not None:
        yield *key, list(index), np.array(idf), tf, held


def _segs(top: DataFrame) -> tuple[dict, dict, int]:
    """seg_id by unit, and messages by seg_id, by window; and one more than the largest seg_id: K units a window at most."""
    rows = top.select("window_id", "unit", "seg_id", "f").collect()
    units, counts = {}, {}
    for w, unit, seg, f in rows:
        units.setdefault(w, {})[unit] = seg
        counts.setdefault(w, {})[seg] = f
    return units, counts, max((r["seg_id"] for r in rows), default=-1) + 1


def tfidf(messages: DataFrame, top: DataFrame, m: int = 12) -> DataFrame:
    """(window_id, m, seg_id, feature, tf, weight): words of all messages in a part of the day that hold the unit.

    idf is over the whole corpus.
    """
    units, _, k = _segs(top)
    rows = _part_rows(messages, units, m)
    schema = T_.StructType([rows.schema["window_id"], rows.schema["m"], *T_._parse_datatype_string("seg_id int, feature string, tf long, weight double")])
    kind = to_arrow_schema(schema)

    def run(batches):
        for window, m, _, features, idf, tf, _ in _parts(batches, k):
            names = pa.array(features, pa.string())
            for seg in np.flatnonzero(tf.any(1)):
                at = np.flatnonzero(tf[seg])
                n = tf[seg, at]
                yield pa.RecordBatch.from_arrays([pa.array([x], t).take(pa.array(np.zeros(len(at), np.int32))) for x, t in zip((window, m, int(seg)), kind.types)] + [names.take(pa.array(at)), pa.array(n.astype(np.int64)), pa.array(n * idf[at])], schema=kind)

    return rows.mapInArrow(run, schema)


def pair_similarity(messages: DataFrame, top: DataFrame, m: int = 12) -> DataFrame:
    """(window_id, seg_i, seg_j, sim), seg_i < seg_j: sum over the day's parts of both shares times the cosine of the units' weights as in tfidf().

    A unit's share is the part of its messages that is in the part of the day.  Scalar products of a part are made where its rows
    are, so that K units give K * (K - 1) / 2 rows a part at most, whatever the corpus.
    """
    units, counts, k = _segs(top)
    rows = _part_rows(messages, units, m)
    schema = T_.StructType([rows.schema["window_id"], *T_._parse_datatype_string("seg_i int, seg_j int, part double")])
    kind = to_arrow_schema(schema)

    def products(window, gram, held):
        f = np.array([counts[window].get(seg, 1) for seg in range(k)], float)
        norm = np.sqrt(np.diag(gram))
        i, j = np.nonzero(np.triu(gram > 0, 1))
        part = (held / f)[i] * (held / f)[j] * (gram[i, j] / (norm[i] * norm[j]))
        return pa.RecordBatch.from_arrays([pa.array([window], kind.field(0).type).take(pa.array(np.zeros(len(i), np.int32))), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(part)], schema=kind)

    def run(batches):
        key, gram, seen = None, None, None
        for window, m, _, _, idf, tf, held in _parts(batches, k):
            if (window, m) != key:
                if key is not None:
                    yield products(key[0], gram, seen)
                key, gram, seen = (window, m), np.zeros((k, k)), held
            weight = tf * idf
            gram += weight @ weight.T
        if key is not None:
            yield products(key[0], gram, seen)

    parts = rows.mapInArrow(run, schema)
    return parts.groupBy("window_id", "seg_i", "seg_j").agg(S.rounded(F.sum("part")).alias("sim")).where("sim > 0")


def knn(pairs: DataFrame, k: int = 9) -> DataFrame:
    """(window_id, src, dst, sim, rank): the k most similar neighbours of each unit; ties to the smaller."""
    both = pairs.select("window_id", F.col("seg_i").alias("src"), F.col("seg_j").alias("dst"), "sim").unionByName(pairs.select("window_id", F.col("seg_j").alias("src"), F.col("seg_i").alias("dst"), "sim"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("window_id", "src").orderBy(F.desc("sim"), "dst"))).where(F.col("rank") <= k)


def mutual(edges: DataFrame) -> DataFrame:
    """(window_id, src, dst, sim) of neighbours that are each other's."""
    back = edges.select("window_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("window_id", "src", "dst", "sim").join(back, ["window_id", "src", "dst"], "left_semi")


def greedy_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(window_id, seg_id, event_id): in the order of seg_id, a unit's free mutual neighbours join its event.

    A unit without an event founds one under its own id when its turn comes.  Units that have an
    event never move, so that a mutual edge doesn't imply one event.
    """
    lists = edges.groupBy("window_id", "src").agg(F.collect_list("dst").alias("near"))  # k at most
    rows = nodes.select("window_id", F.col("seg_id").alias("src")).join(lists, ["window_id", "src"], "left")
    own = rows.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("src", F.coalesce("near", F.array().cast("array<int>")).alias("near")))).alias("units"))
    n = F.size("units")

    def visit(acc, i):
        return F.transform(acc, lambda v, x: F.when(v >= 0, v).when(x == i, i).when(F.array_contains(F.col("units")[i]["near"], x), F.when(acc[i] >= 0, acc[i]).otherwise(i)).otherwise(v))

    labels = F.aggregate(F.sequence(F.lit(0), n - 1), F.transform("units", lambda u: F.lit(-1)), visit)
    return own.select("window_id", F.posexplode(labels).alias("seg_id", "event_id"))


def cluster_edges(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(window_id, event_id, seg_i, seg_j, sim): mutual edges inside an event that the fold grew it by.

    A unit joins by the edge to the unit whose turn it was: the smallest mutual neighbour of its
    event that isn't after it in the order of turns, or its founder.
    """
    a = clusters.select("window_id", F.col("seg_id").alias("src"), F.col("event_id").alias("e1"))
    b = clusters.select("window_id", F.col("seg_id").alias("dst"), F.col("event_id").alias("e2"))
    inside = edges.join(a, ["window_id", "src"]).join(b, ["window_id", "dst"]).where("e1 = e2 and dst <> e1")
    joined = inside.groupBy("window_id", F.col("e1").alias("event_id"), "dst").agg(F.min(F.struct("src", "sim")).alias("by"))
    return joined.select("window_id", "event_id", F.least("by.src", "dst").alias("seg_i"), F.greatest("by.src", "dst").alias("seg_j"), F.col("by.sim").alias("sim"))
