"""Language model, anchors, cohesion of grams, and cutting messages into their most cohesive phrases."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scores as S
from ..functions import text as T
from ..sources.stored import written

LONGEST = 5
#: Two to this power is the number of bits that tell which grams are wanted.
FILTER_BITS = 27
#: Texts whose grams are looked up at once.
ROWS = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(df: DataFrame, longest: int = LONGEST, *keep: str) -> DataFrame:
    """(*keep, n, gram) of every place."""
    return df.select(*keep, F.explode(T.ngrams(F.col("tokens"), longest)).alias("g")).select(*keep, "g.n", "g.gram")


def log_probabilities(df: DataFrame, longest: int = LONGEST, among: DataFrame | None = None) -> DataFrame:
    """(gram, n, count, logp): log10 of a gram's share of all grams of its length; of the grams that are among (gram) only, if given.

    How many grams of a length there are follows from the sizes of the messages.
    """
    own = grams(df, longest) if among is None else grams_among(df, gram_filter(among), longest, "tweet_id")
    counts = own.groupBy("gram", "n").agg(F.count("*").alias("count"))
    counts = counts if among is None else counts.join(among.select("gram"), "gram", "left_semi")
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.greatest(F.size("tokens") - (n - 1), F.lit(0)).alias("places")) for n in range(1, longest + 1)))).alias("p")
    totals = df.where(F.size("tokens") > 0).select(places).groupBy("p.n").agg(F.sum("p.places").alias("total"))
    return counts.join(F.broadcast(totals), "n").select("gram", "n", "count", F.log10(F.col("count") / F.col("total")).alias("logp"))  # one total a length


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of a column."""
    enc = words.dictionary_encode()
    own = np.array([zlib.crc32(w.encode()) for w in enc.dictionary.to_pylist()] or [0], np.uint64)
    return own[enc.indices.to_numpy(zero_copy_only=False)] * _ODD if len(words) else np.zeros(0, np.uint64)


def _longer(h: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams at all places, from those of the (n - 1)-grams and of the words."""
    return (h[:-1] ^ h[:-1] >> np.uint64(29)) * _ODD + word[n - 1 :]


def _bit(h: np.ndarray) -> np.ndarray:
    for by in (30, 27):
        h = (h ^ h >> np.uint64(by)) * _ODD
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def gram_filter(wanted: DataFrame):
    """2^FILTER_BITS bits of the grams of wanted (gram), as a broadcast value: 16 MB, whatever their number."""

    def bits(batches):
        for batch in batches:
            lists = pc.split_pattern(batch.column(0), " ")
            word, ends = _hashes(lists.flatten()), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
            n, out = np.diff(lists.offsets.to_numpy()), np.zeros(batch.num_rows, np.int64)
            h = word
            for size in range(1, int(n.max(initial=0)) + 1):
                h = _longer(h, word, size) if size > 1 else h
                own = n == size
                out[own] = _bit(h[ends[own] - size])
            yield pa.RecordBatch.from_arrays([pa.array(out)], ["bit"])

    at = F.col("bit") + 1
    rows = wanted.select("gram").mapInArrow(bits, "bit long").groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    every = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for k, own in rows:
        every[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(own), np.uint8)
    return wanted.sparkSession.sparkContext.broadcast(every)


def grams_among(df: DataFrame, wanted, longest: int, key: str, once: bool = False) -> DataFrame:
    """(key, n, gram) of the places of df (key, tokens) whose gram is in the filter `wanted`: all that it was made of, and a few others.

    Only these are made and shuffled.  With once=True a word is given once a row.
    """
    schema = T_.StructType([df.schema[key], *T_._parse_datatype_string("n int, gram string")])
    kind = to_arrow_schema(schema)

    def run(batches):
        bits = wanted.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                keys, lists = batch.column(0).slice(lo, ROWS), batch.column(1).slice(lo, ROWS)
                flat, sizes = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                ends = np.repeat(np.cumsum(sizes), sizes)
                word = _hashes(flat)
                h = word
                for n in range(1, longest + 1):
                    if len(flat) < n:
                        break
                    h = _longer(h, word, n) if n > 1 else h
                    bit = _bit(h)
                    at = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1) & (np.arange(len(h)) + n <= ends[: len(h)]))
                    if n == 1 and once:
                        code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                        at = at[np.unique(row[at] * len(flat) + code[at], return_index=True)[1]]
                    if len(at):
                        parts = [flat.take(pa.array(at + i)) for i in range(n)]
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[at])), pa.array(np.full(len(at), n, np.int32)), pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]], schema=kind)

    return df.select(key, "tokens").mapInArrow(run, schema)


def keyphraseness(anchors: DataFrame, pages: DataFrame, longest: int = LONGEST, among: DataFrame | None = None) -> DataFrame:
    """(gram, linked, pages, prob): of the pages that hold a gram, the share that hold it inside a link.

    Both sides are grams of pages; they meet by gram, and only grams of links are counted, or of these the ones that are among (gram).
    """
    link = anchors.select("page_id", T.words(F.col("anchor")).alias("tokens"))
    own = grams(link, longest, "page_id") if among is None else grams_among(link, gram_filter(among), longest, "page_id", True).join(among.select("gram"), "gram", "left_semi")
    linked = written(own.groupBy("gram").agg(F.count_distinct("page_id").alias("linked")), "linked")
    body = pages.select("page_id", T.words(F.regexp_replace("html", "<[^>]*>", " ")).alias("tokens"))
    held = grams_among(body, gram_filter(linked), longest, "page_id", True).groupBy("gram").agg(F.count_distinct("page_id").alias("pages"))
    return linked.join(held, "gram").select("gram", "linked", "pages", F.least(F.col("linked") / F.col("pages"), F.lit(1.0)).alias("prob"))


def gram_stickiness(lm: DataFrame, anchors: DataFrame) -> DataFrame:
    """(gram, n, scp, stickiness) of every gram, once for the corpus.

    SCP of a gram is log10 of p squared over the mean product of p of its two parts, over all cuts; of a
    single word twice its log10 p.  Parts that the model lacks count as 10^-100.
    """
    words = F.split("gram", " ")
    cuts = lm.where("n > 1").select("gram", "n", "logp", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(F.array_join(F.slice(words, 1, i), " ").alias("l"), F.array_join(F.slice(words, i + 1, F.col("n") - i), " ").alias("r")))).alias("c"))
    p = lm.select(F.col("gram").alias("part"), F.col("logp").alias("lp"))
    left = cuts.join(p, F.col("c.l") == p.part, "left").select("gram", "n", "logp", "c", F.coalesce("lp", F.lit(S.MISSING_LOG)).alias("a"))
    both = left.join(p, F.col("c.r") == p.part, "left").select("gram", "n", "logp", "a", F.coalesce("lp", F.lit(S.MISSING_LOG)).alias("b"))
    mean = both.groupBy("gram", "n", "logp").agg(F.avg(F.pow(F.lit(10.0), F.col("a") + F.col("b"))).alias("mean"))
    many = mean.select("gram", "n", (2 * F.col("logp") - S.safe_log10(F.col("mean"))).alias("scp"))
    scp = lm.where("n = 1").select("gram", "n", (2 * F.col("logp")).alias("scp")).unionByName(many)
    known = scp.join(anchors.select("gram", "prob"), "gram", "left")
    return known.select("gram", "n", S.rounded(F.col("scp")).alias("scp"), S.rounded(S.stickiness(F.col("scp"), F.col("n"), F.coalesce("prob", F.lit(0.0)))).alias("stickiness"))


def segment(df: DataFrame, sticky: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(tweet_id, window_id, segments, score): the cut of each message into phrases of 1..longest words with the largest sum of stickiness.

    Grams meet their stickiness in one join and return as one array a message; the best cut is a fold
    over its places, which keeps the score, the first place of the last phrase, and nothing else.
    Of equal scores the longer last phrase wins.  A message without tokens has no segments.
    """
    own = df.select("tweet_id", "window_id", F.explode(T.ngrams(F.col("tokens"), longest)).alias("g")).select("tweet_id", "window_id", "g.at", "g.n", "g.gram")
    scored = own.join(sticky.select("gram", "stickiness"), "gram", "left")
    ends = scored.groupBy("tweet_id", "window_id", (F.col("at") + F.col("n")).alias("end")).agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("stickiness", F.lit(0.0)).alias("s"))), False).alias("c"))  # `longest` at most
    rows = ends.groupBy("tweet_id", "window_id").agg(F.sort_array(F.collect_list(F.struct("end", "c"))).alias("ends"))

    def step(acc, e):
        choice = lambda x: F.struct(F.round(acc[e["end"] - x["n"]]["score"] + x["s"], 9).alias("score"), x["n"].alias("n"))
        return F.array_append(acc, F.array_max(F.transform(e["c"], choice)))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("n")))
    best = rows.select("tweet_id", "window_id", F.aggregate("ends", start, step).alias("best"))
    # Back from the end: the first place of each phrase.
    cut = F.aggregate(F.sequence(F.size("best") - 1, F.lit(1), F.lit(-1)), F.struct(F.array().cast("array<int>").alias("cuts"), (F.size("best") - 1).alias("at")), lambda a, i: F.when(a["at"] == i, F.struct(F.array_append(a["cuts"], i).alias("cuts"), (i - F.col("best")[i]["n"]).alias("at"))).otherwise(a))
    cuts = best.select("tweet_id", "window_id", S.rounded(F.element_at("best", -1)["score"]).alias("score"), F.reverse(cut["cuts"]).alias("cuts"))
    joined = df.join(cuts, ["tweet_id", "window_id"], "left")
    phrases = F.transform("cuts", lambda e, i: F.array_join(F.slice("tokens", F.when(i == 0, 1).otherwise(F.col("cuts")[i - 1] + 1), e - F.when(i == 0, 0).otherwise(F.col("cuts")[i - 1])), " "))
    return joined.select("tweet_id", "window_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(phrases, F.array().cast("array<string>")).alias("segments"))
