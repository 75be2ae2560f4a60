"""How well events are found: confusion, precision, recall, and matches with news."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from .stats import cumulative


def confusion(df: DataFrame) -> DataFrame:
    """(predicted, label, n)."""
    return df.groupBy("predicted", "label").agg(F.count("*").alias("n"))


def metrics(df: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 and accuracy of predicted against label."""
    hit = F.count_if((F.col("predicted") == 1) & (F.col("label") == 1))
    one = df.agg(hit.alias("hit"), F.count_if(F.col("predicted") == 1).alias("said"), F.count_if(F.col("label") == 1).alias("all"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("acc"))
    p, r = S.ratio(F.col("hit"), F.col("said")), S.ratio(F.col("hit"), F.col("all"))
    return one.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(S.f1(p, r), 4).alias("f1"), S.rounded(F.coalesce("acc", F.lit(0.0))).alias("accuracy"))


def score_labels(df: DataFrame) -> DataFrame:
    """(score, label, n) by the score with one decimal."""
    return df.groupBy(F.round("score", 1).alias("score"), "label").agg(F.count("*").alias("n"))


def by_ratio(events: DataFrame) -> DataFrame:
    """(ceiling, events, true, false, doubtful, precision): judged events up to each whole ratio. events: (ratio, judged T, F or O)."""
    bins = events.groupBy(F.ceil("ratio").cast("int").alias("ceiling")).agg(F.count("*").alias("n"), *(F.count_if(F.col("judged") == x).alias(x) for x in "TFO"))
    span = bins.agg(F.min("ceiling").alias("a"), F.max("ceiling").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("ceiling"))
    w = Window.orderBy("ceiling")
    run = span.join(bins, "ceiling", "left").fillna(0).select("ceiling", *(F.sum(a).over(w).alias(b) for a, b in (("n", "events"), ("T", "true"), ("F", "false"), ("O", "doubtful"))))
    return run.withColumn("precision", S.rounded(S.ratio(F.col("true"), F.col("events"))))


def pooled_and_mean(events: DataFrame) -> DataFrame:
    """(ceiling, pooled, window_mean): precision over all events, and the mean of the windows' precisions, up to each ratio."""
    per = events.groupBy("window_id", F.ceil("ratio").cast("int").alias("ceiling")).agg(F.count("*").alias("n"), F.count_if(F.col("judged") == "T").alias("t"))
    ends = events.agg(F.min(F.ceil("ratio")).cast("int").alias("a"), F.max(F.ceil("ratio")).cast("int").alias("b")).where("a is not null")
    grid = events.select("window_id").distinct().crossJoin(F.broadcast(ends)).select("window_id", F.explode(F.sequence("a", "b")).alias("ceiling"))
    w = Window.partitionBy("window_id").orderBy("ceiling")
    run = grid.join(per, ["window_id", "ceiling"], "left").fillna(0).select("window_id", "ceiling", F.sum("n").over(w).alias("n"), F.sum("t").over(w).alias("t"))
    return run.groupBy("ceiling").agg(S.rounded(F.sum("t") / F.nullif(F.sum("n"), F.lit(0))).alias("pooled"), S.rounded(F.avg(F.col("t") / F.nullif(F.col("n"), F.lit(0)))).alias("window_mean"))


def duplicates(events: DataFrame) -> DataFrame:
    """(band, found, repeated, ratio): distinct true events up to each whole ratio, and the share found more than once. events: (ratio, event)."""
    own = events.select(F.ceil("ratio").cast("int").alias("at"), "event")
    ends = own.agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a is not null")
    bands = own.crossJoin(F.broadcast(ends)).select("event", F.explode(F.sequence("at", "b")).alias("band"))
    counts = bands.groupBy("band", "event").agg(F.count("*").alias("n"))
    return counts.groupBy("band").agg(F.count("*").alias("found"), F.count_if(F.col("n") > 1).alias("repeated")).withColumn("ratio", S.rounded(F.col("repeated") / F.col("found")))


def topk_sweep(ranked: DataFrame, most: int = 30) -> DataFrame:
    """(k, said, hits, precision, recall) for k from 1 to most, over ranked (window_id, rank, hit)."""
    every = ranked.agg(F.count_if("hit").alias("all"))
    own = ranked.where(F.col("rank") <= most).groupBy("rank").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    ks = ranked.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("rank"))
    w = Window.orderBy("rank")
    run = ks.join(own, "rank", "left").fillna(0).crossJoin(F.broadcast(every)).select(F.col("rank").alias("k"), F.sum("n").over(w).alias("said"), F.sum("h").over(w).alias("hits"), "all")
    return run.select("k", "said", "hits", S.rounded(S.ratio(F.col("hits"), F.col("said"))).alias("precision"), S.rounded(S.ratio(F.col("hits"), F.col("all"))).alias("recall"))


def matches(found: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(key, n): how often each is matched, the most common first."""
    out = found.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)
    return out.limit(k) if k else out


def concatenated(events: DataFrame) -> DataFrame:
    """(reason, n, events): false events by their class, ids in order and joined."""
    return events.groupBy("reason").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col("event").cast("string"))), ",").alias("events"))


def names_in_texts(texts: DataFrame, names: DataFrame, least: float = 0.8) -> DataFrame:
    """(text_id, name_id, gram, fraction): names of which a contiguous part, at least `least` of their words, stands in a text.

    Grams of the texts and parts of the names meet by equality; a text is never compared with every
    name. The longest part stands for a name. texts: (text_id, tokens); names: (name_id, tokens).
    """
    size = F.size("tokens")
    long = F.filter(F.sequence(F.lit(1), size), lambda n: F.round(n / size, 2) >= least)
    part = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(n.alias("n"), F.array_join(F.slice("tokens", i, n), " ").alias("gram")))
    parts = names.where(size > 0).select("name_id", size.alias("size"), F.explode(F.flatten(F.transform(long, part))).alias("g")).select("name_id", "size", "g.n", "g.gram").distinct()
    lengths = parts.agg(F.coalesce(F.max("n"), F.lit(1)).alias("m")).first()["m"]
    grams = texts.select("text_id", F.explode(T.ngrams(F.col("tokens"), lengths)).alias("g")).select("text_id", F.col("g.gram").alias("gram"))
    best = grams.join(parts, "gram").groupBy("text_id", "name_id").agg(F.max_by(F.struct("gram", "n", "size"), F.struct("n", "gram")).alias("b"))
    return best.select("text_id", "name_id", "b.gram", F.round(F.col("b.n") / F.col("b.size"), 2).alias("fraction"))


def tickers_in_texts(texts: DataFrame, symbols: DataFrame, most: int | None = None) -> DataFrame:
    """(text_id, name_id) by "$symbol" tokens; with `most`, texts that name more are left out. texts: (text_id, text); symbols: (symbol, name_id)."""
    tokens = texts.select("text_id", F.explode(F.regexp_extract_all("text", F.lit(r"\$([A-Za-z0-9]+)"), F.lit(1))).alias("s")).select("text_id", F.lower("s").alias("symbol"))
    found = tokens.join(symbols.select(F.lower("symbol").alias("symbol"), "name_id"), "symbol").select("text_id", "name_id").distinct()
    if most is None:
        return found
    return found.join(found.groupBy("text_id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("text_id"), "text_id", "left_semi")


def news_matches(clusters: DataFrame, news: DataFrame, low: int = 0, high: int = 0, least: int = 1) -> DataFrame:
    """(cluster_id, news_id, shared): news of a day within low..high of the cluster's that name a company of it and share `least` other stems.

    clusters, news: (id, day, companies, stems).  They meet by company and day.
    """
    a = clusters.select("cluster_id", F.explode(F.sequence(F.col("day") + low, F.col("day") + high)).alias("day"), F.explode("companies").alias("company")).join(clusters.select("cluster_id", F.col("stems").alias("own"), F.col("companies").alias("named")), "cluster_id") if low != high else clusters.select("cluster_id", (F.col("day") + low).alias("day"), F.explode("companies").alias("company"), F.col("stems").alias("own"), F.col("companies").alias("named"))
    b = news.select("news_id", "day", F.explode("companies").alias("company"), "stems")
    shared = F.size(F.array_intersect(F.array_except("own", "named"), "stems"))
    return a.join(b, ["day", "company"]).select("cluster_id", "news_id", shared.alias("shared")).where(F.col("shared") >= least).distinct()


def day_scores(found: DataFrame, clusters: DataFrame, news: DataFrame) -> DataFrame:
    """(day, clusters, matched, precision, news, recalled, recall) of each day with clusters."""
    hits = clusters.join(found.select("cluster_id").distinct().withColumn("hit", F.lit(1)), "cluster_id", "left").groupBy("day").agg(F.count("*").alias("clusters"), F.count("hit").alias("matched"))
    back = news.join(found.select("news_id").distinct().withColumn("hit", F.lit(1)), "news_id", "left").groupBy("day").agg(F.count("*").alias("news"), F.count("hit").alias("recalled"))
    both = hits.join(back, "day", "left").fillna({"news": 0, "recalled": 0})
    return both.select("day", "clusters", "matched", S.rounded(S.ratio(F.col("matched"), F.col("clusters"))).alias("precision"), "news", "recalled", S.rounded(S.ratio(F.col("recalled"), F.col("news"))).alias("recall"))


__all__ = ["by_ratio", "concatenated", "confusion", "cumulative", "day_scores", "duplicates", "matches", "metrics", "names_in_texts", "news_matches", "pooled_and_mean", "score_labels", "tickers_in_texts", "topk_sweep"]
