"""Pair similarity, clusters, ranked events, features and hashtags.

Messages are the turns of the conversations, units their words.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.stem import stem
from ..operators import affix, burst, events, features, graph, segment, stats
from ..sources.stored import written
from ..sources.tables import SQL, Tables, sql
from .bursts import ANCHORS
from .catalog import query

K, NEIGHBOURS, PARTS = 200, 9, 12

#: Bursty words of the turns, in the words of DuckDB.
TOPW = ANCHORS + ", " + SQL["tw"] + f""",
 totals AS (SELECT window_id, count(DISTINCT tweet_id) AS n_tweets, count(DISTINCT user_id) AS n_users FROM tw GROUP BY 1),
 counts AS (SELECT window_id, unit, count(DISTINCT tweet_id) AS f, count(DISTINCT user_id) AS u FROM tw GROUP BY 1, 2),
 ps AS (SELECT unit, avg(f / n_tweets) AS ps FROM counts JOIN totals USING (window_id) GROUP BY 1),
 e0 AS (SELECT *, n_tweets * ps AS expected, sqrt(n_tweets * ps * (1 - ps)) AS sigma FROM counts JOIN totals USING (window_id) JOIN ps USING (unit)),
 b0 AS (SELECT *, CASE WHEN f >= expected + 2 * sigma THEN 1.0::DOUBLE ELSE 1 / (1 + exp(-(10 * (f - expected - sigma) / nullif(sigma, 0)))) END AS pb FROM e0 WHERE f > expected),
 top AS MATERIALIZED (SELECT *, CAST(rn - 1 AS INTEGER) AS seg_id FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY wb DESC, unit) AS rn FROM (SELECT window_id, unit, f, u, round(pb * log10(u), 6) AS wb FROM b0)) WHERE rn <= {K})"""
SIM = TOPW + f""",
 share AS (SELECT tw.window_id, CAST(floor(hour / 2) AS INTEGER) AS m, seg_id, count(DISTINCT tweet_id) / f AS share FROM tw JOIN top USING (window_id, unit) GROUP BY 1, 2, 3, f),
 idf AS (SELECT unit AS feature, ln(floor((SELECT count(DISTINCT tweet_id) FROM tw) / count(DISTINCT tweet_id))) AS idf FROM tw GROUP BY 1),
 holder AS (SELECT DISTINCT tweet_id, tw.window_id, CAST(floor(hour / 2) AS INTEGER) AS m, seg_id FROM tw JOIN top USING (window_id, unit)),
 tf AS (SELECT h.window_id, m, seg_id, unit AS feature, count(*) AS tf FROM holder h JOIN tw USING (tweet_id) GROUP BY 1, 2, 3, 4),
 weights AS MATERIALIZED (SELECT window_id, m, seg_id, feature, tf, tf * idf AS weight FROM tf JOIN idf USING (feature)),
 norms AS (SELECT window_id, m, seg_id, sqrt(sum(weight * weight)) AS norm FROM weights WHERE weight > 0 GROUP BY 1, 2, 3),
 x AS MATERIALIZED (SELECT window_id, m, seg_id, feature, weight / norm AS x FROM weights JOIN norms USING (window_id, m, seg_id) WHERE weight > 0),
 cosine AS (SELECT a.window_id, a.m, a.seg_id AS seg_i, b.seg_id AS seg_j, sum(a.x * b.x) AS cos FROM x a JOIN x b ON a.window_id = b.window_id AND a.m = b.m AND a.feature = b.feature AND a.seg_id < b.seg_id GROUP BY 1, 2, 3, 4),
 sim AS MATERIALIZED (SELECT * FROM (SELECT c.window_id, seg_i, seg_j, round(sum(a.share * b.share * cos), 6) AS sim FROM cosine c JOIN share a ON a.window_id = c.window_id AND a.m = c.m AND a.seg_id = seg_i
   JOIN share b ON b.window_id = c.window_id AND b.m = c.m AND b.seg_id = seg_j GROUP BY 1, 2, 3) WHERE sim > 0)"""
KNN = SIM + f""",
 both_ AS (SELECT window_id, seg_i AS src, seg_j AS dst, sim FROM sim UNION ALL SELECT window_id, seg_j, seg_i, sim FROM sim),
 knn AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY window_id, src ORDER BY sim DESC, dst) AS INTEGER) AS rank FROM both_) WHERE rank <= {NEIGHBOURS}),
 mutual AS MATERIALIZED (SELECT a.window_id, a.src, a.dst, a.sim FROM knn a JOIN knn b ON a.window_id = b.window_id AND a.src = b.dst AND a.dst = b.src)"""
CLUSTERS = KNN + """,
 mut AS (SELECT window_id, src, list(dst) AS near FROM mutual GROUP BY 1, 2),
 lists AS MATERIALIZED (SELECT window_id, list(coalesce(near, []) ORDER BY seg_id) AS near, count(*) AS n FROM (SELECT top.window_id, seg_id, near FROM top LEFT JOIN mut ON mut.window_id = top.window_id AND src = seg_id) GROUP BY 1),
 fold AS (SELECT window_id, 0 AS i, list_transform(range(n), lambda q: -1) AS s FROM lists
   UNION ALL SELECT f.window_id, i + 1, list_transform(s, lambda v, q: CASE WHEN v >= 0 THEN v WHEN q - 1 = i THEN i WHEN list_contains(near[i + 1], q - 1) THEN CASE WHEN s[i + 1] >= 0 THEN s[i + 1] ELSE i END ELSE v END) FROM fold f JOIN lists USING (window_id) WHERE i < n),
 clusters AS MATERIALIZED (SELECT window_id, CAST(unnest(range(n)) AS INTEGER) AS seg_id, CAST(unnest(s) AS INTEGER) AS event_id FROM fold JOIN lists USING (window_id) WHERE i = n)"""
WORTH = CLUSTERS + """,
 worth AS MATERIALIZED (SELECT u.unit, round(coalesce(exp(prob), 0), 6) AS worth FROM (SELECT DISTINCT unit FROM top) u LEFT JOIN kp ON kp.gram = u.unit)"""
RANKED = WORTH + """,
 inside AS (SELECT c.window_id, c.event_id, m.dst, arg_min(m.src, m.src) AS src, arg_min(m.sim, m.src) AS sim FROM mutual m JOIN clusters c ON c.window_id = m.window_id AND c.seg_id = m.src JOIN clusters d ON d.window_id = m.window_id AND d.seg_id = m.dst
   WHERE c.event_id = d.event_id AND m.dst <> c.event_id GROUP BY 1, 2, 3),
 edges AS (SELECT window_id, event_id, least(src, dst) AS seg_i, greatest(src, dst) AS seg_j, sim FROM inside),
 nodes AS (SELECT c.window_id, c.event_id, c.seg_id, unit, worth FROM clusters c JOIN top USING (window_id, seg_id) JOIN worth USING (unit)),
 na AS (SELECT window_id, event_id, count(*) AS n_nodes, round(sum(worth), 6) AS worth_sum FROM nodes GROUP BY 1, 2),
 ea AS (SELECT window_id, event_id, count(*) AS n_edges, round(sum(sim), 6) AS sim_sum FROM edges GROUP BY 1, 2),
 measured AS (SELECT window_id, event_id, n_nodes, coalesce(n_edges, 0) AS n_edges, worth_sum, coalesce(sim_sum, 0) AS sim_sum, round(worth_sum / n_nodes * coalesce(sim_sum, 0) / n_nodes, 6) AS mu FROM na LEFT JOIN ea USING (window_id, event_id)),
 ratios AS (SELECT *, round(max(mu) OVER (PARTITION BY window_id) / mu, 6) AS ratio FROM measured WHERE mu > 0),
 ranked AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY window_id ORDER BY ratio, event_id) AS INTEGER) AS rank FROM ratios)"""


class Plan:
    """The event pipeline over the turns; each step is planned once, stored, and read by what follows.

    All that is stored has a few rows for each of the K units of a window, so that disk and plans stay small.
    """

    def __init__(self, t: Tables):
        self.t = t
        self.turns = t.turns()
        #: A word once a message.
        self.words = self.turns.select("tweet_id", "user_id", "window_id", "hour", F.explode(F.array_distinct("tokens")).alias("unit"))
        self.totals = stats.window_totals(self.turns.where(F.size("tokens") > 0))
        self.top = written(burst.top_units(burst.burst_scores(self.words, self.totals), K), "top")

    def weights(self) -> DataFrame:
        return graph.tfidf(self.turns, self.top, PARTS)

    def sim(self) -> DataFrame:
        return graph.pair_similarity(self.turns, self.top, PARTS)

    @cached_property
    def knn(self) -> DataFrame:
        return written(graph.knn(written(self.sim(), "sim"), NEIGHBOURS), "knn")

    @cached_property
    def mutual(self) -> DataFrame:
        return written(graph.mutual(self.knn), "mutual")

    @cached_property
    def clusters(self) -> DataFrame:
        return written(graph.greedy_clusters(self.top, self.mutual), "clusters")

    @cached_property
    def edges(self) -> DataFrame:
        return written(graph.cluster_edges(self.clusters, self.mutual), "edges")

    @cached_property
    def worth(self) -> DataFrame:
        known = segment.keyphraseness(self.t.anchors(), self.t.pages, among=events.subgrams(self.top).select("gram").distinct())
        return written(events.newsworthiness(self.top, known), "worth")

    @cached_property
    def ranked(self) -> DataFrame:
        return written(events.ranked(events.measured(self.clusters, self.edges, self.top, self.worth)), "ranked")


@query(sql("turns") + ", " + SQL["tw"] + " SELECT window_id, CAST(floor(hour / 2) AS INTEGER) AS m, count(DISTINCT tweet_id) AS n FROM tw GROUP BY 1, 2")
def subwindow_doc_counts(t: Tables) -> DataFrame:
    return graph.subwindow_totals(t.turn_words(), PARTS)


@query(SIM + " SELECT window_id, m, seg_id, feature, tf, round(weight, 6) AS weight FROM weights")
def segment_tfidf(t: Tables) -> DataFrame:
    return Plan(t).weights().withColumn("weight", S.rounded(F.col("weight")))


@query(SIM + " SELECT * FROM sim")
def segment_pair_similarity(t: Tables) -> DataFrame:
    return Plan(t).sim()


@query(KNN + " SELECT window_id, src, dst, sim, rank FROM knn")
def knn_edges(t: Tables) -> DataFrame:
    return Plan(t).knn.select("window_id", "src", "dst", "sim", "rank")


@query(KNN + " SELECT * FROM mutual")
def mutual_knn(t: Tables) -> DataFrame:
    return Plan(t).mutual


@query(CLUSTERS + " SELECT * FROM clusters")
def event_clusters(t: Tables) -> DataFrame:
    return Plan(t).clusters


@query(WORTH + " SELECT * FROM worth")
def segment_newsworthiness(t: Tables) -> DataFrame:
    return Plan(t).worth


@query(RANKED + " SELECT window_id, event_id, n_nodes, n_edges, worth_sum, sim_sum, mu, ratio, rank FROM ranked")
def event_ranking(t: Tables) -> DataFrame:
    return Plan(t).ranked.select("window_id", "event_id", "n_nodes", "n_edges", "worth_sum", "sim_sum", "mu", "ratio", "rank")


@query(RANKED + """, h AS (SELECT CAST(floor(ratio) AS INTEGER) AS bin, count(*) AS n FROM ranked WHERE ratio <= 10 GROUP BY 1), s AS (SELECT unnest(range((SELECT min(bin) FROM h), (SELECT max(bin) FROM h) + 1)) AS bin)
 SELECT CAST(s.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY s.bin) AS BIGINT) AS cumulative FROM s LEFT JOIN h USING (bin)""")
def event_ratio_histogram(t: Tables) -> DataFrame:
    return events.ratio_histogram(Plan(t).ranked)


@query(RANKED + " SELECT n_nodes, count(*) AS n FROM ranked GROUP BY 1")
def event_size_distribution(t: Tables) -> DataFrame:
    return events.size_distribution(Plan(t).ranked)


@query(RANKED + """, ends AS (SELECT window_id, seg_id, count(*) AS degree FROM (SELECT window_id, unnest([seg_i, seg_j]) AS seg_id FROM edges) GROUP BY 1, 2),
 l AS (SELECT window_id, event_id, string_agg(unit, '|' ORDER BY coalesce(degree, 0) DESC, unit) AS by_degree, string_agg(unit, '|' ORDER BY worth DESC, unit) AS by_worth FROM nodes LEFT JOIN ends USING (window_id, seg_id) GROUP BY 1, 2)
 SELECT window_id, rank, ratio, n_nodes, n_edges, by_degree, by_worth FROM ranked JOIN l USING (window_id, event_id)""")
def event_report(t: Tables) -> DataFrame:
    p = Plan(t)
    return events.report(p.ranked, p.clusters, p.edges, p.top, p.worth)


_SOCIAL = """social AS (SELECT tweet_id, user_id, window_id, hour, length(text) > 5 AND starts_with(lower(text), 'rt @') AS rt, contains(text, '@') AS men, starts_with(text, '@') AS reply, contains(text, 'http') AS url,
  array_to_string(list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda q: q <> ''), lambda q: regexp_extract(q, '#\\S*')), lambda q: length(q) > 0), ' ') AS tag,
  array_to_string(list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda q: q <> ''), lambda q: lower(q)), lambda q: regexp_matches(q, '..ed$')), ' ') AS past FROM {0})"""


@query(sql("tweets") + ", " + _SOCIAL.format("tweets") + " SELECT tweet_id, user_id, window_id, CAST(hour AS INTEGER) AS hour, rt, men, reply, url, tag, past FROM social")
def social_features(t: Tables) -> DataFrame:
    return features.social(t.tweets())


@query(sql("tweets") + " SELECT window_id, CAST(hour % 12 AS INTEGER) AS part, count(*) AS n FROM tweets GROUP BY 1, 2")
def hour_mod_histogram(t: Tables) -> DataFrame:
    return features.hour_histogram(t.tweets())


FEATURES = RANKED + ", " + _SOCIAL.format("turns") + """,
 heldm AS (SELECT DISTINCT n.window_id, n.event_id, tweet_id, user_id FROM tw JOIN nodes n ON n.window_id = tw.window_id AND n.unit = tw.unit),
 agg AS (SELECT h.window_id, h.event_id, count(DISTINCT h.tweet_id) AS tweets, count(DISTINCT h.user_id) AS users, round(coalesce(avg(rt::INT), 0), 6) AS f07, round(coalesce(avg(men::INT), 0), 6) AS f08, round(coalesce(avg(reply::INT), 0), 6) AS f09,
   round(coalesce(avg(url::INT), 0), 6) AS f10, round(coalesce(avg((tag <> '')::INT), 0), 6) AS f11, round(coalesce(avg(len(list_filter(string_split(tag, ' '), lambda q: q <> ''))), 0), 6) AS f12,
   round(coalesce(avg(len(list_filter(string_split(past, ' '), lambda q: q <> ''))), 0), 6) AS f13 FROM heldm h LEFT JOIN social USING (tweet_id) GROUP BY 1, 2),
 f13t AS (SELECT window_id, event_id, mu AS f01, CAST(n_nodes AS DOUBLE) AS f02, round(n_edges / n_nodes, 6) AS f03, round(coalesce(sim_sum / nullif(n_edges, 0), 0), 6) AS f04, round(tweets / n_tweets, 6) AS f05, round(users / n_users, 6) AS f06,
   f07, f08, f09, f10, f11, f12, f13 FROM ranked JOIN agg USING (window_id, event_id) JOIN totals USING (window_id))"""


def _base(p: Plan) -> tuple[DataFrame, DataFrame]:
    social = features.social(p.t.turns())
    held = features.event_messages(p.words, p.clusters, p.top)
    return features.event_features(p.ranked, held, social, p.totals), held.join(social.select("tweet_id", "tag"), "tweet_id")


@query(FEATURES + " SELECT * FROM f13t")
def event_features_13(t: Tables) -> DataFrame:
    return _base(Plan(t))[0]


@query()
def event_features_17(t: Tables) -> DataFrame:
    p = Plan(t)
    base, messages = _base(p)
    words = p.top.select(F.explode(F.split("unit", "[ _]")).alias("word")).distinct()
    dups = features.repeated_stems(p.clusters, p.top, words.withColumn("stem", stem(F.col("word"))))
    tags = messages.select("window_id", "event_id", F.explode(F.split("tag", " ")).alias("tag")).where("tag <> ''").withColumn("tag", F.lower("tag"))
    counts = affix.tag_counts(t.tags())
    weights = affix.affix_weights(counts)
    frequent = lambda kind: affix.frequent(weights.where(F.col("kind") == kind), "affix", "weight")
    hits = features.frequent_hits(tags, affix.frequent(counts, "tag", "tf"), frequent("prefix"), frequent("suffix"))
    return features.wide_features(base, dups, hits)


# Hashtags.


@query("SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split_regex(text, '\\s+'), lambda q: q <> ''), lambda q: regexp_extract(q, '#\\S*')), lambda q: length(q) > 0), ' ') AS tags FROM documents WHERE contains(text, '#')")
def hashtag_extract(t: Tables) -> DataFrame:
    return t.documents.where(F.contains("text", F.lit("#"))).select("doc_id", F.array_join(T.hashtags(F.col("text")), " ").alias("tags"))


@query("""WITH tg AS (SELECT p_partkey * 1000 AS tweet_id, list_sort(list(DISTINCT '#' || lower(replace(p_name, ' ', '')))) AS tags FROM part GROUP BY 1)
 SELECT conv_id * 1000 + turn AS tweet_id, array_to_string(list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), coalesce(tags, [])), '|') AS segments FROM conversations LEFT JOIN tg ON tg.tweet_id = conv_id * 1000 + turn""")
def merge_hashtags(t: Tables) -> DataFrame:
    tags = t.tags().withColumn("tweet_id", F.col("tweet_id") * 1000)
    own = t.turns().select("tweet_id", F.col("tokens").alias("segments"))
    return affix.merged(own, tags).select("tweet_id", F.array_join("segments", "|").alias("segments"))


TAGS = sql("tags") + ", tc AS (SELECT lower(tag) AS tag, count(*) AS tf, count(DISTINCT tweet_id) AS df FROM tags WHERE NOT regexp_matches(tag, '[^ -~]') GROUP BY 1)"
AFFIX = TAGS + """, parts AS (SELECT tf, tag[2:] AS body, unnest(range(1, length(tag))) AS i FROM tc),
 aw AS (SELECT kind, affix, CAST(sum(tf) AS BIGINT) AS weight FROM (SELECT tf, 'prefix' AS kind, left(body, i) AS affix FROM parts UNION ALL SELECT tf, 'suffix', right(body, i) FROM parts) GROUP BY 1, 2),
 pr AS (SELECT * FROM aw WHERE weight >= 20 AND length(affix) >= 3 AND length(replace(affix, left(affix, 1), '')) > 0)"""


@query(TAGS + " SELECT * FROM tc")
def hashtag_tf_df(t: Tables) -> DataFrame:
    return affix.tag_counts(t.tags())


@query(TAGS + " SELECT length(tag) AS length, count(*) AS n FROM tc GROUP BY 1")
def hashtag_length_histogram(t: Tables) -> DataFrame:
    return stats.length_histogram(affix.tag_counts(t.tags()), F.length("tag").cast("long"))


@query(AFFIX + " SELECT * FROM aw")
def affix_weights(t: Tables) -> DataFrame:
    return affix.affix_weights(affix.tag_counts(t.tags()))


def _pruned(t: Tables) -> DataFrame:
    return affix.pruned(affix.affix_weights(affix.tag_counts(t.tags())), 20)


@query(AFFIX + " SELECT * FROM pr")
def affix_pruned(t: Tables) -> DataFrame:
    return _pruned(t)


@query(AFFIX + " SELECT * FROM pr a WHERE NOT EXISTS (SELECT 1 FROM pr b WHERE b.kind = a.kind AND b.affix <> a.affix AND starts_with(a.affix, b.affix))")
def affix_keep_shortest(t: Tables) -> DataFrame:
    return affix.keep_shortest(_pruned(t), "affix", "kind")


@query(AFFIX + " SELECT * FROM pr a WHERE NOT EXISTS (SELECT 1 FROM pr b WHERE b.kind = a.kind AND b.affix <> a.affix AND starts_with(b.affix, a.affix))")
def affix_keep_longest(t: Tables) -> DataFrame:
    return affix.keep_longest(_pruned(t), "affix", "kind")
