"""Feature transforms, filters, clustering, linear learners, evaluation, late data and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import evaluate, learn
from ..sources.stored import written
from ..sources.tables import Tables, sql
from ..streaming import days
from .catalog import query

_NORM = sql("vectors") + """, lv AS (SELECT instance_id, label, unnest(range(6)) AS i, unnest(x) AS v FROM vectors), ends AS (SELECT i, min(v) AS low, max(v) AS high FROM lv GROUP BY 1),
 mm AS (SELECT instance_id, label, list(round(coalesce((v - low) / nullif(high - low, 0), 0), 6) ORDER BY i) AS x FROM lv JOIN ends USING (i) GROUP BY 1, 2)"""
_FLAT = "instance_id, label, " + ", ".join(f"x[{i + 1}] AS x{i}" for i in range(6))


def _norm(t: Tables) -> DataFrame:
    return learn.minmax(written(t.vectors(), "vectors"))  # read for its ends and again; a few numbers a text


def _flat(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select("instance_id", "label", *(F.col("x")[i].alias(f"x{i}") for i in range(n)))


@query(_NORM + f" SELECT {_FLAT} FROM mm")
def minmax_features(t: Tables) -> DataFrame:
    return _flat(_norm(t))


@query(_NORM + " SELECT instance_id, label, round(x[1] * x[2], 6) AS x0, round(x[3] * x[4], 6) AS x1, x[5] AS x2, x[6] AS x3 FROM mm")
def merged_features(t: Tables) -> DataFrame:
    return _flat(learn.merge(_norm(t), [(0, 1), (2, 3)]), 4)


@query(_NORM + " SELECT instance_id, label, x[1] AS x0, round(1 - x[2], 6) AS x1, x[3] AS x2, round(1 - x[4], 6) AS x3, x[5] AS x4, x[6] AS x5 FROM mm")
def flipped_features(t: Tables) -> DataFrame:
    return _flat(learn.flip(_norm(t), [1, 3]))


@query(_NORM + " SELECT instance_id, label, x[1] * 2 AS x0, x[2] / 4 AS x1, x[4] AS x2, x[5] AS x3, x[6] AS x4 FROM mm")
def strengthened_features(t: Tables) -> DataFrame:
    return _flat(learn.delete(learn.strengthen(_norm(t), [0], weaken=[1]), [2]), 5)


@query(_NORM + """ SELECT instance_id, label, i, CAST(least(floor(v * 10), 9) AS INTEGER) AS bin FROM (SELECT instance_id, label, CAST(unnest(range(6)) AS INTEGER) AS i, unnest(x) AS v FROM mm)""")
def binned_features(t: Tables) -> DataFrame:
    hot = learn.binned(_norm(t)).select("instance_id", "label", F.posexplode("x").alias("at", "on")).where("on = 1")
    return hot.select("instance_id", "label", F.floor(F.col("at") / 10).cast("int").alias("i"), (F.col("at") % 10).alias("bin"))


@query("""SELECT k.n, coalesce(string_agg(CAST(CASE WHEN i >= 11 THEN i + 1 ELSE i END AS VARCHAR), ',' ORDER BY i) FILTER (substr(lpad(bin(k.n), 12, '0'), CAST(i AS BIGINT), 1) = '1'), '') AS places
 FROM (SELECT DISTINCT CAST(p_partkey % 4096 AS BIGINT) AS n FROM part) k, range(1, 13) r(i) GROUP BY k.n""")
def positive_set_bits(t: Tables) -> DataFrame:
    n = t.part.select((F.col("p_partkey") % 4096).cast("long").alias("n")).distinct()
    return n.select("n", F.array_join(F.transform(S.positive_set(F.col("n")), lambda i: i.cast("string")), ",").alias("places"))


@query(_NORM + ", c AS (SELECT i, avg(v) FILTER (label = 1) AS a, avg(v) FILTER (label = 0) AS b FROM (SELECT label, CAST(unnest(range(6)) AS INTEGER) AS i, unnest(x) AS v FROM mm) GROUP BY 1) SELECT i FROM c WHERE a > b")
def positive_features(t: Tables) -> DataFrame:
    return learn.positive_features(_norm(t))


_SCORES = {
    "norm": "sqrt(list_sum(list_transform(x, lambda q: q * q)))",
    "sum": "list_sum(x)",
    "product": "list_product(list_transform(x, lambda q: CASE WHEN q = 0 THEN 1e-5 ELSE q END))",
    "single": "x[3]",
    "vote": "CAST((least(floor(x[1] * 30), 29) IN (0, 1, 2))::INT + (least(floor(x[3] * 30), 29) >= 15)::INT AS DOUBLE)",
}


def _metrics(kind: str, op: str, threshold: float) -> str:
    return _NORM + f""", sc AS (SELECT label, round({_SCORES[kind]}, 6) AS score FROM mm), p AS (SELECT label, (score {op} {threshold})::INT AS predicted FROM sc),
 n AS (SELECT count(*) FILTER (predicted = 1 AND label = 1) AS hit, count(*) FILTER (predicted = 1) AS said, count(*) FILTER (label = 1) AS pos, avg((predicted = label)::INT) AS acc FROM p),
 r AS (SELECT coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(pos, 0), 0) AS r, acc FROM n)
 SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(coalesce(acc, 0), 6) AS accuracy FROM r"""


def _filter(t: Tables, kind: str, threshold: float, feature: int = 0) -> DataFrame:
    return evaluate.metrics(learn.filtered(learn.scored(_norm(t), kind, feature), threshold))


@query(_metrics("norm", "<=", 1.1))
def filter_norm(t: Tables) -> DataFrame:
    return _filter(t, "norm", 1.1)


@query(_metrics("sum", "<=", 1.5))
def filter_sum(t: Tables) -> DataFrame:
    return _filter(t, "sum", 1.5)


@query(_metrics("product", "<=", 1e-6))
def filter_product(t: Tables) -> DataFrame:
    return _filter(t, "product", 1e-6)


@query(_metrics("single", "<=", 0.5))
def filter_single(t: Tables) -> DataFrame:
    return _filter(t, "single", 0.5, 2)


@query(_metrics("vote", ">=", 1))
def filter_vote(t: Tables) -> DataFrame:
    return evaluate.metrics(learn.filtered(learn.votes(_norm(t), {0: [0, 1, 2], 2: list(range(15, 30))}), 1, below=False))


@query(_NORM + f""", sc AS (SELECT label, round({_SCORES['norm']}, 6) AS score FROM mm), e AS (SELECT min(score) AS low, max(score) AS high, sum(label) AS pos FROM sc),
 b AS (SELECT CASE WHEN high = low THEN 0 ELSE least(floor((score - low) / ((high - low) / 30)), 29) END AS bin, label FROM sc, e),
 h AS (SELECT r.bin, count(label) FILTER (label = 1) AS positive, count(label) FILTER (label <> 1) AS negative FROM range(30) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY 1),
 c AS (SELECT bin, positive, negative, sum(positive) OVER (ORDER BY bin) AS cp, sum(negative) OVER (ORDER BY bin) AS cq, pos FROM h, e), m AS (SELECT *, coalesce(cp / nullif(cp + cq, 0), 0) AS p, coalesce(cp / nullif(pos, 0), 0) AS r FROM c)
 SELECT CAST(bin AS INTEGER) AS bin, positive, negative, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM m""")
def score_histogram(t: Tables) -> DataFrame:
    return learn.histogram(learn.scored(_norm(t), "norm"))


@query(_NORM + f", sc AS (SELECT label, round({_SCORES['sum']}, 6) AS score FROM mm) SELECT round(score, 1) AS score, label, count(*) AS n FROM sc GROUP BY 1, 2")
def score_label_distribution(t: Tables) -> DataFrame:
    return evaluate.score_labels(learn.scored(_norm(t), "sum"))


def _seeds(t: Tables) -> list[int]:
    """The labelled documents with the smallest ids of each quality: two rows."""
    rows = t.labels.where("quality in (0, 1)").groupBy("quality").agg(F.min("doc_id").alias("i")).orderBy("quality").collect()
    return [r["i"] for r in rows]


@query()
def kmeans_labels(t: Tables) -> DataFrame:
    return learn.kmeans(_norm(t).persist(), _seeds(t)).select("instance_id", "label", "cluster")


@query()
def kmeans_confusion(t: Tables) -> DataFrame:
    return evaluate.confusion(learn.event_cluster(learn.kmeans(_norm(t).persist(), _seeds(t))))


@query()
def cw_binary_model(t: Tables) -> DataFrame:
    m = learn.cw_binary(_norm(t))
    return m.select("feature", S.rounded(F.col("mean")).alias("mean"), S.rounded(F.col("variance")).alias("variance"), "mistakes")


@query()
def cw_binary_predict(t: Tables) -> DataFrame:
    own = _norm(t)
    return learn.cw_predict(own, learn.cw_binary(own, epochs=1, average=True))


@query()
def cw_multiclass_predict(t: Tables) -> DataFrame:
    own = t.embeddings.select(F.col("vec_id").alias("instance_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    return learn.cw_multiclass_predict(own, learn.cw_multiclass(own, k=2))


@query()
def reweighted_features(t: Tables) -> DataFrame:
    own = _norm(t)
    return _flat(learn.reweighted(own, learn.cw_binary(own)))


@query()
def kmeans_cw_loop(t: Tables) -> DataFrame:
    return learn.kmeans_cw(_norm(t).persist(), _seeds(t), 15).select("instance_id", "label", "cluster", "predicted")


# Evaluation.  Judged events: parts, their price as ratio, their kind as judgement.
_JUDGED = """WITH j AS (SELECT p_partkey AS event_id, p_partkey % 15 + 1 AS window_id, p_retailprice / 200.0 AS ratio, CASE WHEN p_size <= 20 THEN 'T' WHEN p_size <= 40 THEN 'F' ELSE 'O' END AS judged, p_name AS event FROM part)"""


def _judged(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("event_id"), (F.col("p_partkey") % 15 + 1).alias("window_id"), (F.col("p_retailprice") / 200.0).alias("ratio"), F.when(F.col("p_size") <= 20, "T").when(F.col("p_size") <= 40, "F").otherwise("O").alias("judged"), F.col("p_name").alias("event"))


_CEIL = _JUDGED + ", c AS (SELECT *, CAST(ceil(ratio) AS INTEGER) AS ceiling FROM j), s AS (SELECT CAST(unnest(range((SELECT min(ceiling) FROM c), (SELECT max(ceiling) FROM c) + 1)) AS INTEGER) AS ceiling)"


@query(_CEIL + """, b AS (SELECT s.ceiling, count(judged) AS n, count(*) FILTER (judged = 'T') AS t, count(*) FILTER (judged = 'F') AS f, count(*) FILTER (judged = 'O') AS o FROM s LEFT JOIN c USING (ceiling) GROUP BY 1),
 r AS (SELECT ceiling, CAST(sum(n) OVER w AS BIGINT) AS events, CAST(sum(t) OVER w AS BIGINT) AS "true", CAST(sum(f) OVER w AS BIGINT) AS "false", CAST(sum(o) OVER w AS BIGINT) AS doubtful FROM b WINDOW w AS (ORDER BY ceiling))
 SELECT *, round(coalesce("true" / nullif(events, 0), 0), 6) AS precision FROM r""")
def precision_by_ratio(t: Tables) -> DataFrame:
    return evaluate.by_ratio(_judged(t))


@query(_CEIL + """, g AS (SELECT DISTINCT window_id, s.ceiling FROM j, s), b AS (SELECT g.window_id, g.ceiling, count(judged) AS n, count(*) FILTER (judged = 'T') AS t FROM g LEFT JOIN c ON c.window_id = g.window_id AND c.ceiling = g.ceiling GROUP BY 1, 2),
 r AS (SELECT window_id, ceiling, sum(n) OVER w AS n, sum(t) OVER w AS t FROM b WINDOW w AS (PARTITION BY window_id ORDER BY ceiling))
 SELECT ceiling, round(sum(t) / nullif(sum(n), 0), 6) AS pooled, round(avg(t / nullif(n, 0)), 6) AS window_mean FROM r GROUP BY 1""")
def precision_pooled_vs_mean(t: Tables) -> DataFrame:
    return evaluate.pooled_and_mean(_judged(t))


@query(_CEIL + """, b AS (SELECT s.ceiling AS band, event, count(*) AS n FROM s JOIN c ON c.ceiling <= s.ceiling WHERE judged = 'T' GROUP BY 1, 2)
 SELECT band, count(*) AS found, count(*) FILTER (n > 1) AS repeated, round(count(*) FILTER (n > 1) / count(*), 6) AS ratio FROM b WHERE band <= (SELECT max(ceiling) FROM c WHERE judged = 'T') GROUP BY 1""")
def recall_duplicates(t: Tables) -> DataFrame:
    return evaluate.duplicates(_judged(t).where("judged = 'T'"))


_RANKS = _JUDGED + ", k AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ratio, event_id) AS rank FROM j)"


@query(_RANKS + """, s AS (SELECT unnest(range(1, 31)) AS k)
 SELECT CAST(s.k AS INTEGER) AS k, count(rank) AS said, count(*) FILTER (judged = 'T') AS hits, round(coalesce(count(*) FILTER (judged = 'T') / nullif(count(rank), 0), 0), 6) AS precision,
 round(coalesce(count(*) FILTER (judged = 'T') / nullif((SELECT count(*) FROM k WHERE judged = 'T'), 0), 0), 6) AS recall FROM s LEFT JOIN k ON k.rank <= s.k GROUP BY s.k""")
def topk_sweep(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("window_id").orderBy("ratio", "event_id"))
    return evaluate.topk_sweep(_judged(t).select("window_id", rank.alias("rank"), (F.col("judged") == "T").alias("hit")))


@query(_JUDGED + " SELECT event AS reason, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) AS events FROM j WHERE judged = 'F' GROUP BY 1")
def false_events_by_class(t: Tables) -> DataFrame:
    return evaluate.concatenated(_judged(t).where("judged = 'F'").select(F.col("event").alias("reason"), F.col("event_id").alias("event")))


@query(_JUDGED + " SELECT event, count(*) AS n FROM j WHERE NOT list_has_any(string_split(event, ' '), ['red', 'small']) GROUP BY 1")
def horoscope_filtered(t: Tables) -> DataFrame:
    own = _judged(t).where(~F.arrays_overlap(F.split("event", " "), F.array(F.lit("red"), F.lit("small"))))
    return evaluate.matches(own, "event")


# Companies are link texts, messages the titles of pages.
_NAMES = sql("anchors") + """, nm AS (SELECT DISTINCT anchor AS name_id, regexp_extract_all(anchor, '[a-z0-9]+') AS k FROM anchors WHERE len(regexp_extract_all(anchor, '[a-z0-9]+')) > 0),
 tx AS (SELECT page_id AS text_id, regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z0-9]+') AS k FROM pages),
 parts AS (SELECT DISTINCT name_id, len(k) AS size, n, array_to_string(k[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM (SELECT *, unnest(range(1, len(k) + 1)) AS n FROM nm)) WHERE i + n - 1 <= len(k) AND round(n / len(k), 2) >= 0.8),
 hits AS (SELECT text_id, name_id, gram, n, size FROM tx, parts WHERE contains(' ' || array_to_string(k, ' ') || ' ', ' ' || gram || ' '))"""


@query(_NAMES + " SELECT text_id, name_id, arg_max(gram, (n, gram)) AS gram, arg_max(round(n / size, 2), (n, gram)) AS fraction FROM hits GROUP BY 1, 2")
def company_name_match(t: Tables) -> DataFrame:
    words = T.words(F.col("anchor"))
    names = t.anchors().select(F.col("anchor").alias("name_id"), words.alias("tokens")).distinct().where(F.size("tokens") > 0)
    texts = t.pages.select(F.col("page_id").alias("text_id"), T.words(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("tokens"))
    return evaluate.names_in_texts(texts, names)


_TICK = """WITH tx AS (SELECT s_suppkey AS text_id, 'buys $S' || (s_suppkey % 7) || ' and $S' || (s_suppkey % 5) || ', not $zz' AS text FROM supplier), sy AS (SELECT 'S' || n_nationkey AS symbol, n_name AS name_id FROM nation)"""


@query(_TICK + " SELECT DISTINCT text_id, name_id FROM (SELECT text_id, lower(unnest(regexp_extract_all(text, '\\$([A-Za-z0-9]+)', 1))) AS s FROM tx) JOIN sy ON s = lower(symbol)")
def ticker_match(t: Tables) -> DataFrame:
    i = F.col("s_suppkey")
    texts = t.supplier.select(i.alias("text_id"), F.concat(F.lit("buys $S"), (i % 7).cast("string"), F.lit(" and $S"), (i % 5).cast("string"), F.lit(", not $zz")).alias("text"))
    symbols = t.nation.select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"), F.col("n_name").alias("name_id"))
    return evaluate.tickers_in_texts(texts, symbols)


# Clusters are conversations of a day, news are benchmark items; companies are numbers, stems words.
_NEWS = """WITH cl AS (SELECT conv_id AS cluster_id, conv_id % 7 AS day, ['n' || (conv_id % 5), 'n' || (conv_id % 3)] AS companies, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS stems FROM conversations GROUP BY conv_id),
 nw AS (SELECT item_id AS news_id, item_id % 7 AS day, ['n' || (item_id % 5)] AS companies, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS stems FROM benchmark),
 m AS (SELECT DISTINCT cluster_id, news_id, CAST(len(list_intersect(list_filter(c.stems, lambda q: NOT list_contains(c.companies, q)), n.stems)) AS INTEGER) AS shared FROM cl c JOIN nw n ON c.day = n.day AND list_has_any(c.companies, n.companies))"""


def _news(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = lambda x: F.concat(F.lit("n"), x.cast("string"))
    i, j = F.col("conv_id"), F.col("item_id")
    words = t.conversations.groupBy("conv_id").agg(F.collect_set("text").alias("texts")).select(i.alias("cluster_id"), (i % 7).alias("day"), F.array(n(i % 5), n(i % 3)).alias("companies"), F.array_distinct(F.flatten(F.transform("texts", T.words))).alias("stems"))
    news = t.benchmark.select(j.alias("news_id"), (j % 7).alias("day"), F.array(n(j % 5)).alias("companies"), F.array_distinct(T.words(F.col("text"))).alias("stems"))
    return words, news


@query(_NEWS + " SELECT * FROM m WHERE shared >= 3")
def news_cluster_match(t: Tables) -> DataFrame:
    return evaluate.news_matches(*_news(t), least=3)


@query(_NEWS + """, f AS (SELECT * FROM m WHERE shared >= 3), a AS (SELECT day, count(*) AS clusters, count(*) FILTER (cluster_id IN (SELECT cluster_id FROM f)) AS matched FROM cl GROUP BY 1),
 b AS (SELECT day, count(*) AS news, count(*) FILTER (news_id IN (SELECT news_id FROM f)) AS recalled FROM nw GROUP BY 1)
 SELECT day, clusters, matched, round(matched / clusters, 6) AS precision, coalesce(news, 0) AS news, coalesce(recalled, 0) AS recalled, round(coalesce(recalled / nullif(news, 0), 0), 6) AS recall FROM a LEFT JOIN b USING (day)""")
def news_day_scores(t: Tables) -> DataFrame:
    clusters, news = _news(t)
    return evaluate.day_scores(evaluate.news_matches(clusters, news, least=3), clusters, news)


# Late data and streams.


@query("WITH r AS (SELECT event_id, CAST(ts AS DATE) AS day, max(CAST(ts AS DATE)) OVER (ORDER BY (event_id * 7919) % 10007, event_id) AS latest FROM events) SELECT event_id FROM r WHERE day >= latest")
def late_drop_batch(t: Tables) -> DataFrame:
    # Arrivals in an order other than that of time; ties by event_id.
    own = t.events.select("event_id", "ts", (F.col("event_id") * 7919 % 10007 * 10_000_000_000 + F.col("event_id")).alias("arrival"))
    ranked = own.withColumn("arrival", F.col("arrival") / 10_000_000_000)
    return days.late_dropped(ranked, "arrival", "ts").select("event_id")


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def stream_day_window(t: Tables) -> DataFrame:
    """The day windows of events, driven as a stream over the table's file."""
    import uuid

    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events*.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = days.run_to_memory(days.day_counts(stream, keys=("event_type",)), f"days_{uuid.uuid4().hex}")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
