"""Counts, bursts, raw messages, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import rounded
from ..operators import burst, clean, segment, stats
from ..sources import readers
from ..sources.stored import written
from ..sources.tables import Tables, sql
from .catalog import query

COUNTS = sql("ue") + """,
 totals AS (SELECT window_id, count(DISTINCT tweet_id) AS n_tweets, count(DISTINCT user_id) AS n_users FROM ue GROUP BY 1),
 counts AS (SELECT window_id, unit, count(DISTINCT tweet_id) AS f, count(DISTINCT user_id) AS u FROM ue GROUP BY 1, 2),
 ps AS (SELECT unit, avg(f / n_tweets) AS ps FROM counts JOIN totals USING (window_id) GROUP BY 1),
 e AS (SELECT *, n_tweets * ps AS expected, sqrt(n_tweets * ps * (1 - ps)) AS sigma FROM counts JOIN totals USING (window_id) JOIN ps USING (unit)),
 b AS (SELECT *, CASE WHEN f >= expected + 2 * sigma THEN 1.0::DOUBLE ELSE 1 / (1 + exp(-(10 * (f - expected - sigma) / nullif(sigma, 0)))) END AS pb FROM e WHERE f > expected),
 scores AS (SELECT window_id, unit, f, u, round(ps, 6) AS ps, round(expected, 6) AS expected, round(sigma, 6) AS sigma, round(pb, 6) AS pb, round(pb * log10(u), 6) AS wb FROM b)"""


@query(COUNTS + " SELECT * FROM totals")
def window_tweet_counts(t: Tables) -> DataFrame:
    return stats.window_totals(t.unit_events())


@query(COUNTS + " SELECT window_id, n_users FROM totals")
def window_user_counts(t: Tables) -> DataFrame:
    return stats.window_totals(t.unit_events()).select("window_id", "n_users")


@query(sql("ue") + """, firsts AS (SELECT user_id, min(window_id) AS window_id FROM ue GROUP BY 1), n AS (SELECT window_id, count(*) AS c FROM firsts GROUP BY 1)
 SELECT w.window_id, coalesce(c, 0) AS new_users, CAST(sum(coalesce(c, 0)) OVER (ORDER BY w.window_id) AS BIGINT) AS users FROM (SELECT DISTINCT window_id FROM ue) w LEFT JOIN n USING (window_id)""")
def cumulative_distinct_users(t: Tables) -> DataFrame:
    return stats.cumulative_users(t.unit_events())


@query(COUNTS + " SELECT * FROM scores")
def burst_scores_all(t: Tables) -> DataFrame:
    return burst.burst_scores(t.unit_events())


TOP = COUNTS + ", top AS (SELECT *, CAST(rn - 1 AS INTEGER) AS seg_id FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY wb DESC, unit) AS rn FROM scores) WHERE rn <= 200)"


@query(TOP + " SELECT window_id, unit, f, u, ps, expected, sigma, pb, wb, seg_id FROM top")
def burst_top_units(t: Tables) -> DataFrame:
    return burst.top_units(burst.burst_scores(t.unit_events()))


@query(sql("ue") + " SELECT unit, count(DISTINCT tweet_id) AS df FROM ue GROUP BY 1")
def unit_df(t: Tables) -> DataFrame:
    return stats.unit_df(t.unit_events())


@query(COUNTS + " SELECT unit, round(ps, 6) AS ps FROM ps")
def unit_ps(t: Tables) -> DataFrame:
    e = t.unit_events()
    return stats.unit_ps(stats.unit_counts(e), stats.window_totals(e)).select("unit", rounded(F.col("ps")).alias("ps"))


@query(COUNTS + " SELECT window_id, n_tweets AS n, CAST(sum(n_tweets) OVER () AS BIGINT) AS total FROM totals")
def df_header(t: Tables) -> DataFrame:
    own = stats.window_totals(t.unit_events()).select("window_id", F.col("n_tweets").alias("n"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("total"))))


@query(TOP + """, k AS (SELECT window_id, unit, count(DISTINCT tweet_id) AS f, count(DISTINCT user_id) AS u FROM ue SEMI JOIN top USING (window_id, unit) GROUP BY 1, 2)
 SELECT window_id, seg_id, unit, k.f, k.u, n_tweets, n_users FROM k JOIN totals USING (window_id) JOIN (SELECT window_id, unit, seg_id FROM top) USING (window_id, unit)""")
def event_segment_df(t: Tables) -> DataFrame:
    e = t.unit_events()
    return burst.event_segment_df(e, burst.top_units(burst.burst_scores(e)))


SLANG = [(str(i), "x") for i in range(0, 100, 7)]


@query(TOP + " SELECT window_id, unit, wb FROM top WHERE NOT list_has_any(string_split_regex(unit, '[ _]'), [" + ", ".join(f"'{a}'" for a, _ in SLANG) + "])")
def slang_filtered_units(t: Tables) -> DataFrame:
    slang = t.spark.createDataFrame(SLANG, "slang string, word string")
    return burst.slang_filtered(burst.top_units(burst.burst_scores(t.unit_events())), slang).select("window_id", "unit", "wb")


def _lines(t: Tables) -> DataFrame:
    """Documents as lines of JSON; those of one source are cut short."""
    d = t.documents
    user = F.struct((F.col("doc_id") % 97).cast("string").alias("id_str"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("location"), F.col("lang"), F.col("n_chars").alias("statuses_count"))
    message = F.struct(F.col("doc_id").cast("string").alias("id_str"), "text", F.lit("Sun Jan 23 00:00:02 +0000 2011").alias("created_at"), F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), user.alias("user"))
    line = F.to_json(message)
    return d.select(F.when(F.col("source") == "src1", F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id_str, CAST(doc_id % 97 AS VARCHAR) AS user_id, CASE WHEN lang <> 'es' THEN lang END AS lang, n_chars AS statuses, TIMESTAMP '2011-01-23 00:00:02' AS created FROM documents WHERE source <> 'src1'")
def raw_json_parse(t: Tables) -> DataFrame:
    return readers.messages(readers.parsed(_lines(t))).select("id_str", F.col("user.id_str").alias("user_id"), "lang", F.col("user.statuses_count").alias("statuses"), F.col("created").cast("timestamp_ntz").alias("created"))


@query("SELECT count(*) FILTER (source = 'src1') AS rejected, count(*) FILTER (source <> 'src1') AS accepted FROM documents")
def raw_json_rejects(t: Tables) -> DataFrame:
    # The reader keeps only what is asked for: without other columns no line counts as broken.
    return readers.parsed(_lines(t)).select("_bad", "id_str").agg(F.count_if(F.col("id_str").isNull() | F.col("_bad").isNotNull()).alias("rejected"), F.count_if(F.col("id_str").isNotNull() & F.col("_bad").isNull()).alias("accepted"))


@query("""WITH g AS (SELECT * FROM documents WHERE source <> 'src1') SELECT 'lang' AS attribute, count(*) FILTER (lang = 'es') AS missing FROM g
 UNION ALL SELECT 'user.location', count(*) FILTER (doc_id % 3 <> 0) FROM g UNION ALL SELECT 'user.name', count(*) FROM g UNION ALL SELECT 'entities', count(*) FROM g UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM g""")
def attribute_null_profile(t: Tables) -> DataFrame:
    return readers.null_profile(readers.messages(readers.parsed(_lines(t))), ["lang", "user.location", "user.name", "entities", "text"])


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_PUNCT = "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$"
CLEAN = f"""WITH s AS (SELECT doc_id AS tweet_id, lang, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '' AND NOT starts_with(x, 'http')) AS w FROM documents),
 c AS (SELECT tweet_id, lang, list_filter(list_transform(w, lambda x: CASE WHEN contains(x, '@') THEN regexp_replace(x, '[^@a-zA-Z0-9]', '', 'g')
   WHEN NOT regexp_matches(x, '[^ -~]') AND regexp_matches(x, '[a-zA-Z0-9]') AND length(regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '{_PUNCT}', '', 'g')) >= 2
     AND NOT list_contains({_STOP}, regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '{_PUNCT}', '', 'g')) THEN regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '{_PUNCT}', '', 'g') END), lambda x: x IS NOT NULL) AS tokens FROM s)"""


def _clean(t: Tables) -> DataFrame:
    return clean.cleaned(t.documents.select(F.col("doc_id").alias("tweet_id"), "lang", "text"))


@query(CLEAN + " SELECT tweet_id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM c")
def clean_tokens(t: Tables) -> DataFrame:
    return _clean(t).select("tweet_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query(CLEAN + " SELECT tweet_id, array_to_string(tokens, ' ') AS text FROM c WHERE len(tokens) > 0")
def tweet_clean_text(t: Tables) -> DataFrame:
    return _clean(t).where(F.size("tokens") > 0).select("tweet_id", F.array_join("tokens", " ").alias("text"))


@query(CLEAN + """, dict AS (SELECT lower(x) AS word FROM (SELECT tweet_id, unnest(tokens) AS x FROM c WHERE lang = 'en') GROUP BY 1 HAVING count(DISTINCT tweet_id) >= 5),
 k AS (SELECT tweet_id, lower(x) AS word FROM (SELECT tweet_id, unnest(tokens) AS x FROM c)),
 r AS (SELECT tweet_id, count(*) AS valid, count(*) FILTER (word NOT IN (SELECT word FROM dict)) AS foreign_words FROM k GROUP BY 1)
 SELECT tweet_id, valid, foreign_words, foreign_words > 0.8 * valid AS rejected FROM r""")
def non_english_rejects(t: Tables) -> DataFrame:
    # A word goes out once a text, and texts are cleaned once; only words that are not known meet their texts again.
    own = written(stats.word_counts(_clean(t)), "words")
    known = own.where("lang = 'en'").groupBy("word").agg(F.count_distinct("tweet_id").alias("df")).where("df >= 5").select("word")
    foreign = own.join(known, "word", "left_anti").groupBy("tweet_id").agg(F.sum("n").alias("foreign_words"))
    counts = own.groupBy("tweet_id").agg(F.sum("n").alias("valid")).join(foreign, "tweet_id", "left").fillna({"foreign_words": 0})
    return counts.select("tweet_id", "valid", "foreign_words").withColumn("rejected", F.col("foreign_words") > 0.8 * F.col("valid"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda x: split_part(split_part(x, '@', 1), '#', 1)), lambda x: x <> '' AND lower(x) <> 'rt') AS w FROM conversations)
 SELECT conv_id, turn, len(w) AS n, array_to_string(w, ' ') AS text FROM s""")
def tweet_str_to_vec(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.cut_tokens(F.col("text")).alias("w")).select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("text"))


@query(f"""WITH s AS (SELECT conv_id, turn, regexp_replace(text, '_+', '_', 'g') AS a FROM conversations),
 r AS (SELECT conv_id, turn, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '@\\w+', ' ', 'g'), 'https?://\\S+', ' ', 'g'), '(^|\\s)[rR][tT](\\s+|$)', ' ', 'g'), '#[A-Za-z0-9{{}}]+', ' ', 'g')) AS b FROM s),
 w AS (SELECT conv_id, turn, list_filter(string_split_regex(b, '\\s+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^_+$') AND NOT list_contains({_STOP}, x)) AS w FROM r)
 SELECT conv_id, turn, len(w) AS n, array_to_string(w, ' ') AS text FROM w""")
def java_style_tokens(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.social_tokens(F.col("text"), T.STOP_WORDS).alias("w")).select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("text"))


@query("SELECT CASE WHEN source IS NULL OR source = '' THEN 'empty' WHEN contains(lower(source), 'src1') THEN 'located' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def location_split(t: Tables) -> DataFrame:
    place = F.col("source")
    kind = F.when(place.isNull() | (place == ""), "empty").when(F.contains(F.lower(place), F.lit("src1")), "located").otherwise("other")
    return t.documents.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(sql("tweets") + """ SELECT count(*) AS n_tweets, count(DISTINCT user_id) AS n_users, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens, round(avg(len(tokens)), 6) AS mean_tokens, count(*) FILTER (len(tokens) = 0) AS n_empty,
 (SELECT count(DISTINCT w) FROM (SELECT unnest(tokens) AS w FROM tweets)) AS n_words FROM tweets""")
def corpus_statistics(t: Tables) -> DataFrame:
    return stats.corpus(t.tweets())


@query(sql("tweets") + " SELECT length(w) AS length, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM tweets) GROUP BY 1")
def token_length_histogram(t: Tables) -> DataFrame:
    words = t.tweets().select(F.explode("tokens").alias("w"))
    return stats.length_histogram(words, F.length("w").cast("long"))


GRAMS = sql("turns") + ", g AS (SELECT tweet_id, window_id, n, i, array_to_string(tokens[i:i + n - 1], ' ') AS gram FROM turns, range(1, 6) r(n), (SELECT unnest(range(1, (SELECT max(len(tokens)) + 1 FROM turns))) AS i) p WHERE i + n - 1 <= len(tokens))"


@query(GRAMS + " SELECT DISTINCT window_id, n, gram FROM g")
def distinct_ngrams(t: Tables) -> DataFrame:
    return segment.grams(t.turns(), 5, "window_id").select("window_id", F.col("n").cast("long").alias("n"), "gram").distinct()


@query(GRAMS + " SELECT n, count(*) AS places, count(DISTINCT gram) AS distinct_grams FROM g GROUP BY 1")
def ngram_length_distribution(t: Tables) -> DataFrame:
    return segment.grams(t.turns(), 5).groupBy(F.col("n").cast("long").alias("n")).agg(F.count("*").alias("places"), F.count_distinct("gram").alias("distinct_grams"))


LM = GRAMS + ", lm AS (SELECT gram, n, count(*) AS c, log10(count(*) / sum(count(*)) OVER (PARTITION BY n)) AS logp FROM g GROUP BY 1, 2)"


@query(LM + " SELECT gram, n, c AS count, round(logp, 6) AS logp FROM lm")
def gram_logprob(t: Tables) -> DataFrame:
    return segment.log_probabilities(t.turns()).select("gram", F.col("n").cast("long").alias("n"), "count", rounded(F.col("logp")).alias("logp"))


@query(LM + ", raw AS (SELECT DISTINCT gram FROM g WHERE window_id = 1) SELECT gram, round(logp, 6) AS logp FROM lm SEMI JOIN raw USING (gram)")
def gram_prob_semijoin(t: Tables) -> DataFrame:
    raw = written(segment.grams(t.turns().where("window_id = 1"), 5).select("gram").distinct(), "raw")
    return segment.log_probabilities(t.turns(), among=raw).select("gram", rounded(F.col("logp")).alias("logp"))


@query("SELECT lower(w) AS gram, max_by(v, doc_id) AS value FROM (SELECT doc_id, n_chars AS v, string_split_regex(text, '\\s+')[1] AS w FROM documents) WHERE w <> '' GROUP BY 1")
def lower_dedupe_last_wins(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", F.col("n_chars").alias("v"), F.split("text", r"\s+")[0].alias("w")).where("w <> ''")
    return own.groupBy(F.lower("w").alias("gram")).agg(F.max_by("v", "doc_id").alias("value"))


ANCHORS = sql("turns", "anchors") + """, atx AS (SELECT page_id, regexp_extract_all(anchor, '[a-z0-9]+') AS k FROM anchors),
 ag AS (SELECT DISTINCT page_id, array_to_string(k[i:i + n - 1], ' ') AS gram FROM atx, range(1, 6) r(n), range(1, 60) p(i) WHERE i + n - 1 <= len(k)),
 bt AS (SELECT page_id, regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[a-z0-9]+') AS k FROM pages),
 bg AS (SELECT page_id, array_to_string(k[i:i + n - 1], ' ') AS gram FROM bt, range(1, 6) r(n), (SELECT unnest(range(1, (SELECT max(len(k)) + 1 FROM bt))) AS i) p WHERE i + n - 1 <= len(k)),
 linked AS (SELECT gram, count(DISTINCT page_id) AS linked FROM ag GROUP BY 1), held AS (SELECT gram, count(DISTINCT page_id) AS pages FROM bg SEMI JOIN linked USING (gram) GROUP BY 1),
 kp AS (SELECT gram, linked, pages, least(linked / pages, 1.0) AS prob FROM linked JOIN held USING (gram))"""


@query(ANCHORS + " SELECT gram, linked, pages, round(prob, 6) AS prob FROM kp")
def anchor_keyphraseness(t: Tables) -> DataFrame:
    return segment.keyphraseness(t.anchors(), t.pages).select("gram", "linked", "pages", rounded(F.col("prob")).alias("prob"))


STICKY = ANCHORS + """, g AS (SELECT tweet_id, window_id, n, i, array_to_string(tokens[i:i + n - 1], ' ') AS gram FROM turns, range(1, 6) r(n), (SELECT unnest(range(1, (SELECT max(len(tokens)) + 1 FROM turns))) AS i) p WHERE i + n - 1 <= len(tokens)),
 lm AS (SELECT gram, n, count(*) AS c, log10(count(*) / sum(count(*)) OVER (PARTITION BY n)) AS logp FROM g GROUP BY 1, 2),
 cuts AS (SELECT gram, lm.n, logp, array_to_string(string_split(gram, ' ')[1:i], ' ') AS l, array_to_string(string_split(gram, ' ')[i + 1:], ' ') AS r FROM lm, range(1, 5) x(i) WHERE i < lm.n),
 mean AS (SELECT c.gram, c.n, c.logp, avg(pow(10, coalesce(a.logp, -100) + coalesce(b.logp, -100))) AS m FROM cuts c LEFT JOIN lm a ON a.gram = c.l LEFT JOIN lm b ON b.gram = c.r GROUP BY 1, 2, 3),
 scp AS (SELECT gram, n, 2 * logp AS scp FROM lm WHERE n = 1 UNION ALL SELECT gram, n, 2 * logp - CASE WHEN m > 0 THEN log10(m) ELSE -1e20 END FROM mean),
 sticky AS (SELECT gram, n, round(scp, 6) AS scp, round(CASE WHEN n <= 1 THEN 1.0 ELSE (n - 1) / n END * exp(coalesce(prob, 0)) * 2 / (1 + exp(-scp)), 6) AS stickiness FROM scp LEFT JOIN kp USING (gram))"""


def _sticky(t: Tables) -> DataFrame:
    return segment.gram_stickiness(written(segment.log_probabilities(t.turns()), "lm"), written(segment.keyphraseness(t.anchors(), t.pages), "anchors"))


@query(STICKY + " SELECT * FROM sticky")
def gram_stickiness(t: Tables) -> DataFrame:
    return _sticky(t).withColumn("n", F.col("n").cast("long"))


def segmented(t: Tables) -> DataFrame:
    return segment.segment(t.turns(), _sticky(t))


@query()
def segment_tweets(t: Tables) -> DataFrame:
    return segmented(t)


@query()
def segment_length_distribution(t: Tables) -> DataFrame:
    own = segmented(t).select(F.explode("segments").alias("s"))
    return stats.length_histogram(own, F.size(F.split("s", " ")), 5)


WORDS = sql("tw") .replace("WITH RECURSIVE ", "WITH RECURSIVE turns AS (SELECT conv_id * 1000 + turn AS tweet_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens, conv_id AS user_id, conv_id % 15 + 1 AS window_id, turn * 3 % 24 AS hour FROM conversations), ")
TFDF = WORDS + ", k AS (SELECT window_id, unit, count(*) AS tf, count(DISTINCT tweet_id) AS df FROM tw GROUP BY 1, 2), c AS (SELECT unit, count(*) AS tf, count(DISTINCT tweet_id) AS df FROM tw GROUP BY 1)"


@query(TFDF + " SELECT * FROM k")
def word_segment_tf_df(t: Tables) -> DataFrame:
    return stats.unit_tf_df(t.turn_words())


def _totals(t: Tables) -> DataFrame:
    return t.turn_words().groupBy("unit").agg(F.count("*").alias("tf"), F.count_distinct("tweet_id").alias("df"))


@query(TFDF + " SELECT CAST(x AS INTEGER) AS threshold, count(*) FILTER (tf > x) AS n, round(count(*) FILTER (tf > x) / count(*), 6) AS share FROM c, (SELECT unnest([0, 1, 10, 100, 1000]) AS x) GROUP BY x")
def tf_threshold_counts(t: Tables) -> DataFrame:
    return stats.above_thresholds(_totals(t), "tf")


@query(TFDF + " SELECT tf AS value, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def top_tf_values(t: Tables) -> DataFrame:
    return stats.common_values(_totals(t), "tf")


@query(TFDF + ", v AS (SELECT window_id, count(DISTINCT unit) AS words, count(DISTINCT tweet_id) AS n_tweets FROM tw GROUP BY 1) SELECT window_id, words, n_tweets, round(100 * n_tweets / sum(n_tweets) OVER (), 2) AS share FROM v")
def vocab_ratio(t: Tables) -> DataFrame:
    return stats.vocabulary(t.turn_words())
