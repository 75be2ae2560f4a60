"""Steps whose shuffles and plans must not grow faster than their input."""

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from burstline.operators import graph, segment
from burstline.plans import QUERIES
from pyspark.sql import functions as F

FOLDER = os.environ.get("BURSTLINE_TESTDATA", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_made_where_their_part_of_the_day_is(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, i % 2 + 1, rng.choice([0, 3, 22]), [rng.choice(words) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    rows += [(7, 2, 3, ["w1", "w2"]), (8, 1, 3, ["w1", "w1"])]  # two rows of one message
    df = spark.createDataFrame(rows, "tweet_id long, window_id long, hour int, tokens array<string>")
    held = {(w, u): {i for i, x, _, t in rows if x == w and u in t} for w in (1, 2) for u in words[:12]}
    units = {(w, u): k for w in (1, 2) for k, u in enumerate(words[:12])}
    top = spark.createDataFrame([(w, u, k, len(held[w, u])) for (w, u), k in units.items()], "window_id long, unit string, seg_id int, f long")
    n = len({i for i, *_, t in rows if t})
    idf = {u: math.log(n // len({i for i, *_, t in rows if u in t})) for u in words if any(u in t for *_, t in rows)}
    every, members = defaultdict(list), defaultdict(set)
    for i, w, h, t in rows:
        every[i] += t
        for u in t:
            if (w, u) in units:
                members[w, h // 2, units[w, u]].add(i)
    tf = Counter((*key, u) for key, ids in members.items() for i in ids for u in every[i])
    got = {(r["window_id"], r["m"], r["seg_id"], r["feature"]): (r["tf"], round(r["weight"], 9)) for r in graph.tfidf(df, top).collect()}
    assert got == {k: (v, round(v * idf[k[3]], 9)) for k, v in tf.items()}
    vector = defaultdict(dict)
    for (*key, u), v in tf.items():
        if idf[u] > 0:
            vector[tuple(key)][u] = v * idf[u]
    sims = defaultdict(float)
    f = {(w, k): len(held[w, u]) for (w, u), k in units.items()}
    for (w, m, i), x in vector.items():
        for (w2, m2, j), y in vector.items():
            if (w2, m2) == (w, m) and i < j:
                dot = sum(x[u] * y[u] for u in x.keys() & y.keys()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
                sims[w, i, j] += len(members[w, m, i]) / f[w, i] * len(members[w, m, j]) / f[w, j] * dot
    sim = graph.pair_similarity(df, top)
    got = {(r["window_id"], r["seg_i"], r["seg_j"]): r["sim"] for r in sim.collect()}
    want = {k: v for k, v in sims.items() if v > 1e-6}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items())
    assert "SortMergeJoin" not in executed(sim)  # pairs of units are never joined by feature


@tables
def test_event_queries_read_stored_steps(spark):
    for name in ("event_size_distribution", "event_ratio_histogram", "mutual_knn", "event_clusters"):
        plan = analyzed(QUERIES[name](spark, FOLDER))
        assert "conversations" not in plan and "SortMergeJoin" not in plan and plan.count("Relation") <= 2, name


def test_only_grams_that_may_be_wanted_are_made(spark):
    rng = random.Random(4)
    texts = [(i, [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))]) for i in range(700)]
    df = spark.createDataFrame([*texts, (9999, None)], "page_id long, tokens array<string>")
    every = [(i, n, " ".join(t[a : a + n])) for i, t in texts for n in range(1, 6) for a in range(len(t) - n + 1)]
    wanted = {g for *_, g in rng.sample(every, 300)}
    keep = segment.gram_filter(spark.createDataFrame([(g,) for g in wanted], "gram string"))
    got = [tuple(r) for r in segment.grams_among(df, keep, 5, "page_id").collect()]
    must = Counter(x for x in every if x[2] in wanted)
    assert must == Counter(x for x in got if x[2] in wanted) and len(got) < must.total() + len(every) / 100
    once = [tuple(r) for r in segment.grams_among(df, keep, 5, "page_id", True).where("n = 1").collect()]
    assert len(once) == len(set(once)) and {x for x in once if x[2] in wanted} == {x for x in must if x[1] == 1}


@tables
def test_texts_are_measured_once_and_before_they_meet_labels(spark):
    from burstline.sources.tables import Tables

    plan = Tables(spark, FOLDER).vectors()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(plan) if "Join" in x)
    assert "regexp" not in "".join(plan[:join]) and "regexp" in "".join(plan[join:])
    for name in ("minmax_features", "filter_vote", "score_histogram", "reweighted_features"):
        plan = analyzed(QUERIES[name](spark, FOLDER))
        assert "text#" not in plan and "regexp" not in plan, name


@tables
def test_words_of_texts_are_counted_before_they_are_shuffled(spark):
    from burstline.operators import stats

    rows = [(1, "en", ["A", "a", "b"]), (2, None, []), (3, "de", None), (1, "en", ["b", "B", "c"])]
    got = sorted(tuple(r) for r in stats.word_counts(spark.createDataFrame(rows, "tweet_id long, lang string, tokens array<string>")).collect())
    assert got == [(1, "en", "a", 2), (1, "en", "b", 1), (1, "en", "b", 2), (1, "en", "c", 1)]
    plan = analyzed(QUERIES["non_english_rejects"](spark, FOLDER))
    assert "text#" not in plan and "LeftAnti" in plan


@tables
def test_probabilities_of_some_grams_read_stored_grams(spark):
    rows = [(i, f"a b a {'c' * (i % 3)} b".split()) for i in range(20)] + [(99, [])]
    df = spark.createDataFrame(rows, "tweet_id long, tokens array<string>")
    every = {r["gram"]: r for r in segment.log_probabilities(df).collect()}
    some = segment.log_probabilities(df, among=spark.createDataFrame([("a b",), ("b",), ("z",)], "gram string")).collect()
    assert {r["gram"]: r for r in some} == {g: every[g] for g in ("a b", "b")}
    plan = analyzed(QUERIES["gram_prob_semijoin"](spark, FOLDER))
    assert "grams_among" in plan or "MapInArrow" in plan


def test_texts_are_cleaned_in_batches_as_by_columns(spark):
    from burstline.functions import text as T
    from burstline.operators import clean

    rng = random.Random(6)
    bits = ["a", "B", "9", "&lt;", "&gt;", "@", "#", "_", "-", "'", "é", "\u2028", "\u00a0", "\x1c", "http", "the", "rt", "&", "x1", "~", "\x7f"]
    texts = ["".join(rng.choice([*bits, " ", "\t", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([None, "", " ", "http the a", *texts])], "tweet_id long, text string")
    want = {r[0]: r[1] for r in df.select("tweet_id", T.clean_tokens(F.col("text"))).collect()}
    got = clean.cleaned(df)
    assert {r["tweet_id"]: r["tokens"] for r in got.collect()} == want
    assert "rlike" not in executed(got).lower() and "MapInArrow" in executed(got)


@tables
def test_clean_texts_take_no_pattern_a_token(spark):
    assert "RLIKE" not in analyzed(QUERIES["tweet_clean_text"](spark, FOLDER))
