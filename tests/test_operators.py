"""Operators against direct statements of their rules."""

import random

from burstline.operators import affix, evaluate, events, graph, learn, segment
from burstline.streaming import days
from pyspark.sql import functions as F

LISTS = [[11], [8], [4, 8, 11], [5, 9, 10], [2, 7], [3, 10], [7, 9], [4, 6, 9], [1, 2], [3, 6, 7], [3, 5], [0, 2]]


def _clusters(spark, lists):
    nodes = spark.createDataFrame([(1, i) for i in range(len(lists))], "window_id int, seg_id int")
    edges = spark.createDataFrame([(1, i, j, 0.5) for i, own in enumerate(lists) for j in own], "window_id int, src int, dst int, sim double")
    clusters = graph.greedy_clusters(nodes, edges)
    return clusters, edges


def test_greedy_clusters(spark):
    clusters, edges = _clusters(spark, LISTS)
    assert [r["event_id"] for r in clusters.orderBy("seg_id").collect()] == [0, 1, 2, 3, 2, 3, 6, 2, 1, 3, 3, 0]
    # A star forest: one edge fewer than units in every event.
    sizes = {r["event_id"]: r["n"] for r in clusters.groupBy("event_id").agg(F.count("*").alias("n")).collect()}
    grown = {r["event_id"]: r["n"] for r in graph.cluster_edges(clusters, edges).groupBy("event_id").agg(F.count("*").alias("n")).collect()}
    assert all(grown.get(e, 0) == n - 1 for e, n in sizes.items())


def test_greedy_clusters_random(spark):
    rng = random.Random(5)
    n = 40
    near = [set() for _ in range(n)]
    for _ in range(50):
        a, b = rng.sample(range(n), 2)
        near[a].add(b)
        near[b].add(a)
    want = [None] * n
    for i in range(n):
        for j in sorted(near[i]):
            if want[j] is None and j != i:
                want[j] = want[i] if want[i] is not None else i
        if want[i] is None:
            want[i] = i
    clusters, _ = _clusters(spark, [sorted(x) for x in near])
    assert [r["event_id"] for r in clusters.orderBy("seg_id").collect()] == want


def test_newsworthiness(spark):
    units = spark.createDataFrame([("a",), ("a b",), ("z",), ("z y",)], "unit string")
    anchors = spark.createDataFrame([("a", 0.2), ("a b", 0.5)], "gram string, prob double")
    got = {r["unit"]: r["worth"] for r in events.newsworthiness(units, anchors).collect()}
    assert got == {"a": 1.221403, "a b": 0.648721, "z": 0.0, "z y": 0.0}


def test_segment_is_the_best_of_all_cuts(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 7))], 1) for i in range(30)]
    df = spark.createDataFrame(rows, "tweet_id int, tokens array<string>, window_id int")
    grams = sorted({" ".join(t[i : i + n]) for _, t, _ in rows for n in range(1, 6) for i in range(len(t) - n + 1)})
    sticky = {g: round(rng.random() * len(g), 6) for g in grams}
    got = {r["tweet_id"]: r for r in segment.segment(df, spark.createDataFrame(list(sticky.items()), "gram string, stickiness double")).collect()}

    def best(t):
        if not t:
            return 0.0
        return max(sticky[" ".join(t[:n])] + best(t[n:]) for n in range(1, min(5, len(t)) + 1))

    for i, t, _ in rows:
        assert abs(got[i]["score"] - best(t)) < 1e-5 and " ".join(got[i]["segments"]) == " ".join(t)
        assert abs(sum(sticky[s] for s in got[i]["segments"]) - best(t)) < 1e-5


def test_keep_shortest_and_longest(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("abd",), ("b",)], "affix string")
    assert sorted(r[0] for r in affix.keep_shortest(df).collect()) == ["ab", "b"]
    assert sorted(r[0] for r in affix.keep_longest(df).collect()) == ["abc", "abd", "b"]


def test_learners_separate(spark):
    rng = random.Random(1)
    rows = [(i, y, [rng.gauss(2 if y else -2, 1), rng.random()]) for i in range(200) for y in (i % 2,)]
    df = spark.createDataFrame(rows, "instance_id int, label int, x array<double>")
    right = learn.cw_predict(df, learn.cw_binary(df)).where("predicted = label").count()
    assert right > 185
    multi = spark.createDataFrame([(i, i % 3, [float(i % 3 == k) + rng.random() * 0.3 for k in range(3)]) for i in range(150)], "instance_id int, label int, x array<double>")
    assert learn.cw_multiclass_predict(multi, learn.cw_multiclass(multi, k=2)).where("predicted = label").count() > 140
    assert learn.event_cluster(learn.kmeans(df, [0, 1])).where("predicted = label").count() > 185


def test_learners_of_no_rows(spark):
    df = spark.createDataFrame([], "instance_id int, label int, x array<double>")
    assert learn.cw_binary(df).count() == 0 and learn.kmeans(df, [0, 1]).count() == 0 and learn.minmax(df).count() == 0


def test_late_rows_go(spark):
    days_ = [1, 2, 1, 2, 3, 2, 3]
    df = spark.createDataFrame([(i * 3000, f"2024-01-0{d} 10:00:00") for i, d in enumerate(days_)], "at long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted(r["at"] // 3000 for r in days.late_dropped(df, "at", "ts").collect())
    assert got == [0, 1, 3, 4, 6]


def test_names_of_any_length(spark):
    name = " ".join(f"w{i}" for i in range(15))
    names = spark.createDataFrame([("one", ["acme"]), (name, name.split())], "name_id string, tokens array<string>")
    texts = spark.createDataFrame([(1, "buys acme today".split()), (2, name.split()), (3, ["x", *name.split()[2:14]]), (4, name.split()[:11])], "text_id long, tokens array<string>")
    got = {(r["text_id"], r["name_id"]): (r["gram"], r["fraction"]) for r in evaluate.names_in_texts(texts, names).collect()}
    assert got == {(1, "one"): ("acme", 1.0), (2, name): (name, 1.0), (3, name): (" ".join(name.split()[2:14]), 0.8)}
