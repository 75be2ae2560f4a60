"""Golden vectors of tokenizers and scores."""

import math

import pytest
from burstline.functions import scores as S
from burstline.functions import text as T
from burstline.functions.stem import porter
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_cut_tokens(spark):
    got = one(spark, "hash#usr@testa ab@cd#sd usr@usr12 rT@test hash#sd Rt rt RT test tweet", T.cut_tokens)
    assert " ".join(got) == "hash ab usr hash test tweet"


def test_social_tokens(spark):
    text = " rttest _ RT@B RT @A RT@Jayjabz01 Wedding @jayjabz01 amp ab@SenoritaFaqaty gooooooood"
    assert one(spark, text, lambda v: T.social_tokens(v, legacy=True)) == "rttest wedding amp ab gooooooood".split()


def test_social_tokens_keep_words_that_end_in_rt(spark):
    assert one(spark, "start here", T.social_tokens) == ["start", "here"]
    assert one(spark, "start here", lambda v: T.social_tokens(v, legacy=True)) == ["sta", "here"]


@pytest.mark.parametrize(("f", "u", "expected"), [(13, 10, 0.385712), (17, 100, 2.0), (17, 1, 0.0)])
def test_burst(spark, f, u, expected):
    df = spark.createDataFrame([(1000, 0.01, f, u)], "n long, ps double, f long, u long")
    mean, sigma = S.expected(F.col("n"), F.col("ps")), S.deviation(F.col("n"), F.col("ps"))
    got = df.select(S.burst_weight(S.burst_probability(F.col("f"), mean, sigma), F.col("u")).alias("w"), sigma.alias("s")).first()
    assert got["s"] == pytest.approx(math.sqrt(9.9)) and got["w"] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(("hour", "part"), [(0, 0), (1, 0), (2, 1), (23, 11)])
def test_subwindow(spark, hour, part):
    assert spark.range(1).select(T.subwindow(F.lit(hour)).alias("x")).first()["x"] == part


def test_affixes(spark):
    assert one(spark, "#abc", T.prefixes) == ["a", "ab", "abc"] and sorted(one(spark, "#abc", T.suffixes)) == ["abc", "bc", "c"]
    assert one(spark, "#", T.prefixes) == []


def test_ngrams_of_short_and_no_tokens(spark):
    grams = lambda v: F.transform(T.ngrams(F.filter(F.split(v, " "), lambda x: x != "")), lambda g: g["gram"])
    assert one(spark, "a b", grams) == ["a", "a b", "b"] and one(spark, "", grams) == []


def test_message_time(spark):
    assert str(one(spark, "Sun Jan 23 00:00:02 +0000 2011", T.message_time)) == "2011-01-23 00:00:02"


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("relational", "relat"), ("happy", "happi"), ("adjustment", "adjust"), ("probate", "probat"), ("is", "is")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_positive_set(spark):
    assert spark.range(1).select(S.positive_set(F.lit(0b100000000011)).alias("x")).first()["x"] == [1, 12, 13]
