"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places that doubles are rounded to before they are ranked or put out.
PLACES = 6
#: log10 of nothing.
NO_LOG, MISSING_LOG = -1e20, -100.0


def rounded(x: Column, places: int = PLACES) -> Column:
    return F.round(x, places)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(NO_LOG))


def expected(n: Column, ps: Column) -> Column:
    return n * ps


def deviation(n: Column, ps: Column) -> Column:
    return F.sqrt(n * ps * (1 - ps))


def burst_probability(f: Column, mean: Column, sigma: Column) -> Column:
    """1 from two deviations above the mean, a steep sigmoid below."""
    return F.when(f >= mean + 2 * sigma, F.lit(1.0)).otherwise(sigmoid(10 * (f - mean - sigma) / F.nullif(sigma, F.lit(0.0))))


def burst_weight(probability: Column, users: Column) -> Column:
    return probability * F.log10(users)


def length_norm(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1.0)).otherwise((n - 1) / n)


def stickiness(scp: Column, n: Column, anchor: Column) -> Column:
    """Cohesion of a gram: 2 sigmoid(SCP) by its length and how often it is an anchor."""
    return length_norm(n) * F.exp(anchor) * 2 * sigmoid(scp)


def idf(documents: Column, df: Column, whole: bool = True) -> Column:
    """ln of the quotient, by default without its fraction: 0 for what more than half of the documents hold."""
    quotient = documents / df
    return F.ln(F.floor(quotient).cast("double") if whole else quotient)


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def product(v: Column, least: float = 1e-5) -> Column:
    """Product of the values, 0 counting as `least`."""
    return F.aggregate(v, F.lit(1.0), lambda a, x: a * F.when(x == 0, least).otherwise(x))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_length(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def sign(margin: Column) -> Column:
    """1 above 0, else -1."""
    return F.when(margin > 0, 1).otherwise(-1)


def positive_set(number: Column, width: int = 12) -> Column:
    """Places of the 1 bits of a number, from the left; places 11 and 12 count one more, for the feature that is left out."""
    bits = F.lpad(F.bin(number), width, "0")
    places = F.filter(F.sequence(F.lit(1), F.lit(width)), lambda i: F.substring(bits, i, F.lit(1)) == "1")
    return F.transform(places, lambda i: F.when(i >= 11, i + 1).otherwise(i))
