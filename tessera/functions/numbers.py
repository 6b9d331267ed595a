"""Statistics, distances and array arithmetic as column expressions."""

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _xlogy(k: Column, p: Column) -> Column:
    return F.when((k == 0) | (p <= 0), F.lit(0.0)).otherwise(k * F.log(p))


def _likelihood(p: Column, k: Column, n: Column) -> Column:
    return _xlogy(k, p) + _xlogy(n - k, 1 - p)


def log_likelihood_ratio(f: Column, f1: Column, f2: Column, n: Column) -> Column:
    """Log likelihood ratio of a pair seen ``f`` times, its parts ``f1`` and ``f2``, in ``n`` terms (without factor 2)."""
    k1, n1, k2, n2 = f, f1, F.greatest(f2 - f, F.lit(0)), n - f1
    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    return _likelihood(p1, k1, n1) + _likelihood(p2, k2, n2) - _likelihood(p, k1, n1) - _likelihood(p, k2, n2)


def association_ratio(f: Column, f1: Column, f2: Column, n: Column) -> Column:
    return f * n / f1 / f2


def phrase_score(f: Column, terms: Column, llr: Column) -> Column:
    """Integer score of a phrase from its frequency, number of terms and association."""
    half = F.when(f > 200, F.lit(100)).otherwise(F.floor(f / 2))
    strength = F.when(llr >= 10, F.sqrt(F.least(llr, F.lit(100.0)))).otherwise(F.lit(5.0))
    return F.ceil(F.sqrt(half.cast("double")) * F.least(terms, F.lit(4)) * strength).cast("int") + 1


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function. SQL has no error function, so batches go through Arrow."""
    return x.map(lambda v: math.nan if v is None else 0.5 * math.erfc(-v / math.sqrt(2)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def _folded(a: Column, b: Column, each, start: float = 0.0, fold=None) -> Column:
    return F.aggregate(F.zip_with(a, b, each), F.lit(start), fold or (lambda s, v: s + v))


def l1(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: F.abs(x.cast("double") - y))


def l2_squared(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l_max(a: Column, b: Column) -> Column:
    return _folded(a, b, lambda x, y: F.abs(x.cast("double") - y), fold=lambda s, v: F.greatest(s, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if the sizes differ, null if a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), 0.0).when(norm == 0, None).otherwise(dot(a, b) / norm)


def l1_similarity(a: Column, b: Column) -> Column:
    """Reciprocal of the L1 distance; 100 if equal, 0 if the sizes differ."""
    d = l1(a, b)
    return F.when(F.size(a) != F.size(b), 0.0).when(d == 0, 100.0).otherwise(1 / d)


def normalised(a: Column) -> Column:
    """Vector of length one; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def round3(x: Column) -> Column:
    """Three decimals, halves up, truncating after that."""
    return F.floor((x + 0.0005) * 1000) / 1000


def entropy_over(counts: Column) -> Column:
    """Natural entropy of an array of counts; 0.001 if they sum to 0."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda s, c: s + c)
    h = F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, c / total * F.log(c / total)).otherwise(0.0))
    return F.when(total == 0, 0.001).otherwise(h)
