"""Column and frame primitives: ranks, correlations, histograms, vector expressions.

Ranks and histograms are windows and aggregations; vector expressions are higher-order functions, so everything
here stays in the JVM. Grouped forms take the grouping columns, and one shuffle by them serves all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Standard deviations below this count as none.
FLAT = 1e-10


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1, ties sharing the mean of their places: the mean of the first and the last of them, by one window."""
    ordered = Window.partitionBy(*by).orderBy(value)
    return (F.rank().over(ordered) + F.count("*").over(ordered)) / 2


def percentile_rank(value: str, by: list[str]) -> Column:
    """Average rank over the number of rows: above 0, at most 1."""
    return average_rank(value, by) / F.count("*").over(Window.partitionBy(*by))


def ordinal_rank(value: str, by: list[str], tie: str = "node_id") -> Column:
    """Place from 0; ties go by ``tie``."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) - 1


def strict_percentile(value: str, by: list[str]) -> Column:
    """The share of rows strictly below."""
    return (F.rank().over(Window.partitionBy(*by).orderBy(value)) - 1) / F.count("*").over(Window.partitionBy(*by))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson's r; 0 where a side is flat or r is undefined. An aggregate."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    # not F.corr, which raises where a side is constant
    r = F.try_divide(F.covar_pop(a, b), sa * sb)
    return F.when((sa < FLAT) | (sb < FLAT) | r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r)


def min_max(df: DataFrame, value: str = "score", by: list[str] | None = None) -> DataFrame:
    """``value`` scaled to 0..1 (0 where the range is below 1e-10). The extremes are an aggregate joined back, not a window over all rows."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # one row
    span = F.col("_hi") - F.col("_lo")
    return joined.withColumn(value, F.when(span < FLAT, F.lit(0.0)).otherwise((F.col(value) - F.col("_lo")) / span)).drop("_lo", "_hi")


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts of equal-width bins between the extremes, empty ones included: by, bin, lo, hi, n. One value alone gets a width of 1 around it."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(value).cast("double").alias("mn"), F.max(value).cast("double").alias("mx")).where("mn is not null")
    ends = ends.withColumn("half", F.when(F.col("mx") == F.col("mn"), 0.5).otherwise(0.0)).select(*by, (F.col("mn") - F.col("half")).alias("mn"), (F.col("mx") + F.col("half")).alias("mx"))
    joined = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))
    place = F.least(F.floor((F.col(value) - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins), F.lit(bins - 1)).cast("int")
    counts = joined.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select(*by, "mn", "mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("mx") - F.col("mn")) / bins
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("mn") + width * F.col("bin")).alias("lo"), (F.col("mn") + width * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def ks_statistic(df: DataFrame, value: str, flag: str, by: list[str] | None = None) -> DataFrame:
    """by, ks, p: the greatest distance between the distribution functions of the flagged and the other rows, and its asymptotic p.

    Rows are first summed by value, so the running sums go over distinct values.
    """
    by = by or []
    hit = F.when(F.col(flag), 1).otherwise(0)
    steps = df.groupBy(*by, value).agg(F.sum(hit).alias("a"), F.sum(1 - hit).alias("b"))
    run = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    share = lambda c: F.try_divide(F.sum(c).over(run), F.sum(c).over(whole))  # null where a side is missing
    gap = F.abs(share("a") - share("b"))
    out = steps.select(*by, gap.alias("gap"), F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"))
    out = out.groupBy(*by).agg(F.max("gap").alias("ks"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    z2 = F.pow("ks", F.lit(2)) * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    terms = [(-1) ** (j - 1) * F.exp(-2.0 * j * j * z2) for j in range(1, 21)]
    return out.select(*by, "ks", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * sum(terms[1:], terms[0]))).alias("p"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: str | Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: str | Column, floor: float = 1e-8) -> Column:
    """The vector over its length, which counts as ``floor`` at least."""
    length = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x / length)


def cosine(a: str | Column, b: str | Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mean_vector(vector: str, dim: int, weight: str | Column | None = None) -> Column:
    """The (weighted) mean of a vector column of known length: an aggregate, partly summed before its shuffle."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    total = F.sum(w)
    return F.array(*[F.sum(F.col(vector)[i] * w) / total for i in range(dim)])


def long_form(nodes: DataFrame, vector: str = "features", key: str = "node_id") -> DataFrame:
    """key, dim, value."""
    return nodes.select(key, F.posexplode(vector).alias("dim", "value"))


def erf(x: Column) -> Column:
    """The error function to 1.5e-7 (Abramowitz and Stegun 7.1.26), as an expression."""
    # fixed values: the formula's coefficients
    p, a = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def robust_gaussian_scale(df: DataFrame, value: str = "score", by: list[str] | None = None) -> DataFrame:
    """``value`` as the normal distribution's share below it, with median and 1.4826 times the median deviation; percentile ranks where that is flat."""
    by = by or []
    middle = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("_m"))
    with_m = df.join(middle, by) if by else df.crossJoin(F.broadcast(middle))
    with_m = with_m.withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    spread = with_m.groupBy(*by).agg((1.4826 * F.percentile("_d", 0.5)).alias("_s"))
    with_s = with_m.join(spread, by) if by else with_m.crossJoin(F.broadcast(spread))
    z = (F.col(value) - F.col("_m")) / (F.col("_s") * math.sqrt(2))
    return with_s.withColumn(value, F.when(F.col("_s") < FLAT, percentile_rank(value, by)).otherwise(0.5 * (1 + erf(z)))).drop("_m", "_d", "_s")


def chi2_tail(x: float, k: int) -> float:
    """The chance of a chi-squared value above ``x`` with ``k`` degrees of freedom (regularised upper incomplete gamma)."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 1.0
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= z / n
            total += term
        return 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a))
    tiny = 1e-300
    b, c, d = z + 1 - a, 1 / tiny, 1 / (z + 1 - a)
    h = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # where the fraction converges slowly
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * total
    raise ValueError("the incomplete beta function has not converged")


def f_tail(f: float, d1: float, d2: float) -> float:
    """The chance of a larger F."""
    return 0.0 if math.isinf(f) else beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def studentized_range(k: int, alpha: float = 0.05) -> float:
    """The range of ``k`` normal values that is passed with chance ``alpha`` (the deviation being known), by bisection of its integral."""
    below = lambda z: 0.5 * math.erfc(-z / 2**0.5)

    def inside(q: float) -> float:
        steps, low, high = 2000, -8.0, 8.0
        h = (high - low) / steps
        point = lambda z: math.exp(-z * z / 2) * (below(z) - below(z - q)) ** (k - 1)
        total = point(low) + point(high) + sum((4 if i % 2 else 2) * point(low + i * h) for i in range(1, steps))
        return k * total * h / 3 / (2 * math.pi) ** 0.5

    low, high = 0.0, 20.0
    for _ in range(60):
        q = (low + high) / 2
        low, high = (q, high) if inside(q) < 1 - alpha else (low, q)
    return (low + high) / 2
