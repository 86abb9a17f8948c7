"""Intervals and paired tests as expressions and aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95) -> Column:
    """Struct low, high of the Wilson score interval; 0, 0 for no trials."""
    n = F.greatest(total.cast("double"), F.lit(1.0))
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.struct(F.when(total > 0, low).otherwise(0.0).alias("low"), F.when(total > 0, high).otherwise(0.0).alias("high"))


def log_factorial(n: Column) -> Column:
    """ln n! as a sum of logarithms up to 256 and by Stirling's series (error below 1e-15) beyond."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(n <= 256, exact).otherwise(series)


def mcnemar(left_only: Column, right_only: Column) -> Column:
    """Exact two-sided p-value from the discordant counts; 1 without any."""
    n, least = left_only + right_only, F.least(left_only, right_only)
    tail = F.aggregate(F.sequence(F.lit(0), least.cast("int")), F.lit(0.0), lambda a, k: a + F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def paired_test(pairs: DataFrame, left: str, right: str, by: list[str] | None = None) -> DataFrame:
    """n, left_only, right_only, p of paired 0/1 columns."""
    a, b = F.col(left) == 1, F.col(right) == 1
    per = pairs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"))
    return per.withColumn("p", F.round(mcnemar(F.col("left_only"), F.col("right_only")), 6))


def binary_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    per = rows.groupBy(*(by or [])).agg(F.count_if(F.col(value) == 1).alias("successes"), F.count(F.lit(1)).alias("total"))
    per = per.withColumn("rate", F.coalesce(F.round(F.col("successes") / F.nullif("total", F.lit(0)), 6), F.lit(0.0))).withColumn("i", wilson(F.col("successes"), F.col("total")))
    return per.withColumn("low", F.round("i.low", 6)).withColumn("high", F.round("i.high", 6)).drop("i")


def bootstrap_mean(rows: DataFrame, value: str, repetitions: int = 1000, seed: int = 1, bucket_values: int = 4096, most_buckets: int = 1024) -> DataFrame:
    """mean, low, high: percentile bootstrap of a mean.

    A repetition draws how often each distinct value is taken, a multinomial draw over the
    values' counts, in two steps: over buckets of values (drawn alike by every task), then
    over the values of a bucket (drawn by the bucket's task). No draw becomes a row; a
    bucket gives one sum a repetition. Null values are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return bootstrap_counted(counts, repetitions, seed, bucket_values, most_buckets)


def bootstrap_counted(counts: DataFrame, repetitions: int = 1000, seed: int = 1, bucket_values: int = 4096, most_buckets: int = 1024) -> DataFrame:
    """The same from distinct values and their counts: v, c."""
    distinct = counts.count()
    buckets = max(1, min(most_buckets, -(-distinct // bucket_values)))
    counts = counts.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int"))
    totals = {r.bucket: (r.n, r.total) for r in counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total")).collect()}
    sizes, n = [totals.get(b, (0, 0.0))[0] for b in range(buckets)], sum(c for c, _ in totals.values())
    mean = sum(t for _, t in totals.values()) / n if n else None

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf, shares = pdf.sort_values("v"), np.array(sizes) / n
        v, p = pdf["v"].to_numpy(), pdf["c"].to_numpy() / pdf["c"].sum()
        taken = [np.random.default_rng([seed, rep]).multinomial(n, shares)[key[0]] for rep in range(repetitions)]
        sums = [float(v @ np.random.default_rng([seed, rep, 1 + key[0]]).multinomial(k, p)) for rep, k in enumerate(taken)]
        return pd.DataFrame({"rep": range(repetitions), "s": sums})

    sums = counts.groupBy("bucket").applyInPandas(draw, "rep int, s double").groupBy("rep").agg((F.sum("s") / F.lit(max(n, 1))).alias("m"))
    return sums.agg(F.lit(mean).cast("double").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def bootstrap_paired(pairs: DataFrame, left: str, right: str, **how) -> DataFrame:
    """mean, low, high of the difference left - right over paired rows."""
    return bootstrap_mean(pairs.select((F.col(left).cast("double") - F.col(right).cast("double")).alias("difference")), "difference", **how)


def bootstrap_reference(values: list[float], repetitions: int, seed: int) -> tuple[float, float]:
    """The interval of a seeded Mersenne Twister, for results that must agree to the bit."""
    import random

    rng, n = random.Random(seed), len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(repetitions))

    def at(p: float) -> float:
        x = (repetitions - 1) * p
        lo = int(x)
        return means[lo] + (means[min(lo + 1, repetitions - 1)] - means[lo]) * (x - lo)

    return at(0.025), at(0.975)
