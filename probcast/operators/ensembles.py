"""Combining the probabilities of several forecasters, and scoring such combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def ensemble(forecasts: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Median, geometric mean, log-odds mean, mean and trimmed mean per question.

    Missing and zero forecasts are left out; with none left the two geometric means are 0. Sums of
    logarithms aggregate map-side; a probability of 1 gives the limit 1. The trimmed mean drops
    one lowest and one highest value and needs at least three.
    """
    p = F.when(F.col("forecast") != 0, F.col("forecast"))
    n = F.count(p)
    certain = F.count_if(p == 1) > 0
    odds = F.avg(F.when(p < 1, F.ln(p / (F.lit(1.0) - p))))
    geometric = F.exp(F.avg(F.ln(p)))
    log_odds = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    trimmed = F.try_divide(F.sum(p) - F.min(p) - F.max(p), n - 2)
    return forecasts.groupBy(*key).agg(
        n.alias("n"),
        F.median(p).alias("median"),
        F.when(n > 0, geometric).otherwise(0.0).alias("geometric_mean"),
        F.when(n == 0, 0.0).when(certain, 1.0).otherwise(log_odds).alias("log_odds_mean"),
        F.avg(p).alias("mean"),
        F.when(n > 2, trimmed).alias("trimmed_mean"),
    )


def brier_summary(forecasts: DataFrame, key: Sequence[str] = ("model",)) -> DataFrame:
    """Mean Brier with two population standard errors, and the number of refusals (scored as 0.5)."""
    given = F.coalesce("forecast", F.lit(0.5))
    score = F.pow(given - F.col("resolved_to"), F.lit(2))
    error = F.stddev_pop(score) / F.sqrt(F.count(score))
    return forecasts.groupBy(*key).agg(
        F.avg(score).alias("mean_brier"), (F.avg(score) - 2 * error).alias("lower"),
        (F.avg(score) + 2 * error).alias("upper"),
        F.count_if(F.col("forecast").isNull()).alias("refusals"), F.count(score).alias("n"))


def success_counts(forecasts: DataFrame, questions: DataFrame) -> DataFrame:
    """Forecasts got and expected per variant; dataset questions expect one per date."""
    expected = questions.select(F.coalesce(F.when(
        F.size("resolution_dates") > 0, F.size("resolution_dates")), F.lit(1)).alias("_e")).agg(
        F.sum("_e").alias("e")).scalar()
    return forecasts.groupBy("variant").agg(
        F.count("forecast").alias("got")).withColumn("expected", expected.cast("bigint"))
