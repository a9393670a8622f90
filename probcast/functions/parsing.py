"""Reading probabilities out of free response text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: token shapes ------------------------------------------------------------
PROBABILITY_TOKEN = r"^\*?([0-9]*\.?[0-9]+)\*?$"
STARRED_TOKEN = r"\*([0-9]*\.?[0-9]+)\*"
EDGE_SPACE = r"^\s+|\s+$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def _in_unit_interval(number: Column) -> Column:
    return F.when((number >= 0) & (number <= 1), number)


def probability(text: Column) -> Column:
    """The response when it is one probability token, else null."""
    token = F.regexp_extract(_strip(text), PROBABILITY_TOKEN, 1)
    return _in_unit_interval(token.try_cast("double"))


def probabilities(text: Column) -> Column:
    """Array of probabilities when every token is one; an empty array otherwise."""
    tokens = F.filter(
        F.split(F.regexp_replace(_strip(text), ",", " "), r"\s+"), lambda t: t != ""
    )
    numbers = F.transform(tokens, probability)
    valid = text.isNotNull() & F.forall(numbers, lambda n: n.isNotNull())
    return F.when(valid, numbers).otherwise(F.array().cast("array<double>"))


def literal_list(text: Column) -> Column:
    """Array from a bracketed list of plain numbers in 0..1; null for anything else."""
    number = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    shape = rf"^\[\s*({number}\s*(,\s*{number}\s*)*,?)?\s*\]$"
    body = F.regexp_replace(_strip(text), r"[\[\]\s]", "")
    items = F.transform(
        F.filter(F.split(body, ","), lambda t: t != ""), lambda t: t.try_cast("double")
    )
    valid = _strip(text).rlike(shape) & F.forall(items, lambda n: (n >= 0) & (n <= 1))
    return F.when(valid, items)


def last_starred(text: Column) -> Column:
    """The last ``*p*`` in the text that is a valid probability."""
    found = F.regexp_extract_all(text, F.lit(STARRED_TOKEN), F.lit(1))
    numbers = F.filter(
        F.transform(found, lambda t: t.try_cast("double")), lambda n: (n >= 0) & (n <= 1)
    )
    return F.try_element_at(numbers, F.lit(-1))


def market_forecasts(responses: DataFrame, response: str = "response",
                     extracted: str | None = None) -> DataFrame:
    """One probability per market question; rows that give none are dropped.

    ``extracted`` optionally names a column with a bracketed list from a second reading.
    """
    value = probability(F.col(response))
    if extracted:
        again = literal_list(F.col(extracted))
        value = F.coalesce(value, F.when(F.size(again) == 1, F.try_element_at(again, F.lit(1))))
    blank = F.coalesce(_strip(F.col(response)), F.lit("")) == ""
    return responses.filter(~blank).withColumn("forecast", value).filter("forecast is not null")


def dataset_forecasts(responses: DataFrame, response: str = "response",
                      dates: str = "resolution_dates", extracted: str | None = None) -> DataFrame:
    """One row per resolution date; a question whose count of numbers differs is dropped."""
    wanted = F.size(dates)
    value = probabilities(F.col(response))
    chosen = F.when(F.size(value) == wanted, value)
    if extracted:
        again = literal_list(F.col(extracted))
        chosen = F.coalesce(chosen, F.when(F.size(again) == wanted, again))
    blank = F.coalesce(_strip(F.col(response)), F.lit("")) == ""
    return (
        responses.filter(~blank)
        .withColumn("_forecasts", chosen)
        .filter("_forecasts is not null")
        .withColumn("_pair", F.explode(F.arrays_zip(
            F.col(dates).alias("resolution_date"), F.col("_forecasts").alias("forecast"))))
        .select(
            *[c for c in responses.columns if c != dates],
            F.col("_pair.resolution_date").alias("resolution_date"),
            F.col("_pair.forecast").alias("forecast"),
        )
    )
