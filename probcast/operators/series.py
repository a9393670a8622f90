"""Daily value series: closing, filling, splicing, trailing windows.

Every window here is partitioned by one series after it has been reduced to one row per day, so a
window partition is bounded by the length of the calendar, however many raw rows a series has.
Filled calendars are made by stretching each row over the days up to the next one; no calendar
join is needed.
"""

from __future__ import annotations

from datetime import date
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from probcast.operators.skew import skew_join

KEY = ("id",)
DAY_LAST_MICRO = "23:59:59.999999"


# --- one row per day -----------------------------------------------------------------------

def daily_last(trades: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", seq: str = "seq",
               value: str = "value", until: date | None = None) -> DataFrame:
    """Last value of each day by (time, sequence). Partial aggregation, no sort of the trades."""
    if until is not None:
        trades = trades.filter(F.col(ts).cast("date") <= F.lit(until))
    return (
        trades.groupBy(*key, F.col(ts).cast("date").alias("date"))
        .agg(F.max_by(F.struct(value), F.struct(ts, seq)).alias("_last"))
        .select(*key, "date", F.col(f"_last.{value}").alias("value"))
    )


def daily_first_shifted(trades: DataFrame, key: Sequence[str] = KEY, ts: str = "ts",
                        seq: str = "seq", value: str = "value") -> DataFrame:
    """First value of each day, dated one day earlier (midnight price closes the day before)."""
    return (
        trades.groupBy(*key, F.col(ts).cast("date").alias("_day"))
        .agg(F.min_by(F.struct(value), F.struct(ts, seq)).alias("_first"))
        .select(*key, F.date_sub("_day", 1).alias("date"), F.col(f"_first.{value}").alias("value"))
    )


def last_revision(df: DataFrame, key: Sequence[str], day: Column, order: Sequence[str],
                  day_name: str = "date") -> DataFrame:
    """Keep the newest row of each (key, day); all other columns come along."""
    kept = [c for c in df.columns if c not in (*key, day_name)]
    return (
        df.groupBy(*key, day.alias(day_name))
        .agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_row"))
        .select(*key, day_name, *[F.col(f"_row.{c}").alias(c) for c in kept])
    )


# --- filling -------------------------------------------------------------------------------

def _stretch(df: DataFrame, key: Sequence[str], until: Column | None) -> DataFrame:
    """Repeat each row on the days up to the next row (or ``until`` for the last one)."""
    following = F.lead("date").over(Window.partitionBy(*key).orderBy("date"))
    end = F.coalesce(F.date_sub(following, 1), until if until is not None else F.col("date"))
    return df.withColumn("_end", F.greatest(F.col("date"), end)).withColumn(
        "date", F.explode(F.sequence("date", "_end"))
    ).drop("_end")


def _as_date(until: date | Column | None) -> Column | None:
    return F.lit(until) if isinstance(until, date) else until


def fill_rows(series: DataFrame, until: date | Column | None = None,
              key: Sequence[str] = KEY) -> DataFrame:
    """Row-level forward fill: an explicit null row carries forward as null."""
    return _stretch(series.select(*key, "date", "value"), key, _as_date(until))


def fill_values(series: DataFrame, until: date | Column | None = None,
                key: Sequence[str] = KEY) -> DataFrame:
    """Value-level forward fill: an explicit null takes the value before it."""
    running = Window.partitionBy(*key).orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    carried = series.select(
        *key, "date", F.last("value", ignorenulls=True).over(running).alias("value"))
    return _stretch(carried, key, _as_date(until))


def fill_values_keep_last(series: DataFrame, resolved: Column, until: date | Column | None = None,
                          key: Sequence[str] = KEY) -> DataFrame:
    """Value-level fill that leaves the final row of a resolved series as it is."""
    by_day = Window.partitionBy(*key).orderBy("date")
    running = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_last = F.lead("date").over(by_day).isNull()
    carried = series.select(
        *key, "date",
        F.when(is_last & resolved, F.col("value"))
        .otherwise(F.last("value", ignorenulls=True).over(running)).alias("value"),
        F.when(is_last & resolved, F.col("date")).alias("_stop"),
    )
    limit = _as_date(until)
    stop = F.coalesce(F.col("_stop"), limit) if limit is not None else F.col("_stop")
    return _stretch(carried, key, stop).drop("_stop")


def fill_backward(series: DataFrame, start: Column | None = None,
                  key: Sequence[str] = KEY) -> DataFrame:
    """Value-level backward fill over the days between rows; ``start`` extends the first row."""
    by_day = Window.partitionBy(*key).orderBy("date")
    ahead = by_day.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    columns = [*key, "date", F.first("value", ignorenulls=True).over(ahead).alias("value")]
    begin = F.coalesce(
        F.date_add(F.lag("date").over(by_day), 1), start if start is not None else F.col("date"))
    return (
        series.select(*columns, F.least(begin, F.col("date")).alias("_begin"))
        .withColumn("date", F.explode(F.sequence("_begin", "date")))
        .select(*key, "date", "value")
    )


def zero_fill(events: DataFrame, start: date | Column, until: date | Column,
              key: Sequence[str] = KEY, value: str = "value") -> DataFrame:
    """Daily calendar from ``start`` to ``until`` for each key; days without a row count 0."""
    begin, end = _as_date(start), _as_date(until)
    daily = events.filter(F.col("date").between(begin, end)).groupBy(*key, "date").agg(
        F.sum(value).alias("value"))
    calendar = daily.select(*key).distinct().withColumn(
        "date", F.explode(F.sequence(begin, end)))
    zeros = calendar.withColumn("value", F.lit(0).cast(daily.schema["value"].dataType))
    return zeros.unionByName(daily).groupBy(*key, "date").agg(F.sum("value").alias("value"))


# --- splicing ------------------------------------------------------------------------------

def splice_resolution(series: DataFrame, resolutions: DataFrame,
                      key: Sequence[str] = KEY) -> DataFrame:
    """Drop days at or after the resolution day and append the final value on that day.

    ``resolutions``: one row per resolved series (key, resolved_on DATE, final_value, nullable).
    """
    kept = (
        series.join(resolutions.select(*key, "resolved_on"), list(key), "left")
        .filter(F.col("resolved_on").isNull() | (F.col("date") < F.col("resolved_on")))
        .select(*key, "date", "value")
    )
    final = resolutions.select(
        *key, F.col("resolved_on").alias("date"), F.col("final_value").alias("value"))
    return kept.unionByName(final)


def splice_and_refill(series: DataFrame, resolutions: DataFrame,
                      key: Sequence[str] = KEY) -> DataFrame:
    """Cut after the resolution day, put the final value on it, fill the days in between."""
    return fill_rows(splice_resolution(series, resolutions, key), None, key)


def final_value(outcome: Column, probability: Column) -> Column:
    """Number for a stated outcome; anything but yes, no or market-priced is null."""
    name = F.upper(outcome)
    return F.when(name == "YES", 1.0).when(name == "NO", 0.0).when(name == "MKT", probability)


def clamp_start(series: DataFrame, start: date) -> DataFrame:
    return series.filter(F.col("date") >= F.lit(start))


def close_intervals(history: DataFrame, as_of: date, key: Sequence[str] = KEY) -> DataFrame:
    """Daily values from a history of (start_ts, end_ts, value) intervals.

    An open interval ends at ``as_of``. Intervals within one day are dropped unless they end in
    the day's last microsecond; an interval is dated on the day before its end, or on the end day
    when that is the day's last microsecond; the last interval of a day wins; values fill
    backward from the first start; days from ``as_of`` on are removed.
    """
    end = F.coalesce(F.col("end_ts"), F.lit(as_of).cast(history.schema["end_ts"].dataType))
    at_day_end = F.date_format("_end", "HH:mm:ss.SSSSSS") == DAY_LAST_MICRO
    end_day = F.col("_end").cast("date")
    kept = (
        history.withColumn("_end", end)
        .filter((F.col("start_ts").cast("date") != end_day) | at_day_end)
        .withColumn("date", F.when(at_day_end, end_day).otherwise(F.date_sub(end_day, 1)))
    )
    daily = kept.groupBy(*key, "date").agg(
        F.max_by(F.struct("value"), F.struct("_end", "start_ts")).alias("_last"),
        F.min("start_ts").alias("_start"),
    )
    first = F.min(F.col("_start").cast("date")).over(Window.partitionBy(*key))
    with_start = daily.select(
        *key, "date", F.col("_last.value").alias("value"), first.alias("_first"))
    return fill_backward(with_start, F.col("_first"), key).filter(
        F.col("date") < F.lit(as_of))


def page_positions(pages: DataFrame, page: str = "page") -> tuple[DataFrame, DataFrame]:
    """Numbered page dates (page, position, date), and per calendar day how many are not later
    (page, date, position). Windows hold the dates of one page, which its calendar bounds."""
    order = Window.partitionBy(page).orderBy("date")
    numbered = pages.select(page, "date").distinct().select(
        page, F.row_number().over(order).alias("position"), "date",
        F.coalesce(F.date_sub(F.lead("date").over(order), 1), F.col("date")).alias("_until"))
    daily = numbered.select(page, "position", F.explode(F.sequence("date", "_until")).alias("date"))
    return numbered.drop("_until"), daily


def mark_dropouts(items: DataFrame, pages: DataFrame, page: str = "page",
                  item: str = "item", storage_start: date | None = None) -> DataFrame:
    """Add explicit null rows on page dates where an item is absent.

    An item is marked on the page dates between its first date and the page date after its last
    one. ``items``: (page, item, date, value); ``pages``: distinct (page, date). Dates become
    positions among the page's dates, so the gaps of an item are ranges of positions: no row carries
    a calendar, and all joins are on equality of (page, day) or (page, position), which spread a page
    that holds most items.
    """
    if storage_start is not None:
        pages = pages.filter(F.col("date") >= F.lit(storage_start))
    numbered, daily = page_positions(pages, page)
    ends = numbered.groupBy(page).agg(F.min("date").alias("_begin"), F.max("position").alias("_end"))
    placed = skew_join(items.select(page, item, "date").distinct().join(daily, [page, "date"], "left"),
                       ends, [page], [item, "date"]).withColumn("position", F.coalesce(
        "position", F.when(F.col("date") < F.col("_begin"), 0).otherwise(F.col("_end"))))
    after = F.lead("position").over(Window.partitionBy(page, item).orderBy("date"))
    gaps = placed.select(page, item, "position", "_end", after.alias("_after")).withColumn(
        "_stop", F.coalesce(F.col("_after") - 1, F.least(F.col("position") + 1, F.col("_end"))))
    missing = gaps.filter("_stop > position").select(
        page, item, F.explode(F.sequence(F.col("position") + 1, F.col("_stop"))).alias("position")).join(
        numbered, [page, "position"])
    own = items.select(page, item, "date")
    nulls = missing.select(page, item, "date").join(own, [page, item, "date"], "left_anti").withColumn(
        "value", F.lit(None).cast(items.schema["value"].dataType))
    return items.select(page, item, "date", "value").unionByName(nulls)


# --- checks --------------------------------------------------------------------------------

def contiguous(series: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per key: whether consecutive dates always differ by exactly one day.

    With distinct dates this is a span test, so a plain aggregate is enough.
    """
    return series.groupBy(*key).agg(
        (F.datediff(F.max("date"), F.min("date")) + F.lit(1) == F.count("date")).alias(
            "is_contiguous"))


def up_to_date(series: DataFrame, cutoff: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Per key: last stored date and whether it reaches the cutoff (then fetching is skipped)."""
    last = series.groupBy(*key).agg(F.max("date").alias("last_date"))
    return last.withColumn("is_up_to_date", F.col("last_date") >= cutoff)


def changed_series(new: DataFrame, stored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of the series in ``new`` that differ from what is stored, in any day or value.

    Both sides are reduced to an order-free digest per key before they are compared.
    """
    digest = lambda df: df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("date", "value").cast("decimal(38,0)")).alias("digest"))
    old = digest(stored).withColumnsRenamed({"n": "old_n", "digest": "old_digest"})
    changed = digest(new).join(old, list(key), "left").filter(
        ~(F.col("n").eqNullSafe(F.col("old_n")) & F.col("digest").eqNullSafe(F.col("old_digest"))))
    return new.join(changed.select(*key), list(key), "left_semi")


# --- lookups and windows -------------------------------------------------------------------

def value_as_of(series: DataFrame, requests: DataFrame, until: date | None = None,
                key: Sequence[str] = KEY, payload: Sequence[str] = ("value",)) -> DataFrame:
    """Row-level filled value at each requested (key, date), without filling the calendar.

    Requests are reduced to distinct (key, date) and merged into the series; one window carries
    the last row forward. The row, not its value, marks presence, so explicit nulls carry too.
    """
    asked = requests.select(*key, "date").distinct()
    if until is not None:
        asked = asked.filter(F.col("date") <= F.lit(until))
    held_rows = series.select(*key, "date", F.struct(*payload).alias("_row"),
                              F.lit(False).alias("_asked"))
    merged = held_rows.unionByName(asked.select(
        *key, "date", F.lit(None).cast(held_rows.schema["_row"].dataType).alias("_row"),
        F.lit(True).alias("_asked")))
    running = Window.partitionBy(*key).orderBy("date", "_asked").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        merged.withColumn("_held", F.last("_row", ignorenulls=True).over(running))
        .filter("_asked")
        .select(*key, "date", *[F.col(f"_held.{name}").alias(name) for name in payload],
                F.col("_held").isNotNull().alias("found"))
    )


def trailing_sums(daily: DataFrame, requests: DataFrame, days: Sequence[int],
                  key: Sequence[str], value: str = "n") -> DataFrame:
    """Sum over the half-open window [date - k, date) for each requested (key, date), each k.

    The requests join the daily rows with value 0, then one range window per k does the work: no
    range join, one shuffle. Columns ``sum_<k>``; a request whose key has no rows sums to 0.
    """
    asked = requests.select(*key, "date").distinct().select(
        *key, "date", F.lit(0).cast(daily.schema[value].dataType).alias(value),
        F.lit(True).alias("_asked"))
    merged = daily.select(*key, "date", value, F.lit(False).alias("_asked")).unionByName(asked)
    ordered = Window.partitionBy(*key).orderBy(F.unix_date("date"))
    sums = [F.coalesce(F.sum(value).over(ordered.rangeBetween(-k, -1)), F.lit(0)).alias(f"sum_{k}")
            for k in days]
    return merged.select(*key, "date", "_asked", *sums).filter("_asked").drop("_asked")


def conflict_daily(events: DataFrame) -> DataFrame:
    """Long daily counts (country, date, metric, n): one metric per event type, plus fatalities."""
    metrics = F.array(
        F.struct(F.col("event_type").alias("metric"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("fatalities").alias("metric"),
                 F.col("fatalities").cast("bigint").alias("n")),
    )
    return (
        events.select("country", F.col("event_date").alias("date"),
                      F.explode(metrics).alias("_m"))
        .groupBy("country", "date", F.col("_m.metric").alias("metric"))
        .agg(F.sum("_m.n").alias("n"))
    )


def conflict_wide(events: DataFrame, event_types: Sequence[str]) -> DataFrame:
    """Wide form: one column per event type and the fatalities, per (country, date)."""
    counts = [
        F.count_if(F.col("event_type") == kind).alias(kind) for kind in event_types
    ]
    return events.groupBy("country", F.col("event_date").alias("date")).agg(
        *counts, F.sum("fatalities").alias("fatalities"))
