"""Question explosion, resolution by source family, matching forecasts, imputation.

All due dates resolve in one plan: the due date is part of every key.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from probcast import constants as C
from probcast.operators.filters import flag_nullified, is_dataset, is_market
from probcast.operators.series import conflict_daily, trailing_sums, value_as_of
from probcast.operators.skew import require_no_rows
from probcast.session import materialise

ROW_KEY = ["source", "ids", "direction", "forecast_due_date"]
DIRECTIONS = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
NO_DATE = date(9999, 12, 31)
MARKET_MATCH_DATE = date(1900, 1, 1)


def explode_question_set(question_set: DataFrame, as_of: date,
                         market_once: bool = False) -> DataFrame:
    """One row per question, resolution date and direction.

    Market questions take every date of their set; with ``market_once`` they take one row
    (resolution date null), which is all that resolution needs because it overwrites the date.
    Only dates before ``as_of`` count.
    """
    no_dates = F.array().cast("array<date>")
    all_dates = question_set.select(
        "forecast_due_date", F.explode("resolution_dates").alias("_d")
    ).groupBy("forecast_due_date").agg(F.array_sort(F.collect_set("_d")).alias("_all"))
    past = F.filter(
        F.when(is_market(), F.coalesce("_all", no_dates)).otherwise(
            F.coalesce("resolution_dates", no_dates)),
        lambda d: d < F.lit(as_of))
    if market_once:
        past = F.when(is_market() & (F.size(past) > 0),
                      F.array(F.lit(None).cast("date"))).otherwise(past)
    signs = F.array(*[F.array(*[F.lit(s) for s in pair]) for pair in DIRECTIONS])
    none = F.array(F.array().cast("array<int>"))
    return (
        question_set.join(F.broadcast(all_dates), "forecast_due_date", "left")   # one row per due date
        .withColumn("resolution_date", F.explode(past))
        .withColumn("direction", F.explode(F.when(F.size("ids") > 1, signs).otherwise(none)))
        .select("source", "ids", "direction", "forecast_due_date", "resolution_date")
    )


# --- value lookups -------------------------------------------------------------------------

def value_maps(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per (source, id): map of date to value on the wanted dates, and the last value.

    Only wanted dates (a few per due date) enter the maps, so they stay small whatever the length
    of the series, and one equi-join then serves every lookup of a question.
    """
    marked = series.join(
        F.broadcast(wanted.select("date").distinct().withColumn("_wanted", F.lit(True))), "date", "left")
    return marked.groupBy("source", "id").agg(
        F.map_from_entries(F.collect_list(
            F.when(F.col("_wanted"), F.struct("date", "value")))).alias("values"),
        F.max_by(F.struct("value"), "date").alias("last"),
    )


def _value(day: Column) -> Column:
    return F.try_element_at("values", day)


def signed(value: Column, direction: Column) -> Column:
    """Leg value under a direction: itself for 1, its complement for -1."""
    return F.when(direction == 1, value).when(direction == -1, F.lit(1.0) - value)


def combine_legs(combos: DataFrame, legs: DataFrame, match: list[str],
                 columns: list[str]) -> DataFrame:
    """Adds ``<column>_0`` and ``<column>_1`` of the two legs (null when a leg is absent)."""
    out = combos
    for leg in (0, 1):
        side = legs.select(
            *match, F.col("id").alias(f"leg_{leg}"), F.lit(True).alias(f"has_{leg}"),
            *[F.col(c).alias(f"{c}_{leg}") for c in columns])
        out = out.withColumn(f"leg_{leg}", F.element_at("ids", leg + 1)).join(
            side, [*match, f"leg_{leg}"], "left")
    return out


def _product(column: str) -> Column:
    return signed(F.col(f"{column}_0"), F.element_at("direction", 1)) * signed(
        F.col(f"{column}_1"), F.element_at("direction", 2))


def _null_double(name: str) -> Column:
    return F.lit(None).cast("double").alias(name)


# --- dataset sources -----------------------------------------------------------------------

def resolve_dataset(exploded: DataFrame, series: DataFrame, pairs: bool = True) -> DataFrame:
    """1 when the value on the resolution date exceeds the value on the due date, else 0.

    ``pairs``: whether there may be combinations; their legs read the stored singles.
    """
    singles = exploded.filter(F.size("ids") == 1).withColumn("id", F.element_at("ids", 1))
    combos = exploded.filter(F.size("ids") > 1)
    wanted = exploded.select(F.explode(F.array("forecast_due_date", "resolution_date")).alias(
        "date"))
    now, then = _value(F.col("forecast_due_date")), _value(F.col("resolution_date"))
    resolved = singles.join(value_maps(series, wanted), ["source", "id"], "left").select(
        *exploded.columns, "id",
        F.when(now.isNotNull() & then.isNotNull(), (then > now).cast("double")).alias(
            "resolved_to"),
        now.alias("market_value_on_due_date"),
    )
    more = {
        "resolved": F.col("resolved_to").isNotNull(),
        "market_value_on_due_date_minus_one": F.lit(None).cast("double"),
    }
    if not pairs:
        return resolved.drop("id").withColumns(more)
    resolved = materialise(resolved)
    paired = combine_legs(
        combos, resolved.select("source", "forecast_due_date", "resolution_date", "id",
                                "resolved_to"),
        ["source", "forecast_due_date", "resolution_date"], ["resolved_to"],
    ).select(*exploded.columns, _product("resolved_to").alias("resolved_to"),
             _null_double("market_value_on_due_date"))
    return resolved.drop("id").unionByName(paired).withColumns(more)


# --- market sources ------------------------------------------------------------------------

def market_resolution_date(close: Column, resolution: Column) -> Column:
    """The earlier of close and resolution day; an unreadable one never wins."""
    day = lambda text: F.coalesce(
        F.try_to_timestamp(text).cast("date"), F.lit(NO_DATE))
    return F.least(day(close), day(resolution))


def resolve_market(exploded: DataFrame, questions: DataFrame, series: DataFrame, as_of: date,
                   collapse: bool = True, pairs: bool = True) -> tuple[DataFrame, DataFrame]:
    """Market resolution; returns (rows, warnings).

    Unresolved questions take yesterday's value; resolved ones their last value on the earlier of
    close and resolution day, null when that is not 0 or 1 or is not after the due date.
    ``collapse`` merges rows that differ only in resolution date (not needed with market_once).
    ``pairs``: whether there may be combinations; their legs read the stored singles.
    """
    yesterday = F.lit(as_of - timedelta(days=1))
    rows = exploded.drop("resolution_date")
    if collapse:
        rows = rows.dropDuplicates(ROW_KEY)
    due = F.col("forecast_due_date")
    wanted = exploded.select("forecast_due_date").distinct().select(F.explode(F.array(
        due, F.date_sub(due, 1), yesterday)).alias("date"))
    facts = questions.select(
        "source", "id", "url", F.col("resolved").alias("_done"),
        market_resolution_date(F.col("market_info_close_datetime"),
                               F.col("market_info_resolution_datetime")).alias("_done_on"))
    singles = rows.filter(F.size("ids") == 1).withColumn("id", F.element_at("ids", 1))
    looked_up = (
        singles.join(value_maps(series, wanted), ["source", "id"], "left")
        .join(facts, ["source", "id"], "left")
        .withColumn("_done", F.coalesce("_done", F.lit(False)))
        .withColumn("_raw", F.when(F.col("_done"), F.col("last.value")).otherwise(
            _value(yesterday)))
    )
    off = F.col("_done") & ~F.col("_raw").isin(0.0, 1.0)
    late = F.col("_done") & (F.col("_done_on") <= due)
    resolved = looked_up.select(
        *rows.columns, "id", "url",
        F.when(F.col("_done"), F.col("_done_on")).otherwise(yesterday).alias("resolution_date"),
        F.col("_done").alias("resolved"),
        F.when(~F.coalesce(off, F.lit(True)) & ~late, F.col("_raw")).alias("resolved_to"),
        _value(due).alias("market_value_on_due_date"),
        _value(F.date_sub(due, 1)).alias("market_value_on_due_date_minus_one"),
        F.when(off & F.col("_raw").isNotNull(), F.col("_raw")).alias("_odd_value"),
    )
    if pairs:
        resolved = materialise(resolved)
    warnings = resolved.filter("_odd_value is not null").select(
        "source", "id", "url", F.col("_odd_value").alias("value")).distinct()
    if not pairs:
        return resolved.drop("id", "url", "_odd_value"), warnings
    leg_columns = ["resolved_to", "market_value_on_due_date", "resolved", "resolution_date"]
    legs = resolved.select("source", "forecast_due_date", "id", *leg_columns)
    paired = combine_legs(
        rows.filter(F.size("ids") > 1), legs, ["source", "forecast_due_date"], leg_columns)
    both = F.coalesce(F.col("has_0") & F.col("has_1"), F.lit(False))
    decided = F.when(both, combination_date())
    combos = paired.select(
        *rows.columns,
        F.coalesce(decided, yesterday).alias("resolution_date"),
        decided.isNotNull().alias("resolved"),
        _product("resolved_to").alias("resolved_to"),
        _product("market_value_on_due_date").alias("market_value_on_due_date"),
        _null_double("market_value_on_due_date_minus_one"),
    )
    return resolved.drop("id", "url", "_odd_value").unionByName(combos), warnings


def combination_date() -> Column:
    """Day on which a two-leg market combination is decided; null while it is open.

    A leg ends the pair when it has no value or its outcome contradicts its sign; the first such day
    decides. Without one, the pair is decided on the last day once both outcomes match their signs.
    """
    legs = F.array(*[F.struct(
        F.col(f"resolution_date_{k}").alias("day"), F.col(f"resolved_{k}").alias("done"),
        F.col(f"resolved_to_{k}").alias("value"),
        ((1 + F.element_at("direction", k + 1)) / 2).alias("wanted")) for k in (0, 1)])
    ending = F.filter(legs, lambda leg: leg["value"].isNull()
                      | (leg["done"] & (leg["value"] == 1 - leg["wanted"])))
    fulfilled = F.forall(legs, lambda leg: leg["done"] & F.coalesce(
        leg["value"] == leg["wanted"], F.lit(False)))
    days = lambda rows: F.transform(rows, lambda leg: leg["day"])
    return F.when(F.exists(legs, lambda leg: leg["done"]), F.coalesce(
        F.array_min(days(ending)), F.when(fulfilled, F.array_max(days(legs)))))


# --- leg-wise sources ----------------------------------------------------------------------

def _distinct_legs(exploded: DataFrame) -> DataFrame:
    return exploded.select(
        F.explode("ids").alias("id"), "forecast_due_date", "resolution_date").distinct()


def _assemble(exploded: DataFrame, legs: DataFrame, done: Column) -> DataFrame:
    """Rows from leg values (id, forecast_due_date, resolution_date, resolved_to)."""
    match = ["forecast_due_date", "resolution_date"]
    legs = materialise(legs)   # read by singles and both legs of combinations
    singles = exploded.filter(F.size("ids") == 1).withColumn("id", F.element_at("ids", 1)).join(
        legs, ["id", *match], "left").select(*exploded.columns, "resolved_to")
    combos = combine_legs(
        exploded.filter(F.size("ids") > 1), legs, match, ["resolved_to"],
    ).select(*exploded.columns, _product("resolved_to").alias("resolved_to"))
    return singles.unionByName(combos).withColumns({
        "resolved": done,
        "resolved_to": F.when(done, F.col("resolved_to")),
        "market_value_on_due_date": F.lit(None).cast("double"),
        "market_value_on_due_date_minus_one": F.lit(None).cast("double"),
    })


def resolve_conflict(exploded: DataFrame, questions: DataFrame, attributes: DataFrame,
                     events: DataFrame) -> DataFrame:
    """Sum over the past 30 days against the 360-day monthly average on the due date.

    ``attributes``: (id, key, event_type, country). Only dates up to the last event day resolve;
    an unknown question or id has no value, yet counts as resolved; an absent country counts 0.
    """
    daily = conflict_daily(events)
    last_day = events.agg(F.max("event_date").alias("last")).scalar()
    legs = (
        _distinct_legs(exploded)
        .join(questions.select("id").distinct(), "id", "left_semi")
        .join(attributes.withColumnRenamed("event_type", "metric"), "id")
    )
    requests = legs.select("country", "metric", F.explode(F.array(
        "forecast_due_date", "resolution_date")).alias("date"))
    sums = trailing_sums(daily, requests, [30, 360], ["country", "metric"])
    at_resolution = sums.select("country", "metric", F.col("date").alias("resolution_date"),
                                F.col("sum_30").alias("recent"))
    at_due = sums.select("country", "metric", F.col("date").alias("forecast_due_date"),
                         (F.col("sum_360") / 12).alias("average"))
    valued = legs.join(at_resolution, ["country", "metric", "resolution_date"]).join(
        at_due, ["country", "metric", "forecast_due_date"]).select(
        "id", "forecast_due_date", "resolution_date",
        (F.col("recent") > conflict_base(F.col("key"), F.col("average"))).cast("double").alias(
            "resolved_to"))
    return _assemble(exploded, valued, F.coalesce(
        F.col("resolution_date") <= last_day, F.lit(False)))


def conflict_base(key: Column, average: Column) -> Column:
    """Value that the recent sum must exceed."""
    return F.when(key == C.CONFLICT_KEY_PLAIN, average).when(
        key == C.CONFLICT_KEY_TENFOLD, F.lit(10) * (F.lit(1) + average)
    ).otherwise(F.raise_error(F.concat(F.lit("invalid key: "), key)).cast("double"))


def compare_values(kind: Column, later: Column, base: Column, later_text: Column,
                   base_text: Column) -> Column:
    """Boolean by comparison type; SAME falls back to text when a side is not a number."""
    numeric = later.isNotNull() & base.isNotNull()
    same = F.when(numeric, later == base).otherwise(later_text == base_text)
    return (
        F.when(kind == C.SAME, same)
        .when(kind == C.SAME_OR_MORE, later >= base)
        .when(kind == C.SAME_OR_LESS, later <= base)
        .when(kind == C.MORE, later > base)
        .when(kind == C.ONE_PERCENT_MORE, later >= base * 1.01)
    )


def resolve_pages(exploded: DataFrame, attributes: DataFrame, remaps: DataFrame,
                  series: DataFrame, as_of: date) -> DataFrame:
    """Page questions compare the filled value on the resolution date with the one on the due date.

    ``attributes``: (id, question_type); ``remaps``: (old_id, new_id). No value on the due date
    gives null; no value on the resolution date gives 0. Dates up to yesterday resolve.
    """
    yesterday = as_of - timedelta(days=1)
    renamed = remaps.select(F.col("old_id").alias("id"), "new_id")
    legs = _distinct_legs(exploded).join(renamed, "id", "left").withColumn(
        "target", F.coalesce("new_id", "id"))
    stored = series if "value_str" in series.columns else series.withColumn(
        "value_str", F.col("value").cast("string"))
    requests = legs.select(F.col("target").alias("id"), F.explode(F.array(
        "forecast_due_date", "resolution_date")).alias("date"))
    held = value_as_of(stored, requests, yesterday, ("id",), ("value", "value_str"))
    at_due = held.select(F.col("id").alias("target"), F.col("date").alias("forecast_due_date"),
                         F.col("value").alias("base"), F.col("value_str").alias("base_text"))
    at_resolution = held.select(
        F.col("id").alias("target"), F.col("date").alias("resolution_date"),
        F.col("value").alias("later"), F.col("value_str").alias("later_text"))
    kinds = attributes.select(F.col("id").alias("target"), "question_type")
    outcome = F.coalesce(compare_values(
        F.col("question_type"), F.col("later"), F.col("base"), F.col("later_text"),
        F.col("base_text")), F.lit(False))
    has_base = F.col("base").isNotNull() | F.col("base_text").isNotNull()
    valued = (
        legs.join(at_due, ["target", "forecast_due_date"], "left")
        .join(at_resolution, ["target", "resolution_date"], "left")
        .join(kinds, "target", "left")
        .select("id", "forecast_due_date", "resolution_date",
                F.when(has_base & F.col("question_type").isNotNull(),
                       outcome.cast("double")).alias("resolved_to"))
    )
    return _assemble(exploded, valued, F.coalesce(
        F.col("resolution_date") <= F.lit(yesterday), F.lit(False)))


# --- wrappers ------------------------------------------------------------------------------

def with_nullification(exploded: DataFrame, nullified: DataFrame, resolver) -> DataFrame:
    """Nullified rows bypass ``resolver`` and come back resolved without a value."""
    flagged = materialise(flag_nullified(exploded, nullified))
    return resolver(active_rows(flagged)).unionByName(nullified_rows(flagged))


def active_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("is_nullified")).drop("is_nullified")


def nullified_rows(flagged: DataFrame) -> DataFrame:
    """What flagged rows come to without a resolver: resolved, no value."""
    return flagged.filter("is_nullified").drop("is_nullified").withColumns({
        "resolved": F.lit(True),
        "resolved_to": F.lit(None).cast("double"),
        "market_value_on_due_date": F.lit(None).cast("double"),
        "market_value_on_due_date_minus_one": F.lit(None).cast("double"),
    })


def missing_series(exploded: DataFrame, series: DataFrame) -> DataFrame:
    """(source, id) of questions or legs without any stored value row."""
    legs = exploded.select("source", F.explode("ids").alias("id")).distinct()
    return legs.join(series.select("source", "id").distinct(), ["source", "id"], "left_anti")


def drop_unresolved(resolved: DataFrame) -> DataFrame:
    """Drop dataset rows that have not resolved, then every row without a value."""
    return resolved.filter(~(is_dataset() & ~F.col("resolved"))).filter(
        F.col("resolved_to").isNotNull())


def resolve_all(exploded: DataFrame, questions: DataFrame, series: DataFrame,
                nullified: DataFrame, as_of: date, *, conflict_events: DataFrame,
                conflict_attributes: DataFrame, page_attributes: DataFrame,
                page_remaps: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Resolve every source in one plan; returns (resolved rows, warnings).

    With ``check`` a source without questions or series, or a question without series, raises.
    """
    # Exploded and flagged once; the checks and every family read that table.
    flagged = materialise(flag_nullified(exploded, nullified))
    if check:
        check_question_bank(flagged, questions, series, conflict_events)
    plain_sources = [s for s in C.DATASET_SOURCES if s not in ("acled", "wikipedia")]
    market_warnings: list[DataFrame] = []

    def market(rows: DataFrame) -> DataFrame:
        resolved, warnings = resolve_market(rows, questions, series.filter(is_market()), as_of)
        market_warnings.append(warnings)
        return resolved

    families = [
        (F.col("source").isin(plain_sources), lambda rows: resolve_dataset(
            rows, series.filter(F.col("source").isin(plain_sources)))),
        (F.col("source") == "acled", lambda rows: resolve_conflict(
            rows, questions.filter("source = 'acled'"), conflict_attributes, conflict_events)),
        (F.col("source") == "wikipedia", lambda rows: resolve_pages(
            rows, page_attributes, page_remaps, series.filter("source = 'wikipedia'"), as_of)),
        (is_market(), market),
    ]
    active, merged = active_rows(flagged), nullified_rows(flagged)
    for mask, resolver in families:
        merged = merged.unionByName(resolver(active.filter(mask)))
    return drop_unresolved(merged), market_warnings[0]


def check_question_bank(exploded: DataFrame, questions: DataFrame, series: DataFrame,
                        conflict_events: DataFrame) -> None:
    """Raise on an unknown source, an empty bank of a used source, or a question without series."""
    used = exploded.select("source").distinct()
    require_no_rows(used.filter(~F.col("source").isin(C.ALL_SOURCES)), "unknown source")
    require_no_rows(used.join(questions.select("source").distinct(), "source", "left_anti"),
                    "no questions for source")
    keys = materialise(series.select("source", "id").distinct())   # both checks of the series read it
    stored = keys.select("source").distinct()
    if not conflict_events.isEmpty():
        stored = stored.unionByName(stored.sparkSession.createDataFrame([("acled",)],
                                                                        "source STRING"))
    require_no_rows(used.join(stored, "source", "left_anti"), "no series for source")
    strict = exploded.filter(~F.col("source").isin("acled", "wikipedia"))
    require_no_rows(missing_series(strict, keys), "missing series values")


# --- forecasts against resolutions ---------------------------------------------------------

SUBMISSION = ["organization", "model_organization", "model"]


def submissions_by_due(forecasts: DataFrame, submission: list[str] | None = None) -> DataFrame:
    """(forecast_due_date, _at, submission columns): the submissions of each due date (hundreds at
    most), numbered from 0; a small table."""
    submission = submission or SUBMISSION
    number = F.row_number().over(Window.partitionBy("forecast_due_date").orderBy(*submission)) - 1
    return materialise(forecasts.select("forecast_due_date", *submission).distinct().withColumn("_at", number))


def with_given(resolved: DataFrame, forecasts: DataFrame, submissions: DataFrame,
               submission: list[str] | None = None, least: bool = False) -> DataFrame:
    """Resolved rows of due dates with submissions and their list ``_entries``: number and forecast of every
    submission, null where it has none.

    One row per resolved row: a question meets all its forecasts in one join, so rows of submissions
    without a forecast never travel. Forecasts travel once, by question; ``least`` keeps the lowest one of a
    repeated key.
    """
    submission = submission or SUBMISSION
    match_date = lambda: F.when(
        is_market(), F.lit(MARKET_MATCH_DATE)).otherwise(F.col("resolution_date"))
    keys = [*ROW_KEY, "_match_date"]
    # One exchange for all that follows; plans drop a constant direction from their keys, so it is no part of it.
    numbered = forecasts.withColumn("_match_date", match_date()).join(
        F.broadcast(submissions), ["forecast_due_date", *submission]).select(*keys, "_at", "forecast").repartition(
        *[k for k in keys if k != "direction"])
    if least:
        numbered = numbered.groupBy(*keys, "_at").agg(F.min("forecast").alias("forecast"))
    given = numbered.groupBy(*keys).agg(F.collect_list(F.struct("_at", "forecast")).alias("_given"))
    counts = submissions.groupBy("forecast_due_date").agg(F.count("*").cast("int").alias("_n"))
    # Filled up here, where rows are stored, and not where they are read; these functions are compiled.
    kind = given.schema["_given"].dataType.simpleString()
    have = F.coalesce("_given", F.array().cast(kind))
    lacking = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), have["_at"])
    entries = F.concat(have, F.arrays_zip(lacking, F.array_repeat(F.lit(None).cast("double"), F.size(lacking))).cast(kind))
    return resolved.join(F.broadcast(counts), "forecast_due_date").withColumn(
        "_match_date", match_date()).join(given, keys, "left").select(*resolved.columns, entries.alias("_entries"))


def spread_submissions(matched: DataFrame, submissions: DataFrame,
                       submission: list[str] | None = None) -> DataFrame:
    """A row per submission of the rows of ``with_given``, forecast null when missing; no shuffle."""
    submission = submission or SUBMISSION
    columns = [c for c in matched.columns if c != "_entries"]
    return matched.select(*columns, F.inline("_entries")).join(
        F.broadcast(submissions), ["forecast_due_date", "_at"]).select(*columns, *submission, "forecast")


def match_forecasts(resolved: DataFrame, forecasts: DataFrame,
                    submission: list[str] | None = None) -> DataFrame:
    """Every resolved row for every submission of its due date, forecast null when missing."""
    submissions = submissions_by_due(forecasts, submission)
    return spread_submissions(with_given(resolved, forecasts, submissions, submission), submissions, submission)


def impute(matched: DataFrame, benchmark_org: str) -> DataFrame:
    """Missing forecasts become 0.5, or a market value for two of the benchmark's own models."""
    missing = F.col("forecast").isNull() | F.isnan("forecast")
    own = (F.col("organization") == benchmark_org) & (
        F.col("model_organization") == benchmark_org) & is_market()
    filled = (
        F.when(own & (F.col("model") == C.IMPUTED_FORECASTER), F.col("market_value_on_due_date"))
        .when(own & (F.col("model") == C.NAIVE_FORECASTER),
              F.col("market_value_on_due_date_minus_one"))
        .otherwise(0.5)
    )
    return matched.withColumns({
        "imputed": missing, "forecast": F.when(missing, filled).otherwise(F.col("forecast"))})


def restrict_to_human_set(resolved: DataFrame, human_set: DataFrame) -> DataFrame:
    """Resolutions of the questions that are also in the human question set."""
    keys = ["forecast_due_date", "source", "ids"]
    return resolved.join(human_set.select(*keys).distinct(), keys, "left_semi")


def first_seen_resolution(rows: DataFrame) -> DataFrame:
    """Per market question the first resolved row, or the last row when none is resolved."""
    others = [c for c in rows.columns if c not in ("source", "ids")]
    return (
        rows.groupBy("source", "ids")
        .agg(F.min_by(F.struct(*others), F.when(F.col("resolved"), F.col("forecast_due_date")))
             .alias("_first"),
             F.max_by(F.struct(*others), F.col("forecast_due_date")).alias("_last"))
        .withColumn("_row", F.coalesce("_first", "_last"))
        .select("source", "ids", *[F.col(f"_row.{c}").alias(c) for c in others])
    )
