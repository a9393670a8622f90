"""Projections, masks and row filters."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from probcast import constants as C
from probcast.functions.dates import mixed_date
from probcast.operators.skew import keep_first_n, require_no_rows

FORECAST_KEY = ["organization", "model_organization", "model", "forecast_due_date",
                "source", "ids", "direction", "resolution_date"]


# --- masks ---------------------------------------------------------------------------------

def is_combination(ids: Column = F.col) -> Column:
    column = F.col("ids") if ids is F.col else ids
    return F.size(column) > 1


def split_combinations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(single questions, combinations)."""
    return df.filter(F.size("ids") == 1), df.filter(F.size("ids") > 1)


def is_dataset(source: str = "source") -> Column:
    return F.col(source).isin(C.DATASET_SOURCES)


def is_market(source: str = "source") -> Column:
    return F.col(source).isin(C.MARKET_SOURCES)


def with_masks(df: DataFrame) -> DataFrame:
    """Adds the four selection flags used by scoring."""
    return df.withColumns({
        "in_dataset": is_dataset() & F.col("resolved"),
        "in_market": is_market(),
        "in_market_resolved": is_market() & F.col("resolved"),
        "in_market_unresolved": is_market() & ~F.col("resolved"),
    })


def split_on_source(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the source, all other rows)."""
    return df.filter(F.col("source") == source), df.filter(F.col("source") != source)


def split_questions(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dataset, market); a row of an unknown source fails the job when it is reached."""
    known = F.col("source").isin(C.ALL_SOURCES)
    checked = questions.withColumn("source", F.when(known, F.col("source")).otherwise(
        F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null"))))
        .cast("string")))
    return checked.filter(is_dataset()), checked.filter(is_market())


# --- forecasts -----------------------------------------------------------------------------

def valid_forecasts(raw: DataFrame) -> DataFrame:
    """Rows of submitted forecasts that can be scored.

    ``raw``: submission columns, source, ids, direction, forecast, resolution_date (text or date),
    forecast_due_date. Source is lower-cased; unknown sources, null or out-of-range forecasts and
    dataset rows whose date is not due date plus a horizon are dropped; market dates become null.
    """
    due, day = F.col("forecast_due_date"), F.col("resolution_date")
    if raw.schema["resolution_date"].dataType.typeName() != "date":
        day = F.try_to_date(F.substring("resolution_date", 1, 10))
    horizon = F.datediff(day, due)
    return (
        raw.drop("reasoning")
        .withColumn("source", F.lower("source"))
        .filter(F.col("source").isin(C.ALL_SOURCES))
        .filter(F.col("forecast").between(0, 1) & ~F.isnan("forecast"))
        .filter(is_market() | horizon.isin(C.HORIZONS_DAYS))
        .withColumn("resolution_date", F.when(is_dataset(), day))
        .withColumn("direction", F.coalesce("direction", F.array().cast("array<int>")))
    )


def duplicate_forecasts(valid: DataFrame) -> DataFrame:
    """Dataset keys that occur more than once in a submission (market repeats are allowed)."""
    return valid.filter(is_dataset()).groupBy(*FORECAST_KEY).count().filter("count > 1")


def prepare_forecasts(raw: DataFrame) -> DataFrame:
    """Valid forecasts; a submission that repeats a dataset key is an error."""
    valid = valid_forecasts(raw)
    require_no_rows(duplicate_forecasts(valid), "duplicate dataset forecast")
    return valid


def only_eligible(submissions: DataFrame) -> DataFrame:
    """Submissions count for the board unless they opt out."""
    return submissions.filter(F.coalesce("leaderboard_eligible", F.lit(True)))


# --- nullification -------------------------------------------------------------------------

def active_nullifications(nullified: DataFrame, as_of: date | Column | None) -> DataFrame:
    """Nullified (source, id) as of a date; all of them when no date is given."""
    if as_of is None:
        return nullified.select("source", "id").distinct()
    limit = F.lit(as_of) if isinstance(as_of, date) else as_of
    return nullified.filter(F.col("start_date") <= limit).select("source", "id").distinct()


def flag_nullified(df: DataFrame, nullified: DataFrame) -> DataFrame:
    """Adds ``is_nullified``: any leg is nullified as of the row's due date.

    The nullified list has one row per (source, id); each leg is a left equi-join, which AQE turns
    into a broadcast when the list is small.
    """
    starts = nullified.groupBy("source", "id").agg(F.min("start_date").alias("start_date"))
    out = df
    for leg in (0, 1):
        side = starts.select("source", F.col("id").alias(f"_leg{leg}"),
                             F.col("start_date").alias(f"_start{leg}"))
        out = out.withColumn(f"_leg{leg}", F.try_element_at("ids", F.lit(leg + 1))).join(
            side, ["source", f"_leg{leg}"], "left")
    hit = lambda leg: F.coalesce(
        F.col(f"_start{leg}") <= F.col("forecast_due_date"), F.lit(False))
    return out.withColumn("is_nullified", hit(0) | hit(1)).select(*df.columns, "is_nullified")


# --- question selection --------------------------------------------------------------------

def drop_invalid(questions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Keep questions marked valid; with no metadata at all, keep everything."""
    if metadata.isEmpty():
        return questions
    marks = metadata.select("source", "id", "category", "valid_question")
    return questions.drop("category").join(marks, ["source", "id"]).filter(
        "valid_question").drop("valid_question")


def drop_missing_freeze_value(questions: DataFrame) -> DataFrame:
    value = F.col("freeze_datetime_value")
    return questions.filter(value.isNotNull() & ~value.isin("N/A", "nan"))


def drop_resolving_too_soon(questions: DataFrame, freeze: date) -> DataFrame:
    """Dataset questions need a horizon; market questions must close after the due date ends."""
    due = freeze + timedelta(days=C.FREEZE_WINDOW_DAYS)
    due_end = F.to_timestamp(F.lit(f"{due.isoformat()} 23:59:59.999999"))
    close = F.try_to_timestamp("market_info_close_datetime")
    has_horizon = F.coalesce(F.size("forecast_horizons") > 0, F.lit(False))
    return questions.filter(
        F.when(is_dataset(), has_horizon).otherwise(F.coalesce(close > due_end, F.lit(False))))


def eligible_questions(questions: DataFrame, metadata: DataFrame, freeze: date,
                       criteria: dict[str, str] | None = None) -> DataFrame:
    """Questions that may enter a question set, with the resolution criteria text filled in."""
    kept = drop_missing_freeze_value(drop_invalid(questions, metadata))
    if "category" in kept.columns:
        kept = kept.filter(F.col("category") != "Other")
    kept = drop_resolving_too_soon(kept.filter(~F.col("resolved")), freeze)
    if criteria:
        template = F.lit(None).cast("string")
        for source, text in criteria.items():
            template = F.when(F.col("source") == source, F.lit(text)).otherwise(template)
        kept = kept.withColumn(
            "resolution_criteria", F.replace(template, F.lit("{url}"), F.col("url")))
    return kept


def limit_per_type(questions: DataFrame, n: int) -> DataFrame:
    """At most ``n`` dataset and ``n`` market questions (a test run), by id order."""
    kind = questions.withColumn("_kind", F.when(is_market(), "market").otherwise("dataset"))
    return keep_first_n(kind, ["_kind"], [F.col("source"), F.col("id")], F.lit(n)).drop(
        "_kind", "_rank")


# --- submissions and due dates -------------------------------------------------------------

def old_enough(df: DataFrame, as_of: date, min_days: int) -> DataFrame:
    """Due dates at least ``min_days`` before ``as_of``; zero turns the filter off."""
    if min_days == 0:
        return df
    return df.filter(F.col("forecast_due_date") <= F.lit(as_of - timedelta(days=min_days)))


def due_dates_with_enough(naive_rows: DataFrame, min_market: int, min_dataset: int) -> DataFrame:
    """Due dates on which the naive forecaster has enough resolved questions."""
    counts = with_masks(naive_rows).groupBy("forecast_due_date").agg(
        F.count_if("in_market_resolved").alias("n_market_resolved"),
        F.count_if("in_dataset").alias("n_dataset"))
    return counts.filter(
        (F.lit(min_market == 0) | (F.col("n_market_resolved") >= min_market))
        & (F.lit(min_dataset == 0) | (F.col("n_dataset") >= min_dataset)))


def imputed_shares(forecasts: DataFrame, submission: list[str]) -> DataFrame:
    """Percent imputed per submission: all rows, market rows, resolved dataset rows."""
    imputed = F.col("imputed").cast("double") * 100
    return with_masks(forecasts).groupBy(*submission).agg(
        F.avg(imputed).alias("pct_all"),
        F.avg(F.when(F.col("in_market"), imputed)).alias("pct_market"),
        F.avg(F.when(F.col("in_dataset"), imputed)).alias("pct_dataset"))


def drop_over_imputed(forecasts: DataFrame, submission: list[str], benchmark_org: str,
                      cutoff_pct: float = C.IMPUTED_CUTOFF_PCT) -> DataFrame:
    """Drop whole submissions with too many imputed rows; the benchmark's own are exempt."""
    shares = imputed_shares(forecasts, submission)
    own = (F.col("organization") == benchmark_org) & (
        F.col("model_organization") == benchmark_org)
    over = F.lit(False)
    for name in ("pct_all", "pct_market", "pct_dataset"):
        over = over | F.coalesce(F.col(name) > cutoff_pct, F.lit(False))
    kept = shares.filter(own | ~over).select(*submission)
    return forecasts.join(F.broadcast(kept), submission, "left_semi")   # one row per submission


def baseline_board_rows(df: DataFrame) -> DataFrame:
    return df.filter("baseline_model")


def tournament_board_rows(df: DataFrame) -> DataFrame:
    return df.filter("tournament_model")


# --- screens on raw listings ---------------------------------------------------------------

def screen_manifold(listing: DataFrame, as_of: date) -> DataFrame:
    """Enough bettors and liquidity, closing within two years; one row per id over all topics."""
    latest = F.unix_millis(F.lit(as_of + timedelta(days=731)).cast("timestamp"))
    return listing.filter(
        (F.col("uniqueBettorCount") >= 17) & (F.col("totalLiquidity") >= 120)
        & (F.col("closeTime") < latest)
    ).dropDuplicates(["id"])


def screen_metaculus(listing: DataFrame, as_of: date) -> DataFrame:
    reveal = F.try_to_timestamp("cp_reveal_time").cast("date")
    return listing.filter((F.col("nr_forecasters") > 5) & (reveal < F.lit(as_of)))


def screen_polymarket(listing: DataFrame) -> DataFrame:
    outcomes = F.sort_array(F.from_json(F.lower("outcomes"), "array<string>"))
    binary = outcomes == F.array(F.lit("no"), F.lit("yes"))
    return listing.filter(
        binary & (F.col("liquidityNum") > 25000) & ~F.col("slug").contains("other"))


def screen_infer(listing: DataFrame) -> DataFrame:
    predictions = F.get("answers", F.lit(0))["predictions_count"]
    return listing.filter(
        (F.col("state") == "active") & (F.col("type") == "Forecast::YesNoQuestion")
        & (predictions > 0))


def screen_fred_series(listing: DataFrame) -> DataFrame:
    """Popular daily, weekly or monthly series that are still published."""
    return listing.filter(
        (F.col("popularity") > 50) & F.col("frequency_short").isin("D", "W", "M")
        & ~F.col("frequency").contains("Not Applicable")
        & ~F.col("title").contains("DISCONTINUED"))


def screen_fred_observations(observations: DataFrame, as_of: date) -> DataFrame:
    """Numeric observations of the series whose last date is at most a month old."""
    fresh = observations.groupBy("id").agg(F.max("date").alias("_last")).filter(
        F.col("_last") >= F.add_months(F.lit(as_of), -1)).select("id")
    return observations.filter(F.col("value") != ".").join(fresh, "id", "left_semi").withColumn(
        "value", F.col("value").cast("double"))


# --- page tables ---------------------------------------------------------------------------
# fixed values: one spelling for each player name
PLAYER_NAMES = {
    "Gukesh D.": "Gukesh Dommaraju",
    "Gukesh D": "Gukesh Dommaraju",
    "Leinier Dominguez": "Leinier Domínguez Pérez",
    "Leinier Dominguez Pérez": "Leinier Domínguez Pérez",
    "Nana Dzagnidze]": "Nana Dzagnidze",
}


def clean_rankings(df: DataFrame) -> DataFrame:
    player = F.col("Player")
    name = player
    for old, new in PLAYER_NAMES.items():
        name = F.when(player == old, F.lit(new)).otherwise(name)
    return df.filter(~player.contains("Change from the previous month")).withColumn("Player", name)


def clean_swimming(df: DataFrame, name: str = "Name") -> DataFrame:
    value = F.col(name)
    return df.filter(~value.rlike(r"[()]|eventsort|recordinfo"))


def clean_diseases(df: DataFrame, name: str = "Common name", vaccine: str = "Vaccine(s)",
                   after: date = date(2021, 7, 7)) -> DataFrame:
    """Drop names repeated within a date, keep later dates, read the vaccine cell as yes or no."""
    repeated = df.groupBy("date", name).count().filter("count > 1")
    text = F.col(vaccine)
    answer = F.when(text.rlike(r"^(Under research|Under Development|No)"), 0).when(
        text.rlike(r"^Yes"), 1)
    return (
        df.join(repeated.drop("count"), ["date", name], "left_anti")
        .filter(F.col("date") > F.lit(after)).withColumn("value", answer)
        .filter("value is not null")
    )


def until_last_data_day(df: DataFrame, due: date, day: str = "date") -> DataFrame:
    """Forecasters see nothing from the due date on."""
    return df.filter(F.col(day) < F.lit(due))
