"""Fixed values of the forecasting domain (names, bins, dates). Kept together as plain text."""

from __future__ import annotations

from datetime import date, timedelta
from fractions import Fraction

# --- fixed values: sources -----------------------------------------------------------------
DATASET_SOURCES = ["acled", "dbnomics", "fred", "wikipedia", "yfinance"]
MARKET_SOURCES = ["infer", "manifold", "metaculus", "polymarket"]
ALL_SOURCES = sorted(DATASET_SOURCES + MARKET_SOURCES)

# --- fixed values: dates and horizons ------------------------------------------------------
BENCHMARK_START_DATE = date(2024, 5, 1)
TOURNAMENT_START_DATE = date(2024, 7, 21)
STORAGE_START_DATE = BENCHMARK_START_DATE - timedelta(days=360)
HORIZONS_DAYS = [7, 30, 90, 180, 365, 1095, 1825, 3650]
LAST_REPRESENTABLE_DATE = date(2262, 4, 11)
FREEZE_WINDOW_DAYS = 10
PUBLISH_EVERY_DAYS = 14

# --- fixed values: question sets -----------------------------------------------------------
CATEGORIES = [
    "Science & Tech",
    "Healthcare & Biology",
    "Economics & Business",
    "Environment & Energy",
    "Politics & Governance",
    "Arts & Recreation",
    "Security & Defense",
    "Sports",
    "Other",
]
LLM_QUESTION_COUNT = 500
HUMAN_QUESTION_COUNT = 200

# (lower, upper, weight); lower inclusive, upper exclusive except in the last bin.
MARKET_VALUE_BINS = [
    (0.00, 0.01, 0.02),
    (0.01, 0.10, 0.096),
    (0.10, 0.20, 0.096),
    (0.20, 0.30, 0.096),
    (0.30, 0.40, 0.096),
    (0.40, 0.50, 0.096),
    (0.50, 0.60, 0.096),
    (0.60, 0.70, 0.096),
    (0.70, 0.80, 0.096),
    (0.80, 0.90, 0.096),
    (0.90, 0.99, 0.096),
    (0.99, 1.00, 0.02),
]
# (first day, last day, weight); both inclusive.
TIME_HORIZON_BINS = [
    (0, 7, 0.12),
    (8, 30, 0.21),
    (31, 50, 0.21),
    (51, 90, 0.14),
    (91, 180, 0.14),
    (181, 365, 0.14),
    (366, float("inf"), 0.04),
]
UNKNOWN_BIN = "unknown"

# --- fixed values: scoring -----------------------------------------------------------------
IMPUTED_CUTOFF_PCT = 5
MIN_DATASET_QUESTIONS = 225
MIN_MARKET_QUESTIONS = 50
MODEL_AGE_CUTOFF_DAYS = 365
BOOTSTRAP_REPLICATES = 1999
BOARD_DECIMALS = 1

# --- fixed values: comparison models -------------------------------------------------------
ALWAYS_HALF = "Always 0.5"
ALWAYS_ZERO = "Always 0"
ALWAYS_ONE = "Always 1"
RANDOM_UNIFORM = "Random Uniform"
IMPUTED_FORECASTER = "Imputed Forecaster"
NAIVE_FORECASTER = "Naive Forecaster"
SUPERFORECASTERS = "Superforecaster median forecast"
PUBLIC = "Public median forecast"
ENSEMBLES = [
    "LLM Crowd (gpt-4o, claude-3.5-sonnet, gemini-1.5-pro) geometric mean log odds with news",
    "LLM Crowd (gpt-4o, claude-3.5-sonnet, gemini-1.5-pro) geometric mean with news",
    "LLM Crowd (gpt-4o, claude-3.5-sonnet, gemini-1.5-pro) median with news",
]
COMPARISON_MODELS = [
    ALWAYS_ZERO, ALWAYS_ONE, ALWAYS_HALF, RANDOM_UNIFORM, IMPUTED_FORECASTER,
    NAIVE_FORECASTER, SUPERFORECASTERS, PUBLIC, *ENSEMBLES,
]
EXCLUDED_FROM_FIT = [
    ALWAYS_ZERO, ALWAYS_ONE, ALWAYS_HALF, RANDOM_UNIFORM, IMPUTED_FORECASTER, *ENSEMBLES,
]

# --- fixed values: forecast variants -------------------------------------------------------
VARIANTS_WITH_CONTEXT = [
    "zero-shot-with-freeze-values",
    "scratchpad-with-freeze-values",
    "scratchpad-with-news",
    "scratchpad-with-news-with-freeze-values",
    "scratchpad-with-second-news",
    "superforecaster-with-news-1",
    "superforecaster-with-news-2",
    "superforecaster-with-news-3",
]
VARIANTS_WITHOUT_CONTEXT = ["zero-shot", "scratchpad"]

# --- fixed values: conflict question keys --------------------------------------------------
CONFLICT_KEY_PLAIN = "last30Days.gt.30DayAvgOverPast360Days"
CONFLICT_KEY_TENFOLD = "last30DaysTimes10.gt.30DayAvgOverPast360DaysPlus1"

# --- fixed values: comparison types of page questions --------------------------------------
SAME, SAME_OR_MORE, SAME_OR_LESS, MORE, ONE_PERCENT_MORE = (
    "SAME", "SAME_OR_MORE", "SAME_OR_LESS", "MORE", "ONE_PERCENT_MORE",
)
PAGE_COMPARISONS = [SAME, SAME_OR_MORE, SAME_OR_LESS, MORE, ONE_PERCENT_MORE]
PAGE_URL = "https://en.wikipedia.org/wiki/"
# least and greatest value that a page can show
PAGE_LIMITS = {
    "FIDE_rankings_elo_rating": (0, 2950),
    "FIDE_rankings_ranking": (1, 1000),
    "List_of_world_records_in_swimming": (0, 1),
    "List_of_infectious_diseases": (0, 1),
}


def check_bin_weights() -> None:
    """Both bin weight lists must sum to exactly one (exact rational arithmetic)."""
    for name, bins in (("market value", MARKET_VALUE_BINS), ("time horizon", TIME_HORIZON_BINS)):
        total = sum(Fraction(str(weight)) for _, _, weight in bins)
        if total != 1:
            raise ValueError(f"{name} weights sum to {float(total)}, expected 1")

# --- fixed values: question texts and addresses -------------------------------------------------
NOT_AVAILABLE = "N/A"
INFER_URL = "https://www.randforecastinginitiative.org/questions/{id}"
WEATHER_URL = "https://db.nomics.world/{series}"
MACRO_URL = "https://fred.stlouisfed.org/series/{id}"
STOCK_URL = "https://finance.yahoo.com/quote/{id}"
CROWD_EXPLANATION = "The crowd forecast."
WEATHER_BACKGROUND = "The history of {dataset} - {name} from {provider} is available at {url}."
MACRO_QUESTION = (
    "Will {name} have increased by {resolution_date} as compared to its value on {forecast_due_date}?")
MACRO_BACKGROUND = (
    "The notes from the release: {release_notes}.  The notes from the series: {notes}.  Additional "
    "background of the series:  1. the units of the series: {units}.  2. the seasonal adjustments of "
    "the series:  {seasonal_adjustment}  3. the update frequency: {frequency} ")
MACRO_EXPLANATION = "The latest value released in {title} from the release {release}."
STOCK_QUESTION = (
    "Will {id}'s market close price on {resolution_date} be higher than its market close price on "
    "{forecast_due_date}?\n\nStock splits and reverse splits will be accounted for in resolving this "
    "question. Forecasts on questions about companies that have been delisted (through mergers or "
    "bankruptcy) will resolve to their final close price.")
STOCK_EXPLANATION = "The latest market close price of {id}."
