"""Question generation and upkeep, one function per source or rule.

Question texts are the caller's templates with ``{field}`` slots; ``{resolution_date}`` and
``{forecast_due_date}`` always stay open.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from probcast import constants as C
from probcast.functions import dates as D
from probcast.functions.hashing import object_id
from probcast.functions.text import fill_template, object_label, yes_item
from probcast.operators.page_rules import PageRules
from probcast.operators.series import conflict_daily, splice_and_refill, trailing_sums
from probcast.operators.upsert import upsert

NOT_AVAILABLE = C.NOT_AVAILABLE
MARKET_FIELDS = ["market_info_resolution_criteria", "market_info_open_datetime",
                 "market_info_close_datetime", "market_info_resolution_datetime"]


def _horizons(values: Sequence[int] = tuple(C.HORIZONS_DAYS)) -> Column:
    return F.array(*[F.lit(h) for h in values])


# --- conflict events -------------------------------------------------------------------------

def conflict_questions(events: DataFrame, event_types: Sequence[str], as_of: date,
                       templates: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Every country x metric x question key, with hashed id and freeze value.

    Metrics and keys are short fixed lists, so each country row is exploded over them. The freeze
    value is the 360-day monthly average, plus one for the second key (not multiplied by ten).
    ``templates``: key -> (question, explanation) with fields event_type and country.
    """
    daily = conflict_daily(events)
    metrics = [*event_types, "fatalities"]
    kinds = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key"))
                      for m in metrics for k in templates])
    grid = events.select("country").distinct().select("country", F.explode(kinds).alias("_k")
                                                      ).select("country", "_k.*")
    requests = grid.select("country", "metric").distinct().withColumn("date", F.lit(as_of))
    sums = trailing_sums(daily, requests, [360], ["country", "metric"]).select(
        "country", "metric", (F.col("sum_360") / 12).alias("_average"))
    shown = F.when(F.col("metric") == "fatalities", F.col("metric")).otherwise(
        F.concat(F.lit("'"), F.col("metric"), F.lit("'")))
    pick = lambda part: F.coalesce(*[
        F.when(F.col("key") == key, F.lit(texts[part])) for key, texts in templates.items()])
    fill = lambda part: fill_template(
        pick(part), event_type=shown, country=F.col("country"))
    return grid.join(sums, ["country", "metric"]).select(
        object_id(key=F.col("key"), event_type=F.col("metric"), country=F.col("country")).alias(
            "id"),
        "country", F.col("metric").alias("event_type"), "key",
        fill(0).alias("question"), fill(1).alias("freeze_datetime_value_explanation"),
        F.when(F.col("key") == C.CONFLICT_KEY_TENFOLD, F.col("_average") + 1).otherwise(
            F.col("_average")).alias("freeze_value"),
        F.lit(False).alias("resolved"), _horizons().alias("forecast_horizons"),
    )


CONFLICT_UPDATED_FIELDS = ["question", "background", "freeze_datetime_value",
                           "freeze_datetime_value_explanation"]


def update_conflict_questions(stored: DataFrame, generated: DataFrame) -> DataFrame:
    """Append new ids; of known ids refresh four fields only."""
    return upsert(stored, generated, ["id"], CONFLICT_UPDATED_FIELDS)


# --- page tables -----------------------------------------------------------------------------

def page_item_ids(items: DataFrame, root: str = "page", item: str = "item") -> DataFrame:
    return items.withColumn("id", object_id(id_root=F.col(root), id_field_value=F.col(item)))


def page_questions(series: DataFrame, rules: PageRules, storage_start: date = C.STORAGE_START_DATE
                   ) -> DataFrame:
    """Question row per page item from its marked series (page, item, date, value).

    The page's rules decide on the latest value by date: whether it settles the question, which then
    has no horizons, how it is shown, and the texts. ``item`` makes the id; ``name``, where the frame
    has it, is what texts call the item. Series that end before the storage start and pages without a
    rule give none.
    """
    name = "name" if "name" in series.columns else "item"
    latest = series.groupBy("page", "item").agg(
        F.max("date").alias("_last"),
        F.max_by(F.struct("value", F.col(name).alias("name")), "date").alias("_v"))
    root, value = F.col("page"), F.col("_v.value")
    rows = page_item_ids(latest.filter(
        (F.col("_last") >= F.lit(storage_start)) & rules.known(root))).select(
        "page", "item", "id", F.col("_v.name").alias("_name"), rules.shown(root, value).alias("_shown"),
        rules.resolved(root, value).alias("resolved"))
    text = lambda part: rules.text(root, part, F.col("_name"), F.col("_shown"))
    return rows.select(
        "page", "item", "id", text("question").alias("question"), text("background").alias("background"),
        rules.url(root).alias("url"), "resolved",
        F.when(F.col("resolved"), F.array().cast("array<int>")).otherwise(_horizons()).alias(
            "forecast_horizons"),
        F.col("_shown").alias("freeze_datetime_value"),
        text("explanation").alias("freeze_datetime_value_explanation"),
        *[F.lit(NOT_AVAILABLE).alias(c) for c in MARKET_FIELDS])


def resolve_dropped_pages(questions: DataFrame, attributes: DataFrame, roots: Sequence[str]
                          ) -> DataFrame:
    """Questions without attributes, or of a page no longer tracked, become resolved."""
    side = attributes.select("id", F.col("id_root").alias("_root"))
    gone = F.col("_root").isNull() | ~F.col("_root").isin(list(roots))
    return questions.join(side, "id", "left").withColumn(
        "resolved", F.col("resolved") | gone).select(*questions.columns)


def resolve_remapped(questions: DataFrame, remaps: DataFrame) -> DataFrame:
    """An old id is resolved when the id it was replaced by is."""
    done = questions.filter("resolved").select(F.col("id").alias("new_id"))
    side = remaps.join(done, "new_id", "left_semi").select(
        F.col("old_id").alias("id"), F.lit(True).alias("_done"))
    return questions.join(side, "id", "left").withColumn(
        "resolved", F.col("resolved") | F.coalesce("_done", F.lit(False))).select(
        *questions.columns)


# --- weather, macro and stock series ---------------------------------------------------------

def filled(template: str, **values: Column) -> Column:
    """A fixed text with some of its slots filled; a missing value reads 'N/A'."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit(NOT_AVAILABLE)))
    return out


def question_row(**columns: Column) -> list[Column]:
    """The columns of a question table; fields that are not given read 'N/A'."""
    given = {name: F.lit(NOT_AVAILABLE) for name in ("background", *MARKET_FIELDS)} | columns
    return [given[name].alias(name) for name in QUESTION_FIELDS]


QUESTION_FIELDS = ["id", "question", "background", "url", "resolved", "forecast_horizons",
                   "freeze_datetime_value", "freeze_datetime_value_explanation", *MARKET_FIELDS]


def weather_questions(observations: DataFrame, catalog: DataFrame, stored: DataFrame, as_of: date,
                      recent: int = 10) -> DataFrame:
    """The weather source's question table after a fetch.

    ``observations``: (id, period DATE, value text with 'NA' gaps, provider, dataset, name);
    ``catalog``: (series, question, explanation), whose series name with '/' as '_' is the id. A series
    counts when any of its last ``recent`` values is present. A new question freezes the last value
    only when dated after yesterday; of a known one the last present value, url and background are
    renewed. Other stored rows stay.
    """
    yesterday = as_of - timedelta(days=1)
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("period").desc()))
    present = F.col("value") != "NA"
    lively = observations.select("id", "period", "value", newest.alias("_k")).filter(F.col("_k") <= recent).groupBy(
        "id").agg(F.bool_or(present).alias("_lively"))
    latest = observations.groupBy("id").agg(
        F.max_by(F.struct("period", "value"), "period").alias("_last"),
        F.max_by("value", F.when(present, F.col("period"))).alias("_present"),
        *[F.max_by(c, "period").alias(c) for c in ("provider", "dataset", "name")])
    source = catalog.withColumn("id", object_label(F.col("series"))).join(latest, "id").join(
        lively.filter("_lively"), "id")
    value = F.col("_last.value")
    fresh = (F.col("_last.period") > F.lit(yesterday)) & (value != "NA")
    url = filled(C.WEATHER_URL, series=F.col("series"))
    known = stored.select("id", F.lit(True).alias("_known"))
    frozen = F.when(F.col("_known"), F.col("_present")).when(fresh, value).try_cast("double").cast("string")
    rows = source.join(known, "id", "left").select(*question_row(
        id=F.col("id"), question=F.col("question"), url=url, resolved=F.lit(False), forecast_horizons=_horizons(),
        background=filled(C.WEATHER_BACKGROUND, dataset=F.col("dataset"), name=F.col("name"),
                          provider=F.col("provider"), url=url),
        freeze_datetime_value=F.coalesce(frozen, F.lit(NOT_AVAILABLE)),
        freeze_datetime_value_explanation=F.col("explanation")))
    return upsert(stored.select(*QUESTION_FIELDS), rows, ["id"], ["freeze_datetime_value", "url", "background"])


def weather_resolution_rows(observations: DataFrame) -> DataFrame:
    """Stored series of the weather source: period becomes date, 'NA' becomes 'N/A'."""
    return observations.select(
        "id", F.col("period").alias("date"),
        F.when(F.col("value") == "NA", NOT_AVAILABLE).otherwise(F.col("value")).alias("value_str"),
        F.col("value").try_cast("double").alias("value"))


def within_window(observations: DataFrame, start: date, day: str = "period") -> DataFrame:
    return observations.filter(F.col(day) >= F.lit(start))


def macro_questions(series: DataFrame, observations: DataFrame, stored: DataFrame, nullified: DataFrame) -> DataFrame:
    """The macro source's question table after a fetch.

    ``series``: (id, name, title, release, release_notes, frequency_short, frequency, units, notes,
    seasonal_adjustment); ``observations``: (id, date, value). A series without a name of its own keeps
    its stored question text. Monthly series lose the shortest horizon; nullified ones leave the table.
    """
    last = observations.groupBy("id").agg(F.max_by("value", "date").alias("_value"))
    gone = nullified.filter("source = 'fred'").select("id")
    kept = stored.select(*QUESTION_FIELDS).join(gone, "id", "left_anti")
    texts = kept.select("id", F.col("question").alias("_stored"))
    monthly = F.col("frequency_short") == "M"
    named = F.when(F.col("name").isNotNull(), filled(C.MACRO_QUESTION, name=F.col("name")))
    parts = ("release_notes", "notes", "units", "seasonal_adjustment", "frequency")
    rows = series.join(gone, "id", "left_anti").join(last, "id").join(texts, "id", "left").select(*question_row(
        id=F.col("id"), question=F.coalesce(named, "_stored"), resolved=F.lit(False),
        background=filled(C.MACRO_BACKGROUND, **{c: F.col(c) for c in parts}),
        url=filled(C.MACRO_URL, id=F.col("id")),
        forecast_horizons=F.when(monthly, F.slice(_horizons(), 2, len(C.HORIZONS_DAYS) - 1)).otherwise(_horizons()),
        freeze_datetime_value=F.coalesce(F.col("_value").cast("string"), F.lit(NOT_AVAILABLE)),
        freeze_datetime_value_explanation=filled(
            C.MACRO_EXPLANATION, title=F.col("title"), release=F.col("release"))))
    return upsert(kept, rows, ["id"])


def nested_observations(fetched: DataFrame, column: str = "observations") -> DataFrame:
    """Series rows from a fetched table with an embedded list of (date, value)."""
    return fetched.select("id", F.explode(column).alias("_o")).select(
        "id", F.to_date("_o.date").alias("date"), F.col("_o.value").alias("value"))


def stock_questions(stored: DataFrame, prices: DataFrame, companies: DataFrame, listed: DataFrame,
                    nullified: DataFrame, renames: DataFrame) -> DataFrame:
    """The stock source's question rows of a fetch: last close to 2 decimals, or carried forward.

    Known tickers that are nullified or renamed come back as stored, resolved and without a value; so
    do stored tickers that have left the index and return no price. New tickers need a price.
    ``companies``: (id, background).
    """
    dead = nullified.filter("source = 'yfinance'").select("id").union(
        renames.select(F.col("old_id").alias("id"))).distinct().withColumn("_dead", F.lit(True))
    close = prices.groupBy("id").agg(F.bround(F.max_by("value", "date"), 2).alias("_close"))
    rest = [c for c in QUESTION_FIELDS if c != "id"]
    bank = stored.select("id", F.struct(*rest).alias("_stored"))
    index = listed.select("id").distinct().withColumn("_listed", F.lit(True))
    about = companies.select("id", F.col("background").alias("_about"))
    known = bank.join(index, "id", "full").join(dead, "id", "left").join(close, "id", "left").join(about, "id", "left")
    carried = F.col("_stored").isNotNull() & (
        F.col("_dead").isNotNull() | (F.col("_close").isNull() & F.col("_listed").isNull()))
    state = known.withColumn("_carried", F.coalesce(carried, F.lit(False)))
    fresh = state.filter(~F.col("_carried") & F.col("_close").isNotNull() & F.col("_dead").isNull()).select(*question_row(
        id=F.col("id"), question=filled(C.STOCK_QUESTION, id=F.col("id")), resolved=F.lit(False),
        background=F.coalesce("_about", F.lit(NOT_AVAILABLE)), url=filled(C.STOCK_URL, id=F.col("id")),
        forecast_horizons=_horizons(), freeze_datetime_value=F.col("_close").cast("string"),
        freeze_datetime_value_explanation=filled(C.STOCK_EXPLANATION, id=F.col("id"))))
    old = state.filter("_carried").select("id", "_stored.*").withColumns({
        "resolved": F.lit(True), "freeze_datetime_value": F.lit(NOT_AVAILABLE)})
    return fresh.unionByName(old)


# --- market payloads -------------------------------------------------------------------------

def earlier_text(a: Column, b: Column) -> Column:
    """The earlier of two ISO texts, or the one that is there, else 'N/A'."""
    return F.coalesce(F.least(a, b), F.lit(NOT_AVAILABLE))


def infer_questions(payload: DataFrame) -> DataFrame:
    """Question rows from prediction-platform payloads with two optional close times.

    ``clarifications``: array of (content). Besides the question's columns: the crowd's probability
    and whether the question is to be nullified, which is so for anything but yes/no questions.
    """
    nullify = F.col("type") != "Forecast::YesNoQuestion"
    iso = lambda name: F.when(F.col(name) != "", D.zulu_to_iso(F.col(name)))
    close = earlier_text(iso("scoring_end_time"), iso("ends_at"))
    known_close = F.when(close != NOT_AVAILABLE, close)
    resolved = F.coalesce("resolved", F.lit(False))
    answers = F.col("answers")
    first, second = (F.try_element_at(answers, F.lit(k)) for k in (1, 2))
    yes = F.when(F.lower(first["name"]) == "yes", first["probability"]).otherwise(
        second["probability"])
    notes = F.array_join(F.transform("clarifications", lambda c: c["content"]), " ")
    return payload.withColumn("_probability", F.when((F.size(answers) == 2) & ~nullify, yes)).select(*question_row(
        id=F.col("id").cast("string"), question=F.col("name"), background=F.col("description"),
        url=filled(C.INFER_URL, id=F.col("id")), resolved=resolved,
        forecast_horizons=F.lit(None).cast("array<int>"),
        freeze_datetime_value=F.coalesce(F.col("_probability").cast("string"), F.lit(NOT_AVAILABLE)),
        freeze_datetime_value_explanation=F.lit(C.CROWD_EXPLANATION),
        market_info_resolution_criteria=F.when(F.size("clarifications") > 0, notes).otherwise(NOT_AVAILABLE),
        market_info_open_datetime=F.coalesce(iso("scoring_start_time"), F.lit(NOT_AVAILABLE)),
        market_info_close_datetime=close,
        market_info_resolution_datetime=F.when(resolved, earlier_text(iso("resolved_at"), known_close)).otherwise(
            NOT_AVAILABLE)),
        F.col("_probability").alias("probability"), nullify.alias("nullify_question"))


def manifold_questions(payload: DataFrame) -> DataFrame:
    return payload.select(
        "id", "question", F.col("textDescription").alias("background"), "url",
        D.epoch_millis_to_iso(F.col("createdTime")).alias("market_info_open_datetime"),
        D.epoch_millis_to_iso(F.col("closeTime")).alias("market_info_close_datetime"),
        F.col("isResolved").alias("resolved"),
        F.when(F.col("isResolved"), D.epoch_millis_to_iso(F.col("resolutionTime"))).otherwise(
            NOT_AVAILABLE).alias("market_info_resolution_datetime"))


def metaculus_questions(payload: DataFrame) -> DataFrame:
    q = F.col("question")
    close, resolve = q["actual_close_time"], q["actual_resolve_time"]
    return payload.select(
        F.col("id").cast("string").alias("id"), F.col("title").alias("question"),
        F.coalesce(q["description"], F.lit(NOT_AVAILABLE)).alias("background"),
        F.concat(F.lit("https://www.metaculus.com/questions/"), F.col("id").cast("string")).alias(
            "url"),
        D.zulu_to_iso(q["open_time"]).alias("market_info_open_datetime"),
        D.zulu_to_iso(close).alias("market_info_close_datetime"), "resolved",
        F.when(F.col("resolved"), F.least(D.zulu_to_iso(close), D.zulu_to_iso(resolve))
               ).otherwise(NOT_AVAILABLE).alias("market_info_resolution_datetime"))


def polymarket_questions(payload: DataFrame) -> DataFrame:
    """Question rows; the oracle's end date counts when it is before the listed end date."""
    end = F.coalesce(F.col("endDate"), F.try_element_at("events", F.lit(1))["endDate"])
    close, oracle = D.zulu_to_iso(end), D.zulu_to_iso(F.col("umaEndDate"))
    resolved = F.coalesce(F.col("umaResolutionStatus") == "resolved", F.lit(False))
    return payload.filter(end.isNotNull()).select(
        F.col("conditionId").alias("id"), "question", F.col("description").alias("background"),
        F.concat(F.lit("https://polymarket.com/market/"), F.col("slug")).alias("url"),
        F.col("startDateIso").alias("market_info_open_datetime"),
        close.alias("market_info_close_datetime"), resolved.alias("resolved"),
        F.when(oracle < close, oracle).otherwise(close).alias("market_info_resolution_datetime"),
        yes_item(F.col("outcomes"), F.col("outcomePrices")).try_cast("double").alias(
            "resolved_price"))


def polymarket_series(daily: DataFrame, questions: DataFrame, invalid: DataFrame) -> DataFrame:
    """Filled price series with the outcome price spliced in for resolved, valid questions."""
    done = questions.filter("resolved").join(invalid.select("id"), "id", "left_anti").select(
        "id", F.to_date(F.substring("market_info_resolution_datetime", 1, 10)).alias(
            "resolved_on"), F.col("resolved_price").alias("final_value"))
    return splice_and_refill(daily, done)


def nullify_series(stored: DataFrame, questions: DataFrame, as_of: date) -> DataFrame:
    """Nullified questions keep their dates with null values, or get one null row yesterday."""
    flagged = questions.filter("nullify_question").select("id").withColumn("_n", F.lit(True))
    kept = stored.join(flagged, "id", "left").select(
        "id", "date", F.when(F.col("_n").isNull(), F.col("value")).alias("value"))
    bare = flagged.join(stored.select("id"), "id", "left_anti").select(
        "id", F.lit(as_of - timedelta(days=1)).alias("date"),
        F.lit(None).cast("double").alias("value"))
    return kept.unionByName(bare)


def resolve_nullified(questions: DataFrame) -> DataFrame:
    return questions.withColumn("resolved", F.col("resolved") | F.col("nullify_question"))


def to_regenerate(questions: DataFrame, stored: DataFrame) -> DataFrame:
    """Resolved question ids that have no stored series."""
    return questions.filter("resolved").select("id").join(
        stored.select("id").distinct(), "id", "left_anti")


# --- metadata --------------------------------------------------------------------------------
# fixed values: categories that follow from the source
SOURCE_CATEGORY = {
    "acled": "Security & Defense",
    "fred": "Economics & Business",
    "yfinance": "Economics & Business",
}


def assign_categories(questions: DataFrame, stored: DataFrame, labels: DataFrame) -> DataFrame:
    """Category per question: by source, else a valid stored one, else a valid new label.

    ``labels``: (source, id, label); a label outside the list is 'Other'; none leaves null.
    """
    old = stored.select("source", "id", F.col("category").alias("_stored"))
    given = labels.select("source", "id", F.col("label").alias("_label"))
    by_source = F.lit(None).cast("string")
    for source, category in SOURCE_CATEGORY.items():
        by_source = F.when(F.col("source") == source, F.lit(category)).otherwise(by_source)
    valid = lambda c: F.when(F.col(c).isin(C.CATEGORIES), F.col(c))
    label = F.when(F.col("_label").isNotNull(), F.coalesce(valid("_label"), F.lit("Other")))
    return questions.select("source", "id").join(old, ["source", "id"], "left").join(
        given, ["source", "id"], "left").select(
        "source", "id", F.coalesce(by_source, valid("_stored"), label).alias("category"))


def classify_response(response: Column) -> Column:
    """Valid, invalid or unset from a reviewer's response."""
    verdict = F.try_element_at(F.split(response, "Classification:"), F.lit(2))
    return F.when(~response.contains("Classification:"), F.lit(None).cast("boolean")).when(
        verdict.contains("ok"), True).when(verdict.contains("flag"), False).otherwise(True)


def assign_validity(questions: DataFrame, stored: DataFrame, responses: DataFrame,
                    invalid_pages: DataFrame) -> DataFrame:
    """valid_question per question; rows still without an answer are left out.

    Dataset sources and two platforms are valid as they are, page ids that were remapped or
    nullified are not; the rest keep a stored mark or take it from a response.
    """
    trusted = F.col("source").isin([*C.DATASET_SOURCES, "infer", "metaculus"])
    pages = invalid_pages.select("id", F.lit("wikipedia").alias("source"),
                                 F.lit(True).alias("_bad")).distinct()
    old = stored.select("source", "id", F.col("valid_question").alias("_stored"))
    said = responses.select("source", "id", classify_response(F.col("response")).alias("_said"))
    return questions.select("source", "id").join(pages, ["source", "id"], "left").join(
        old, ["source", "id"], "left").join(said, ["source", "id"], "left").withColumn(
        "valid_question", F.when(F.col("_bad").isNotNull(), False).when(trusted, True).otherwise(
            F.coalesce("_stored", "_said"))).filter("valid_question is not null").select(
        "source", "id", "valid_question")


# --- prompts ---------------------------------------------------------------------------------

def render_prompts(questions: DataFrame, dataset_template: str, market_template: str) -> DataFrame:
    """Prompt text per question row; ``{name}`` slots take the column of that name.

    Dataset question texts first get their due date and a fixed phrase for the resolution dates;
    criteria are appended to the background when there are any.
    """
    dataset = F.col("source").isin(C.DATASET_SOURCES)
    text = fill_template(
        F.col("question"), forecast_due_date=F.col("forecast_due_date").cast("string"),
        resolution_date=F.lit("each of the resolution dates provided below"))
    criteria = F.col("market_info_resolution_criteria")
    background = F.when(criteria != NOT_AVAILABLE, F.concat_ws("\n", "background", criteria)
                        ).otherwise(F.col("background"))
    slots = {"question": F.when(dataset, text).otherwise(F.col("question")),
             "background": background}
    for name in ("today_date", "freeze_datetime", "freeze_datetime_value", "resolution_criteria",
                 "freeze_datetime_value_explanation", "list_of_resolution_dates"):
        if name in questions.columns:
            slots[name] = F.coalesce(F.col(name).cast("string"), F.lit(NOT_AVAILABLE))
    if "market_info_close_datetime" in questions.columns:
        slots["resolution_date"] = F.coalesce("market_info_close_datetime", F.lit(NOT_AVAILABLE))
    return questions.withColumn("prompt", F.when(
        dataset, fill_template(F.lit(dataset_template), **slots)).otherwise(
        fill_template(F.lit(market_template), **slots)))
