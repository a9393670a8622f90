import datetime as dt

import pytest
from pyspark.sql import functions as F

from probcast import constants as C
from probcast.operators import filters, resolve as R
from tests.conftest import day

EXPLODED = ("source STRING, ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, "
            "resolution_date DATE")
SERIES = "source STRING, id STRING, date DATE, value DOUBLE"
DUE, LATER = day("2024-01-10"), day("2024-01-17")


def exploded(spark, items, source="fred"):
    return spark.createDataFrame(
        [(source, ids, direction, DUE, on) for ids, direction, on in items], EXPLODED)


# --- explosion -------------------------------------------------------------------------------

def test_explode_dates_and_directions(spark):
    questions = spark.createDataFrame([
        (DUE, "fred", ["a"], [day("2024-01-12"), day("2024-03-01")]),
        (DUE, "infer", ["m"], None),
        (DUE, "fred", ["a", "b"], [day("2024-01-12")]),
    ], "forecast_due_date DATE, source STRING, ids ARRAY<STRING>, resolution_dates ARRAY<DATE>")
    out = R.explode_question_set(questions, day("2024-02-01"))
    got = {(tuple(r.ids), tuple(r.direction), r.resolution_date) for r in out.collect()}
    assert got == {
        (("a",), (), day("2024-01-12")), (("m",), (), day("2024-01-12")),
        *{(("a", "b"), pair, day("2024-01-12")) for pair in R.DIRECTIONS}}
    # the market question takes the union of dates before as_of; all dates with a later as_of
    late = R.explode_question_set(questions, day("2024-04-01"))
    assert late.filter("source = 'infer'").count() == 2
    once = R.explode_question_set(questions, day("2024-04-01"), market_once=True)
    assert once.filter("source = 'infer'").count() == 1


# --- dataset ---------------------------------------------------------------------------------

def test_dataset_comparisons(spark):
    data = {"up": (1.0, 2.0), "same": (2.0, 2.0), "down": (3.0, 2.0), "late": (None, 2.0),
            "open": (1.0, None)}
    series = spark.createDataFrame(
        [("fred", i, on, v) for i, pair in data.items() for on, v in zip((DUE, LATER), pair)
         if v is not None], SERIES)
    out = R.resolve_dataset(
        exploded(spark, [([i], [], LATER) for i in data]), series).collect()
    value = {r.ids[0]: r.resolved_to for r in out}
    assert value == {"up": 1.0, "same": 0.0, "down": 0.0, "late": None, "open": None}
    assert {r.ids[0]: r.resolved for r in out} == {
        "up": True, "same": True, "down": True, "late": False, "open": False}


def test_dataset_combination_and_missing_leg(spark):
    series = spark.createDataFrame([
        ("fred", "up", DUE, 1.0), ("fred", "up", LATER, 2.0),
        ("fred", "down", DUE, 2.0), ("fred", "down", LATER, 1.0)], SERIES)
    items = [(["up"], [], LATER), (["down"], [], LATER)]
    items += [(["up", "down"], list(p), LATER) for p in R.DIRECTIONS]
    items += [(["up", "gone"], [1, 1], LATER)]
    out = R.resolve_dataset(exploded(spark, items), series)
    got = {(tuple(r.ids), tuple(r.direction)): r.resolved_to
           for r in out.filter(F.size("ids") > 1).collect()}
    assert got == {(("up", "down"), (1, 1)): 0.0, (("up", "down"), (1, -1)): 1.0,
                   (("up", "down"), (-1, 1)): 0.0, (("up", "down"), (-1, -1)): 0.0,
                   (("up", "gone"), (1, 1)): None}


def test_missing_series_is_found_for_legs(spark):
    series = spark.createDataFrame([("fred", "a", DUE, 1.0)], SERIES)
    rows = exploded(spark, [(["a"], [], LATER), (["a", "b"], [1, 1], LATER)])
    assert [r.id for r in R.missing_series(rows, series).collect()] == ["b"]


# --- market ----------------------------------------------------------------------------------

QUESTIONS = ("source STRING, id STRING, url STRING, resolved BOOLEAN, "
             "market_info_close_datetime STRING, market_info_resolution_datetime STRING")
AS_OF = day("2024-02-01")
YESTERDAY = day("2024-01-31")


def market(spark, questions, series, items):
    rows, warnings = R.resolve_market(
        exploded(spark, items, "infer"),
        spark.createDataFrame([("infer", *q) for q in questions], QUESTIONS),
        spark.createDataFrame([("infer", *s) for s in series], SERIES), AS_OF)
    return {(tuple(r.ids), tuple(r.direction)): r for r in rows.collect()}, warnings.collect()


def test_market_open_and_resolved(spark):
    close = "2024-01-20T00:00:00Z"
    questions = [("open", "u", False, close, "N/A"), ("yes", "u", True, close, "N/A"),
                 ("odd", "u", True, close, "2024-01-15T10:00:00Z"),
                 ("early", "u", True, "2024-01-05T00:00:00Z", "N/A"),
                 ("null", "u", True, close, "N/A")]
    series = [("open", DUE, 0.3), ("open", day("2024-01-09"), 0.2), ("open", YESTERDAY, 0.7),
              ("yes", DUE, 0.6), ("yes", day("2024-01-20"), 1.0),
              ("odd", day("2024-01-15"), 0.4), ("early", day("2024-01-05"), 1.0),
              ("null", day("2024-01-12"), None)]
    got, warnings = market(spark, questions, series,
                           [([q[0]], [], on) for q in questions for on in (LATER, YESTERDAY)])
    assert len(got) == 5     # rows of several dates collapse into one
    view = {k[0][0]: (r.resolved, r.resolved_to, r.resolution_date) for k, r in got.items()}
    assert view["open"] == (False, 0.7, YESTERDAY)
    assert view["yes"] == (True, 1.0, day("2024-01-20"))
    assert view["odd"] == (True, None, day("2024-01-15"))
    assert view["early"] == (True, None, day("2024-01-05"))
    assert view["null"][1] is None
    assert got[(("open",), ())].market_value_on_due_date == 0.3
    assert got[(("open",), ())].market_value_on_due_date_minus_one == 0.2
    assert [w.id for w in warnings] == ["odd"]


D0, D1 = day("2024-01-12"), day("2024-01-20")
STATES = [(done, sign, value) for done in (True, False) for sign in (1, -1)
          for value in (None, 0.0, 0.4, 1.0)]


def decided_on(legs):
    """The rule in words: see ``combination_date``."""
    if not any(done for done, _, _, _ in legs):
        return None
    wanted = {1: 1.0, -1: 0.0}
    ending = [on for done, sign, value, on in legs
              if value is None or (done and value == 1 - wanted[sign])]
    if ending:
        return min(ending)
    return max(leg[3] for leg in legs) if all(
        done and value == wanted[sign] for done, sign, value, _ in legs) else None


@pytest.mark.parametrize("days", [(D0, D1), (D1, D0)])
def test_combination_date_in_all_states(spark, days):
    pairs = [(a, b) for a in STATES for b in STATES]
    data = [(i, [a[1], b[1]], a[0], b[0], a[2], b[2], *days) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(data, "n INT, direction ARRAY<INT>, resolved_0 BOOLEAN, "
                               "resolved_1 BOOLEAN, resolved_to_0 DOUBLE, resolved_to_1 DOUBLE, "
                               "resolution_date_0 DATE, resolution_date_1 DATE")
    got = {r.n: r.on for r in df.select("n", R.combination_date().alias("on")).collect()}
    assert got == {i: decided_on([(*a, days[0]), (*b, days[1])]) for i, (a, b) in enumerate(pairs)}


def test_market_combination_without_leg(spark):
    got, _ = market(spark, [("a", "u", False, "N/A", "N/A")], [("a", YESTERDAY, 0.5)],
                    [(["a"], [], LATER), (["a", "x"], [1, 1], LATER)])
    row = got[(("a", "x"), (1, 1))]
    assert (row.resolved, row.resolved_to, row.resolution_date) == (False, None, YESTERDAY)


# --- conflict --------------------------------------------------------------------------------

def test_conflict_windows_are_half_open(spark):
    due, on = day("2024-03-01"), day("2024-03-31")
    events = spark.createDataFrame(
        [("X", due - dt.timedelta(days=1), "riot", 0)]
        + [("X", on, "riot", 0)] * 5                       # on the day itself: outside
        + [("X", on - dt.timedelta(days=30), "riot", 0)],   # first day of the window: inside
        "country STRING, event_date DATE, event_type STRING, fatalities BIGINT")
    attributes = spark.createDataFrame(
        [("q", C.CONFLICT_KEY_PLAIN, "riot", "X"), ("t", C.CONFLICT_KEY_TENFOLD, "riot", "X"),
         ("none", C.CONFLICT_KEY_PLAIN, "riot", "Nowhere")],
        "id STRING, key STRING, event_type STRING, country STRING")
    rows = spark.createDataFrame(
        [("acled", [i], [], due, on) for i in ("q", "t", "none", "unknown")]
        + [("acled", ["q"], [], due, day("2025-01-01"))], EXPLODED)
    got = {(r.ids[0], r.resolution_date): (r.resolved_to, r.resolved) for r in R.resolve_conflict(
        rows, attributes.select("id"), attributes, events).collect()}
    assert got[("q", on)] == (1.0, True)          # 1 > 1/12
    assert got[("t", on)] == (0.0, True)          # 1 > 10 * (1 + 1/12) fails
    assert got[("none", on)] == (0.0, True)       # absent country counts 0
    assert got[("unknown", on)] == (None, True)
    assert got[("q", day("2025-01-01"))] == (None, False)


# --- pages -----------------------------------------------------------------------------------

@pytest.mark.parametrize("kind,base,later,expected", [
    (C.SAME, 1.0, 1.0, 1.0), (C.SAME, 1.0, 2.0, 0.0), (C.SAME_OR_MORE, 2.0, 2.0, 1.0),
    (C.SAME_OR_LESS, 2.0, 3.0, 0.0), (C.MORE, 2.0, 2.0, 0.0), (C.ONE_PERCENT_MORE, 100.0, 101.0, 1.0),
    (C.ONE_PERCENT_MORE, 100.0, 100.5, 0.0), (C.MORE, None, 2.0, None), (C.MORE, 2.0, None, 0.0)])
def test_page_comparisons(spark, kind, base, later, expected):
    series = spark.createDataFrame(
        [("w", DUE, base), ("w", day("2024-01-15"), later)], "id STRING, date DATE, value DOUBLE")
    kinds = spark.createDataFrame([("w", kind)], "id STRING, question_type STRING")
    remaps = spark.createDataFrame([("old", "w")], "old_id STRING, new_id STRING")
    rows = exploded(spark, [(["w"], [], LATER), (["old"], [], LATER)], "wikipedia")
    got = R.resolve_pages(rows, kinds, remaps, series, AS_OF).collect()
    assert [r.resolved_to for r in got] == [expected, expected]


def test_page_text_values_compare_as_text(spark):
    series = spark.createDataFrame(
        [("w", DUE, None, "Yes"), ("w", LATER, None, "Yes")],
        "id STRING, date DATE, value DOUBLE, value_str STRING")
    kinds = spark.createDataFrame([("w", C.SAME)], "id STRING, question_type STRING")
    remaps = spark.createDataFrame([], "old_id STRING, new_id STRING")
    rows = exploded(spark, [(["w"], [], LATER)], "wikipedia")
    assert R.resolve_pages(rows, kinds, remaps, series, AS_OF).first().resolved_to == 1.0


# --- nullification and the whole ---------------------------------------------------------------

def test_nullified_rows_bypass_the_resolver(spark):
    rows = exploded(spark, [(["a"], [], LATER), (["b"], [], LATER), (["a", "b"], [1, 1], LATER),
                            (["c"], [], LATER)])
    nullified = spark.createDataFrame(
        [("fred", "a", day("2024-01-10")), ("fred", "c", day("2024-01-11"))],
        "source STRING, id STRING, start_date DATE")
    seen = []

    def resolver(part):
        seen.extend(tuple(r.ids) for r in part.collect())
        return R.resolve_dataset(part, spark.createDataFrame([], SERIES))

    out = R.with_nullification(rows, nullified, resolver)
    flags = {tuple(r.ids): (r.resolved, r.resolved_to) for r in out.collect()}
    assert sorted(seen) == [("b",), ("c",)]
    assert flags[("a",)] == (True, None) and flags[("a", "b")] == (True, None)
    assert flags[("b",)] == (False, None)
    assert {r.id for r in filters.active_nullifications(nullified, DUE).collect()} == {"a"}


def test_question_bank_checks(spark):
    rows = exploded(spark, [(["a"], [], LATER)])
    questions = spark.createDataFrame([("fred", "a")], "source STRING, id STRING")
    nothing = spark.createDataFrame([], SERIES)
    no_events = spark.createDataFrame([], "country STRING")
    with pytest.raises(ValueError, match="no series"):
        R.check_question_bank(rows, questions, nothing, no_events)
    with pytest.raises(ValueError, match="no questions"):
        R.check_question_bank(rows, questions.filter("id = 'x'"), nothing, no_events)
    with pytest.raises(ValueError, match="unknown source"):
        R.check_question_bank(exploded(spark, [(["a"], [], LATER)], "web"), questions, nothing,
                              no_events)


# --- forecasts -------------------------------------------------------------------------------

RAW = ("organization STRING, model_organization STRING, model STRING, source STRING, "
       "ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, resolution_date STRING, "
       "forecast DOUBLE")


def raw(spark, *items):
    return spark.createDataFrame([("o", "o", "m", s, [i], None, DUE, on, f)
                                  for s, i, on, f in items], RAW)


def test_prepare_forecasts(spark):
    df = raw(spark, ("FRED", "ok", "2024-01-17T00:00:00", 0.2), ("web", "x", "2024-01-17", 0.2),
             ("fred", "big", "2024-01-17", 1.2), ("fred", "none", "2024-01-17", None),
             ("fred", "day", "2024-01-18", 0.2), ("infer", "m", "N/A", 0.4),
             ("infer", "m", "N/A", 0.5))
    out = filters.prepare_forecasts(df).collect()
    assert sorted((r.source, r.ids[0], r.resolution_date) for r in out if r.source == "fred") == [
        ("fred", "ok", day("2024-01-17"))]
    assert sum(r.source == "infer" for r in out) == 2
    assert all(r.direction == [] for r in out)


def test_duplicate_dataset_forecast_is_an_error(spark):
    df = raw(spark, ("fred", "a", "2024-01-17", 0.2), ("fred", "a", "2024-01-17", 0.3))
    with pytest.raises(ValueError, match="duplicate"):
        filters.prepare_forecasts(df)


def test_match_and_impute(spark):
    resolved = spark.createDataFrame([
        ("fred", ["a"], [], DUE, LATER, True, 1.0, None, None),
        ("fred", ["b"], [], DUE, LATER, True, 0.0, None, None),
        ("infer", ["m"], [], DUE, YESTERDAY, False, 0.7, 0.3, 0.2)],
        "source STRING, ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, "
        "resolution_date DATE, resolved BOOLEAN, resolved_to DOUBLE, "
        "market_value_on_due_date DOUBLE, market_value_on_due_date_minus_one DOUBLE")
    given = spark.createDataFrame(
        [(org, org, model, "fred", ["a"], [], DUE, LATER, 0.9)
         for org, model in (("B", C.IMPUTED_FORECASTER), ("B", C.NAIVE_FORECASTER),
                            ("T", C.NAIVE_FORECASTER))],
        "organization STRING, model_organization STRING, model STRING, source STRING, "
        "ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, resolution_date DATE, "
        "forecast DOUBLE")
    out = R.impute(R.match_forecasts(resolved, given), "B")
    got = {(r.organization, r.model, r.ids[0]): (r.forecast, r.imputed) for r in out.collect()}
    assert len(got) == 9
    assert got[("B", C.IMPUTED_FORECASTER, "a")] == (0.9, False)
    assert got[("B", C.IMPUTED_FORECASTER, "b")] == (0.5, True)
    assert got[("B", C.IMPUTED_FORECASTER, "m")] == (0.3, True)
    assert got[("B", C.NAIVE_FORECASTER, "m")] == (0.2, True)
    assert got[("T", C.NAIVE_FORECASTER, "m")] == (0.5, True)
