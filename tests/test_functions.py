import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from probcast import constants as C, schemas
from probcast.functions import dates as D, hashing, normal, parsing, text as X
from probcast.operators import questions as Q, sampling as P, scoring
from tests.conftest import day


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("value", ["plain", 'qu"ote', "back\\slash", "línea\n", "tab\t", "😀 é", "\x01"])
def test_hash_matches_sorted_json(spark, value):
    attributes = {"id_root": "root", "id_field_value": value}
    want = hashlib.sha256(json.dumps(attributes, sort_keys=True).encode()).hexdigest()
    df = spark.createDataFrame([(value,)], "x STRING")
    got = df.select(hashing.object_id(id_root=F.lit("root"), id_field_value=F.col("x"))).first()[0]
    assert got == want


@pytest.mark.parametrize("token,expected", [
    ("0.5", 0.5), ("*0.25*", 0.25), (" .7 ", 0.7), ("1", 1.0), ("1.01", None), ("-0.1", None),
    ("0.5 maybe", None), ("", None), ("**0.5**", None), ("5%", None)])
def test_probability_tokens(spark, token, expected):
    df = spark.createDataFrame([(token,)], "x STRING")
    assert df.select(parsing.probability(F.col("x"))).first()[0] == expected


@pytest.mark.parametrize("text,expected", [
    ("0.1, 0.2 *0.3*", [0.1, 0.2, 0.3]), ("0.1, two", []), ("", []), (None, [])])
def test_probability_lists(spark, text, expected):
    df = spark.createDataFrame([(text,)], "x STRING")
    assert df.select(parsing.probabilities(F.col("x"))).first()[0] == expected


@pytest.mark.parametrize("text,expected", [
    ("[0.1, 1]", [0.1, 1.0]), (" [] ", []), ("[0.1, 2]", None), ("[True]", None), ("0.1", None),
    ("[0.1", None), ("[1e-2]", [0.01])])
def test_literal_lists(spark, text, expected):
    df = spark.createDataFrame([(text,)], "x STRING")
    assert df.select(parsing.literal_list(F.col("x"))).first()[0] == expected


def test_last_starred(spark):
    assert one(spark, parsing.last_starred(F.lit("a *0.2* b *0.4* c *7*"))) == 0.4
    assert one(spark, parsing.last_starred(F.lit("none"))) is None


def test_dates(spark):
    assert one(spark, D.epoch_millis_to_iso(F.lit(1704067200999))) == "2024-01-01T00:00:00+00:00"
    assert one(spark, D.zulu_to_iso(F.lit("2024-01-01T05:00:00Z"))) == "2024-01-01T05:00:00+00:00"
    assert one(spark, D.zulu_to_iso(F.lit("2024-01-01T05:00:00+02:00"))) == (
        "2024-01-01T03:00:00+00:00")
    assert one(spark, D.ordinal(F.lit(day("2024-01-01")))) == day("2024-01-01").toordinal()
    assert one(spark, D.from_ordinal(F.lit(738886.4))) == day("2024-01-01")
    assert one(spark, D.bounded_date(F.lit("9999-01-01"))) == day("2262-04-11")
    assert one(spark, D.mixed_date(F.lit("2024-01-01T10:00:00Z"))) == day("2024-01-01")
    assert one(spark, D.mixed_date(F.lit("soon"))) is None
    assert one(spark, D.is_publication_day(F.lit(day("2024-08-04"))))
    assert one(spark, D.is_curation_day(F.lit(day("2024-07-25"))))
    with pytest.raises(Exception, match="without zone"):
        one(spark, D.require_zone(F.lit("2024-01-01T05:00:00")))


def test_normal_distribution(spark):
    df = spark.createDataFrame([(0.0,), (1.96,), (None,)], "z DOUBLE")
    got = [r[0] for r in df.select(normal.normal_cdf("z")).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(0.9750021) and got[2] is None
    back = spark.createDataFrame([(0.975,), (0.0,)], "p DOUBLE").select(
        normal.normal_quantile("p")).collect()
    assert back[0][0] == pytest.approx(1.959964, abs=1e-6) and back[1][0] == -math.inf


def test_names_and_templates(spark):
    assert one(spark, X.display_model_name(F.lit("s"), F.lit("zero-shot-with-freeze-values"))) == "s†"
    assert one(spark, X.anonymous_team_number(F.lit(" Anonymous 12 "))) == 12
    assert one(spark, X.anonymous_team_number(F.lit("Team"))) is None
    X.check_template("a {b} {{c}}", {"b"})
    with pytest.raises(ValueError):
        X.check_template("a {b}", {"c"})


def test_brier_index(spark):
    assert one(spark, scoring.brier_index(F.lit(0.25))) == pytest.approx(50)
    assert one(spark, scoring.brier_index(F.lit(-0.1))) is None


# --- sampling --------------------------------------------------------------------------------

def test_bin_edges_and_weights(spark):
    C.check_bin_weights()
    got = [one(spark, P.market_value_bin(F.lit(x))) for x in ("0", "0.01", "0.99", "1", "1.2", "N/A")]
    assert got == ["0.0-0.01%", "0.01-0.1%", "0.99-1.0%", "0.99-1.0%", "unknown", "unknown"]
    due = day("2024-01-10")
    got = [one(spark, P.time_horizon_bin(F.lit(x), due)) for x in (
        "2024-01-17T23:00:00+00:00", "2024-01-18T00:00:00+00:00", "2024-01-09T23:00:00+00:00", "x")]
    assert got == ["0-7d", "8-30d", "unknown", "unknown"]


@pytest.mark.parametrize("available,n,expected", [
    ({"a": 10, "b": 10, "c": 10}, 9, {"a": 3, "b": 3, "c": 3}),
    ({"a": 1, "b": 10, "c": 10}, 9, {"a": 1, "b": 4, "c": 4}),
    ({"a": 5, "b": 5}, 10, {"a": 5, "b": 5}), ({"a": 10, "b": 10}, 5, {"a": 3, "b": 2})])
def test_even_allocation(available, n, expected):
    assert P.allocate_evenly(available, n) == expected


def test_allocation_of_too_few_is_an_error():
    with pytest.raises(ValueError):
        P.allocate_evenly({"a": 1}, 2)


@pytest.mark.parametrize("n", [3, 10, 40, 500])
def test_quotas_reach_the_target(spark, n):
    bins = [("b1", 30, 0.5), ("b2", 5, 0.3), ("b3", 50, 0.15), ("b4", 9, 0.05), ("b5", 9, 0.0)]
    weights = spark.createDataFrame(
        bins, "composite_bin STRING, available BIGINT, bin_weight DOUBLE")
    quotas = {r.composite_bin: r.quota for r in P.bin_quotas(weights, n).collect()}
    assert sum(quotas.values()) == min(n, 94)
    assert all(0 <= q <= dict((b[0], b[1]) for b in bins)[k] for k, q in quotas.items())
    assert "b5" not in quotas


def test_hot_stratum_sample_is_whole(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("id"), F.when(
        F.col("id") < 4900, "hot").otherwise("cold").alias("bin"))
    quotas = spark.createDataFrame([("hot", 700), ("cold", 20)], "bin STRING, quota BIGINT")
    got = P.sample_strata(df, quotas, ["bin"], 5)
    assert {r.bin: r["count"] for r in got.groupBy("bin").count().collect()} == {
        "hot": 700, "cold": 20}
    order = lambda i: hashlib.md5(f"{i}#5".encode()).hexdigest()
    want = sorted((f"k{i}" for i in range(4900)), key=order)[:700]
    assert {r.id for r in got.filter("bin = 'hot'").collect()} == set(want)


def test_conform_quarantines(spark):
    df = spark.createDataFrame([("s", "a", "2024-01-01", "1.5", 7), ("s", None, "2024-01-01", "1", 8),
                                ("s", "c", "2024-01-01", "x", 9)],
                               "source STRING, id STRING, date STRING, value STRING, more INT")
    accepted, quarantined = schemas.conform(df, schemas.SERIES)
    assert [(r.id, r.value, r.value_str, r.more) for r in accepted.collect()] == [("a", 1.5, None, 7)]
    assert quarantined.count() == 2


def test_run_files_and_anonymous_teams(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 5), "Org", "prov", "lab", "run", "zero-shot", "Anonymous 7")],
                               "d DATE, o STRING, p STRING, l STRING, r STRING, v STRING, t STRING")
    names = [X.run_file_name(*map(F.col, "doplrv"), test=test) for test in (False, True)]
    row = df.select(*names, X.anonymous_team_number(F.col("t"))).first()
    assert tuple(row) == ("2025-01-05.Org.prov.lab.run-zero-shot.json", "TEST.2025-01-05.Org.prov.lab.run-zero-shot.json", 7)


def test_price_series_and_nullified_questions(spark):
    day = lambda k: dt.date(2024, 1, k)
    daily = spark.createDataFrame([("a", day(1), 0.4), ("a", day(4), 0.6), ("b", day(1), 0.5)], "id STRING, date DATE, value DOUBLE")
    questions = spark.createDataFrame(
        [("a", True, "2024-01-03T10:00:00+00:00", 1.0, False), ("b", False, "N/A", None, True)],
        "id STRING, resolved BOOLEAN, market_info_resolution_datetime STRING, resolved_price DOUBLE, nullify_question BOOLEAN")
    got = {(r.id, r.date.day): r.value for r in Q.polymarket_series(daily, questions, questions.limit(0)).collect()}
    assert got[("a", 1)] == got[("a", 2)] == 0.4 and got[("a", 3)] == 1.0 and ("a", 4) not in got and got[("b", 1)] == 0.5
    assert {r.id: r.resolved for r in Q.resolve_nullified(questions).collect()} == {"a": True, "b": True}
