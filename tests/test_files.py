import json
import os

import pytest
from pyspark.sql import functions as F

from probcast.sources import readers as R, writers as W
from tests.conftest import day


def put(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as handle:
        handle.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def test_bad_series_file_is_skipped_whole(spark, tmp_path):
    base = str(tmp_path / "bank")
    put(f"{base}/fred/good.jsonl", {"id": "g", "date": "2024-01-01", "value": 1.5},
        {"id": "g", "date": "2024-01-02T00:00:00Z", "value": "N/A"})
    put(f"{base}/fred/bad.jsonl", {"id": "b", "date": "2024-01-01", "value": 1}, "{broken")
    put(f"{base}/fred/hash_mapping.json", {"x": {}})
    rows, skipped = R.read_resolutions(spark, base)
    assert sorted((r.source, r.id, r.date, r.value) for r in rows.collect()) == [
        ("fred", "g", day("2024-01-01"), 1.5), ("fred", "g", day("2024-01-02"), None)]
    assert [os.path.basename(r.file) for r in skipped.collect()] == ["bad.jsonl"]
    assert {r.id for r in R.existing_series_ids(spark, base).collect()} == {"good", "bad"}
    os.remove(f"{base}/fred/good.jsonl")
    with pytest.raises(ValueError):
        R.read_resolutions(spark, base)


def test_question_file(spark, tmp_path):
    path = str(tmp_path / "q.jsonl")
    put(path, {"id": "a", "resolved": False, "forecast_horizons": [7, 30]},
        {"id": "b", "resolved": True, "forecast_horizons": "N/A"})
    got = {r.id: r.forecast_horizons for r in R.read_questions(spark, path, "fred").collect()}
    assert got == {"a": [7, 30], "b": None}
    put(path)
    with pytest.raises(ValueError):
        R.read_questions(spark, path, "fred")


SET = {"forecast_due_date": "2024-07-21", "question_set": "2024-07-21-llm.json", "questions": [
    {"id": "a", "source": "fred", "resolution_dates": ["2024-07-28"]},
    {"id": ["a", "b"], "source": "fred", "resolution_dates": ["2024-07-28"]},
    {"id": "m", "source": "infer", "resolution_dates": "N/A"}]}


def test_question_set(spark, tmp_path):
    base = str(tmp_path)
    put(f"{base}/2024-07-21-llm.json", json.dumps(SET, indent=1))
    put(f"{base}/2024-08-04-llm.json", json.dumps({**SET, "forecast_due_date": "2024-08-04"}))
    got = {tuple(r.ids): r.resolution_dates
           for r in R.read_question_set(spark, base, "2024-07-21-llm.json").collect()}
    assert got == {("a",): [day("2024-07-28")], ("a", "b"): [day("2024-07-28")], ("m",): None}
    assert R.latest_question_set(spark, base) == "2024-08-04-llm.json"
    put(f"{base}/latest-llm.json", "2024-07-21-llm.json")
    assert R.latest_question_set(spark, base) == "2024-07-21-llm.json"
    with pytest.raises(ValueError):
        R.read_question_set(spark, base, "../x.json")
    put(f"{base}/2024-09-01-llm.json", json.dumps({"forecast_due_date": "2024-09-01"}))
    with pytest.raises(ValueError):
        R.read_question_set(spark, base, "2024-09-01-llm.json")


def submission(**extra):
    base = {"organization": "o", "model": "m", "model_organization": "o",
            "question_set": "2024-07-21-llm.json", "forecasts": [
                {"id": "a", "source": "fred", "forecast": 0.5, "resolution_date": "2024-07-28",
                 "reasoning": "x", "direction": None},
                {"id": ["a", "b"], "source": "fred", "forecast": 0.4,
                 "resolution_date": "2024-07-28", "direction": [1, -1]}]}
    return json.dumps({**base, **extra})


def test_forecast_files(spark, tmp_path):
    base = str(tmp_path / "f")
    put(f"{base}/2024-07-21/one.json", submission())
    put(f"{base}/2024-07-21/TEST.two.json", submission(model="test"))
    put(f"{base}/2024-07-21/three.json", submission(question_set="no date"))
    put(f"{base}/2024-07-21/four.json", submission(model=None))
    got = R.read_forecasts(spark, base).collect()
    assert sorted((tuple(r.ids), tuple(r.direction), r.forecast_due_date) for r in got) == [
        (("a",), (), day("2024-07-21")), (("a", "b"), (1, -1), day("2024-07-21"))]
    assert all(r.leaderboard_eligible for r in got)
    files = R.list_forecast_files(spark, base)
    assert files.count() == 3
    assert R.list_forecast_files(spark, base, day("2025-01-01")).count() == 0
    put(f"{base}/notes/five.json", submission())
    with pytest.raises(ValueError):
        R.list_forecast_files(spark, base)


def test_missing_files_give_typed_empty_frames(spark, tmp_path):
    got = R.load_source(spark, str(tmp_path), "fred", questions=True, resolutions=True, fetch=True)
    assert set(got) == {"questions", "resolutions", "fetch"}
    assert all(df.isEmpty() for df in got.values())
    assert R.read_hash_mapping(spark, str(tmp_path / "none.json")).isEmpty()
    assert R.read_metadata(spark, str(tmp_path / "none.jsonl")).isEmpty()


def test_freshness(spark, tmp_path):
    import datetime as dt

    path = str(tmp_path / "q.jsonl")
    put(path, {"id": "a"})
    today = dt.datetime.now(dt.timezone.utc).date()
    R.check_fresh(spark, [path], today)
    with pytest.raises(ValueError):
        R.check_fresh(spark, [path], today + dt.timedelta(days=1))


def test_legacy_board(spark, tmp_path):
    path = str(tmp_path / "board.csv")
    put(path, "Organization,Model,Dataset Score (N=5),Market Score (N=3),Overall Score,"
        "Confidence Interval,p-value",
        'o,m,0.1,0.2,0.15,"[0.1, 0.2]",<0.001', 'o,n,0.1,0.2,0.15,"[0.1, 0.2]",0.25')
    got = R.read_legacy_board(spark, path).collect()
    assert [(r.dataset, r.overall, r.ci_lower, r.ci_upper, r.p_value) for r in got] == [
        (0.1, 0.15, 0.1, 0.2, "<0.001"), (0.1, 0.15, 0.1, 0.2, "0.250")]


def test_resolution_set_document(spark, tmp_path):
    df = spark.createDataFrame(
        [("fred", ["a"], [], day("2024-07-21"), day("2024-07-28"), True, 1.0),
         ("fred", ["a", "b"], [1, -1], day("2024-07-21"), day("2024-07-28"), True, 0.0)],
        "source STRING, ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, "
        "resolution_date DATE, resolved BOOLEAN, resolved_to DOUBLE")
    W.write_resolution_set(df, str(tmp_path / "sets"))
    with open(tmp_path / "sets" / "2024-07-21_resolution_set.json") as handle:
        doc = json.load(handle)
    assert doc["forecast_due_date"] == "2024-07-21"
    assert [(r["id"], r["direction"], r["resolution_date"]) for r in doc["resolutions"]] == [
        ('["a","b"]', [1, -1], "2024-07-28"), ("a", None, "2024-07-28")]


def test_parity_document_and_fetch(spark, tmp_path):
    parity = spark.createDataFrame(
        [("dataset", "May 2026", "June 2028", "July 2027"), ("market", None, None, None)],
        "question_type STRING, lower STRING, upper STRING, intersection STRING")
    doc = json.loads(W.parity_document(parity, "baseline").first().value)
    assert doc["dataset"]["baseline"]["lower"] == "May 2026"
    assert doc["market"].get("baseline") is None
    W.write_fetch(parity, str(tmp_path / "fetch"))
    assert spark.read.json(str(tmp_path / "fetch")).count() == 2


def test_series_files_replace_only_their_sources(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = spark.createDataFrame([("a", "1", day("2024-01-01"), 1.0), ("b", "1", day("2024-01-01"), 2.0)],
                                 "source STRING, id STRING, date DATE, value DOUBLE")
    W.write_series(rows, path)
    W.write_series(rows.filter("source = 'a'").withColumn("value", F.lit(9.0)), path)
    got = {r.source: r.value for r in spark.read.parquet(path).collect()}
    assert got == {"a": 9.0, "b": 2.0}


def test_written_files_read_back(spark, tmp_path):
    base = str(tmp_path)
    questions = spark.createDataFrame(
        [(day(d), "llm", "fred", f"q{i}", [7, 30]) for d in ("2024-07-21", "2024-08-04") for i in range(30)],
        "forecast_due_date DATE, question_set STRING, source STRING, id STRING, forecast_horizons ARRAY<INT>")
    W.write_question_set(questions, f"{base}/sets")
    assert R.latest_question_set(spark, f"{base}/sets") == "2024-08-04-llm.json"
    back = R.read_question_set(spark, f"{base}/sets", "2024-07-21-llm.json").collect()
    assert sorted(r.ids[0] for r in back) == sorted(f"q{i}" for i in range(30))
    assert all(r.resolution_dates == [day("2024-07-28"), day("2024-08-20")] for r in back)
    assert {r.question_set for r in back} == {"2024-07-21-llm.json"}
    forecasts = spark.createDataFrame(
        [("o", "m o", f"model {k}", "2024-07-21-llm.json", day("2024-07-21"), "fred", [f"q{i}"], 0.5, "2024-07-28")
         for k in range(3) for i in range(20)],
        "organization STRING, model_organization STRING, model STRING, question_set STRING, forecast_due_date DATE, "
        "source STRING, ids ARRAY<STRING>, forecast DOUBLE, resolution_date STRING")
    W.write_forecasts(forecasts, ["organization", "model_organization", "model", "question_set", "forecast_due_date"],
                      F.concat(F.lit("a%b "), "model", F.lit(".json")), f"{base}/forecasts")
    names = [x for x in os.listdir(f"{base}/forecasts/2024-07-21") if not x.startswith(".")]
    assert sorted(names) == [f"a%b model {k}.json" for k in range(3)]
    assert R.read_forecasts(spark, f"{base}/forecasts").count() == 60
    assert R.list_forecast_files(spark, f"{base}/forecasts", day("2024-07-21")).count() == 3


def test_series_read_back_in_both_forms(spark, tmp_path):
    rows = spark.createDataFrame(
        [(s, i, day("2024-01-01"), v) for s in ("fred", "acled") for i, v in (("a/b +c", 1.5), ("d", None))],
        "source STRING, id STRING, date DATE, value DOUBLE")
    want = sorted(((r.source, r.id, r.date, r.value) for r in rows.collect()), key=repr)
    for name, write in (("by_source", lambda p: W.write_series(rows, p, "json")),
                        ("by_question", lambda p: W.write_series_per_question(rows, p))):
        path = str(tmp_path / name)
        write(path)
        got, skipped = R.read_resolutions(spark, path)
        assert sorted(((r.source, r.id, r.date, r.value) for r in got.collect()), key=repr) == want
        assert skipped.isEmpty()
    assert {r.id for r in R.existing_series_ids(spark, str(tmp_path / "by_question")).collect()} == {"a/b +c", "d"}
