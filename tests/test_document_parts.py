"""Documents of many rows are written and read by several tasks."""

import os

import pytest

from probcast.sources import readers as R, writers as W
from tests.conftest import day
from pyspark.sql import functions as F


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(W, "PART_ROWS", 20, raising=False)


def test_large_question_set_is_a_folder_of_documents(spark, tmp_path, small_parts):
    sizes = {"2024-07-21": 100, "2024-08-04": 7}
    questions = spark.createDataFrame(
        [(day(d), "llm", "fred", f"q{i}", [7, 30]) for d, n in sizes.items() for i in range(n)],
        "forecast_due_date DATE, question_set STRING, source STRING, id STRING, forecast_horizons ARRAY<INT>")
    W.write_question_set(questions, str(tmp_path / "sets"))
    assert len([x for x in os.listdir(tmp_path / "sets" / "2024-07-21-llm.json") if not x.startswith(".")]) == 5
    assert os.path.isfile(tmp_path / "sets" / "2024-08-04-llm.json")
    assert R.latest_question_set(spark, str(tmp_path / "sets")) == "2024-08-04-llm.json"
    for name, n in sizes.items():
        back = R.read_question_set(spark, str(tmp_path / "sets"), f"{name}-llm.json").collect()
        assert sorted(r.ids[0] for r in back) == sorted(f"q{i}" for i in range(n))
        assert {r.question_set for r in back} == {f"{name}-llm.json"}


def test_large_submission_stays_one_file_of_the_list(spark, tmp_path, small_parts):
    forecasts = spark.createDataFrame(
        [("o", "mo", m, "2024-07-21-llm.json", day("2024-07-21"), "fred", [f"q{i}"], 0.5, "2024-07-28")
         for m in ("model", "TEST.model") for i in range(90)],
        "organization STRING, model_organization STRING, model STRING, question_set STRING, forecast_due_date DATE, "
        "source STRING, ids ARRAY<STRING>, forecast DOUBLE, resolution_date STRING")
    W.write_forecasts(forecasts, ["organization", "model_organization", "model", "question_set", "forecast_due_date"],
                      F.concat("model", F.lit(".json")), str(tmp_path / "f"))
    assert os.path.isdir(tmp_path / "f" / "2024-07-21" / "model.json")
    assert R.list_forecast_files(spark, str(tmp_path / "f"), day("2024-07-21")).count() == 1
    assert sorted(r.ids[0] for r in R.read_forecasts(spark, str(tmp_path / "f")).collect()) == sorted(
        f"q{i}" for i in range(90))


def test_lists_kept_as_text_are_read_from_the_document_in_memory(spark, tmp_path):
    """Dates come as list, as text of a list, as one date or as N/A; no list is fetched from the file again."""
    (tmp_path / "2024-07-21-llm.json").write_text("""{"forecast_due_date": "2024-07-21", "question_set": "2024-07-21-llm.json",
        "questions": [{"id": "a", "source": "FRED", "resolution_dates": ["2024-07-28",  "2024-08-20"], "freeze_datetime_value": "1.50"},
        {"id": ["b", "c"], "source": "fred", "resolution_dates": "[\\"2024-07-28\\"]"},
        {"id": "d", "source": "infer", "resolution_dates": "2024-07-28"}, {"id": "e", "source": "infer", "resolution_dates": "N/A"}]}""")
    back = R.read_question_set(spark, str(tmp_path), "2024-07-21-llm.json")
    assert "json" not in back._jdf.queryExecution().executedPlan().toString().lower().split("filescan")[1].split("[")[0]
    first, last = day("2024-07-28"), day("2024-08-20")
    assert [(r.ids, r.resolution_dates, r.freeze_datetime_value) for r in back.collect()] == [
        (["a"], [first, last], "1.50"), (["b", "c"], [first], None), (["d"], [first], None), (["e"], None, None)]
    (tmp_path / "2024-08-04-llm.json").write_text('{"forecast_due_date": "2024-08-04"}')
    with pytest.raises(Exception, match="no questions"):
        R.read_question_set(spark, str(tmp_path), "2024-08-04-llm.json").collect()
