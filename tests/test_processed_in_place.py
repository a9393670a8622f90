"""Processed forecasts are written where they are made."""

from pathlib import Path

from probcast.sources import writers as W
from tests.conftest import day, rows


def test_rows_of_one_submission_are_not_gathered(spark, tmp_path):
    """A large submission is written by all tasks that hold rows of it, not by one."""
    made = spark.range(0, 400, numPartitions=4).selectExpr(
        "'o' AS organization", "'mo' AS model_organization", "'m' AS model", "DATE '2024-01-11' + CAST(id % 2 AS INT) AS "
        "forecast_due_date", "CAST(id AS STRING) AS id", "id / 400D AS forecast")
    W.write_processed_forecasts(made, str(tmp_path / "out"))
    assert sorted(len(list(p.glob("part-*"))) for p in Path(tmp_path / "out").glob("forecast_due_date=*")) == [4, 4]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, *made.columns) == rows(made, *made.columns)
    W.write_processed_forecasts(made.filter("forecast_due_date = '2024-01-12'"), str(tmp_path / "out"))
    assert {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("forecast_due_date").count().collect()} == {
        day("2024-01-11"): 200, day("2024-01-12"): 200}
