"""The resolve job reads each series only for the sources that resolve by it."""

import pytest
from pyspark.sql import functions as F

from probcast.operators import resolve
from tests.conftest import day


def test_each_family_reads_its_own_series(spark, monkeypatch):
    seen = {}
    for name in ("resolve_dataset", "resolve_market"):
        own = getattr(resolve, name)

        def watch(rows, *rest, _name=name, _own=own, **more):
            table = next(x for x in rest if "value" in x.columns)
            seen[_name] = {r.source for r in table.select("source").distinct().collect()}
            return _own(rows, *rest, **more)

        monkeypatch.setattr(resolve, name, watch)
    due = day("2024-01-10")
    series = spark.createDataFrame(
        [(s, "a", day(f"2024-01-{10 + k}"), float(k)) for s in ("fred", "infer", "wikipedia") for k in range(9)],
        "source STRING, id STRING, date DATE, value DOUBLE")
    exploded = spark.createDataFrame(
        [("fred", ["a"], [], due, day("2024-01-17")), ("infer", ["a"], [], due, None)],
        "source STRING, ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, resolution_date DATE")
    questions = spark.createDataFrame(
        [("fred", "a"), ("infer", "a")], "source STRING, id STRING").withColumns({
            "resolved": F.lit(False), "url": F.lit("u"), "market_info_close_datetime": F.lit("2024-03-01T00:00:00Z"),
            "market_info_resolution_datetime": F.lit("N/A")})
    empty = lambda schema: spark.createDataFrame([], schema)
    out, _ = resolve.resolve_all(
        exploded, questions, series, empty("source STRING, id STRING, start_date DATE"), day("2024-01-19"),
        conflict_events=empty("country STRING, event_date DATE, event_type STRING, fatalities BIGINT"),
        conflict_attributes=empty("id STRING, key STRING, country STRING, metric STRING"),
        page_attributes=empty("id STRING, question_type STRING"), page_remaps=empty("old_id STRING, new_id STRING"))
    got = {r.source: r.resolved_to for r in out.collect()}
    assert got == {"fred": 1.0, "infer": 8.0}
    assert seen == {"resolve_dataset": {"fred"}, "resolve_market": {"infer"}}
    with pytest.raises(ValueError, match="missing series"):
        resolve.check_question_bank(exploded.withColumn("ids", F.array(F.lit("b"))), questions, series,
                                    empty("country STRING"))
