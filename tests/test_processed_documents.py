"""Processed documents: their lines travel once, and they can be compressed."""

import gzip
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from probcast.sources import writers as W
from tests.conftest import day


@pytest.fixture
def processed(spark):
    return spark.createDataFrame(
        [("o", "mo", m, day("2024-07-21"), "fred", [f"q{i:03}"], None, day("2024-07-28"), i / 90, True, 1.0, i % 2 == 0)
         for m in ("one", "two") for i in range(90)],
        "organization STRING, model_organization STRING, model STRING, forecast_due_date DATE, source STRING, ids ARRAY<STRING>, "
        "direction ARRAY<INT>, resolution_date DATE, forecast DOUBLE, resolved BOOLEAN, resolved_to DOUBLE, imputed BOOLEAN")


def test_lines_travel_once(processed):
    rows = processed.withColumn("_ids", F.to_json("ids"))
    lines = W.document_lines(rows, F.col("model"), ["model"], [F.col("source")], "forecasts", ["source", "_ids"])
    sent = []
    saved = lines.sortWithinPartitions("file_name", "place").select("file_name", "value")
    for plan in (lines, saved):
        text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        sent.append(len(re.findall(r"Exchange hashpartitioning\(file_name", text)))
    assert sent == [1, 1]
    places = [r.place for r in lines.filter("file_name = 'one.json'").orderBy("place").collect()]
    assert places == [*range(91), W.END]


def test_lines_are_saved_without_another_exchange(spark, processed, tmp_path, monkeypatch):
    plans = []
    text = type(processed.write).text
    monkeypatch.setattr(type(processed.write), "text", lambda self, *a, **k: plans.append(self._df) or text(self, *a, **k))
    W.write_processed_documents(processed, F.col("model"), str(tmp_path / "d"))
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(file_name", plan)) == 1


@pytest.mark.parametrize("part_rows,compression", [(250_000, None), (250_000, "gzip"), (20, "gzip")])
def test_documents_are_whole(spark, processed, tmp_path, monkeypatch, part_rows, compression):
    monkeypatch.setattr(W, "PART_ROWS", part_rows)
    W.write_processed_documents(processed, F.col("model"), str(tmp_path / "d"), **(
        {"compression": compression} if compression else {}))
    ending = ".json.gz" if compression else ".json"
    files = [p for p in Path(tmp_path / "d" / "2024-07-21").rglob(f"*{ending}") if p.is_file() and not p.name.startswith(".")]
    found = []
    for p in files:
        document = json.loads((gzip.decompress(p.read_bytes()) if compression else p.read_bytes()).decode())
        ids = [f["id"] for f in document["forecasts"]]
        assert ids == sorted(ids)
        found += [(document["model"], i) for i in ids]
    assert len(files) == (2 if part_rows > 90 else 10)
    assert sorted(found) == [(m, f"q{i:03}") for m in ("one", "two") for i in range(90)]
    back = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").json(str(tmp_path / "d"))
    assert back.select(F.explode("forecasts")).count() == 180
