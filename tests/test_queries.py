import os
import re
import subprocess
import sys

import duckdb
import pytest

from probcast.catalog import load
from probcast.sources.testtables import RAW_TABLES
from tools.check_queries import rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["daily_close_t5", "fill_values_t2", "value_as_of_j8", "resolve_market_combinations_r5_r6",
          "prepare_forecasts_f5", "bin_quotas_p4", "ensembles_a8_a9", "baseline_board_s9_s10_s21",
          "resolve_job_r10_r11_r12", "streamed_daily_close_st1", "mark_dropouts_t12", "page_questions_g2",
          "weather_questions_g4", "macro_questions_g5", "stock_questions_g6_u8", "infer_questions_g8",
          "straight_series_forecaster_b3", "keyed_upsert_u3", "stratified_sample_p5"]


def test_registry_names():
    registry = load()
    assert len(registry) > 150
    for name in registry:
        assert re.fullmatch(r"[a-z][a-z0-9_]+", name)
        assert "pipeline" not in name and not re.match(r"op\d+_", name)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    query = load()[name]
    connection = duckdb.connect()
    for table in RAW_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = connection.execute(query.sql)
    names = [c[0] for c in cursor.description]
    want = rows_of(names, cursor.fetchall())
    df = query.run(spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_registry_loads_without_a_session():
    """Queries and SQL can be listed before any Spark session exists."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
