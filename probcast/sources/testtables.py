"""Domain tables derived from the generic warehouse tables, for benchmarks and checks.

Each definition is one SELECT that Spark and DuckDB both read, so that a check compares operators,
not two versions of the input. ``{name}`` stands for a table. Question, series and forecast counts
grow with the tables: one dataset question per part, one market question per event user.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

# --- fixed choices -------------------------------------------------------------------------
AS_OF = date(2024, 3, 25)          # dataset series run 2024-01-01 .. 2024-03-23
TRADES_AS_OF = date(2024, 1, 31)   # trades run 2024-01-01 .. 2024-01-30
DUE_DATES = [date(2024, 1, 11), date(2024, 1, 25), date(2024, 2, 8)]
MARKET_DUE_DATES = [date(2024, 1, 8), date(2024, 1, 15)]
BENCHMARK_ORG = "Benchmark"
MODEL_COUNT = 12

_DAY = ("date_add(CAST('2024-01-01' AS DATE), CAST((year(l_shipdate) - 1995) * 12 "
        "+ month(l_shipdate) - 1 AS INT))")
_DUE = ("date_add(CAST('2024-01-11' AS DATE), CAST((l_linenumber % 3) * 14 AS INT))")

# Dataset sources that resolve by plain comparison.
_PLAIN = ("CASE l_partkey % 3 WHEN 0 THEN 'dbnomics' WHEN 1 THEN 'fred' ELSE 'yfinance' END")
_MARKET = ("CASE user_id % 4 WHEN 0 THEN 'infer' WHEN 1 THEN 'manifold' "
           "WHEN 2 THEN 'metaculus' ELSE 'polymarket' END")

DEFINITIONS: dict[str, str] = {
    # events -> trades: one row per fill
    "trades": f"""
        SELECT {_MARKET} AS source, concat('u', CAST(user_id AS STRING)) AS id, ts,
               event_id AS seq,
               (CAST(round(value * 100) AS BIGINT) % 101) / CAST(100 AS DOUBLE) AS value,
               event_type <> 'error' AS is_filled
        FROM {{events}}""",
    # events -> conflict events; the country is the user's, so the count of countries grows
    "conflict_events": """
        SELECT concat('C', CAST(user_id AS STRING)) AS country, CAST(ts AS DATE) AS event_date,
               event_type, CAST(round(value * 100) AS BIGINT) % 7 AS fatalities, event_id
        FROM {events}""",
    # lineitem -> daily values of one series per part
    "series": f"""
        SELECT {_PLAIN} AS source, concat('p', CAST(l_partkey AS STRING)) AS id, {_DAY} AS date,
               CAST(max(l_extendedprice) AS DOUBLE) AS value
        FROM {{lineitem}} GROUP BY 1, 2, 3""",
    # lineitem -> the dataset questions asked on each due date
    "dataset_questions": f"""
        SELECT DISTINCT {_PLAIN} AS source, concat('p', CAST(l_partkey AS STRING)) AS id,
               l_partkey AS part_no, {_DUE} AS forecast_due_date
        FROM {{lineitem}}""",
    # lineitem -> submitted dataset forecasts, some of them unusable
    "dataset_forecasts": f"""
        SELECT concat('m', CAST(l_suppkey % {MODEL_COUNT} AS STRING)) AS model_no,
               CASE WHEN l_linenumber = 7 THEN upper({_PLAIN}) ELSE {_PLAIN} END AS source,
               concat('p', CAST(l_partkey AS STRING)) AS id, {_DUE} AS forecast_due_date,
               date_add({_DUE}, CAST(CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 7 WHEN 1 THEN 30
                   WHEN 2 THEN 90 WHEN 3 THEN 180 WHEN 4 THEN 365 ELSE 8 END AS INT))
                   AS resolution_date,
               CASE WHEN l_tax > 0.07 THEN NULL WHEN l_tax > 0.06 THEN 1.5 ELSE
                   CAST(round(abs(l_discount) * 100) AS INT) / CAST(10 AS DOUBLE) END AS forecast,
               l_orderkey, l_linenumber
        FROM {{lineitem}}""",
    # events -> submitted market forecasts, one per model, question and due date
    "market_forecasts": f"""
        SELECT concat('m', CAST(event_id % {MODEL_COUNT} AS STRING)) AS model_no,
               {_MARKET} AS source, concat('u', CAST(user_id AS STRING)) AS id,
               date_add(CAST('2024-01-08' AS DATE), CAST((CAST(floor(event_id / 12) AS BIGINT) % 2) * 7 AS INT))
                   AS forecast_due_date,
               min((CAST(round(value * 10) AS BIGINT) % 101) / CAST(100 AS DOUBLE)) AS forecast
        FROM {{events}} GROUP BY 1, 2, 3, 4""",
    # events -> market questions
    "market_questions": f"""
        SELECT DISTINCT {_MARKET} AS source, concat('u', CAST(user_id AS STRING)) AS id,
               user_id AS user_no,
               concat('https://markets.example/', CAST(user_id AS STRING)) AS url,
               user_id % 3 = 0 AS resolved,
               concat(CAST(date_add(CAST('2024-01-12' AS DATE), CAST(user_id % 16 AS INT)) AS STRING),
                      'T12:00:00Z') AS market_info_close_datetime,
               CASE WHEN user_id % 5 = 0 THEN 'N/A' ELSE
               concat(CAST(date_add(CAST('2024-01-10' AS DATE), CAST(user_id % 19 AS INT)) AS STRING),
                      'T08:30:00Z') END AS market_info_resolution_datetime
        FROM {{events}}""",
    # orders -> candidate questions for sampling
    "sample_questions": """
        SELECT concat('o', CAST(o_orderkey AS STRING)) AS id, o_orderkey % 9 AS source_no,
               o_custkey % 9 AS category_no,
               (CAST(round(o_totalprice * 100) AS BIGINT) % 101) / CAST(100 AS DOUBLE)
                   AS freeze_value,
               date_add(CAST(o_orderdate AS DATE), CAST((o_custkey * 7) % 500 AS INT))
                   AS close_date,
               o_orderstatus = 'F' AS resolved, o_orderkey % 20 <> 0 AS valid_question
        FROM {orders}""",
    # lineitem -> free response text
    "responses": """
        SELECT l_orderkey, l_linenumber, l_partkey,
               CASE l_linenumber % 4
                 WHEN 0 THEN concat('*0.', lpad(CAST(CAST(l_quantity AS INT) AS STRING), 2, '0'), '*')
                 WHEN 1 THEN concat(' 0.', lpad(CAST(CAST(l_quantity AS INT) AS STRING), 2, '0'))
                 WHEN 2 THEN 'no number' ELSE '' END AS response
        FROM {lineitem}""",
    # models: five of the benchmark's own, six LLM entries, one external team
    "model_dim": """
        SELECT concat('m', CAST(n AS STRING)) AS model_no, n AS model_rank,
               CASE WHEN n = 11 THEN 'Team' ELSE 'Benchmark' END AS organization,
               CASE WHEN n < 5 THEN 'Benchmark' WHEN n = 11 THEN 'Team'
                    ELSE concat('Lab', CAST(n % 3 AS STRING)) END AS model_organization,
               CASE n WHEN 0 THEN 'Always 0.5' WHEN 1 THEN 'Naive Forecaster'
                    WHEN 2 THEN 'Imputed Forecaster' WHEN 3 THEN 'Superforecaster median forecast'
                    WHEN 4 THEN 'Public median forecast'
                    ELSE concat('model-', CAST(n AS STRING)) END AS model,
               CASE WHEN n BETWEEN 5 AND 10 THEN concat('run-', CAST(n AS STRING)) END
                    AS model_run_key,
               CASE WHEN n BETWEEN 5 AND 10 THEN CASE WHEN n % 2 = 0 THEN 'zero-shot'
                    ELSE 'zero-shot-with-freeze-values' END END AS forecast_variant_key,
               n = 10 AS uses_tools,
               CASE WHEN n BETWEEN 5 AND 10 THEN
                    date_add(CAST('2023-04-01' AS DATE), CAST((n - 5) * 50 AS INT)) END
                    AS release_date
        FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS t(n)""",
}

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A domain table as a lazy DataFrame over the warehouse files."""
    text = DEFINITIONS[name]
    used = {t: raw(spark, folder, t) for t in RAW_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql(name: str) -> str:
    """The same table as a parenthesised sub-query over the plain table names."""
    text = DEFINITIONS[name]
    for raw_name in RAW_TABLES:
        text = text.replace("{" + raw_name + "}", raw_name)
    return f"({text})"
