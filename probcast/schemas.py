"""Declared table schemas (DDL text), and conforming a frame to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

QUESTION = (
    "source STRING NOT NULL, id STRING NOT NULL, question STRING, background STRING, url STRING, "
    "resolved BOOLEAN NOT NULL, forecast_horizons ARRAY<INT>, freeze_datetime_value STRING, "
    "freeze_datetime_value_explanation STRING, market_info_resolution_criteria STRING, "
    "market_info_open_datetime STRING, market_info_close_datetime STRING, "
    "market_info_resolution_datetime STRING"
)
SERIES = (
    "source STRING NOT NULL, id STRING NOT NULL, date DATE NOT NULL, value DOUBLE, value_str STRING"
)
QUESTION_SET = (
    "forecast_due_date DATE, source STRING, ids ARRAY<STRING>, resolution_dates ARRAY<DATE>"
)
EXPLODED = (
    "source STRING NOT NULL, ids ARRAY<STRING> NOT NULL, direction ARRAY<INT> NOT NULL, "
    "forecast_due_date DATE NOT NULL, resolution_date DATE"
)
RESOLVED = (
    "source STRING, ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, "
    "resolution_date DATE, resolved BOOLEAN, resolved_to DOUBLE, "
    "market_value_on_due_date DOUBLE, market_value_on_due_date_minus_one DOUBLE"
)
FORECAST = (
    "organization STRING, model_organization STRING, model STRING, source STRING, "
    "ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, resolution_date DATE, "
    "forecast DOUBLE"
)
METADATA = ("source STRING, id STRING, category STRING, valid_question BOOLEAN")
MODEL_DIM = (
    "model_pk STRING, organization STRING, model_organization STRING, model STRING, "
    "model_run_key STRING, forecast_variant_key STRING, uses_tools BOOLEAN, release_date DATE"
)
CONFLICT_EVENT = (
    "event_id_cnty STRING, event_date STRING, iso INT, region STRING, country STRING, "
    "admin1 STRING, event_type STRING, fatalities INT, timestamp BIGINT"
)
FETCH_PRICES = (
    "id STRING, probability DOUBLE, fetch_datetime STRING, nullify_question BOOLEAN, "
    "historical_prices ARRAY<STRUCT<date: STRING, value: DOUBLE>>"
)
NULLIFIED = ("source STRING, id STRING, start_date DATE")

# Texts that stand for "no value" in the stored files.
NULL_TEXTS = ["N/A", "NA", "nan", ""]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """Typed empty frame, for files that do not exist yet."""
    return spark.createDataFrame([], schema)


def null_text_to_null(column):
    """One null for the several texts that mean 'no value'."""
    return F.when(F.trim(column).isin(NULL_TEXTS), F.lit(None)).otherwise(column)


def conform(df: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Coerce ``df`` to ``schema`` and split it into (accepted, quarantined).

    Declared columns are cast with ``try_cast`` (missing ones become typed nulls), undeclared
    columns pass through. A row is quarantined when a declared non-null field is null, or when a
    present value cannot be cast.
    """
    declared = StructType.fromDDL(schema)
    present = set(df.columns)
    fields = list(declared.fields)
    extras = [name for name in df.columns if name not in set(declared.fieldNames())]
    cast_columns, problems = [], []
    for field in fields:
        if field.name in present:
            raw = F.col(field.name)
            same_type = df.schema[field.name].dataType == field.dataType
            cast = raw if same_type else raw.try_cast(field.dataType)
            if not same_type:
                problems.append(
                    F.when(raw.isNotNull() & cast.isNull(), F.lit(f"{field.name}: bad type"))
                )
        else:
            cast = F.lit(None).cast(field.dataType)
        if not field.nullable:
            problems.append(F.when(cast.isNull(), F.lit(f"{field.name}: null")))
        cast_columns.append(cast.alias(field.name))
    violations = F.filter(F.array(*problems), lambda p: p.isNotNull()) if problems else F.array()
    checked = df.select(
        *cast_columns, *[F.col(name) for name in extras], violations.alias("_violations")
    )
    accepted = checked.filter(F.size("_violations") == 0).drop("_violations")
    quarantined = checked.filter(F.size("_violations") > 0)
    return accepted, quarantined
