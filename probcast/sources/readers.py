"""Readers of the stored file formats. Everything stays lazy unless a check must fail early.

JSON fields that hold "a text or a list" are read as text and then parsed, so one declared schema
fits all files and nothing is inferred.
"""

from __future__ import annotations

import json
from datetime import date
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from probcast import schemas as S
from probcast.functions.dates import mixed_date
from probcast.operators.skew import require_no_rows

CORRUPT = "_corrupt"
DATE_IN_NAME = r"(\d{4}-\d{2}-\d{2})"
REQUIRED_ENVELOPE = ["organization", "model", "model_organization", "question_set", "forecasts"]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = filesystem.globStatus(jvm_path)
    return matches is not None and len(matches) > 0


def text_or_list(text: Column, kind: str = "array<string>") -> Column:
    """Array from a field that holds a JSON list, or one plain text; null texts become null."""
    bare = S.null_text_to_null(text)
    listed = F.from_json(bare, kind)
    if kind == "array<string>":
        return F.when(bare.startswith("["), listed).when(bare.isNotNull(), F.array(bare))
    return F.when(bare.startswith("["), listed)


def document_name(path: Column) -> Column:
    """Path of a document; that of a part of a large one is its document's."""
    return F.regexp_replace(path, r"\.json/part-\d+\.json$", ".json")


# --- question bank ---------------------------------------------------------------------------

_QUESTION_FILE = (
    "id STRING, question STRING, background STRING, url STRING, resolved BOOLEAN, "
    "forecast_horizons STRING, freeze_datetime_value STRING, "
    "freeze_datetime_value_explanation STRING, market_info_resolution_criteria STRING, "
    "market_info_open_datetime STRING, market_info_close_datetime STRING, "
    "market_info_resolution_datetime STRING"
)


def read_questions(spark: SparkSession, path: str, source: str, check: bool = True) -> DataFrame:
    """JSON-lines question file of one source; an empty file is an error."""
    df = spark.read.schema(_QUESTION_FILE).json(path).withColumns({
        "source": F.lit(source),
        "forecast_horizons": text_or_list(F.col("forecast_horizons"), "array<int>"),
        "resolved": F.coalesce("resolved", F.lit(False)),
    })
    if check and df.isEmpty():
        raise ValueError(f"no questions in {path}")
    return df.select(*StructType.fromDDL(S.QUESTION).fieldNames())


def read_resolutions(spark: SparkSession, folder: str, check: bool = True
                     ) -> tuple[DataFrame, DataFrame]:
    """Series files under ``<folder>/<source>/`` or ``<folder>/source=<source>/``, with one question
    or several: (rows, skipped files).

    A file with any unreadable row, or a row without id or date, is skipped as a whole; when no
    file is left the read is an error.
    """
    raw = (
        spark.read.schema(f"id STRING, date STRING, value STRING, {CORRUPT} STRING")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", SERIES_FILES)
        .json(folder)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    parsed = raw.withColumn("day", mixed_date(F.col("date")))
    bad = F.col(CORRUPT).isNotNull() | F.col("id").isNull() | F.col("day").isNull()
    skipped = parsed.groupBy("file").agg(F.bool_or(bad).alias("_bad")).filter("_bad").select(
        "file")
    text = S.null_text_to_null(F.col("value"))
    rows = parsed.join(skipped, "file", "left_anti").select(
        _series_source(F.col("file")).alias("source"), "id",
        F.col("day").alias("date"), text.try_cast("double").alias("value"),
        text.alias("value_str"))
    if check and rows.isEmpty():
        raise ValueError(f"no readable series under {folder}")
    return rows, skipped


def read_conflict_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw conflict events; two known wrong year prefixes are repaired."""
    fixed = F.regexp_replace(
        F.regexp_replace("event_date", r"^0025-", "2025-"), r"^0024-", "2024-")
    return spark.read.schema(S.CONFLICT_EVENT).json(path).withColumn(
        "event_date", F.to_date(F.substring(fixed, 1, 10)))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return S.empty(spark, S.METADATA)
    return spark.read.schema(S.METADATA).json(path)


def read_hash_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(id, attrs MAP) from one JSON object; a missing file gives an empty frame."""
    if not path_exists(spark, path):
        return S.empty(spark, "id STRING, attrs MAP<STRING,STRING>")
    text = spark.read.option("wholetext", "true").text(path)
    parsed = F.from_json("value", "map<string,map<string,string>>")
    return text.select(F.explode(parsed).alias("id", "attrs"))


def load_source(spark: SparkSession, folder: str, source: str, *, questions: bool = False,
                resolutions: bool = False, fetch: bool = False) -> dict[str, DataFrame]:
    """Tables of a source by file name; a missing file gives a typed empty frame."""
    wanted = {
        "questions": (questions, _QUESTION_FILE), "fetch": (fetch, S.FETCH_PRICES),
        "resolutions": (resolutions, "id STRING, date STRING, value STRING"),
    }
    out = {}
    for name, (use, schema) in wanted.items():
        if not use:
            continue
        path = f"{folder}/{source}_{name}.jsonl"
        out[name] = (spark.read.schema(schema).json(path) if path_exists(spark, path)
                     else S.empty(spark, schema))
    return out


# Series are ``<id>.jsonl`` or parts that this library wrote; other JSON files are not series.
SERIES_FILES = "{*.jsonl,part-*.json}"


def _series_source(file: Column) -> Column:
    """Source of a series file: its folder, or the partition folder that names it."""
    return F.regexp_extract(F.regexp_replace(file, r"/question=[^/]*/", "/"), r"/(?:source=)?([^/]+)/[^/]+$", 1)


def existing_series_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that have a series file of their own, even an empty one."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", SERIES_FILES).option(
        "recursiveFileLookup", "true").load(folder)
    named = F.regexp_extract("path", r"/question=([^/]+)/[^/]+$", 1)
    decoded = F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))
    name = F.when(named != "", decoded).otherwise(F.regexp_extract("path", r"/([^/]+)\.jsonl$", 1))
    return listed.select(name.alias("id")).filter("id <> ''").distinct()


def series_for(series: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the series of the wanted ids."""
    return series.join(ids.select("id").distinct(), "id", "left_semi")


def check_fresh(spark: SparkSession, paths: list[str], as_of: date) -> None:
    """Market question files must have been written on ``as_of``."""
    stamps = spark.read.format("binaryFile").load(paths).groupBy("path").agg(
        F.max("modificationTime").cast("date").alias("day"))
    require_no_rows(stamps.filter(F.col("day") != F.lit(as_of)), "question file is not from today")


# --- question sets ---------------------------------------------------------------------------

_QUESTION_SET_FILE = (
    "forecast_due_date STRING, question_set STRING, "
    "questions ARRAY<STRUCT<id: STRING, source: STRING, question: STRING, background: STRING, "
    "url: STRING, freeze_datetime_value: STRING, market_info_resolution_criteria: STRING, "
    "market_info_close_datetime: STRING, resolution_criteria: STRING, resolution_dates: STRING>>"
)


def check_relative(name: str) -> str:
    """A question set is named by a plain relative file name."""
    path = PurePosixPath(name)
    if path.is_absolute() or len(path.parts) != 1 or ".." in path.parts:
        raise ValueError(f"question set name must be relative: {name}")
    return name


def read_question_set(spark: SparkSession, folder: str, name: str, check: bool = True
                      ) -> DataFrame:
    """Question set file(s), one row per question; a file without questions is an error.

    A document is parsed from its text: the JSON reader goes back to the file for each list that is to be
    kept as text (``resolution_dates``), which reads a block of the file per question.
    """
    files = spark.read.text(f"{folder}/{check_relative(name)}", wholetext=True).select(
        F.from_json("value", _QUESTION_SET_FILE).alias("_d")).select("_d.*")
    if check:
        require_no_rows(files.filter(F.col("questions").isNull()).select("question_set"),
                        "no questions in question set")
    due = F.to_date("forecast_due_date")
    return files.select(
        due.alias("forecast_due_date"),
        F.coalesce("question_set", F.concat("forecast_due_date", F.lit("-llm.json"))).alias(
            "question_set"),
        F.explode("questions").alias("q")).select(
        "forecast_due_date", "question_set", F.lower("q.source").alias("source"),
        text_or_list(F.col("q.id")).alias("ids"),
        F.transform(text_or_list(F.col("q.resolution_dates")), lambda d: F.to_date(d)).alias(
            "resolution_dates"),
        *[F.col(f"q.{c}").alias(c) for c in (
            "question", "background", "url", "freeze_datetime_value",
            "market_info_resolution_criteria", "market_info_close_datetime",
            "resolution_criteria")])


def latest_question_set(spark: SparkSession, folder: str, kind: str = "llm") -> str:
    """File name of the newest set: the pointer file when it names one, else the greatest date."""
    pointer = f"{folder}/latest-{kind}.json"
    if path_exists(spark, pointer):
        text = spark.read.option("wholetext", "true").text(pointer).first().value.strip()
        if text.endswith(".json") and "{" not in text:
            return check_relative(text)
        due = json.loads(text).get("forecast_due_date") if text.startswith("{") else None
        if due:
            return f"{due}-{kind}.json"
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option(
        "recursiveFileLookup", "true").load(folder).select(
        F.regexp_extract(document_name(F.col("path")), rf"/({DATE_IN_NAME[1:-1]}-{kind}\.json)$", 1).alias("name"))
    newest = names.filter("name <> ''").agg(F.max("name").alias("n")).first().n
    if newest is None:
        raise ValueError(f"no question set in {folder}")
    return newest


# --- forecasts -------------------------------------------------------------------------------

_FORECAST_FILE = (
    "organization STRING, model STRING, model_organization STRING, question_set STRING, "
    "forecast_due_date STRING, leaderboard_eligible BOOLEAN, model_run_key STRING, "
    "forecast_variant_key STRING, uses_tools BOOLEAN, "
    "forecasts ARRAY<STRUCT<id: STRING, source: STRING, forecast: DOUBLE, "
    "resolution_date: STRING, direction: STRING, resolved: BOOLEAN, resolved_to: DOUBLE, "
    "imputed: BOOLEAN>>"
)


def list_forecast_files(spark: SparkSession, folder: str, only: date | None = None,
                        check: bool = True) -> DataFrame:
    """(file, forecast_due_date) of submissions; test files are left out, a bad folder is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option(
        "recursiveFileLookup", "true").load(folder).select(
        document_name(F.col("path")).alias("file")).distinct().select(
        "file", F.try_to_date(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)).alias("forecast_due_date"))
    files = files.filter(~F.regexp_extract("file", r"([^/]+)$", 1).startswith("TEST."))
    if check:
        require_no_rows(files.filter("forecast_due_date is null"), "folder is not a date")
    return files if only is None else files.filter(F.col("forecast_due_date") == F.lit(only))


def read_forecasts(spark: SparkSession, folder: str, processed: bool = False) -> DataFrame:
    """Submitted (or processed) forecasts, one row each.

    Files lacking a required envelope field, or a date in the question set name, are dropped; the
    due date comes from the question set name, or from the envelope of a processed file.
    """
    files = (
        spark.read.schema(_FORECAST_FILE).option("multiLine", "true")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
        .filter(~F.regexp_extract(document_name(F.col("_metadata.file_path")), r"([^/]+)$", 1).startswith("TEST."))
    )
    return forecast_rows(files, processed)


def forecast_rows(files: DataFrame, processed: bool = False) -> DataFrame:
    """Rows of parsed forecast documents (see read_forecasts)."""
    for name in REQUIRED_ENVELOPE:
        files = files.filter(F.col(name).isNotNull())
    named = F.try_to_date(F.regexp_extract("question_set", DATE_IN_NAME, 1))
    due = F.coalesce(F.try_to_date("forecast_due_date"), named) if processed else named
    rows = files.withColumn("forecast_due_date", due).filter(named.isNotNull()).withColumn(
        "f", F.explode("forecasts"))
    direction = F.coalesce(text_or_list(F.col("f.direction"), "array<int>"),
                           F.array().cast("array<int>"))
    extra = [F.col(f"f.{c}").alias(c) for c in ("resolved", "resolved_to", "imputed")] \
        if processed else []
    resolution = F.try_to_date(F.substring("f.resolution_date", 1, 10)) if processed \
        else S.null_text_to_null(F.col("f.resolution_date"))
    return rows.select(
        "organization", "model_organization", "model", "model_run_key", "forecast_variant_key",
        "uses_tools", F.coalesce("leaderboard_eligible", F.lit(True)).alias(
            "leaderboard_eligible"),
        F.col("f.source").alias("source"), text_or_list(F.col("f.id")).alias("ids"),
        direction.alias("direction"), "forecast_due_date", resolution.alias("resolution_date"),
        F.col("f.forecast").alias("forecast"), *extra)


# --- boards ----------------------------------------------------------------------------------

def read_board_csv(spark: SparkSession, path: str) -> DataFrame:
    """Published board: numbers, intervals split into bounds, blank release dates as null."""
    raw = spark.read.option("header", "true").csv(path)
    columns = []
    for name in raw.columns:
        value = F.col(f"`{name}`")
        if name.endswith("95% CI"):
            bound = lambda i: F.regexp_extract(
                value, r"\[\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\]", i).try_cast("double")
            base = name.removesuffix(" 95% CI")
            columns += [bound(1).alias(f"{base} lower"), bound(2).alias(f"{base} upper")]
        elif name in ("Team", "Model Organization", "Model") or name.endswith("?"):
            columns.append(value.alias(name))
        elif name == "Model release date":
            columns.append(F.try_to_date(value).alias(name))
        else:
            columns.append(F.regexp_replace(value, ",", "").try_cast("double").alias(name))
    return raw.select(*columns)


def read_legacy_board(spark: SparkSession, path: str) -> DataFrame:
    """Older board: score columns found by prefix, interval text re-split, p-values as text."""
    raw = spark.read.option("header", "true").csv(path)

    def find(prefix: str) -> Column:
        for name in raw.columns:
            if name.startswith(prefix):
                return F.col(f"`{name}`")
        return F.lit(None).cast("string")

    parts = F.split(F.regexp_replace(find("Confidence Interval"), r"[\[\]\s]", ""), ",")
    p = find("p-value") if any(c.startswith("p-value") for c in raw.columns) else find("Pairwise")
    number = p.try_cast("double")
    score = lambda prefix: find(prefix).try_cast("double")
    return raw.select(
        find("Organization").alias("organization"), find("Model").alias("model"),
        score("Dataset Score").alias("dataset"), score("Market Score").alias("market"),
        score("Overall Score").alias("overall"),
        F.try_element_at(parts, F.lit(1)).try_cast("double").alias("ci_lower"),
        F.try_element_at(parts, F.lit(2)).try_cast("double").alias("ci_upper"),
        F.when(number.isNotNull(), F.format_string("%.3f", number)).otherwise(p).alias("p_value"))
