"""Reader and writer queries: tables go out in the stored formats and come back in."""

from __future__ import annotations

from pyspark.sql import functions as F

from probcast import constants as C, schemas as S
from probcast.catalog import inputs as I, register
from probcast.catalog.inputs import joined, n, num
from probcast.catalog.sampling import QUESTIONS, metadata, questions
from probcast.catalog.scoring import BOARD, SCORED, board_from_lineitem, scored
from probcast.operators import reports
from probcast.operators.resolve import drop_unresolved
from probcast.session import fresh_folder
from probcast.sources import readers, testtables as T, writers


def folder(spark, name: str) -> str:
    """A fresh folder for one run, in the shared folder."""
    return fresh_folder(spark, name)


def stored_questions(spark, sf):
    """Questions of all sources in the file form."""
    text = lambda name: F.lit("N/A").alias(name)
    return questions(spark, sf).select(
        "source", "id", F.concat(F.lit("Will "), "id", F.lit(" rise?")).alias("question"),
        text("background"), "url", "resolved",
        F.when(F.col("forecast_horizons").isNotNull(), F.to_json("forecast_horizons")).otherwise(
            "N/A").alias("forecast_horizons"), "freeze_datetime_value",
        text("freeze_datetime_value_explanation"), text("market_info_resolution_criteria"),
        text("market_info_open_datetime"), text("market_info_close_datetime"),
        text("market_info_resolution_datetime"))


@register("question_file_round_trip_io1_io10_io26", f"""
    SELECT source, id, resolved, CAST(CASE WHEN has_horizon AND NOT is_market THEN 2 END AS INT) AS n_horizons,
           freeze_datetime_value FROM {QUESTIONS}""")
def question_file(spark, sf):
    """One file per source, as fetched and as stored, each read back."""
    path, stored, back = folder(spark, "questions"), stored_questions(spark, sf), None
    size = F.when(F.col("forecast_horizons").isNotNull(), F.size("forecast_horizons"))
    for source in C.ALL_SOURCES:
        writers.write_fetch(stored.filter(F.col("source") == source), f"{path}/{source}_fetch.jsonl")
        fetched = spark.read.schema(stored.schema).json(f"{path}/{source}_fetch.jsonl")
        writers.write_questions(fetched.drop("source"), f"{path}/{source}_questions.jsonl")
        rows = readers.read_questions(spark, f"{path}/{source}_questions.jsonl", source, check=False)
        back = rows if back is None else back.unionByName(rows)
    return back.select("source", "id", "resolved", size.alias("n_horizons"), "freeze_datetime_value")


@register("series_files_round_trip_io2_io11", f"""
    SELECT source, id, date, {n('value', decimals=2)} FROM {T.sql('series')}""")
def series_files(spark, sf):
    """JSON lines by source, read back as resolutions, then the internal form."""
    path = folder(spark, "series")
    writers.write_series(T.table(spark, sf, "series").select("source", "id", "date", "value"),
                         f"{path}/raw", "json")
    rows, _ = readers.read_resolutions(spark, f"{path}/raw")
    writers.write_series(rows.select("source", "id", "date", "value"), f"{path}/internal")
    return spark.read.parquet(f"{path}/internal").select(
        "source", "id", "date", num(F.col("value"), "value", 2))


@register("conflict_file_io3", f"""
    SELECT country, event_date, event_type, fatalities FROM {T.sql('conflict_events')}""")
def conflict_file(spark, sf):
    path = folder(spark, "conflict")
    T.table(spark, sf, "conflict_events").select(
        F.col("event_id").cast("string").alias("event_id_cnty"), "country", "event_type",
        F.regexp_replace(F.col("event_date").cast("string"), "^2024", F.when(
            F.col("event_id") % 2 == 0, "0024").otherwise("2024")).alias("event_date"),
        "fatalities").write.mode("overwrite").json(path)
    return readers.read_conflict_events(spark, path).select(
        "country", "event_date", "event_type", F.col("fatalities").cast("bigint").alias(
            "fatalities"))


@register("question_set_round_trip_io4", f"""
    SELECT forecast_due_date, source, id, CAST({len(I.HORIZONS)} AS INT) AS n_dates
    FROM {T.sql('dataset_questions')}""")
def question_set_file(spark, sf):
    """Every set by its published name; the newest one is found by the folder's listing."""
    path = folder(spark, "question_set")
    rows = T.table(spark, sf, "dataset_questions").select(
        "forecast_due_date", F.lit("llm").alias("question_set"), "source", "id",
        F.array(*[F.lit(h) for h in I.HORIZONS]).alias("forecast_horizons"))
    writers.write_question_set(rows, path)
    newest, back = readers.latest_question_set(spark, path), None
    for due in sorted(str(r[0]) for r in rows.select("forecast_due_date").distinct().collect()):
        one = readers.read_question_set(spark, path, f"{due}-llm.json")
        back = one if back is None else back.unionByName(one)
    if newest != f"{due}-llm.json":
        raise ValueError(f"{newest} is not the newest set")
    return back.select("forecast_due_date", "source", joined().alias("id"),
                       F.size("resolution_dates").alias("n_dates"))


@register("forecast_files_round_trip_io7_io15", f"""
    SELECT m.model, f.forecast_due_date, f.source, f.id, f.resolution_date, {n('f.forecast', 'forecast')}
    FROM {I.DATASET_FORECASTS} f JOIN {T.sql('model_dim')} m ON m.model_no = f.model_no""")
def forecast_files(spark, sf):
    path = folder(spark, "forecasts")
    envelope = ["organization", "model_organization", "model", "question_set",
                "forecast_due_date"]
    rows = I.dataset_forecasts(spark, sf).withColumn("question_set", F.concat(
        F.col("forecast_due_date").cast("string"), F.lit("-llm.json")))
    name = F.concat(F.col("forecast_due_date").cast("string"), F.lit("."), "model_organization",
                    F.lit("."), F.regexp_replace("model", r"[^A-Za-z0-9]+", "-"), F.lit(".json"))
    writers.write_forecasts(rows, envelope, name, path)
    listed = readers.list_forecast_files(spark, path)
    if listed.count() != rows.select(*envelope).distinct().count():
        raise ValueError("a submission has no file of its own")
    return readers.read_forecasts(spark, path).select(
        "model", "forecast_due_date", "source", joined().alias("id"),
        F.to_date("resolution_date").alias("resolution_date"), num("forecast"))


@register("processed_round_trip_io13", f"""
    SELECT model, forecast_due_date, source, id, resolution_date, imputed, {n('forecast')}
    FROM {SCORED}""")
def processed_files(spark, sf):
    path = folder(spark, "processed")
    writers.write_processed_forecasts(scored(spark, sf).select(
        "organization", "model_organization", "model", "forecast_due_date", "source", "ids",
        "direction", "resolution_date", "forecast", "resolved", "resolved_to", "imputed"), path)
    return spark.read.parquet(path).select(
        "model", "forecast_due_date", "source", joined().alias("id"), "resolution_date",
        "imputed", num("forecast"))


@register("processed_documents_io13", f"""
    SELECT model, forecast_due_date, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CAST(imputed AS INT)) AS BIGINT) AS n_imputed,
           {n('sum(forecast)', 'sum_forecast', 6)}, CAST(sum(resolved_to) AS DOUBLE) AS sum_resolved
    FROM {SCORED} GROUP BY 1, 2""")
def processed_documents(spark, sf):
    """The published documents, one per submission and due date, read back as JSON."""
    path = folder(spark, "processed_documents")
    rows = scored(spark, sf)
    writers.write_processed_documents(rows, F.concat_ws(
        ".", F.col("forecast_due_date").cast("string"), "organization", F.replace("model", F.lit(" "), F.lit("-"))), path,
        compression="gzip")
    documents = spark.read.schema(
        "model STRING, forecast_due_date DATE, forecasts ARRAY<STRUCT<id: STRING, source: STRING, "
        "forecast: DOUBLE, resolved_to: DOUBLE, imputed: BOOLEAN>>").option("multiLine", "true").option(
        "recursiveFileLookup", "true").json(path)
    return documents.select("model", "forecast_due_date", F.explode("forecasts").alias("f")).groupBy(
        "model", "forecast_due_date").agg(
        F.count("*").alias("n_rows"), F.count_if("f.imputed").alias("n_imputed"),
        num(F.sum("f.forecast"), "sum_forecast", 6), F.sum("f.resolved_to").alias("sum_resolved"))


@register("resolution_set_documents_io12", f"""
    SELECT forecast_due_date, CAST(count(*) AS BIGINT) AS n_rows,
           CAST(sum(resolved_to) AS DOUBLE) AS total
    FROM {I.RESOLVED_DATASET} WHERE resolved_to IS NOT NULL GROUP BY 1""")
def resolution_set(spark, sf):
    """Resolution sets read back from their files as JSON documents."""
    path = folder(spark, "resolution_sets")
    writers.write_resolution_set(drop_unresolved(I.resolved_dataset(spark, sf)), path)
    sets = spark.read.schema(
        "forecast_due_date DATE, resolutions ARRAY<STRUCT<id: STRING, source: STRING, "
        "resolved_to: DOUBLE>>").option("multiLine", "true").option(
        "recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return sets.select("forecast_due_date", F.explode("resolutions").alias("r")).groupBy(
        "forecast_due_date").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.sum("r.resolved_to").alias("total"))


@register("metadata_round_trip_io8", f"""
    SELECT source, id, CASE WHEN source = 'infer' THEN 'Other' ELSE category END AS category, valid_question
    FROM {QUESTIONS}""")
def metadata_file(spark, sf):
    """Written whole, then one source again: the others keep their partitions. Read back as JSON lines."""
    path, lines = folder(spark, "metadata"), folder(spark, "metadata_lines")
    rows = metadata(spark, sf)
    writers.write_metadata(rows, path)
    writers.write_metadata(rows.filter("source = 'infer'").withColumn("category", F.lit("Other")), path)
    spark.read.parquet(path).write.json(lines)
    return readers.read_metadata(spark, lines)


@register("hash_mapping_io8_io24", """
    SELECT concat('h', c_custkey) AS id, c_name AS id_field_value FROM customer
    WHERE c_custkey % 10 <> 0""")
def hash_mapping(spark, sf):
    path = folder(spark, "mapping")
    customer = T.raw(spark, sf, "customer")
    name = F.concat(F.lit("h"), F.col("c_custkey").cast("string"))
    mapping = customer.select(name.alias("id"), F.create_map(
        F.lit("id_field_value"), F.col("c_name")).alias("attrs"))
    remaps = customer.filter("c_custkey % 10 = 0").select(name.alias("old_id"))
    writers.write_hash_mapping(mapping, remaps, path)
    return readers.read_hash_mapping(spark, f"{path}/*/*.txt").select(
        "id", F.col("attrs")["id_field_value"].alias("id_field_value"))


@register("conformed_rows_io19", """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, TRUE AS accepted FROM orders
    WHERE o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), FALSE FROM orders
    WHERE NOT (o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0)""")
def conformed(spark, sf):
    rows = T.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 5 != 0, "fred").alias(
            "source"), F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise("1.5").alias("value"))
    accepted, quarantined = S.conform(rows, S.SERIES)
    return accepted.select("id", F.lit(True).alias("accepted")).unionByName(
        quarantined.select("id", F.lit(False).alias("accepted")))


@register("board_csv_round_trip_io9_io17", f"""
    SELECT CAST(rank() OVER (ORDER BY round_even(brier_index_overall, 1) DESC) AS DOUBLE) AS rank,
           model, {n('round_even(brier_index_overall, 1)', 'overall')},
           {n('round_even(brier_index_dataset, 1)', 'lower')} FROM
    (SELECT * FROM {BOARD})""")
def board_csv(spark, sf):
    path = folder(spark, "board")
    board = board_from_lineitem(spark, sf).withColumns({
        "n_overall": F.lit(1), "n_dataset": F.lit(1), "n_market": F.lit(1),
        "brier_index_overall_ci_lower": F.col("brier_index_dataset"),
        "brier_index_overall_ci_upper": F.col("brier_index_market")})
    writers.write_board_csv(reports.publish(board, I.ORG), path)
    return readers.read_board_csv(spark, path).select(
        F.col("Rank").alias("rank"), F.col("Model").alias("model"),
        num(F.col("Overall"), "overall"), num(F.col("Overall lower"), "lower"))
