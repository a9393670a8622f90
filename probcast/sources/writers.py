"""Writers of the published and stored file formats. Parquet is the internal format.

The published JSON files hold one document per due date or submission. A document is written as a
sorted stream of lines, one per row, so no task holds a document, and gets its published name. Beyond
``PART_ROWS`` rows the published name is that of a folder of such documents with the same envelope, so
that several tasks write and read it; readers take both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from probcast.functions.dates import resolution_dates
from probcast.operators.filters import is_market
from probcast.operators.upsert import new_rows
from probcast.session import materialise

KEEP_NULLS = {"ignoreNullFields": "false"}


def write_questions(questions: DataFrame, path: str) -> None:
    """JSON-lines sorted by id: a range sort, so files are ordered across and within."""
    questions.orderBy("id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_fetch(fetched: DataFrame, path: str) -> None:
    fetched.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_series(series: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Series by source, rows of an id together and in date order within a file."""
    series.repartition("source", "id").sortWithinPartitions("source", "id", "date").write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").option(
        "ignoreNullFields", "false").partitionBy("source").format(fmt).save(path)


def write_series_per_question(series: DataFrame, path: str) -> None:
    """JSON-lines files of one question each, below ``source=<source>/question=<id>``."""
    rows = series.withColumn("question", F.col("id"))
    rows.repartition("source", "question").sortWithinPartitions("source", "question", "date").write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").option(
        "ignoreNullFields", "false").partitionBy("source", "question").json(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Replaces only the sources present (dynamic partition overwrite)."""
    metadata.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "source").parquet(path)


def document_lines(rows: DataFrame, stem: Column, envelope: Sequence[str], body: Sequence[Column],
                   name: str, order: Sequence[str], part_rows: int | None = None) -> DataFrame:
    """``file_name``, ``place``, ``value``: the lines of one JSON document per envelope.

    The first line holds the envelope and opens the list ``name``; then comes one line per row in
    ``order``; the last line closes both. A document of more than ``part_rows`` rows is dealt by the hash
    of its lines into parts of about that size, each a document of its own. The lines of a document lie in
    one partition, as the window that numbers them needs it, so that they need not travel again.
    """
    head = F.regexp_replace(F.to_json(F.struct(*envelope), KEEP_NULLS), r"\}$", "")
    heads = materialise(rows.select(stem.alias("_stem"), F.concat(head, F.lit(f',"{name}":[')).alias("value")).groupBy(
        "_stem", "value").agg(F.count(F.lit(1)).alias("_rows")))   # one row per document
    sizes = F.broadcast(heads.groupBy(F.col("_stem").alias("_of")).agg(F.ceil(
        F.sum("_rows") / (part_rows or PART_ROWS)).cast("int").alias("_parts")))
    own = F.col("_stem").eqNullSafe(F.col("_of"))
    suffix = F.when(F.col("_parts") > 1, F.concat(
        F.lit(".json/part-"), F.lpad(F.col("_part").cast("string"), 5, "0"), F.lit(".json"))).otherwise(".json")
    file_name = F.concat("_stem", suffix).alias("file_name")
    keys = [f"_o{i}" for i in range(len(order))]
    entries = rows.select(stem.alias("_stem"), *[F.col(c).alias(k) for c, k in zip(order, keys)],
                          F.to_json(F.struct(*body), KEEP_NULLS).alias("_text")).join(sizes, own).withColumn(
        "_part", F.pmod(F.xxhash64("_text"), "_parts")).select(file_name, *keys, "_text")
    opened = heads.join(sizes, own).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
        file_name, "value")
    edge = lambda turn, text: opened.select(
        "file_name", F.lit(turn).alias("_turn"), *[F.lit(None).cast(entries.schema[k].dataType).alias(k) for k in keys],
        text.alias("_text"))
    together = entries.select("file_name", F.lit(1).alias("_turn"), *keys, "_text").unionByName(
        edge(0, F.col("value"))).unionByName(edge(2, F.lit("]}"))).repartition("file_name")
    number = F.row_number().over(Window.partitionBy("file_name", "_turn").orderBy(*keys, "_text"))
    place = F.when(F.col("_turn") == 0, 0).when(F.col("_turn") == 2, END).otherwise(number).cast("long")
    return together.withColumn("place", place).select("file_name", "place", F.concat(
        F.when((F.col("_turn") == 1) & (F.col("place") > 1), ",").otherwise(""), "_text").alias("value"))


PART_ROWS = 250_000
END = (1 << 63) - 1


def save_documents(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """One file per ``file_name`` (which may contain folders) below ``path``; ``lines`` are those of
    ``document_lines``, each document's in one partition. With ``compression`` "gzip" names end in ``.gz``,
    which JSON readers take as they are."""
    lines.sortWithinPartitions("file_name", "place").select(
        "file_name", "value").write.mode("overwrite").partitionBy("file_name").text(
            path, compression=compression or "none")
    publish_names(lines.sparkSession, path)


def publish_names(spark: SparkSession, path: str) -> None:
    """Give each written file its published name; documents are as many as due dates or submissions."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(root):
        folder = status.getPath()
        if not folder.getName().startswith("file_name="):
            continue
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(
            folder.getName()[len("file_name="):])
        target = jvm.org.apache.hadoop.fs.Path(root, name)
        files.mkdirs(target.getParent())
        for part in files.listStatus(folder):
            if part.getPath().getName().startswith("part-"):
                named = jvm.org.apache.hadoop.fs.Path(root, name + (".gz" if part.getPath().getName().endswith(".gz") else ""))
                files.delete(named, False)
                files.rename(part.getPath(), named)
        files.delete(folder, True)


def id_value(ids: Column) -> Column:
    """Id as published: plain text for a single question, JSON list text for a combination."""
    return F.when(F.size(ids) == 1, F.element_at(ids, 1)).otherwise(F.to_json(ids))


def resolution_set_lines(resolved: DataFrame) -> DataFrame:
    direction = F.when(F.size("direction") > 0, F.col("direction"))
    rows = resolved.withColumn("_ids", F.to_json("ids"))
    return document_lines(
        rows, F.concat(F.col("forecast_due_date").cast("string"), F.lit("_resolution_set")),
        ["forecast_due_date"],
        [id_value(F.col("ids")).alias("id"), F.col("source"), direction.alias("direction"),
         F.date_format("resolution_date", "yyyy-MM-dd").alias("resolution_date"),
         F.col("resolved_to"), F.col("resolved")],
        "resolutions", ["source", "_ids", "resolution_date", "direction"])


def write_resolution_set(resolved: DataFrame, path: str) -> None:
    save_documents(resolution_set_lines(resolved), path)


PROCESSED_ENVELOPE = ["organization", "model_organization", "model", "forecast_due_date"]


def write_processed_forecasts(processed: DataFrame, path: str) -> None:
    """Internal form, pruned by due date on read.

    Rows are written where they are made: score rows are many times what is stored of them, so they do not
    travel, and a task has one file per due date.
    """
    processed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "forecast_due_date").parquet(path)


def write_processed_documents(processed: DataFrame, file_name: Column, path: str,
                              compression: str | None = None) -> None:
    """Published form of processed forecasts: ``<due date>/<file name>``.

    As plain text it is a dozen times what its rows take in the tables they are made from; see ``save_documents``
    for ``compression``.
    """
    body = [id_value(F.col("ids")).alias("id"), F.col("source"), F.col("direction"),
            F.col("resolution_date"), F.col("forecast"), F.col("resolved"),
            F.col("resolved_to"), F.col("imputed")]
    envelope = [*PROCESSED_ENVELOPE, *(c for c in ("question_set",) if c in processed.columns)]
    save_documents(document_lines(
        processed.withColumn("_ids", F.to_json("ids")), _in_date_folder(file_name), envelope, body,
        "forecasts", ["source", "_ids", "resolution_date", "direction"]), path, compression)


def _in_date_folder(file_name: Column) -> Column:
    """Submissions lie in a folder of their due date; the name's ending is added later."""
    return F.concat(F.col("forecast_due_date").cast("string"), F.lit("/"),
                    F.regexp_replace(file_name, r"\.json$", ""))


def with_resolution_dates(questions: DataFrame) -> DataFrame:
    """Horizons become dates after the due date; market questions have none."""
    dates = resolution_dates(F.col("forecast_due_date"), F.col("forecast_horizons"))
    return questions.withColumn("resolution_dates", F.when(~is_market(), dates)).drop(
        "forecast_horizons")


def question_set_lines(questions: DataFrame) -> DataFrame:
    """Question set per (due date, kind): ``questions`` has forecast_due_date and question_set, the
    kind; the document names itself by its file name."""
    dated = with_resolution_dates(questions)
    first = ["id", "source", "question", "resolution_criteria", "background"]
    columns = [c for c in first if c in dated.columns] + [
        c for c in dated.columns if c not in (*first, "forecast_due_date", "question_set")]
    stem = F.concat_ws("-", F.col("forecast_due_date").cast("string"), "question_set")
    named = dated.withColumn("question_set", F.concat(stem, F.lit(".json")))
    return document_lines(
        named, F.regexp_replace("question_set", r"\.json$", ""), ["forecast_due_date", "question_set"],
        [F.col(c) for c in columns], "questions", ["source", "id"])


def write_question_set(questions: DataFrame, path: str) -> None:
    save_documents(question_set_lines(questions), path)


def write_forecasts(forecasts: DataFrame, envelope: Sequence[str], file_name: Column, path: str
                    ) -> None:
    """``<due date>/<file name>``; ``file_name`` is the published name (see functions.text)."""
    body = [id_value(F.col("ids")).alias("id"), F.col("source"), F.col("forecast"),
            F.col("resolution_date")]
    save_documents(document_lines(
        forecasts.withColumn("_ids", F.to_json("ids")), _in_date_folder(file_name), envelope, body,
        "forecasts", ["source", "_ids", "resolution_date"]), path)


def question_effect_rows(dataset: DataFrame, market: DataFrame, board: str) -> DataFrame:
    """Published effects: due date, source, id, horizon (null for market), board, effect."""
    columns = ["forecast_due_date", "source", "id", "horizon", "question_fixed_effect"]
    without = market.withColumn("horizon", F.lit(None).cast("int"))
    return dataset.select(*columns).unionByName(without.select(*columns)).distinct().withColumn(
        "leaderboard_type", F.lit(board))


def write_question_effects(effects: DataFrame, path: str) -> None:
    effects.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


TREND_COLUMNS = ["Rank", "Team", "Model Organization", "Model", "Dataset", "Market", "Overall",
                 "Overall 95% CI", "Model release date"]


def write_board_csv(published: DataFrame, path: str, trend: bool = False) -> None:
    """Board as CSV, in rank order; a board has one row per model, so it is one file."""
    columns = [c for c in TREND_COLUMNS if c in published.columns] if trend else [
        c for c in published.columns if c != "Model release date"]
    order = [F.col("Rank"), F.col("N").desc()]
    published.orderBy(*order).select(*[F.col(f"`{c}`") for c in columns]).coalesce(1).write.mode(
        "overwrite").option("header", "true").csv(path)


def parity_document(parity: DataFrame, board: str) -> DataFrame:
    """One JSON text: question type -> board -> dates (three rows in)."""
    dates = F.when(F.col("lower").isNotNull(), F.struct("lower", "upper", "intersection"))
    return parity.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col("question_type"), F.create_map(F.lit(board), dates).alias("v"))))).alias("value"))


def write_parity_dates(parity: DataFrame, board: str, path: str) -> None:
    parity_document(parity, board).write.mode("overwrite").text(path)


def hash_mapping_documents(mapping: DataFrame, remaps: DataFrame, per_document: int = 10_000) -> DataFrame:
    """Id -> attributes as JSON objects without the replaced ids, sharded by id hash.

    The mapping grows with the bank, so the number of documents follows it and each holds about
    ``per_document`` ids; the reader accepts any number of documents.
    """
    kept = new_rows(mapping, remaps.select(F.col("old_id").alias("id")), ["id"])
    shards = max(1, -(-kept.count() // per_document))
    return kept.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")).agg(F.to_json(
        F.map_from_entries(F.collect_list(F.struct("id", "attrs")))).alias("value"))


def write_hash_mapping(mapping: DataFrame, remaps: DataFrame, path: str) -> None:
    hash_mapping_documents(mapping, remaps).write.mode("overwrite").partitionBy("shard").text(path)
