"""Summary tables and the published board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from probcast import constants as C
from probcast.operators.filters import is_market


def category_by_source(questions: DataFrame) -> DataFrame:
    """Counts by category and source, market columns first, with totals by row and column.

    The sources are a fixed list, so the pivot is one aggregate; rollup adds the total row.
    """
    columns = [F.count_if(F.col("source") == s).alias(s)
               for s in (*C.MARKET_SOURCES, *C.DATASET_SOURCES)]
    return questions.rollup("category").agg(
        *columns, F.count(F.lit(1)).alias("total")).withColumn(
        "category", F.coalesce("category", F.lit("Total")))


def pairs(n: Column) -> Column:
    """Number of unordered pairs; exact in integers."""
    return F.floor(n * (n - 1) / 2).cast("bigint")


def source_table(questions: DataFrame) -> DataFrame:
    """Open questions and possible pairs per source, with totals per family and overall."""
    per_source = questions.withColumn(
        "family", F.when(is_market(), "market").otherwise("dataset")).groupBy(
        "family", "source").agg(F.count_if(~F.col("resolved")).alias("n")).withColumn(
        "pairs", pairs(F.col("n")))
    return per_source.rollup("family", "source").agg(
        F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).select(
        F.coalesce("family", F.lit("total")).alias("family"),
        F.coalesce("source", F.lit("Total")).alias("source"), "n", "pairs")


def bank_summary(questions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Unresolved and valid unresolved questions per source, with a total row."""
    marks = metadata.filter("valid_question").select("source", "id").withColumn(
        "_valid", F.lit(True))
    return questions.filter(~F.col("resolved")).join(marks, ["source", "id"], "left").rollup(
        "source").agg(F.count(F.lit(1)).alias("n_unresolved"),
                      F.count("_valid").alias("n_valid_unresolved")).withColumn(
        "source", F.coalesce("source", F.lit("Total")))


def resolution_breakdown(resolved: DataFrame, question_set: DataFrame) -> DataFrame:
    """Per due date and source: single questions, combinations (four directions each), asked."""
    got = resolved.groupBy("forecast_due_date", "source").agg(
        F.count_if(F.size("ids") == 1).alias("n_single"),
        F.floor(F.count_if(F.size("ids") > 1) / 4).cast("bigint").alias("n_combination"))
    asked = question_set.groupBy("forecast_due_date", "source").agg(
        F.count(F.lit(1)).alias("n_asked"))
    return asked.join(got, ["forecast_due_date", "source"], "left").na.fill(
        0, ["n_single", "n_combination"])


def unmatched_questions(resolved: DataFrame, question_set: DataFrame) -> DataFrame:
    """Asked questions without any resolution."""
    keys = ["forecast_due_date", "source", "ids"]
    return question_set.select(*keys).distinct().join(
        resolved.select(*keys).distinct(), keys, "left_anti")


def balanced_scores(rows: DataFrame, group: str, first: str = "score_model",
                    second: str = "score_reference") -> DataFrame:
    """Two scores per group: mean of the market mean and the dataset mean, or the one there is.

    The difference is taken after rounding to three decimals.
    """
    def balanced(column: str) -> Column:
        market = F.avg(F.when(is_market(), F.col(column)))
        other = F.avg(F.when(~is_market(), F.col(column)))
        return F.bround(F.coalesce((market + other) / 2, market, other), 3)

    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), balanced(first).alias(first),
        balanced(second).alias(second)).withColumn("difference", F.col(first) - F.col(second))


def join_model_and_reference(model: DataFrame, reference: DataFrame, metadata: DataFrame
                             ) -> DataFrame:
    """Scores of a model and a reference on the questions both answered, with the category."""
    keys = ["source", "ids", "resolution_date"]
    score = lambda df, name: df.select(*keys, F.pow(
        F.col("forecast") - F.col("resolved_to"), F.lit(2)).alias(name))
    return score(model, "score_model").join(score(reference, "score_reference"), keys).join(
        metadata.select("source", F.array("id").alias("ids"), "category"), ["source", "ids"],
        "left")


def long_scores(board: DataFrame, keep: Sequence[str], value: str = "brier_index") -> DataFrame:
    """One row per model and question type."""
    kinds = ["dataset", "market", "overall"]
    pairs_sql = ", ".join(f"'{k}', `{value}_{k}`" for k in kinds)
    return board.select(*keep, F.expr(f"stack(3, {pairs_sql}) as (question_type, {value})"))


def top_n(table: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return table.orderBy(*order).limit(n)


# --- published board ---------------------------------------------------------------------------

def p_value_text(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").when(p < 0.01, "<0.01").otherwise(
        F.format_string("%.2f", p))


def p_value_word(p: Column) -> Column:
    return F.when(p < 0.01, "Yes").when(p < 0.1, "Likely").otherwise("No")


def interval_text(lower: Column, upper: Column, decimals: int = C.BOARD_DECIMALS) -> Column:
    number = lambda c: F.format_string(f"%.{decimals}f", F.bround(c, decimals))
    return F.concat(F.lit("["), number(lower), F.lit(", "), number(upper), F.lit("]"))


def public_model_name(benchmark_org: str) -> Column:
    own = F.col("organization") == benchmark_org
    return F.when(own, F.replace("model", F.lit("freeze values"), F.lit("crowd forecast"))
                  ).otherwise(F.col("model"))


def publish(board: DataFrame, benchmark_org: str,
            comparisons: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Board as published: rounded, ranked by displayed overall score, intervals as text.

    ``comparisons``: (p-value column, comparison model, heading). A board has one row per model,
    so the ranking window is small.
    """
    index_columns = [c for c in board.columns if c.startswith("brier_index")
                     and not c.endswith(("_ci_lower", "_ci_upper"))]
    other = [f.name for f in board.schema.fields
             if f.dataType.simpleString() == "double" and f.name not in index_columns
             and not f.name.startswith(("brier_index", "p_value"))]
    rounded = board.withColumns({
        **{c: F.bround(c, C.BOARD_DECIMALS) for c in index_columns},
        **{c: F.bround(c, 3) for c in other}})
    ranked = rounded.withColumn("Rank", F.rank().over(
        Window.orderBy(F.col("brier_index_overall").desc_nulls_last())))
    columns = [F.col("Rank"), F.col("organization").alias("Team"),
               F.col("model_organization").alias("Model Organization"),
               public_model_name(benchmark_org).alias("Model")]
    for kind, label, count in (("dataset", "Dataset", "N dataset"),
                               ("market", "Market", "N market"), ("overall", "Overall", "N")):
        if f"brier_index_{kind}" not in board.columns:
            continue
        columns += [F.col(f"brier_index_{kind}").alias(label),
                    F.col(f"n_{kind}").cast("int").alias(count)]
        if f"brier_index_{kind}_ci_lower" in board.columns:
            columns.append(interval_text(
                F.col(f"brier_index_{kind}_ci_lower"), F.col(f"brier_index_{kind}_ci_upper")
            ).alias(f"{label} 95% CI"))
    for column, model, heading in comparisons:
        own = F.col("model") == model
        columns += [F.when(own, "—").otherwise(p_value_word(F.col(column))).alias(heading),
                    F.when(own, "—").otherwise(p_value_text(F.col(column))).alias(
                        f"p-val {heading}")]
    names = {"pct_times_best_performer": "Pct times № 1",
             "pct_times_top_5_percentile": "Pct times top 5%", "peer_score_overall": "Peer",
             "brier_skill_score_overall": "BSS", "difficulty_adjusted_dataset": "Brier Dataset",
             "difficulty_adjusted_market": "Brier Market",
             "difficulty_adjusted_overall": "Brier Overall",
             "model_release_date": "Model release date"}
    columns += [F.col(c).alias(label) for c, label in names.items() if c in board.columns]
    return ranked.select(*columns).orderBy(F.col("Rank"), F.col("N").desc())


# --- external tables ---------------------------------------------------------------------------

def attach_external_scores(board: DataFrame, names: DataFrame, scores: DataFrame,
                           compute: DataFrame) -> DataFrame:
    """Board rows with external model names, an external score and a compute estimate."""
    return board.join(names, "base_model", "left").join(scores, "external_name", "left").join(
        compute, "external_name", "left")
