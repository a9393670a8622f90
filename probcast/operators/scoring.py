"""Scores per forecast, per model, and the leaderboard columns derived from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from probcast import constants as C
from probcast.operators.filters import drop_over_imputed, is_dataset, is_market, with_masks
from probcast.operators.skew import require_no_rows, salted_join, skew_join
from probcast.session import materialise

IDENTITY = ["organization", "model_organization", "model", "model_pk"]
TYPE_FLAGS = ["external_submission", "benchmark_llm", "comparison_model"]
QUESTION_TYPES = ("dataset", "market")
SUBMISSION = ["organization", "model_organization", "model", "forecast_due_date"]


def brier() -> Column:
    return F.pow(F.col("forecast") - F.col("resolved_to"), F.lit(2))


def model_pk(benchmark_org: str) -> Column:
    """organization_modelorganization_model; benchmark LLM rows use run and variant key."""
    llm = (F.col("organization") == benchmark_org) & (
        F.col("model_organization") != benchmark_org)
    plain = F.concat_ws("_", "organization", "model_organization", "model")
    keyed = F.concat_ws("_", "organization", "model_organization", "model_run_key",
                        "forecast_variant_key")
    return F.when(llm & F.col("model_run_key").isNotNull(), keyed).otherwise(plain)


def question_pk() -> Column:
    parts = [F.col("forecast_due_date").cast("string"), F.col("source"),
             F.element_at("ids", 1)]
    return F.when(is_dataset(), F.concat_ws("_", *parts, F.col("horizon").cast("string"))
                  ).otherwise(F.concat_ws("_", *parts))


def prepare_scores(processed: DataFrame, benchmark_org: str,
                   imputed_cutoff_pct: float | None = C.IMPUTED_CUTOFF_PCT,
                   check: bool = True) -> DataFrame:
    """Rows to score: single resolved questions of submissions with few imputed forecasts.

    Optional columns (model_run_key, forecast_variant_key, uses_tools, question_pk) are used when
    present. A benchmark model that is neither an LLM nor a known comparison model is an error.
    """
    df = processed.filter(F.size("ids") == 1)
    for name, kind in (("model_run_key", "string"), ("forecast_variant_key", "string"),
                       ("uses_tools", "boolean")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    if imputed_cutoff_pct is not None:
        df = drop_over_imputed(df, SUBMISSION, benchmark_org, imputed_cutoff_pct)
    own_org = F.col("organization") == benchmark_org
    tools = F.coalesce("uses_tools", F.lit(False))
    variant = F.col("forecast_variant_key")
    without = F.coalesce(variant.isin(C.VARIANTS_WITHOUT_CONTEXT), F.lit(False))
    context = F.coalesce(variant.isin(C.VARIANTS_WITH_CONTEXT), F.lit(False))
    scored = (
        with_masks(df)
        .filter(F.col("in_dataset") | F.col("in_market_resolved"))
        .drop("in_dataset", "in_market", "in_market_resolved", "in_market_unresolved")
        .withColumn("horizon", F.datediff("resolution_date", "forecast_due_date"))
        .withColumns({
            "question_pk": F.col("question_pk") if "question_pk" in df.columns else question_pk(),
            "external_submission": ~own_org,
            "benchmark_llm": own_org & (F.col("model_organization") != benchmark_org),
            "comparison_model": F.col("model").isin(C.COMPARISON_MODELS),
            "model_pk": model_pk(benchmark_org),
        })
        .withColumns({
            "baseline_model": F.col("comparison_model")
            | (F.col("benchmark_llm") & without & ~tools),
            "tournament_model": F.col("external_submission") | F.col("comparison_model")
            | (F.col("benchmark_llm") & (context | tools)),
        })
    )
    if check:
        unclassified = scored.filter(
            ~F.col("external_submission") & ~F.col("benchmark_llm") & ~F.col("comparison_model"))
        require_no_rows(unclassified.select("model"), "benchmark model without a class")
    return scored


def with_first_due_date(scored: DataFrame) -> DataFrame:
    """First due date of each model on its rows; the table of models is stored once and broadcast."""
    first = materialise(scored.groupBy("model_pk").agg(
        F.min("forecast_due_date").alias("first_forecast_due_date")))
    return scored.join(F.broadcast(first), "model_pk", "left")


def question_type() -> Column:
    return F.when(is_dataset(), "dataset").when(is_market(), "market")


# --- scoring functions: DataFrame -> DataFrame with one more column --------------------------

def brier_score(df: DataFrame) -> DataFrame:
    return df.withColumn("brier_score", brier())


def peer_score(df: DataFrame) -> DataFrame:
    """Mean Brier of the question minus the forecast's own (positive is better).

    A question has one row per model, so its window is small and the rows travel once.
    """
    scored = df if "brier_score" in df.columns else brier_score(df)
    mean = F.avg("brier_score").over(Window.partitionBy("question_pk"))
    return scored.withColumn("peer_score", mean - F.col("brier_score"))


def skill_reference(df: DataFrame, benchmark_org: str) -> DataFrame:
    """Brier of the naive forecaster per question."""
    return df.filter((F.col("organization") == benchmark_org)
                     & (F.col("model") == C.NAIVE_FORECASTER)).groupBy("question_pk").agg(
        F.max_by("brier_score", F.struct("forecast_due_date", "brier_score")).alias("_reference"))


def brier_skill_score(df: DataFrame, benchmark_org: str, check: bool = True) -> DataFrame:
    """Naive Brier minus own Brier; the naive forecaster must cover every question."""
    scored = df if "brier_score" in df.columns else brier_score(df)
    reference = skill_reference(scored, benchmark_org)
    if check:
        require_no_rows(
            scored.select("question_pk").distinct().join(reference, "question_pk", "left_anti"),
            "reference model lacks question")
    return salted_join(scored, reference, ["question_pk"], ["model_pk"], "inner").withColumn(
        "brier_skill_score", F.col("_reference") - F.col("brier_score")).drop("_reference")


def is_crowd(benchmark_org: str) -> Column:
    """Rows of the imputed (crowd) forecaster."""
    return (F.col("organization") == benchmark_org) & (
        F.col("model_organization") == benchmark_org) & (F.col("model") == C.IMPUTED_FORECASTER)


def market_brier_effects(df: DataFrame, benchmark_org: str) -> DataFrame:
    """Question effects taken from the imputed (crowd) forecaster's Brier."""
    return df.filter(is_crowd(benchmark_org)).groupBy("question_pk").agg(
        F.max("brier_score").alias("question_fixed_effect"))


# --- boards ----------------------------------------------------------------------------------

def score_models(df: DataFrame,
                 scorers: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Mean of each score per model for dataset, market and both.

    ``scorers``: (column, function) pairs; each function sees the rows of one question type and
    adds its column. One aggregation serves both types: grouping keeps null keys, so it equals a
    null-safe outer join of two boards. Overall is the mean of the two, null when one is missing.
    """
    if not scorers or not all(callable(function) for _, function in scorers):
        raise ValueError("at least one scoring function is needed, and all must be callable")
    names = [name for name, _ in scorers]
    typed = brier_score(df).withColumn("question_type", question_type())
    keys = [*IDENTITY, *[c for c in (*TYPE_FLAGS, "model_run_key", "forecast_variant_key")
                         if c in df.columns]]
    parts = []
    for kind in QUESTION_TYPES:
        rows = typed.filter(F.col("question_type") == kind)
        for _, function in scorers:
            rows = function(rows)
        first = [F.col("first_forecast_due_date")] if "first_forecast_due_date" in df.columns \
            else [F.col("forecast_due_date").alias("first_forecast_due_date")]
        parts.append(rows.select(*keys, *first, "question_type", *names))
    of_type = lambda kind, value: F.when(F.col("question_type") == kind, value)
    aggregates = [F.avg(of_type(kind, F.col(name))).alias(f"{name}_{kind}")
                  for name in names for kind in QUESTION_TYPES]
    counts = [F.count(of_type(kind, F.col(names[0]))).alias(f"_n_{kind}")
              for kind in QUESTION_TYPES]
    present = [F.count(of_type(kind, F.lit(1))).alias(f"_rows_{kind}") for kind in QUESTION_TYPES]
    board = parts[0].unionByName(parts[1]).groupBy(*keys).agg(
        *aggregates, *counts, *present,
        F.min("first_forecast_due_date").alias("first_forecast_due_date"))
    for kind in QUESTION_TYPES:
        board = board.withColumn(
            f"n_{kind}", F.when(F.col(f"_rows_{kind}") > 0, F.col(f"_n_{kind}")))
    for name in names:
        board = board.withColumn(
            f"{name}_overall", (F.col(f"{name}_dataset") + F.col(f"{name}_market")) / 2)
    return board.withColumn("n_overall", F.col("n_dataset") + F.col("n_market")).drop(
        *[f"_{p}_{k}" for p in ("n", "rows") for k in QUESTION_TYPES])


def join_boards(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two small boards in which null keys match."""
    rest_left = [c for c in left.columns if c not in keys]
    rest_right = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *rest_right)
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, "full").select(
        *[F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in keys],
        *rest_left, *rest_right)


def rescale(board: DataFrame, score: str, benchmark_org: str) -> DataFrame:
    """Shift each score so that the always-one-half model has 0.25.

    The window spans the board, which has one row per model.
    """
    anchor = (F.col("organization") == benchmark_org) & (F.col("model") == C.ALWAYS_HALF)
    kinds = [k for k in ("dataset", "market", "overall") if f"{score}_{k}" in board.columns]
    whole_board = Window.partitionBy()
    return board.withColumns({
        f"{score}_{kind}": F.col(f"{score}_{kind}") + (
            F.lit(0.25) - F.max(F.when(anchor, F.col(f"{score}_{kind}"))).over(whole_board))
        for kind in kinds})


def brier_index(value: Column) -> Column:
    """(1 - sqrt(score)) * 100; a negative score has no index."""
    return F.when(value >= 0, (F.lit(1.0) - F.sqrt(value)) * 100)


def with_brier_index(board: DataFrame, score: str) -> DataFrame:
    kinds = [k for k in ("dataset", "market", "overall") if f"{score}_{k}" in board.columns]
    return board.withColumns({
        f"brier_index_{kind}": brier_index(F.col(f"{score}_{kind}")) for kind in kinds})


# --- model dates and identity ----------------------------------------------------------------

def with_release_date(df: DataFrame, model_dim: DataFrame, age: bool = True) -> DataFrame:
    """Release date (external: first due date; LLM: by run key) and age on the due date in days."""
    dates = model_dim.select("model_run_key", F.col("release_date").alias("_listed")).filter(
        "model_run_key is not null").dropDuplicates(["model_run_key"])
    out = df.join(F.broadcast(dates), "model_run_key", "left").withColumn(   # one row per model run
        "model_release_date",
        F.when(F.col("external_submission"), F.col("first_forecast_due_date")).when(
            F.col("benchmark_llm"), F.col("_listed"))).drop("_listed")
    if age:
        out = out.withColumn("model_age_at_due_date", F.datediff(
            "forecast_due_date", "model_release_date"))
    return out


def normalise_identity(submissions: DataFrame, identities: DataFrame, benchmark_org: str,
                       check: bool = True) -> DataFrame:
    """Canonical LLM identity by (model_organization, model) or by (run key, variant key).

    ``identities``: alias_organization, alias_model, model_run_key, forecast_variant_key,
    canonical_organization, canonical_model, uses_tools. Rows of other organizations and the
    benchmark's own models pass through; an unknown benchmark LLM is an error.
    """
    llm = (F.col("organization") == benchmark_org) & (
        F.col("model_organization") != benchmark_org)
    for name in ("model_run_key", "forecast_variant_key"):
        if name not in submissions.columns:
            submissions = submissions.withColumn(name, F.lit(None).cast("string"))
    by_key = identities.dropDuplicates(["model_run_key", "forecast_variant_key"]).select(
        "model_run_key", "forecast_variant_key",
        F.struct("canonical_organization", "canonical_model", "model_run_key",
                 "forecast_variant_key", "uses_tools").alias("_by_key"))
    by_name = identities.dropDuplicates(["alias_organization", "alias_model"]).select(
        F.col("alias_organization").alias("model_organization"),
        F.col("alias_model").alias("model"),
        F.struct("canonical_organization", "canonical_model", "model_run_key",
                 "forecast_variant_key", "uses_tools").alias("_by_name"))
    spread = [c for c in submissions.columns if c not in ("model_run_key", "forecast_variant_key")]
    joined = skew_join(skew_join(
        submissions, by_key, ["model_run_key", "forecast_variant_key"], spread, "left"),
        by_name, ["model_organization", "model"], spread, "left").withColumn(
        "_id", F.when(llm, F.coalesce("_by_key", "_by_name")))
    if check:
        require_no_rows(joined.filter(llm & F.col("_id").isNull()).select(
            "model_organization", "model"), "unknown model identity")
    rest = [c for c in submissions.columns if c not in (
        "model_organization", "model", "model_run_key", "forecast_variant_key", "uses_tools")]
    return joined.select(
        *rest,
        F.coalesce("_id.canonical_organization", "model_organization").alias(
            "model_organization"),
        F.coalesce("_id.canonical_model", "model").alias("model"),
        F.col("_id.model_run_key").alias("model_run_key"),
        F.col("_id.forecast_variant_key").alias("forecast_variant_key"),
        F.coalesce("_id.uses_tools", F.lit(False)).alias("uses_tools"))


def identity_table(base_runs: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Identity rows for each base run and variant (an explode, not a cross join)."""
    from probcast.functions.text import display_model_name, file_model_name

    names = F.array(*[F.lit(v) for v in variants])
    expanded = base_runs.withColumn("forecast_variant_key", F.explode(names))
    shown = display_model_name(F.col("slug"), F.col("forecast_variant_key"))
    stored = file_model_name(F.col("slug"), F.col("forecast_variant_key"))
    return expanded.select(
        F.col("lab").alias("alias_organization"),
        F.explode(F.array_distinct(F.array(shown, stored))).alias("alias_model"),
        "model_run_key", "forecast_variant_key",
        F.col("lab").alias("canonical_organization"), shown.alias("canonical_model"),
        "uses_tools")


def min_rank(score: str) -> Column:
    """Rank 1 is the highest; ties share the smallest rank. A board has one row per model."""
    return F.rank().over(Window.orderBy(F.col(score).desc_nulls_last()))
