"""Scoring, board and inference queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from probcast import constants as C
from probcast.catalog import inputs as I, register
from probcast.catalog.inputs import ORG, d, joined, n, num
from probcast.operators import (
    bootstrap, filters, fixed_effects, inference, reports, resolve, scoring, trend,
)
from probcast.plans import leaderboard as L
from probcast.session import fresh_folder, materialise
from probcast.sources import testtables as T

REPLICATES = C.BOOTSTRAP_REPLICATES


def scored(spark, sf):
    return I.stage("scored", spark, sf, build_scored)


def build_scored(spark, sf):
    """Score rows with first due date, release date and age; the imputed cutoff is off."""
    rows = scoring.prepare_scores(I.processed(spark, sf), ORG, None, check=False)
    return scoring.with_release_date(
        scoring.with_first_due_date(rows), I.models(spark, sf)).transform(scoring.brier_score)


_PK = """concat(organization, '_', model_organization, '_',
         CASE WHEN model_run_key IS NOT NULL AND organization = 'Benchmark'
              THEN concat(model_run_key, '_', forecast_variant_key) ELSE model END)"""
_CONTEXT = ", ".join(f"'{v}'" for v in C.VARIANTS_WITH_CONTEXT)
_PLAIN = ", ".join(f"'{v}'" for v in C.VARIANTS_WITHOUT_CONTEXT)
SCORED = f"""(
    SELECT *, {_PK} AS model_pk, (forecast - resolved_to) * (forecast - resolved_to) AS brier_score,
           organization <> 'Benchmark' AS external_submission,
           organization = 'Benchmark' AND model_organization <> 'Benchmark' AS benchmark_llm,
           model_rank < 5 AS comparison_model,
           model_rank < 5 OR (organization = 'Benchmark' AND model_organization <> 'Benchmark'
               AND coalesce(forecast_variant_key IN ({_PLAIN}), FALSE) AND NOT uses_tools)
               AS baseline_model,
           organization <> 'Benchmark' OR model_rank < 5 OR
               coalesce(forecast_variant_key IN ({_CONTEXT}), FALSE) OR uses_tools
               AS tournament_model
    FROM {I.PROCESSED} WHERE resolved)"""


@register("brier_score_s1", f"""
    SELECT model, question_pk, {n('brier_score')} FROM {SCORED}""")
def brier(spark, sf):
    return scored(spark, sf).select("model", "question_pk", num("brier_score"))


@register("prepare_scores_s2_s3", f"""
    SELECT model_pk, question_pk, horizon, external_submission, benchmark_llm, comparison_model,
           baseline_model, tournament_model FROM {SCORED}""")
def prepare(spark, sf):
    return scoring.prepare_scores(I.processed(spark, sf), ORG, None, check=False).select(
        "model_pk", "question_pk", "horizon", "external_submission", "benchmark_llm",
        "comparison_model", "baseline_model", "tournament_model")


@register("selection_masks_f2", f"""
    SELECT question_type = 'dataset' AND resolved AS in_dataset,
           question_type = 'market' AS in_market,
           question_type = 'market' AND resolved AS in_market_resolved,
           question_type = 'market' AND NOT resolved AS in_market_unresolved,
           CAST(count(*) AS BIGINT) AS n
    FROM {I.PROCESSED} GROUP BY 1, 2, 3, 4""")
def masks(spark, sf):
    flags = ["in_dataset", "in_market", "in_market_resolved", "in_market_unresolved"]
    return filters.with_masks(I.processed(spark, sf)).groupBy(*flags).agg(
        F.count(F.lit(1)).alias("n"))


_SUBMISSION = "organization, model_organization, model, forecast_due_date"


#: The published cutoff, which few made-up submissions pass, and one that most of them pass.
CUTOFFS = (C.IMPUTED_CUTOFF_PCT, 88)


@register("over_imputed_cutoff_f14", f"""
    WITH p AS (SELECT * FROM {I.PROCESSED}),
    shares AS (
        SELECT {_SUBMISSION}, 100 * avg(CAST(imputed AS INT)) AS a,
               100 * avg(CASE WHEN question_type = 'market' THEN CAST(imputed AS INT) END) AS m,
               100 * avg(CASE WHEN question_type = 'dataset' AND resolved
                              THEN CAST(imputed AS INT) END) AS s
        FROM p GROUP BY ALL),
    kept AS (SELECT c.cutoff_pct, {_SUBMISSION} FROM shares
             CROSS JOIN (VALUES {", ".join(f"({c})" for c in CUTOFFS)}) AS c(cutoff_pct)
             WHERE (organization = 'Benchmark'
             AND model_organization = 'Benchmark') OR NOT (coalesce(a > c.cutoff_pct, FALSE)
             OR coalesce(m > c.cutoff_pct, FALSE) OR coalesce(s > c.cutoff_pct, FALSE)))
    SELECT k.cutoff_pct, p.model, p.forecast_due_date, CAST(count(*) AS BIGINT) AS n
    FROM p JOIN kept k ON k.organization = p.organization
     AND k.model_organization = p.model_organization AND k.model = p.model
     AND k.forecast_due_date = p.forecast_due_date GROUP BY 1, 2, 3""")
def over_imputed(spark, sf):
    rows, counted = I.processed(spark, sf), None
    for cutoff in CUTOFFS:
        part = filters.drop_over_imputed(rows, scoring.SUBMISSION, ORG, cutoff).groupBy(
            F.lit(cutoff).alias("cutoff_pct"), "model", "forecast_due_date").agg(F.count(F.lit(1)).alias("n"))
        counted = part if counted is None else counted.unionByName(part)
    return counted


# The given due dates have questions of one kind only, so each threshold is asked for on its own.
@register("due_date_filters_f12_f13", f"""
    WITH counted AS (
        SELECT forecast_due_date, CAST(count(*) FILTER (question_type = 'market' AND resolved) AS BIGINT) AS n_market_resolved,
               CAST(count(*) FILTER (question_type = 'dataset' AND resolved) AS BIGINT) AS n_dataset
        FROM {I.PROCESSED} WHERE model = 'Naive Forecaster' AND forecast_due_date <= {d(I.AS_OF)} - 50 GROUP BY 1)
    SELECT 'dataset' AS threshold, * FROM counted WHERE n_dataset >= {C.MIN_DATASET_QUESTIONS}
    UNION ALL SELECT 'market', * FROM counted WHERE n_market_resolved >= {C.MIN_MARKET_QUESTIONS}""")
def due_dates(spark, sf):
    naive = filters.old_enough(I.processed(spark, sf).filter(F.col("model") == C.NAIVE_FORECASTER), I.AS_OF, 50)
    enough = lambda name, market, dataset: filters.due_dates_with_enough(
        naive, market, dataset).select(F.lit(name).alias("threshold"), "*")
    return enough("dataset", 0, C.MIN_DATASET_QUESTIONS).unionByName(enough("market", C.MIN_MARKET_QUESTIONS, 0))


@register("peer_score_s6_t19", f"""
    SELECT model, question_pk,
           {n('avg(brier_score) OVER (PARTITION BY question_pk) - brier_score', 'peer_score')}
    FROM {SCORED}""")
def peer(spark, sf):
    return scoring.peer_score(scored(spark, sf)).select("model", "question_pk", num("peer_score"))


@register("skill_score_s7_j9", f"""
    SELECT s.model, s.question_pk, {n('r.brier_score - s.brier_score', 'brier_skill_score')}
    FROM {SCORED} s JOIN {SCORED} r ON r.question_pk = s.question_pk
     AND r.model = 'Naive Forecaster'""")
def skill(spark, sf):
    return scoring.brier_skill_score(scored(spark, sf), ORG, check=False).select(
        "model", "question_pk", num("brier_skill_score"))


@register("first_due_date_t18", f"""
    SELECT model_pk, min(forecast_due_date) AS first_forecast_due_date FROM {SCORED}
    GROUP BY 1""")
def first_due(spark, sf):
    return scored(spark, sf).select("model_pk", "first_forecast_due_date").distinct()


@register("release_dates_j15", f"""
    WITH firsts AS (SELECT model_pk, min(forecast_due_date) AS first_due FROM {SCORED} GROUP BY 1)
    SELECT s.model_pk, s.forecast_due_date,
           CASE WHEN s.external_submission THEN f.first_due WHEN s.benchmark_llm
                THEN s.release_date END AS model_release_date,
           CAST(s.forecast_due_date - CASE WHEN s.external_submission THEN f.first_due
                WHEN s.benchmark_llm THEN s.release_date END AS INT) AS model_age_at_due_date,
           CAST(count(*) AS BIGINT) AS n
    FROM {SCORED} s JOIN firsts f ON f.model_pk = s.model_pk GROUP BY ALL""")
def release_dates(spark, sf):
    return scored(spark, sf).groupBy(
        "model_pk", "forecast_due_date", "model_release_date", "model_age_at_due_date").agg(
        F.count(F.lit(1)).alias("n"))


@register("normalised_identities_j14", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Benchmark'
               WHEN s_suppkey % 4 = 3 THEN 'Lab9' ELSE concat('Lab', s_suppkey % 2) END
               AS model_organization,
           CASE s_suppkey % 4 WHEN 0 THEN 'Always 0.5'
               WHEN 3 THEN 'own-model'
               WHEN 1 THEN concat('slug', s_suppkey % 2)
               ELSE concat('slug', s_suppkey % 2, '†') END AS model,
           CASE WHEN s_suppkey % 4 IN (1, 2) THEN concat('run', s_suppkey % 2) END
               AS model_run_key,
           CASE s_suppkey % 4 WHEN 1 THEN 'zero-shot' WHEN 2 THEN 'zero-shot-with-freeze-values'
               END AS forecast_variant_key
    FROM supplier""")
def identities(spark, sf):
    runs = spark.createDataFrame(
        [("slug0", "Lab0", "run0", False), ("slug1", "Lab1", "run1", False)],
        "slug STRING, lab STRING, model_run_key STRING, uses_tools BOOLEAN")
    table = scoring.identity_table(runs, ["zero-shot", "zero-shot-with-freeze-values"])
    key = F.col("s_suppkey") % 4
    slug = F.concat(F.lit("slug"), (F.col("s_suppkey") % 2).cast("string"))
    lab = F.concat(F.lit("Lab"), (F.col("s_suppkey") % 2).cast("string"))
    given = T.raw(spark, sf, "supplier").select(
        "s_suppkey", F.when(key == 3, "Team").otherwise(ORG).alias("organization"),
        F.when(key == 0, ORG).when(key == 3, "Lab9").otherwise(lab).alias("model_organization"),
        F.when(key == 0, C.ALWAYS_HALF).when(key == 3, "own-model").when(key == 1, slug).otherwise(
            F.concat(slug, F.lit("-zero-shot-with-freeze-values"))).alias("model"))
    return scoring.normalise_identity(given, table, ORG, check=False).select(
        "s_suppkey", "model_organization", "model", "model_run_key", "forecast_variant_key")


# --- boards ------------------------------------------------------------------------------------

def _mean(kind: str, value: str) -> str:
    return f"avg(CASE WHEN question_type = '{kind}' THEN {value} END)"


@register("score_models_s8_a2_j10", f"""
    WITH r AS (SELECT *, avg(brier_score) OVER (PARTITION BY question_pk) - brier_score AS peer
               FROM {SCORED}),
    b AS (SELECT model, model_run_key, {_mean('dataset', 'brier_score')} AS bd,
                 {_mean('market', 'brier_score')} AS bm, {_mean('dataset', 'peer')} AS pd,
                 {_mean('market', 'peer')} AS pm,
                 count(CASE WHEN question_type = 'dataset' THEN brier_score END) AS nd,
                 count(CASE WHEN question_type = 'market' THEN brier_score END) AS nm,
                 bool_or(question_type = 'dataset') AS hd, bool_or(question_type = 'market') AS hm
          FROM r GROUP BY 1, 2)
    SELECT model, model_run_key, {n('bd', 'brier_score_dataset')}, {n('bm', 'brier_score_market')},
           {n('(bd + bm) / 2', 'brier_score_overall')}, {n('pd', 'peer_score_dataset')},
           {n('pm', 'peer_score_market')}, {n('(pd + pm) / 2', 'peer_score_overall')},
           CASE WHEN hd THEN nd END AS n_dataset, CASE WHEN hm THEN nm END AS n_market,
           CASE WHEN hd AND hm THEN nd + nm END AS n_overall
    FROM b""")
def score_models(spark, sf):
    board = scoring.score_models(scored(spark, sf), [
        ("brier_score", lambda df: df), ("peer_score", scoring.peer_score)])
    return board.select(
        "model", "model_run_key", *[num(f"{s}_{k}") for s in ("brier_score", "peer_score")
                                    for k in ("dataset", "market", "overall")],
        "n_dataset", "n_market", "n_overall")


@register("null_safe_board_join_j10", f"""
    WITH a AS (SELECT model_organization, model_run_key, CAST(count(*) AS BIGINT) AS n_dataset
               FROM {SCORED} WHERE question_type = 'dataset' AND model_rank % 3 <> 0
               GROUP BY 1, 2),
    b AS (SELECT model_organization, model_run_key, CAST(count(*) AS BIGINT) AS n_market
          FROM {SCORED} WHERE question_type = 'market' AND model_rank % 4 <> 0 GROUP BY 1, 2)
    SELECT coalesce(a.model_organization, b.model_organization) AS model_organization,
           coalesce(a.model_run_key, b.model_run_key) AS model_run_key, n_dataset, n_market
    FROM a FULL JOIN b ON a.model_organization IS NOT DISTINCT FROM b.model_organization
     AND a.model_run_key IS NOT DISTINCT FROM b.model_run_key""")
def null_safe_join(spark, sf):
    rows = scored(spark, sf).withColumn("rank", F.substring("model_no", 2, 3).cast("int"))
    keys = ["model_organization", "model_run_key"]
    side = lambda kind, step, name: rows.filter(
        (scoring.question_type() == kind) & (F.col("rank") % step != 0)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(name))
    return scoring.join_boards(side("dataset", 3, "n_dataset"), side("market", 4, "n_market"), keys)


_FITTED = ("baseline_model AND model NOT IN ('Always 0.5', 'Imputed Forecaster') "
           "AND NOT external_submission")


@register("question_effects_s4", f"""
    WITH b AS (SELECT question_pk, avg(brier_score) AS effect FROM {SCORED}
               WHERE question_type = 'dataset' AND {_FITTED} GROUP BY 1)
    SELECT question_pk, {n('effect - (SELECT avg(effect) FROM b)', 'centred_effect')} FROM b""")
def question_effects(spark, sf):
    """Two-way fixed effects; the panel is complete, so SQL has a closed form up to a constant."""
    rows = L.board_rows(scored(spark, sf), L.BoardOptions("baseline", ORG)).filter(
        scoring.question_type() == "dataset")
    effects = materialise(fixed_effects.question_effects(rows, ORG, check=False))
    mean = effects.agg(F.avg("question_fixed_effect").alias("m")).scalar()
    return effects.select("question_pk", num(F.col("question_fixed_effect") - mean,
                                             "centred_effect"))


def _board_sql(rows: str, market_effect: str) -> str:
    """Point board: closed-form effects, rescaled by the always-one-half model, Brier index."""
    return f"""
    WITH s AS (SELECT *, {_FITTED} AS fitted FROM {SCORED} WHERE {rows}),
    e AS (SELECT question_pk, CASE WHEN any_value(question_type) = 'dataset'
                 THEN avg(CASE WHEN fitted THEN brier_score END) ELSE {market_effect} END AS b
          FROM s GROUP BY 1),
    a AS (SELECT s.*, s.brier_score - e.b AS adjusted FROM s JOIN e ON e.question_pk = s.question_pk),
    m AS (SELECT model, {_mean('dataset', 'adjusted')} AS ds, {_mean('market', 'adjusted')} AS mk
          FROM a GROUP BY 1),
    r AS (SELECT model, ds + 0.25 - (SELECT ds FROM m WHERE model = 'Always 0.5') AS ds,
                 mk + 0.25 - (SELECT mk FROM m WHERE model = 'Always 0.5') AS mk FROM m),
    o AS (SELECT *, (ds + mk) / 2 AS ov FROM r)
    SELECT model, {n('ds', 'difficulty_adjusted_dataset')}, {n('mk', 'difficulty_adjusted_market')},
           {n('ov', 'difficulty_adjusted_overall')},
           {n('CASE WHEN ds >= 0 THEN (1 - sqrt(ds)) * 100 END', 'brier_index_dataset', 6)},
           {n('CASE WHEN mk >= 0 THEN (1 - sqrt(mk)) * 100 END', 'brier_index_market', 6)},
           {n('CASE WHEN ov >= 0 THEN (1 - sqrt(ov)) * 100 END', 'brier_index_overall', 6)}
    FROM o"""


def _board(spark, sf, kind: str):
    options = L.BoardOptions(kind, ORG)
    rows = L.board_rows(scored(spark, sf), options)
    effects = materialise(L.all_question_effects(rows, options, check=False))
    board = L.point_board(rows, effects, options)
    kinds = ("dataset", "market", "overall")
    return board.select("model", *[num(f"difficulty_adjusted_{k}") for k in kinds],
                        *[num(F.col(f"brier_index_{k}"), f"brier_index_{k}", 6) for k in kinds])


@register("baseline_board_s9_s10_s21",
          _board_sql("baseline_model", "avg(CASE WHEN fitted THEN brier_score END)"))
def baseline_board(spark, sf):
    return _board(spark, sf, "baseline")


_TOURNAMENT = _board_sql(
    "tournament_model", "max(CASE WHEN model = 'Imputed Forecaster' THEN brier_score END)"
).replace(f"{_FITTED} AS fitted", "model NOT IN ('Always 0.5', 'Imputed Forecaster') "
          "AND NOT external_submission AS fitted")


@register("tournament_board_s5_s21", _TOURNAMENT)
def tournament_board(spark, sf):
    return _board(spark, sf, "tournament")


@register("preliminary_board_s21", f"""
    WITH s AS (SELECT *, model NOT IN ('Always 0.5', 'Imputed Forecaster')
                      AND NOT external_submission AS fitted
               FROM {SCORED} WHERE question_type = 'dataset'),
    e AS (SELECT question_pk, avg(CASE WHEN fitted THEN brier_score END) AS b FROM s GROUP BY 1),
    m AS (SELECT s.model, avg(s.brier_score - e.b) AS ds, CAST(count(*) AS BIGINT) AS k
          FROM s JOIN e ON e.question_pk = s.question_pk GROUP BY 1),
    r AS (SELECT model, k, ds + 0.25 - (SELECT ds FROM m WHERE model = 'Always 0.5') AS ds FROM m)
    SELECT model, k AS n_dataset, {n('ds', 'difficulty_adjusted_dataset')},
           {n('CASE WHEN ds >= 0 THEN (1 - sqrt(ds)) * 100 END', 'brier_index_dataset', 6)}
    FROM r""")
def preliminary(spark, sf):
    board = L.preliminary_board(scored(spark, sf), L.BoardOptions("preliminary", ORG))
    return board.select("model", "n_dataset", num("difficulty_adjusted_dataset"),
                        num(F.col("brier_index_dataset"), "brier_index_dataset", 6))


@register("market_crowd_effects_s5", f"""
    SELECT question_pk, {n('brier_score', 'question_fixed_effect')} FROM {SCORED}
    WHERE question_type = 'market' AND model = 'Imputed Forecaster'""")
def crowd_effects(spark, sf):
    return scoring.market_brier_effects(
        scored(spark, sf).filter(filters.is_market()), ORG).select(
        "question_pk", num("question_fixed_effect"))


@register("board_filters_f15_f16", f"""
    SELECT 'baseline' AS board, model, baseline_model, tournament_model, CAST(count(*) AS BIGINT) AS n
    FROM {SCORED} WHERE baseline_model AND model_rank <> 8 GROUP BY 2, 3, 4
    UNION ALL
    SELECT 'tournament', model, baseline_model, tournament_model, CAST(count(*) AS BIGINT)
    FROM {SCORED} WHERE tournament_model AND model_rank <> 8 GROUP BY 2, 3, 4""")
def board_filters(spark, sf):
    opted = scored(spark, sf).withColumn(
        "leaderboard_eligible", F.when(F.col("model_no") == "m8", False))
    eligible = filters.only_eligible(opted)
    boards = [(name, keep(eligible)) for name, keep in (
        ("baseline", filters.baseline_board_rows), ("tournament", filters.tournament_board_rows))]
    counted = [rows.groupBy(F.lit(name).alias("board"), "model", "baseline_model", "tournament_model").agg(
        F.count(F.lit(1)).alias("n")) for name, rows in boards]
    return counted[0].unionByName(counted[1])


# --- bootstrap (random: no SQL) ------------------------------------------------------------------

def _simulated(spark, sf, kind="tournament"):
    options = L.BoardOptions(kind, ORG, REPLICATES)
    rows = L.board_rows(scored(spark, sf), options)
    scores = bootstrap.replicate_scores(
        rows, ORG, options.market_from_crowd, options.replicates, seed=7)
    return bootstrap.simulated_boards(scores, "Benchmark_Benchmark_Always 0.5")


def large_panel(spark, sf):
    """An unbalanced panel with a model per supplier and a question per part, a row per line."""
    source = F.when(F.col("l_partkey") % 2 == 0, "fred").otherwise("yfinance")
    return T.raw(spark, sf, "lineitem").select(
        F.concat(F.lit("q"), "l_partkey").alias("question_pk"), F.concat(F.lit("m"), "l_suppkey").alias("model_pk"),
        ((F.col("l_quantity") * F.col("l_linenumber")) % 97 / 97).alias("brier_score"),
        F.concat(F.lit("model "), "l_suppkey").alias("model"), F.lit(ORG).alias("organization"),
        F.lit("Lab").alias("model_organization"), F.lit(False).alias("external_submission"),
        F.lit(10).alias("model_age_at_due_date"), F.lit(date(2024, 1, 11)).alias("forecast_due_date"), source.alias("source"))


@register("large_panel_effects_s4")
def large_panel_effects(spark, sf):
    """Question effects of a panel with a thousand models at scale 0.1."""
    return fixed_effects.question_effects(large_panel(spark, sf), ORG)


@register("large_panel_replicates_s11")
def large_panel_replicates(spark, sf):
    """Replicate scores of the same panel, summed up per model."""
    scores = bootstrap.replicate_scores(large_panel(spark, sf), ORG, False, REPLICATES, seed=5)
    return scores.groupBy("question_type", "model_pk").agg(
        F.count("*").alias("n_replicates"), F.avg("score").alias("mean_score"), F.stddev("score").alias("spread"))


@register("bootstrap_boards_s11")
def bootstrap_boards(spark, sf):
    return _simulated(spark, sf)


@register("bias_corrected_intervals_s13")
def bias_corrected(spark, sf):
    options = L.BoardOptions("tournament", ORG)
    rows = L.board_rows(scored(spark, sf), options)
    effects = materialise(L.all_question_effects(rows, options, check=False))
    board = L.point_board(rows, effects, options)
    estimates = reports.long_scores(board, ["model_pk"]).withColumnRenamed(
        "brier_index", "estimate")
    return inference.bias_corrected_interval(_simulated(spark, sf), estimates)


@register("full_leaderboard_s20_s21")
def full_leaderboard(spark, sf):
    options = L.BoardOptions("tournament", ORG, REPLICATES)
    return L.make_leaderboard(scored(spark, sf), options, I.models(spark, sf)).published


@register("parity_dates_s17_io18")
def parity(spark, sf):
    options = L.BoardOptions("tournament", ORG, REPLICATES)
    return L.make_leaderboard(scored(spark, sf), options, I.models(spark, sf)).parity


# --- inference on simulated boards taken from lineitem ---------------------------------------------
# One replicate per twenty parts, so their number grows with the data. Sums are integers, so both
# engines compute the same doubles and comparisons cannot flip.

SIM = f"""(
    SELECT CAST(floor(l_partkey / 20) AS INT) AS replicate,
           concat('m', CAST(l_suppkey % {T.MODEL_COUNT} AS VARCHAR)) AS model_pk,
           CASE l_linenumber % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'market' ELSE 'overall' END
               AS question_type,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS brier_index
    FROM lineitem GROUP BY 1, 2, 3)"""


def simulated_from_lineitem(spark, sf):
    kind = F.col("l_linenumber") % 3
    return T.raw(spark, sf, "lineitem").groupBy(
        F.floor(F.col("l_partkey") / 20).cast("int").alias("replicate"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % T.MODEL_COUNT).cast("string")).alias("model_pk"),
        F.when(kind == 0, "dataset").when(kind == 1, "market").otherwise("overall").alias(
            "question_type")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count(F.lit(1))).alias(
            "brier_index"))


def board_from_lineitem(spark, sf):
    """Point board: sums over all rows, joined with the model table."""
    kind = F.col("l_linenumber") % 3
    mean = lambda k: (F.sum(F.when(kind == k, F.col("l_quantity").cast("bigint"))).cast(
        "double") / F.count(F.when(kind == k, 1)))
    scores = T.raw(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("m"), (F.col("l_suppkey") % T.MODEL_COUNT).cast("string")).alias(
            "model_pk")).agg(
        mean(0).alias("brier_index_dataset"), mean(1).alias("brier_index_market"),
        mean(2).alias("brier_index_overall"))
    names = I.models(spark, sf).select(
        F.col("model_no").alias("model_pk"), "organization", "model_organization", "model",
        F.col("release_date").alias("model_release_date"))
    return scores.join(names, "model_pk")


_BMEAN = lambda k: (f"CAST(sum(CASE WHEN l_linenumber % 3 = {k} THEN CAST(l_quantity AS BIGINT) END) "  # noqa: E731
                    f"AS DOUBLE) / count(CASE WHEN l_linenumber % 3 = {k} THEN 1 END)")
BOARD = f"""(
    SELECT s.*, m.organization, m.model_organization, m.model, m.model_rank,
           m.release_date AS model_release_date FROM (
        SELECT concat('m', CAST(l_suppkey % {T.MODEL_COUNT} AS VARCHAR)) AS model_pk,
               {_BMEAN(0)} AS brier_index_dataset, {_BMEAN(1)} AS brier_index_market,
               {_BMEAN(2)} AS brier_index_overall FROM lineitem GROUP BY 1) s
    JOIN {T.sql('model_dim')} m ON m.model_no = s.model_pk)"""
SUPER_PK = "m3"


@register("percentile_intervals_s12", f"""
    SELECT question_type, model_pk, {n('quantile_cont(brier_index, 0.025)', 'ci_lower')},
           {n('quantile_cont(brier_index, 0.975)', 'ci_upper')} FROM {SIM} GROUP BY 1, 2""")
def percentile_intervals(spark, sf):
    return inference.percentile_interval(simulated_from_lineitem(spark, sf)).select(
        "question_type", "model_pk", num("ci_lower"), num("ci_upper"))


_TOTAL = f"""(SELECT CAST(count(DISTINCT replicate) AS DOUBLE) FROM {SIM}
               WHERE question_type = 'overall')"""
_P = f"""(
    SELECT a.model_pk, CASE WHEN a.model_pk = '{SUPER_PK}' THEN CAST(-1 AS DOUBLE)
               ELSE count(*) FILTER (WHERE a.brier_index >= b.brier_index) / {_TOTAL} END AS p_value
    FROM {SIM} a JOIN {SIM} b ON b.replicate = a.replicate AND b.question_type = 'overall'
     AND b.model_pk = '{SUPER_PK}' WHERE a.question_type = 'overall' GROUP BY 1)"""


@register("one_sided_p_values_s14", f"SELECT model_pk, {n('p_value')} FROM {_P}")
def one_sided(spark, sf):
    return inference.one_sided_p(
        simulated_from_lineitem(spark, sf), board_from_lineitem(spark, sf), SUPER_PK).select(
        "model_pk", num("p_value"))


@register("public_p_values_s14", f"SELECT model_pk, {n('1 - p_value', 'p_value')} FROM {_P}")
def public_p(spark, sf):
    p = inference.one_sided_p(
        simulated_from_lineitem(spark, sf), board_from_lineitem(spark, sf), SUPER_PK)
    return inference.reverse_direction(p).select("model_pk", num("p_value"))


@register("centred_p_values_s14", f"""
    WITH t AS (SELECT model_pk, (SELECT brier_index_overall FROM {BOARD}
                                 WHERE model_pk = '{SUPER_PK}') - brier_index_overall AS gap
               FROM {BOARD})
    SELECT a.model_pk, {n(f'''CASE WHEN a.model_pk = '{SUPER_PK}' THEN -1 ELSE
        count(*) FILTER (WHERE b.brier_index - a.brier_index - t.gap >= t.gap) / {_TOTAL} END''', 'p_value')}
    FROM {SIM} a JOIN {SIM} b ON b.replicate = a.replicate AND b.question_type = 'overall'
     AND b.model_pk = '{SUPER_PK}' JOIN t ON t.model_pk = a.model_pk
    WHERE a.question_type = 'overall' GROUP BY a.model_pk""")
def centred_p(spark, sf):
    return inference.one_sided_p(
        simulated_from_lineitem(spark, sf), board_from_lineitem(spark, sf), SUPER_PK,
        centred=True).select("model_pk", num("p_value"))


@register("benjamini_hochberg_s15", f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY p_value, model_pk) AS k,
                      count(*) OVER () AS m FROM {_P} WHERE model_pk <> '{SUPER_PK}'),
    adj AS (SELECT model_pk, p_value, least(1, min(p_value * m / k) OVER (ORDER BY k DESC
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM r)
    SELECT model_pk, {n('p_value')}, {n('p_adjusted')} FROM adj
    UNION ALL SELECT model_pk, p_value, CAST(-1 AS DOUBLE) FROM {_P}
    WHERE model_pk = '{SUPER_PK}'""")
def benjamini_hochberg(spark, sf):
    p = inference.one_sided_p(
        simulated_from_lineitem(spark, sf), board_from_lineitem(spark, sf), SUPER_PK)
    return inference.benjamini_hochberg(p, SUPER_PK).select(
        "model_pk", num("p_value"), num("p_adjusted"))


@register("performance_shares_s16", f"""
    WITH s AS (SELECT a.*, b.organization, b.model_organization, b.model FROM {SIM} a
               JOIN {BOARD} b ON b.model_pk = a.model_pk WHERE a.question_type = 'overall'),
    best AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY brier_index DESC,
                 organization, model_organization, model, model_pk) AS k,
                 (SELECT count(DISTINCT replicate) FROM s) AS total FROM s),
    top AS (SELECT replicate, quantile_cont(brier_index, 0.95) AS cut FROM s GROUP BY 1)
    SELECT b.model_pk, {n('sum(CAST(b.k = 1 AS INT)) * 100.0 / max(b.total)',
                          'pct_times_best_performer')},
           {n('sum(CAST(b.brier_index >= t.cut AS INT)) * 100.0 / max(b.total)',
              'pct_times_top_5_percentile')}
    FROM best b JOIN top t ON t.replicate = b.replicate GROUP BY 1""")
def performance(spark, sf):
    return inference.performance_shares(
        simulated_from_lineitem(spark, sf), board_from_lineitem(spark, sf)).select(
        "model_pk", num("pct_times_best_performer"), num("pct_times_top_5_percentile"))


_SIM_DATED = f"""(
    SELECT a.*, b.model, b.model_release_date FROM {SIM} a JOIN {BOARD} b ON b.model_pk = a.model_pk
    WHERE b.model_release_date IS NOT NULL)"""
_MARKS = f"""(
    WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY question_type, replicate,
             model_release_date ORDER BY brier_index DESC, model) AS k FROM {_SIM_DATED}),
    before AS (SELECT *, max(brier_index) OVER (PARTITION BY question_type, replicate
             ORDER BY model_release_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
             FROM ranked WHERE k = 1)
    SELECT question_type, replicate, model_release_date, brier_index, model_pk, model FROM before
    WHERE best IS NULL OR brier_index > best + CAST(1e-10 AS DOUBLE))"""


def dated_simulated(spark, sf):
    names = board_from_lineitem(spark, sf).select("model_pk", "model", "model_release_date")
    return simulated_from_lineitem(spark, sf).join(names, "model_pk")


@register("state_of_the_art_t21", f"""
    SELECT question_type, replicate, model_release_date, model_pk, {n('brier_index')}
    FROM {_MARKS}""")
def sota(spark, sf):
    return trend.state_of_the_art(
        dated_simulated(spark, sf), ["question_type", "replicate"], "brier_index").select(
        "question_type", "replicate", "model_release_date", "model_pk", num("brier_index"))


_CROSSING = f"""(
    WITH x AS (SELECT *, CAST(model_release_date - DATE '0001-01-01' + 1 AS DOUBLE) AS day
               FROM {_MARKS}),
    fit AS (SELECT question_type, replicate, regr_slope(brier_index, day) AS slope,
                   regr_intercept(brier_index, day) AS intercept,
                   count(DISTINCT day) AS k, max(model_release_date) AS last_mark
            FROM x GROUP BY 1, 2)
    SELECT f.*, CASE WHEN k >= 3 AND slope > 0 THEN (r.brier_index - intercept) / slope END
           AS crossing FROM fit f
    JOIN {SIM} r ON r.question_type = f.question_type AND r.replicate = f.replicate
     AND r.model_pk = '{SUPER_PK}')"""


@register("trend_crossing_s17", f"""
    SELECT question_type, replicate, {n('slope', decimals=6)}, last_mark,
           round(crossing) AS crossing_day
    FROM {_CROSSING}""")
def trend_crossing(spark, sf):
    marks = trend.state_of_the_art(
        dated_simulated(spark, sf), ["question_type", "replicate"], "brier_index")
    reference = simulated_from_lineitem(spark, sf).filter(
        F.col("model_pk") == SUPER_PK).select(
        "question_type", "replicate", F.col("brier_index").alias("reference_score"))
    return trend.trend_crossing(marks, ["question_type", "replicate"], "brier_index", reference
                                ).select("question_type", "replicate",
                                         num(F.col("slope"), "slope", 6), "last_mark",
                                         F.round("crossing").alias("crossing_day"))


@register("trend_in_months_s18", f"""
    WITH o AS (SELECT question_type, replicate, min(model_release_date) AS origin FROM {_MARKS}
               GROUP BY 1, 2),
    x AS (SELECT m.*, o.origin, CAST(m.model_release_date - o.origin AS DOUBLE) / 30 AS months
          FROM {_MARKS} m JOIN o ON o.question_type = m.question_type
           AND o.replicate = m.replicate),
    fit AS (SELECT question_type, replicate, regr_slope(brier_index, months) AS slope,
                   regr_intercept(brier_index, months) AS intercept, origin
            FROM x GROUP BY question_type, replicate, origin),
    c AS (SELECT f.*, (r.brier_index - intercept) / nullif(slope, 0) AS hit FROM fit f
          JOIN {SIM} r ON r.question_type = f.question_type AND r.replicate = f.replicate
           AND r.model_pk = '{SUPER_PK}')
    SELECT question_type, replicate, {n('slope', 'slope_per_month', 6)},
           CASE WHEN slope > 0 AND day BETWEEN -100000 AND 100000
                 AND origin + CAST(day AS INT) > DATE '2024-03-25'
                 AND origin + CAST(day AS INT) < DATE '2044-03-25'
                THEN CAST(origin + CAST(day AS INT) AS DATE) END AS crossing_date
    FROM (SELECT *, floor(round(hit * 30, {trend.DAY_DECIMALS}) + 0.5) AS day FROM c)""")
def trend_months(spark, sf):
    marks = trend.state_of_the_art(
        dated_simulated(spark, sf), ["question_type", "replicate"], "brier_index")
    reference = simulated_from_lineitem(spark, sf).filter(
        F.col("model_pk") == SUPER_PK).select(
        "question_type", "replicate", F.col("brier_index").alias("reference_score"))
    return trend.trend_in_months(
        marks, ["question_type", "replicate"], "brier_index", reference,
        F.lit(date(2024, 3, 25))).select(
        "question_type", "replicate", num(F.col("slope_per_month"), "slope_per_month", 6),
        "crossing_date")


@register("first_to_reach_a12", f"""
    SELECT a.question_type, a.replicate, min(a.model_release_date) AS first_date
    FROM {_SIM_DATED} a JOIN {SIM} r ON r.question_type = a.question_type
     AND r.replicate = a.replicate AND r.model_pk = '{SUPER_PK}'
    WHERE a.brier_index >= r.brier_index AND a.model NOT IN ('model-5') GROUP BY 1, 2""")
def first_to_reach(spark, sf):
    reference = simulated_from_lineitem(spark, sf).filter(
        F.col("model_pk") == SUPER_PK).select(
        "question_type", "replicate", F.col("brier_index").alias("reference_score"))
    dated = dated_simulated(spark, sf).filter("model_release_date is not null")
    return trend.first_to_reach(dated, ["question_type", "replicate"], "brier_index", reference,
                                ["model-5"])


@register("external_regression_s19")
def external_regression(spark, sf):
    board = board_from_lineitem(spark, sf).withColumn(
        "external", F.col("brier_index_market") * 40 + 200)
    return trend.external_regression(board, "external", "brier_index_overall", 25.0, 1000)


@register("external_fit_s19_j18", f"""
    SELECT 'linear' AS form, {n('regr_slope(brier_index_overall, brier_index_market * 40 + 200)', 'slope', 6)},
           {n('corr(brier_index_overall, brier_index_market * 40 + 200)', 'correlation', 6)}
    FROM {BOARD}
    UNION ALL
    SELECT 'log', {n('regr_slope(brier_index_overall, ln(brier_index_market * 40 + 200))', 'slope', 6)},
           {n('corr(brier_index_overall, ln(brier_index_market * 40 + 200))', 'correlation', 6)}
    FROM {BOARD}""")
def external_fit(spark, sf):
    board = board_from_lineitem(spark, sf).withColumn(
        "external", F.col("brier_index_market") * 40 + 200)
    return trend.external_regression(board, "external", "brier_index_overall", 25.0, 1000).select(
        "form", num(F.col("slope"), "slope", 6), num(F.col("correlation"), "correlation", 6))


@register("min_rank_t22", f"""
    SELECT model_pk, CAST(rank() OVER (ORDER BY round(brier_index_overall, 1) DESC) AS INT) AS rank
    FROM {BOARD}""")
def min_rank(spark, sf):
    return board_from_lineitem(spark, sf).withColumn(
        "brier_index_overall", F.round("brier_index_overall", 1)).select(
        "model_pk", scoring.min_rank("brier_index_overall").alias("rank"))


@register("long_scores_a13", f"""
    SELECT model_pk, question_type, {n('v', 'brier_index')} FROM (
        SELECT model_pk, 'dataset' AS question_type, brier_index_dataset AS v FROM {BOARD}
        UNION ALL SELECT model_pk, 'market', brier_index_market FROM {BOARD}
        UNION ALL SELECT model_pk, 'overall', brier_index_overall FROM {BOARD})""")
def long_scores(spark, sf):
    return reports.long_scores(board_from_lineitem(spark, sf), ["model_pk"]).select(
        "model_pk", "question_type", num("brier_index"))


@register("published_texts_s20", f"""
    SELECT p.model_pk, CASE WHEN p_value < 0.001 THEN '<0.001' WHEN p_value < 0.01 THEN '<0.01'
               ELSE printf('%.2f', p_value) END AS p_text,
           CASE WHEN p_value < 0.01 THEN 'Yes' WHEN p_value < 0.1 THEN 'Likely' ELSE 'No' END
               AS p_word,
           concat('[', printf('%.1f', round_even(b.brier_index_dataset, 1)), ', ',
                  printf('%.1f', round_even(b.brier_index_market, 1)), ']') AS interval_text,
           CASE WHEN b.organization = 'Benchmark' THEN replace(concat(b.model, ' with freeze values'),
                'freeze values', 'crowd forecast') ELSE concat(b.model, ' with freeze values') END
               AS shown_model
    FROM {_P} p JOIN {BOARD} b ON b.model_pk = p.model_pk""")
def published_texts(spark, sf):
    board = board_from_lineitem(spark, sf).withColumn(
        "model", F.concat("model", F.lit(" with freeze values")))
    p = inference.one_sided_p(simulated_from_lineitem(spark, sf), board, SUPER_PK)
    return p.join(board, "model_pk").select(
        "model_pk", reports.p_value_text(F.col("p_value")).alias("p_text"),
        reports.p_value_word(F.col("p_value")).alias("p_word"),
        reports.interval_text(F.col("brier_index_dataset"), F.col("brier_index_market")).alias(
            "interval_text"), reports.public_model_name(ORG).alias("shown_model"))


@register("question_effect_rows_io16", f"""
    SELECT DISTINCT forecast_due_date, source, id,
           CASE WHEN question_type = 'dataset' THEN horizon END AS horizon,
           {n('brier_score', 'question_fixed_effect')}, 'tournament' AS leaderboard_type
    FROM {SCORED} WHERE model = 'Imputed Forecaster'""")
def effect_rows(spark, sf):
    from probcast.sources import writers

    rows = scored(spark, sf).filter(F.col("model") == C.IMPUTED_FORECASTER).select(
        "forecast_due_date", "source", joined().alias("id"), "horizon",
        num(F.col("brier_score"), "question_fixed_effect"))
    path = fresh_folder(spark, "question-effects")
    writers.write_question_effects(writers.question_effect_rows(
        rows.filter(filters.is_dataset()), rows.filter(filters.is_market()), "tournament"), path)
    return spark.read.schema("forecast_due_date DATE, source STRING, id STRING, horizon INT, "
                             "question_fixed_effect DOUBLE, leaderboard_type STRING").json(path)


@register("combinations_dropped_f1_f3", f"""
    SELECT source, CAST(count(*) AS BIGINT) AS n_single, CAST(0 AS BIGINT) AS n_pairs
    FROM {I.RESOLVED_MARKET} WHERE source <> 'infer' GROUP BY 1""")
def combinations_dropped(spark, sf):
    rows = resolve.explode_question_set(
        I.market_question_set(spark, sf, True), I.TRADES_AS_OF, market_once=True)
    singles, _ = filters.split_combinations(rows)
    _, rest = filters.split_on_source(singles, "infer")
    return rest.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_single"), F.count_if(filters.is_combination()).alias("n_pairs"))
