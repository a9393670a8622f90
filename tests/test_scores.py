import numpy as np
import pytest
from pyspark.sql import functions as F

from probcast import constants as C
from probcast.operators import bootstrap as B, fixed_effects as FE, inference, scoring, trend
from tests.conftest import day

COLUMNS = ("question_pk STRING, model_pk STRING, brier_score DOUBLE, model STRING, "
           "organization STRING, model_organization STRING, external_submission BOOLEAN, "
           "model_age_at_due_date INT, forecast_due_date DATE, source STRING")


def panel(models=7, questions=40, seed=1, keep=0.7, sources=("fred", "yfinance")):
    """Random unbalanced panel; model 0 answers everything and is the always-half model."""
    rng = np.random.default_rng(seed)
    out = []
    for q in range(questions):
        for m in range(models):
            if m < 2 or rng.random() < keep:
                name = C.ALWAYS_HALF if m == 0 else f"model-{m}"
                org = "B" if m == 0 else "Lab"
                out.append((f"q{q:03d}", f"m{m}", float(rng.random()), name, "B", org, False, 10,
                            day("2024-01-10"), sources[q % len(sources)]))
    return out


def dummy_least_squares(rows, weights=None):
    """Question effects by ordinary least squares on dummy variables (weights = copies)."""
    fit = [r for r in rows if r[3] not in C.EXCLUDED_FROM_FIT]
    qs, ms = sorted({r[0] for r in fit}), sorted({r[1] for r in fit})
    x = np.zeros((len(fit), len(qs) + len(ms) - 1))
    y, w = np.zeros(len(fit)), np.ones(len(fit))
    for k, r in enumerate(fit):
        x[k, qs.index(r[0])] = 1
        if ms.index(r[1]) > 0:
            x[k, len(qs) + ms.index(r[1]) - 1] = 1
        y[k] = r[2]
        w[k] = 1 if weights is None else weights[r[0]]
    used = w > 0
    root = np.sqrt(w[used])[:, None]
    beta = np.linalg.lstsq(x[used] * root, y[used] * root[:, 0], rcond=None)[0]
    return dict(zip(qs, beta[:len(qs)]))


def test_effects_match_dummy_regression(spark):
    rows = panel()
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.question_pk: r.question_fixed_effect
           for r in FE.question_effects(df, "B").collect()}
    want = dummy_least_squares(rows)
    assert set(got) == set(want)
    assert max(abs(got[q] - want[q]) for q in want) < 1e-10


def test_disconnected_panel_is_an_error(spark):
    rows = [r for r in panel(5, 8, keep=1.0) if r[1] != "m0"]
    split = [r for r in rows if (int(r[0][1:]) < 4) == (r[1] in ("m1", "m2"))]
    with pytest.raises(ValueError, match="connected"):
        FE.question_effects(spark.createDataFrame(split, COLUMNS), "B")


def test_question_without_fit_rows_is_an_error(spark):
    rows = [r for r in panel(4, 6, keep=1.0) if r[0] != "q000" or r[1] == "m0"]
    with pytest.raises(ValueError, match="fit sample"):
        FE.question_effects(spark.createDataFrame(rows, COLUMNS), "B")


def test_fit_sample_excludes_old_and_external(spark):
    base = ("q", "m", 0.1, "model", "B", "Lab", False, 10, day("2024-01-10"), "fred")
    cases = [base, base[:3] + ("model", "B", "Lab", False, 365) + base[8:],
             base[:3] + ("model", "B", "B", False, None) + base[8:],
             base[:3] + ("model", "T", "T", True, 10) + base[8:],
             base[:3] + (C.IMPUTED_FORECASTER, "B", "B", False, None) + base[8:]]
    df = spark.createDataFrame(cases, COLUMNS)
    assert [r.f for r in df.select(FE.in_fit_sample("B").alias("f")).collect()] == [
        True, False, True, False, False]


# --- bootstrap -------------------------------------------------------------------------------

def _weights(spark, questions, plan, block_questions):
    """Weight of every question per replicate, drawn block by block."""
    placed = B.with_blocks(questions, block_questions).collect()
    blocks, weight = {}, {}
    for r in placed:
        blocks.setdefault((r.stratum, r.block), []).append(r)
    for (stratum, _), members in blocks.items():
        w = B.block_weights(plan, stratum, members[0].stratum_size,
                            [p.asDict() for p in members[0].path], [m.hash for m in members])
        for k, r in enumerate(members):
            weight[r.question_pk] = w[:, k]
    return weight


@pytest.mark.parametrize("block_questions", [1, 8, 1024])
def test_weights_sum_to_the_stratum_and_ignore_blocks(spark, block_questions):
    questions = spark.createDataFrame(
        [(f"q{i}", i % 2) for i in range(150)], "question_pk STRING, stratum BIGINT")
    plan = B.Plan(120, 3)
    weight = _weights(spark, questions, plan, block_questions)
    for s in (0, 1):
        drawn = np.stack([weight[f"q{i}"] for i in range(150) if i % 2 == s])
        assert (drawn.sum(axis=0) == 75).all()
        assert 0.8 < drawn.var() < 1.2 and abs(drawn.mean(axis=1) - 1).max() < 0.4
    whole = _weights(spark, questions, plan, 100_000)
    assert all((weight[q] == whole[q]).all() for q in whole)


def test_bootstrap_weights_are_exact_and_replicates_match_explicit_fit(spark):
    """Rebuild the weights of each question from single-model sums, then refit explicitly."""
    rows = panel(6, 60, seed=5)
    df = spark.createDataFrame(rows, COLUMNS)
    replicates = 6
    # A probe panel on the same questions whose Brier is an indicator gives the weights drawn.
    questions = sorted({r[0] for r in rows})
    scores = B.replicate_scores(df, "B", False, replicates, seed=11, block_questions=8)
    got = {(r.replicate, r.model_pk): r.score for r in scores.collect()}
    index = spark.createDataFrame([(f"m{i}", i) for i in range(6)], "model_pk STRING, idx INT")
    weight = _weights(spark, B.question_rows(df, index, "B", False), B.Plan(replicates, 11), 8)
    total = sum(weight[q] for q in questions)
    assert (total == len(questions)).all()
    for k in range(replicates):
        w = {q: int(weight[q][k]) for q in questions}
        effects = dummy_least_squares(rows, w)
        explicit = {}
        for m in {r[1] for r in rows}:
            mine = [r for r in rows if r[1] == m and w[r[0]] > 0]
            explicit[m] = (sum(w[r[0]] * (r[2] - effects[r[0]]) for r in mine)
                           / sum(w[r[0]] for r in mine))
        # effects are defined up to a constant; compare after anchoring on one model
        for m in explicit:
            assert (got[(k, m)] - got[(k, "m0")]) == pytest.approx(
                explicit[m] - explicit["m0"], abs=1e-9)


def test_scores_ignore_blocks_partitions_and_groups(spark):
    """More replicates than a group holds; some questions have no row in the fit sample."""
    rows = panel(6, 50, seed=9)
    rows += [(f"u{q}", "m0", 0.2 + q / 100, C.ALWAYS_HALF, "B", "B", False, 10, day("2024-01-10"), "fred")
             for q in range(5)]
    df = spark.createDataFrame(rows, COLUMNS)
    one = B.replicate_scores(df, "B", False, 130, seed=2)
    two = B.replicate_scores(df.repartition(5), "B", False, 130, seed=2, block_questions=4,
                             vector_cells=300)
    key = ["replicate", "question_type", "model_pk"]
    both = one.join(two.withColumnRenamed("score", "other"), key, "full_outer").collect()
    assert len(both) == 130 * 6
    assert max(abs(r.score - r.other) for r in both) < 1e-9


def test_simulated_boards_anchor(spark):
    df = spark.createDataFrame(
        panel(4, 20, seed=3) + panel(4, 20, seed=4, sources=("infer",)), COLUMNS).withColumn(
        "question_pk", F.concat("question_pk", "source"))
    boards = B.simulated_boards(B.replicate_scores(df, "B", False, 5), "m0")
    own = boards.filter("model_pk = 'm0'").collect()
    assert len(own) == 15 and all(abs(r.brier_index - 50) < 1e-9 for r in own)


# --- boards and inference ----------------------------------------------------------------------

def test_score_models_keeps_null_keys_and_missing_types(spark):
    schema = ("organization STRING, model_organization STRING, model STRING, model_pk STRING, "
              "model_run_key STRING, source STRING, forecast DOUBLE, resolved_to DOUBLE, "
              "forecast_due_date DATE")
    due = day("2024-01-10")
    df = spark.createDataFrame([
        ("B", "B", "x", "x", None, "fred", 0.5, 1.0, due), ("B", "B", "x", "x", None, "infer", 1.0, 1.0, due),
        ("B", "L", "y", "y", "run", "fred", 0.0, 1.0, due)], schema)
    board = {r.model: r for r in scoring.score_models(
        df, [("brier_score", lambda d: d)]).collect()}
    assert board["x"].brier_score_overall == pytest.approx(0.125)
    assert board["x"].n_overall == 2
    assert board["y"].brier_score_overall is None and board["y"].n_market is None
    with pytest.raises(ValueError):
        scoring.score_models(df, [])


def test_bias_corrected_interval_orders_and_matches_percentiles(spark):
    values = [(k, "overall", "m", float(k)) for k in range(101)]
    simulated = spark.createDataFrame(
        values, "replicate INT, question_type STRING, model_pk STRING, brier_index DOUBLE")
    centre = spark.createDataFrame([("overall", "m", 50.5)],
                                   "question_type STRING, model_pk STRING, estimate DOUBLE")
    row = inference.bias_corrected_interval(simulated, centre).first()
    plain = inference.percentile_interval(simulated).first()
    assert row.ci_lower < 50 < row.ci_upper
    assert row.ci_lower == pytest.approx(plain.ci_lower, abs=1.5)
    assert plain.ci_lower == pytest.approx(np.percentile(range(101), 2.5))


def test_state_of_the_art_needs_a_strict_gain(spark):
    df = spark.createDataFrame(
        [("g", day("2024-01-01"), "b", "1", 50.0), ("g", day("2024-01-01"), "a", "2", 50.0),
         ("g", day("2024-02-01"), "c", "3", 50.0 + 1e-12), ("g", day("2024-03-01"), "d", "4", 51.0),
         ("g", None, "e", "5", 99.0)],
        "board STRING, model_release_date DATE, model STRING, model_pk STRING, score DOUBLE")
    marks = trend.state_of_the_art(df, ["board"], "score").orderBy("model_release_date").collect()
    assert [m.model for m in marks] == ["a", "d"]


def test_trend_crossing(spark):
    days = [day("2024-01-01"), day("2024-01-11"), day("2024-01-21")]
    marks = spark.createDataFrame([("g", d, 50.0 + i) for i, d in enumerate(days)],
                                  "board STRING, model_release_date DATE, score DOUBLE")
    reference = spark.createDataFrame([("g", 55.0)], "board STRING, reference_score DOUBLE")
    row = trend.trend_crossing(marks, ["board"], "score", reference).first()
    assert row.crossing == pytest.approx(day("2024-02-20").toordinal())
    flat = marks.withColumn("score", F.lit(50.0))
    assert trend.trend_crossing(flat, ["board"], "score", reference).first().crossing is None
