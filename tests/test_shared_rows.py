"""Score rows made on reading: every submission on every resolved row, with nothing stored per model."""

from probcast.catalog import inputs as I, load
from probcast.operators import resolve as R
from tests.conftest import day

DUE, LATER = day("2024-01-10"), day("2024-01-17")
FOLDER = "/root/testdata/sf0.001"


def matched_inputs(spark):
    resolved = spark.createDataFrame(
        [("fred", [i], [], d, LATER, True, 1.0, None, None) for d in (DUE, day("2024-01-11")) for i in "ab"],
        "source STRING, ids ARRAY<STRING>, direction ARRAY<INT>, forecast_due_date DATE, resolution_date DATE, "
        "resolved BOOLEAN, resolved_to DOUBLE, market_value_on_due_date DOUBLE, market_value_on_due_date_minus_one DOUBLE")
    given = spark.createDataFrame(
        [("T", "T", "one", "fred", ["a"], [], DUE, LATER, 0.1), ("T", "T", "one", "fred", ["a"], [], DUE, LATER, 0.2),
         ("T", "T", "two", "fred", ["z"], [], DUE, LATER, 0.3), ("T", "T", None, "fred", ["a"], [], DUE, LATER, 0.4)],
        "organization STRING, model_organization STRING, model STRING, source STRING, ids ARRAY<STRING>, "
        "direction ARRAY<INT>, forecast_due_date DATE, resolution_date DATE, forecast DOUBLE")
    return resolved, given


def test_repeats_missing_forecasts_and_null_names_are_kept(spark):
    """A repeated forecast gives two rows, a null name matches nothing, a due date without submissions drops."""
    got = sorted(((r.ids[0], r.model, r.forecast) for r in R.match_forecasts(*matched_inputs(spark)).collect()), key=repr)
    assert got == sorted([("a", "one", 0.1), ("a", "one", 0.2), ("a", "two", None), ("a", None, None), ("b", "one", None),
                          ("b", "two", None), ("b", None, None)], key=repr)


def test_score_rows_are_read_without_a_shuffle(spark):
    """Rows per model come from one stored row per resolved question, by broadcast joins alone."""
    plan = I.processed(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(source" not in plan
    assert "hashpartitioning(organization" not in plan and "hashpartitioning(model_run_key" not in plan


def test_both_cutoffs_of_imputed_submissions_are_reported(spark):
    found = load()["over_imputed_cutoff_f14"].run(spark, FOLDER).collect()
    kept = {c: {(r.model, r.forecast_due_date) for r in found if r.cutoff_pct == c} for c in (5, 88)}
    assert kept[5] < kept[88]
