"""Headline queries on the benchmark tables; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from probcast.catalog import load  # noqa: E402
from probcast.session import build_session  # noqa: E402

HEADLINE = [
    "daily_close_t5", "fill_rows_t1", "trailing_sums_t7_j7", "value_as_of_j8",
    "resolve_dataset_r2", "resolve_market_r3", "resolve_market_combinations_r5_r6",
    "resolve_conflict_r7", "resolve_pages_r8", "prepare_forecasts_f5",
    "match_and_impute_j4_r12", "prepare_scores_s2_s3", "peer_score_s6_t19", "skill_score_s7_j9",
    "score_models_s8_a2_j10", "question_effects_s4", "large_panel_effects_s4", "baseline_board_s9_s10_s21",
    "tournament_board_s5_s21", "bootstrap_boards_s11", "percentile_intervals_s12",
    "stratified_sample_p5", "create_question_set_p9", "ensembles_a8_a9",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark_sql_shuffle_partitions=str(2 * int(cpus)),
        spark_driver_memory="16g", spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    registry["daily_close_t5"].run(spark, folder).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        if name not in registry:
            continue
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
