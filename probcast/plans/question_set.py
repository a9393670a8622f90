"""Creating the question sets of a due date."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from probcast import constants as C
from probcast.operators import filters, sampling
from probcast.session import materialise


@dataclass(frozen=True)
class SetSizes:
    llm: int = C.LLM_QUESTION_COUNT
    human: int = C.HUMAN_QUESTION_COUNT


def _family_counts(rows: DataFrame, sources: list[str], n: int) -> dict[str, int]:
    return sampling.allocate_counts(rows, "source", n, sources)


def create_question_sets(questions: DataFrame, metadata: DataFrame, freeze: date, seed: int,
                         sizes: SetSizes = SetSizes(), criteria: dict[str, str] | None = None
                         ) -> tuple[DataFrame, DataFrame]:
    """(LLM set, human set): half market, half dataset, spread over sources.

    Market questions are sampled by value and horizon bins, dataset questions evenly over
    categories; the human set is a simple random subset of the LLM set per source.
    """
    C.check_bin_weights()
    due = sampling.due_date(freeze)
    pool = filters.eligible_questions(questions, metadata, freeze, criteria)
    market_plan = _family_counts(pool, C.MARKET_SOURCES, sizes.llm // 2)
    dataset_plan = _family_counts(pool, C.DATASET_SOURCES, sizes.llm // 2)
    market = pool.filter(filters.is_market())
    picked_market = _sample_markets(market, market_plan, due, seed)
    picked_dataset = sampling.sample_categories_evenly(
        pool.filter(filters.is_dataset()), dataset_plan, seed)
    # Read twice (human allocation and sample), and later written.
    llm_set = materialise(picked_market.unionByName(picked_dataset, allowMissingColumns=True))
    half = sizes.human // 2
    human_plan = {**_family_counts(llm_set, C.MARKET_SOURCES, half),
                  **_family_counts(llm_set, C.DATASET_SOURCES, half)}
    human_set = sampling.sample_strata(
        llm_set, sampling.quota_frame(llm_set, human_plan, ["source"]), ["source"], seed + 1)
    due_columns = lambda df, name: df.withColumns({
        "forecast_due_date": F.lit(due), "question_set": F.lit(name)})
    return due_columns(llm_set, "llm"), due_columns(human_set, "human")


def _sample_markets(market: DataFrame, plan: dict[str, int], due: date, seed: int) -> DataFrame:
    """All market sources in one pass: the target of a bin is that of its source."""
    target = F.lit(0)
    for source, n in plan.items():
        target = F.when(F.col("source") == source, F.lit(n)).otherwise(target)
    return sampling.sample_market(market, target, due, seed, ["source"])
