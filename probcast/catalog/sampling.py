"""Question selection and sampling queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from probcast import constants as C
from probcast.catalog import register
from probcast.catalog.inputs import n, num
from probcast.functions import dates as D
from probcast.operators import filters, sampling
from probcast.plans import question_set
from probcast.sources import testtables as T, writers

FREEZE = date(1999, 1, 1)
DUE = date(1999, 1, 11)
SEED = 11


def questions(spark, sf):
    """Candidate questions in the stored form."""
    base = T.table(spark, sf, "sample_questions")
    pick = lambda names, column: F.element_at(
        F.array(*[F.lit(x) for x in names]), (F.col(column) + 1).cast("int"))
    text = F.col("freeze_value").cast("string")
    source = pick(C.ALL_SOURCES, "source_no")
    horizons = F.when(F.col("category_no") % 2 == 0, F.array(F.lit(7), F.lit(30)))
    return base.select(
        "id", source.alias("source"), pick(C.CATEGORIES, "category_no").alias("category"),
        F.concat(F.lit("https://q.example/"), F.col("id")).alias("url"),
        F.when(F.col("freeze_value") > 0.97, "N/A").otherwise(text).alias("freeze_datetime_value"),
        F.concat(F.col("close_date").cast("string"), F.lit("T12:00:00+00:00")).alias(
            "market_info_close_datetime"),
        "resolved", "valid_question",
        F.when(source.isin(C.DATASET_SOURCES), horizons).alias("forecast_horizons"))


def metadata(spark, sf):
    return questions(spark, sf).select("source", "id", "category", "valid_question")


def _case(column: str, names) -> str:
    return f"CASE {column} " + " ".join(
        f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"


_MARKETS = ", ".join(f"'{s}'" for s in C.MARKET_SOURCES)
QUESTIONS = f"""(
    SELECT *, source IN ({_MARKETS}) AS is_market FROM (
        SELECT id, {_case('source_no', C.ALL_SOURCES)} AS source,
               {_case('category_no', C.CATEGORIES)} AS category,
               CASE WHEN freeze_value > 0.97 THEN 'N/A' ELSE CAST(freeze_value AS VARCHAR) END
                   AS freeze_datetime_value, freeze_value, category_no % 2 = 0 AS has_horizon,
               close_date, resolved, valid_question
        FROM {T.sql('sample_questions')}))"""
ELIGIBLE = f"""(
    SELECT * FROM {QUESTIONS} WHERE valid_question AND freeze_datetime_value <> 'N/A'
      AND category <> 'Other' AND NOT resolved
      AND CASE WHEN is_market THEN close_date + INTERVAL 12 HOUR > TIMESTAMP '1999-01-11 23:59:59.999999'
               ELSE has_horizon END)"""


@register("eligible_questions_f8_f11", f"""
    SELECT source, id, category, concat('See https://q.example/', id, '.') AS resolution_criteria
    FROM {ELIGIBLE}""")
def eligible(spark, sf):
    criteria = {source: "See {url}." for source in C.ALL_SOURCES}
    base = questions(spark, sf).drop("category", "valid_question")
    return filters.eligible_questions(base, metadata(spark, sf), FREEZE, criteria).select(
        "source", "id", "category", "resolution_criteria")


@register("drop_missing_freeze_value_f9", f"""
    SELECT id FROM {QUESTIONS} WHERE freeze_datetime_value <> 'N/A'""")
def missing_freeze(spark, sf):
    return filters.drop_missing_freeze_value(questions(spark, sf)).select("id")


@register("drop_resolving_too_soon_f10", f"""
    SELECT id FROM {QUESTIONS} WHERE CASE WHEN is_market
        THEN close_date + INTERVAL 12 HOUR > TIMESTAMP '1999-01-11 23:59:59.999999'
        ELSE has_horizon END""")
def too_soon(spark, sf):
    return filters.drop_resolving_too_soon(questions(spark, sf), FREEZE).select("id")


@register("split_questions_f4", f"""
    SELECT is_market, CAST(count(*) AS BIGINT) AS n FROM {QUESTIONS} GROUP BY 1""")
def split(spark, sf):
    dataset, market = filters.split_questions(questions(spark, sf))
    flag = lambda df, value: df.select(F.lit(value).alias("is_market"))
    return flag(dataset, False).unionByName(flag(market, True)).groupBy("is_market").agg(
        F.count(F.lit(1)).alias("n"))


@register("limit_per_type_f17_l4", f"""
    SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY is_market
        ORDER BY source, id) AS k FROM {QUESTIONS}) WHERE k <= 40""")
def limit_per_type(spark, sf):
    return filters.limit_per_type(questions(spark, sf), 40).select("source", "id")


# --- bins ----------------------------------------------------------------------------------------

_last = len(C.MARKET_VALUE_BINS) - 1
_VALUE_BIN = "CASE WHEN value IS NULL THEN 'unknown' " + " ".join(
    f"WHEN value >= CAST({lo} AS DOUBLE) AND value {'<=' if k == _last else '<'} "
    f"CAST({hi} AS DOUBLE) THEN '{sampling.value_label(lo, hi)}'"
    for k, (lo, hi, _) in enumerate(C.MARKET_VALUE_BINS)) + " ELSE 'unknown' END"
_TIME_BIN = "CASE " + " ".join(
    f"WHEN days >= {lo}" + ("" if hi == float("inf") else f" AND days <= {hi}")
    + f" THEN '{sampling.horizon_label(lo, hi)}'" for lo, hi, _ in C.TIME_HORIZON_BINS
) + " ELSE 'unknown' END"
_VALUE_WEIGHT = "CASE market_value_bin " + " ".join(
    f"WHEN '{sampling.value_label(lo, hi)}' THEN CAST({w} AS DOUBLE)"
    for lo, hi, w in C.MARKET_VALUE_BINS) + " ELSE 0 END"
_TIME_WEIGHT = "CASE time_horizon_bin " + " ".join(
    f"WHEN '{sampling.horizon_label(lo, hi)}' THEN CAST({w} AS DOUBLE)"
    for lo, hi, w in C.TIME_HORIZON_BINS) + " ELSE 0 END"
BINNED = f"""(
    SELECT *, concat(market_value_bin, '_', time_horizon_bin) AS composite_bin FROM (
        SELECT *, {_VALUE_BIN} AS market_value_bin, {_TIME_BIN} AS time_horizon_bin FROM (
            SELECT source, id, TRY_CAST(freeze_datetime_value AS DOUBLE) AS value,
                   close_date - DATE '1999-01-11' AS days
            FROM {QUESTIONS} WHERE is_market AND NOT resolved)))"""


def market_pool(spark, sf):
    return questions(spark, sf).filter(filters.is_market() & ~F.col("resolved"))


@register("question_bins_p1_p2", f"""
    SELECT source, id, market_value_bin, time_horizon_bin, composite_bin FROM {BINNED}""")
def bins(spark, sf):
    return sampling.with_bins(market_pool(spark, sf), DUE).select(
        "source", "id", "market_value_bin", "time_horizon_bin", "composite_bin")


WEIGHTS = f"""(
    SELECT source, composite_bin, available, raw / sum(raw) OVER (PARTITION BY source) AS bin_weight
    FROM (SELECT source, composite_bin, count(*) AS available,
                 any_value({_VALUE_WEIGHT}) * any_value({_TIME_WEIGHT}) AS raw
          FROM {BINNED} GROUP BY 1, 2))"""


@register("bin_weights_p3", f"""
    SELECT source, composite_bin, available, {n('bin_weight')} FROM {WEIGHTS}""")
def weights(spark, sf):
    return sampling.bin_weights(
        sampling.with_bins(market_pool(spark, sf), DUE), ["source"]).select(
        "source", "composite_bin", "available", num("bin_weight"))


def _quotas(n_target: int) -> str:
    """The greedy written differently: units of shortage or excess handed out along an order."""
    return f"""(
    WITH w AS (SELECT *, least(CAST(round_even({n_target} * bin_weight, 0) AS BIGINT), available)
                      AS base FROM {WEIGHTS} WHERE bin_weight > 0),
    t AS (SELECT source, sum(base) AS total FROM w GROUP BY 1),
    r AS (SELECT w.*, t.total,
             sum(available - base) OVER (PARTITION BY w.source
                 ORDER BY bin_weight DESC, composite_bin) AS room_to_here,
             sum(base) OVER (PARTITION BY w.source ORDER BY bin_weight, composite_bin)
                 AS base_to_here
          FROM w JOIN t ON t.source = w.source)
    SELECT source, composite_bin, available, bin_weight, CAST(CASE
        WHEN total < {n_target} THEN base + (least(room_to_here, {n_target} - total)
             - least(room_to_here - (available - base), {n_target} - total))
        WHEN total > {n_target} THEN base - (least(base_to_here, total - {n_target})
             - least(base_to_here - base, total - {n_target}))
        ELSE base END AS BIGINT) AS quota FROM r)"""


@register("bin_quotas_p4", f"SELECT source, composite_bin, quota FROM {_quotas(400)}")
def quotas(spark, sf):
    binned = sampling.with_bins(market_pool(spark, sf), DUE)
    return sampling.bin_quotas(sampling.bin_weights(binned, ["source"]), 400, ["source"]).select(
        "source", "composite_bin", "quota")


@register("stratified_sample_p5", f"""
    SELECT source, id FROM (SELECT b.source, b.id, q.quota, row_number() OVER (
        PARTITION BY b.source, b.composite_bin ORDER BY md5(concat(b.id, '#{SEED}')), b.id) AS k
        FROM {BINNED} b JOIN {_quotas(60)} q ON q.source = b.source
         AND q.composite_bin = b.composite_bin) WHERE k <= quota""")
def stratified(spark, sf):
    return sampling.sample_market(market_pool(spark, sf), 60, DUE, SEED, ["source"]).select(
        "source", "id")


@register("bin_report_a11", f"""
    WITH q AS (SELECT composite_bin, sum(quota) AS quota FROM {_quotas(60)} GROUP BY 1),
    a AS (SELECT composite_bin, count(*) AS available FROM {BINNED} GROUP BY 1)
    SELECT a.composite_bin, a.available, CAST(coalesce(q.quota, 0) AS BIGINT) AS wanted,
           CAST(coalesce(q.quota, 0) AS BIGINT) AS got, CAST(0 AS BIGINT) AS shortfall
    FROM a LEFT JOIN q ON q.composite_bin = a.composite_bin""")
def bin_report(spark, sf):
    binned = sampling.with_bins(market_pool(spark, sf), DUE)
    wanted = sampling.bin_quotas(sampling.bin_weights(binned, ["source"]), 60, ["source"])
    sampled = sampling.sample_strata(binned, wanted, ["source", "composite_bin"], SEED)
    total = wanted.groupBy("composite_bin").agg(F.sum("quota").alias("quota"))
    return sampling.bin_report(binned, total, sampled)


@register("simple_sample_p8", f"""
    SELECT id FROM {QUESTIONS} ORDER BY md5(concat(id, '#{SEED}')), id LIMIT 200""")
def simple(spark, sf):
    return sampling.sample_simple(questions(spark, sf), 200, SEED).select("id")


# Even splits as round robins: the k-th question of every source, then of every category in order.
_CATEGORY_PLACE = f"list_position([{', '.join(repr(c) for c in C.CATEGORIES)}], category)"


@register("category_even_sample_p7_p6", f"""
    WITH pool AS (SELECT * FROM {QUESTIONS} WHERE NOT is_market AND NOT resolved),
    turn AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM pool),
    share AS (SELECT source, count(*) AS quota FROM (
        SELECT source, row_number() OVER (ORDER BY k, source) AS place FROM turn)
        WHERE place <= 60 GROUP BY 1),
    inside AS (SELECT source, category, id, row_number() OVER (
        PARTITION BY source, category ORDER BY md5(concat(id, '#{SEED}')), id) AS k FROM pool),
    placed AS (SELECT *, row_number() OVER (
        PARTITION BY source ORDER BY k, {_CATEGORY_PLACE}) AS place FROM inside)
    SELECT source, category, id FROM placed JOIN share USING (source) WHERE place <= quota""")
def category_even(spark, sf):
    pool = questions(spark, sf).filter(filters.is_dataset() & ~F.col("resolved"))
    plan = sampling.allocate_counts(pool, "source", 60, C.DATASET_SOURCES)
    return sampling.sample_categories_evenly(pool, plan, SEED).select("source", "category", "id")


# Round-robin form of the even split: the k-th question of every source goes before the k+1-th.
@register("even_allocation_p6", f"""
    WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY id) AS k
               FROM {QUESTIONS} WHERE NOT is_market AND NOT resolved),
    x AS (SELECT source, row_number() OVER (ORDER BY k, source) AS place FROM r)
    SELECT source, CAST(count(*) AS BIGINT) AS quota FROM x WHERE place <= 60 GROUP BY 1""")
def even_allocation(spark, sf):
    pool = questions(spark, sf).filter(filters.is_dataset() & ~F.col("resolved"))
    plan = sampling.allocate_counts(pool, "source", 60, C.DATASET_SOURCES)
    return sampling.quota_frame(pool, plan, ["source"])


@register("create_question_set_p9")
def create_sets(spark, sf):
    base = questions(spark, sf).drop("category", "valid_question")
    llm_set, human_set = question_set.create_question_sets(
        base, metadata(spark, sf), FREEZE, SEED, question_set.SetSizes())
    return llm_set.unionByName(human_set).select("question_set", "source", "category", "id")


@register("question_set_dates_io14", f"""
    SELECT source, id, CASE WHEN NOT is_market AND has_horizon
           THEN '1999-01-18|1999-02-10' END AS resolution_dates
    FROM {QUESTIONS}""")
def question_set_dates(spark, sf):
    dated = writers.with_resolution_dates(
        questions(spark, sf).withColumn("forecast_due_date", F.lit(DUE)))
    return dated.select("source", "id", F.when(
        F.col("resolution_dates").isNotNull(), F.array_join(
            F.transform("resolution_dates", lambda x: x.cast("string")), "|")).alias(
        "resolution_dates"))


@register("schedule_days_p11", """
    SELECT DISTINCT day, (day - DATE '2024-07-21') % 14 = 0 AS publish,
           (((day - DATE '2024-07-21') % 14) + 14) % 14 = 4 AS curate
    FROM (SELECT CAST(o_orderdate AS DATE) + 10000 AS day FROM orders)""")
def schedule(spark, sf):
    day = F.date_add(F.col("o_orderdate").cast("date"), 10000)
    return T.raw(spark, sf, "orders").select(day.alias("day")).distinct().select(
        "day", D.is_publication_day(F.col("day")).alias("publish"),
        D.is_curation_day(F.col("day")).alias("curate"))
