"""Summary table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from probcast import constants as C
from probcast.catalog import register
from probcast.catalog.inputs import n, num
from probcast.catalog.sampling import QUESTIONS, metadata, questions
from probcast.catalog.scoring import BOARD, SCORED, board_from_lineitem, scored
from probcast.operators import reports as R, trend
from probcast.sources import testtables as T


@register("category_by_source_a4", f"""
    SELECT coalesce(category, 'Total') AS category,
           {', '.join(f"count(*) FILTER (source = '{s}') AS {s}"
                      for s in C.MARKET_SOURCES + C.DATASET_SOURCES)}, count(*) AS total
    FROM {QUESTIONS} GROUP BY ROLLUP (category)""")
def category_by_source(spark, sf):
    return R.category_by_source(questions(spark, sf))


@register("source_table_a5", f"""
    WITH s AS (SELECT CASE WHEN is_market THEN 'market' ELSE 'dataset' END AS family, source,
                      CAST(count(*) FILTER (NOT resolved) AS BIGINT) AS n FROM {QUESTIONS}
               GROUP BY 1, 2)
    SELECT coalesce(family, 'total') AS family, coalesce(source, 'Total') AS source,
           CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs
    FROM s GROUP BY ROLLUP (family, source)""")
def source_table(spark, sf):
    return R.source_table(questions(spark, sf))


@register("bank_summary_a6", f"""
    SELECT coalesce(source, 'Total') AS source, count(*) AS n_unresolved,
           count(*) FILTER (valid_question) AS n_valid_unresolved
    FROM {QUESTIONS} WHERE NOT resolved GROUP BY ROLLUP (source)""")
def bank_summary(spark, sf):
    return R.bank_summary(questions(spark, sf), metadata(spark, sf))


def _pair(spark, sf):
    rows = scored(spark, sf).filter("source <> 'wikipedia'")
    meta = rows.select("source", F.element_at("ids", 1).alias("id")).distinct().withColumn(
        "category", F.element_at(F.array(*[F.lit(c) for c in C.CATEGORIES]),
                                 (F.substring("id", 2, 20).cast("int") % 9 + 1)))
    pick = lambda name: rows.filter(F.col("model") == name).filter(
        (F.col("question_pk").isNotNull()))
    return R.join_model_and_reference(
        pick("model-6"), pick(C.SUPERFORECASTERS), meta)


_CAT = "CASE CAST(substr(a.id, 2) AS INT) % 9 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(C.CATEGORIES)) + " END"
_PAIR = f"""(
    SELECT a.question_type, a.source, a.resolution_date, {_CAT} AS category,
           a.brier_score AS x, b.brier_score AS y
    FROM {SCORED} a JOIN {SCORED} b ON b.source = a.source AND b.id = a.id
     AND b.resolution_date = a.resolution_date AND b.model = 'Superforecaster median forecast'
    WHERE a.model = 'model-6')"""


def _balanced(group: str) -> str:
    def side(v):
        m = f"avg(CASE WHEN question_type = 'market' THEN {v} END)"
        o = f"avg(CASE WHEN question_type = 'dataset' THEN {v} END)"
        return f"round_even(coalesce(({m} + {o}) / 2, {m}, {o}), 3)"

    return f"""SELECT {group}, count(*) AS n, {n(side('x'), 'score_model')},
        {n(side('y'), 'score_reference')}, {n(f"{side('x')} - {side('y')}", 'difference')}
        FROM {_PAIR} GROUP BY 1"""


def _balanced_rows(spark, sf, group):
    return R.balanced_scores(_pair(spark, sf), group).select(
        group, "n", num("score_model"), num("score_reference"), num("difference"))


@register("balanced_scores_by_category_a7", _balanced("category"))
def by_category(spark, sf):
    return _balanced_rows(spark, sf, "category")


@register("balanced_scores_by_source_a7", _balanced("source"))
def by_source(spark, sf):
    return _balanced_rows(spark, sf, "source")


@register("balanced_scores_by_date_a7", _balanced("resolution_date"))
def by_date(spark, sf):
    return _balanced_rows(spark, sf, "resolution_date")


@register("model_against_reference_j12", f"""
    SELECT source, resolution_date, category, {n('x', 'score_model')}, {n('y', 'score_reference')}
    FROM {_PAIR}""")
def model_against_reference(spark, sf):
    return _pair(spark, sf).select("source", "resolution_date", "category", num("score_model"),
                                   num("score_reference"))


@register("top_rows_l2", f"""
    SELECT model_pk, {n('brier_index_overall')} FROM {BOARD}
    ORDER BY brier_index_overall DESC, model_pk LIMIT 10""")
def top_rows(spark, sf):
    return R.top_n(board_from_lineitem(spark, sf), [
        F.col("brier_index_overall").desc(), F.col("model_pk")], 10).select(
        "model_pk", num("brier_index_overall"))


@register("top_row_per_group_l3", """
    SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders
    GROUP BY 1""")
def top_per_group(spark, sf):
    return T.raw(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by(
        "o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@register("sorted_output_l1", f"""
    SELECT source, id, date, {n('value', decimals=2)} FROM {T.sql('series')}
    ORDER BY source NULLS FIRST, id NULLS FIRST, date NULLS FIRST""")
def sorted_output(spark, sf):
    return T.table(spark, sf, "series").orderBy(
        F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(),
        F.col("date").asc_nulls_first()).select(
        "source", "id", "date", num(F.col("value"), "value", 2))


@register("external_names_j18", f"""
    SELECT b.model_pk, e.external_name, {n('e.score', 'score')}, {n('c.flops', 'flops')}
    FROM {BOARD} b
    LEFT JOIN (SELECT p_partkey, concat('model-', p_partkey) AS base_model,
                      concat('ext-', p_partkey) AS external_name, p_retailprice AS score FROM part) e
      ON e.base_model = b.model
    LEFT JOIN (SELECT concat('ext-', p_partkey) AS external_name, CAST(p_size AS DOUBLE) AS flops
               FROM part WHERE p_partkey % 2 = 0) c ON c.external_name = e.external_name""")
def external_names(spark, sf):
    part = T.raw(spark, sf, "part")
    ext = F.concat(F.lit("ext-"), F.col("p_partkey").cast("string"))
    names = part.select(F.concat(F.lit("model-"), F.col("p_partkey").cast("string")).alias(
        "base_model"), ext.alias("external_name"))
    scores = part.select(ext.alias("external_name"), F.col("p_retailprice").alias("score"))
    compute = part.filter("p_partkey % 2 = 0").select(
        ext.alias("external_name"), F.col("p_size").cast("double").alias("flops"))
    board = board_from_lineitem(spark, sf).withColumn("base_model", F.col("model"))
    return R.attach_external_scores(board, names, scores, compute).select(
        "model_pk", "external_name", num("score"), num("flops"))


@register("merged_parity_maps_a15", """
    SELECT concat('t', s_suppkey) AS question_type, concat('a-', s_nationkey) AS first_lower,
           CASE WHEN s_suppkey % 2 = 0 THEN concat('b-', s_nationkey) END AS second_lower
    FROM supplier""")
def merged_parity(spark, sf):
    def side(board, label, rows):
        return rows.select(
            F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("question_type"),
            F.lit(board).alias("board"),
            F.concat(F.lit(label), F.col("s_nationkey").cast("string")).alias("lower"),
            F.lit("u").alias("upper"), F.lit("i").alias("intersection"))

    supplier = T.raw(spark, sf, "supplier")
    merged = trend.merge_parity_maps(side("baseline", "a-", supplier), side(
        "tournament", "b-", supplier.filter("s_suppkey % 2 = 0")))
    return merged.select("question_type", F.col("boards")["baseline"]["lower"].alias(
        "first_lower"), F.try_element_at("boards", F.lit("tournament"))["lower"].alias(
        "second_lower"))
