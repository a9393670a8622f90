"""Baseline forecaster, ensemble and response-parsing queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from probcast import constants as C
from probcast.catalog import inputs as I, register
from probcast.catalog.inputs import d, joined, n, num
from probcast.catalog.series import page_items
from probcast.functions import parsing
from probcast.operators import baselines as B, ensembles, questions as Q, series as S, upsert as U
from probcast.operators.resolve import conflict_base
from probcast.sources import testtables as T

DUE = date(2024, 2, 8)


def due_set(spark, sf):
    dataset = I.dataset_question_set(spark, sf)
    return dataset.unionByName(I.market_question_set(spark, sf))


_GRID = f"""(
    SELECT q.source, q.id, q.forecast_due_date,
           CAST(q.forecast_due_date + h.days AS DATE) AS resolution_date
    FROM {T.sql('dataset_questions')} q CROSS JOIN (VALUES {I.HORIZON_VALUES}) AS h(days)
    UNION ALL
    SELECT q.source, q.id, u.due, NULL FROM {T.sql('market_questions')} q
    CROSS JOIN (VALUES {I.DUE_VALUES}) AS u(due))"""


@register("forecast_grid_b2", f"SELECT * FROM {_GRID}")
def forecast_grid(spark, sf):
    return B.forecast_grid(due_set(spark, sf)).select(
        "source", joined().alias("id"), "forecast_due_date", "resolution_date")


@register("constant_forecasts_b1", f"""
    SELECT g.source, g.id, g.forecast_due_date, g.resolution_date, m.model,
           CAST(m.forecast AS DOUBLE) AS forecast
    FROM {_GRID} g CROSS JOIN (VALUES ('Always 0', 0), ('Always 0.5', 0.5), ('Always 1', 1),
        ('Imputed Forecaster', NULL)) AS m(model, forecast)""")
def constants(spark, sf):
    rows = B.constant_forecasts(B.forecast_grid(due_set(spark, sf)))
    return rows.filter(F.col("model") != C.RANDOM_UNIFORM).select(
        "source", joined().alias("id"), "forecast_due_date", "resolution_date", "model",
        "forecast")


@register("random_forecasts_b1", f"""
    SELECT source, id, forecast_due_date, resolution_date,
           {n("CAST(concat('0x', substr(md5(concat_ws('#', '3', CAST(forecast_due_date AS VARCHAR), source, id, CAST(resolution_date AS VARCHAR))), 1, 8)) AS UBIGINT) / 4294967296", 'forecast')}
    FROM {_GRID}""")
def random_forecasts(spark, sf):
    rows = B.constant_forecasts(B.forecast_grid(due_set(spark, sf)), seed=3)
    return rows.filter(F.col("model") == C.RANDOM_UNIFORM).select(
        "source", joined().alias("id"), "forecast_due_date", "resolution_date", num("forecast"))


@register("bounded_forecasts_b6", f"""
    SELECT l_orderkey, l_linenumber, l_partkey,
           {n('CASE WHEN l_tax > 0.07 THEN 0.5 ELSE greatest(0.05, least(0.95, l_discount * 10)) END',
              'forecast')} FROM lineitem""")
def bounded(spark, sf):
    p = F.when(F.col("l_tax") <= 0.07, F.col("l_discount") * 10)
    return T.raw(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", num(B.bounded(p), "forecast"))


def _asked(ids, due=DUE):
    """Every series on each of the eight horizons."""
    return ids.select("id").distinct().withColumn("date", F.explode(
        F.array(*[F.lit(due + timedelta(days=h)) for h in C.HORIZONS_DAYS])))


@register("naive_series_forecaster_b3")
def naive_forecaster(spark, sf):
    """Chance of increase per part series and resolution day by the sources' models."""
    series = T.table(spark, sf, "series")
    parts = []
    for source in ("dbnomics", "fred", "yfinance"):
        model = B.SOURCE_MODELS[source]
        rows = series.filter(F.col("source") == source).select("id", "date", "value")
        holidays = rows.filter(F.date_format("date", "MM-dd") == "01-15") if model.day_flags else None
        forecast = B.trend_forecast(rows, _asked(rows), DUE, model, holidays)
        parts.append(B.increase_probability(forecast, model).select("id", "date", "forecast"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Without seasons and changes of rate the model is plain least squares.
@register("straight_series_forecaster_b3", f"""
    WITH s AS (SELECT id, date, datediff('day', DATE '2024-01-01', date) AS x, value FROM {T.sql('series')}
               WHERE date < {d(DUE)}),
    last AS (SELECT id, arg_max(value, date) AS last_value FROM s GROUP BY id),
    line AS (SELECT id, regr_slope(value, x) AS slope, regr_intercept(value, x) AS level,
                    avg(value) AS mean, count(DISTINCT x) AS days FROM s GROUP BY id),
    fitted AS (SELECT id, CASE WHEN days > 1 THEN slope ELSE 0 END AS slope,
                      CASE WHEN days > 1 THEN level ELSE mean END AS level FROM line),
    spread AS (SELECT id, greatest(sqrt(avg(pow(value - level - slope * x, 2))), 1e-5 * max(abs(value))) AS noise
               FROM s JOIN fitted USING (id) GROUP BY id),
    h AS (SELECT CAST({d(DUE)} + h.days AS DATE) AS date,
                 datediff('day', DATE '2024-01-01', {d(DUE)}) + h.days AS x
          FROM (VALUES {", ".join(f"({x})" for x in C.HORIZONS_DAYS)}) AS h(days))
    SELECT id, date, {n('level + slope * x', 'mean', 0)},
           {n(f'level + slope * x - {B.SeriesModel().z} * noise', 'lower', 0)},
           {n(f'level + slope * x + {B.SeriesModel().z} * noise', 'upper', 0)},
           {n('last_value', decimals=0)}
    FROM fitted JOIN spread USING (id) JOIN last USING (id) CROSS JOIN h""")
def straight_forecaster(spark, sf):
    rows = T.table(spark, sf, "series").select("id", "date", "value")
    asked = _asked(rows.filter(F.col("date") < F.lit(DUE)))
    forecast = B.trend_forecast(rows, asked, DUE, B.SeriesModel(yearly=False, changes=0))
    return forecast.select("id", "date", *[num(c, decimals=0) for c in ("mean", "lower", "upper", "last_value")])


@register("page_forecaster_b4_s22")
def page_forecaster(spark, sf):
    """All pages in one job: own limits, comparison and value rule per page, eight horizons."""
    items = page_items(spark, sf).select(
        F.concat_ws("|", "page", "item").alias("id"), F.col("page").alias("root"), "date", "value")
    asked = _asked(items, I.TRADES_AS_OF).join(items.select("id", "root").distinct(), "id")
    return B.page_forecasts(items, asked, I.PAGE_RULES, I.TRADES_AS_OF, date(2023, 12, 25)).select(
        "id", "root", "comparison", "date", "forecast")


CONFLICT_DUE = I.TRADES_AS_OF + timedelta(days=31)   # its data lag ends where the events do


@register("conflict_forecaster_b5")
def conflict_forecaster(spark, sf):
    """Every country, metric and question key on each of the eight horizons."""
    daily = S.conflict_daily(T.table(spark, sf, "conflict_events"))
    asked = daily.select("country", "metric").distinct()
    base = S.trailing_sums(daily, asked.withColumn("date", F.lit(I.TRADES_AS_OF)), [360], ["country", "metric"])
    keys = F.array(F.lit(C.CONFLICT_KEY_PLAIN), F.lit(C.CONFLICT_KEY_TENFOLD))
    dates = F.array(*[F.lit(CONFLICT_DUE + timedelta(days=h)) for h in C.HORIZONS_DAYS])
    questions = base.withColumn("key", F.explode(keys)).withColumn("resolution_date", F.explode(dates)).select(
        F.concat_ws("|", "country", "metric", "key").alias("id"), "country", "metric",
        conflict_base(F.col("key"), F.col("sum_360") / 12).alias("base"), "resolution_date")
    return B.conflict_forecast(daily, questions, CONFLICT_DUE, date(2024, 1, 1)).select(
        "id", "resolution_date", "forecast")


@register("day_flags_b7", """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS date,
           CAST(dayofweek(o_orderdate) IN (0, 6) OR strftime(o_orderdate, '%m-%d') = '07-04'
                AS DOUBLE) AS is_holiday FROM orders""")
def day_flags(spark, sf):
    days = T.raw(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")
                                             ).distinct()
    return B.with_day_flags(days, days.filter(F.date_format("date", "MM-dd") == "07-04"))


@register("binary_and_backfilled_values_b4", f"""
    WITH b AS (SELECT id, date, CAST(value >= 0.2 AS DOUBLE) AS value FROM {I.DAILY_CLOSE}),
    f AS (SELECT id, min(date) AS first FROM b GROUP BY 1)
    SELECT id, date, value FROM b UNION ALL
    SELECT id, CAST(unnest(generate_series(DATE '2023-12-25', first - 1, INTERVAL 1 DAY)) AS DATE),
           NULL FROM f""")
def binary_values(spark, sf):
    text = I.daily_close(spark, sf).withColumn(
        "value_str", F.when(F.col("value") >= 0.2, F.lit("held")))
    return B.backfill_to_start(B.binary_values(text), date(2023, 12, 25))


@register("visible_rows_f20", f"""
    SELECT id, date, {n('value', decimals=2)} FROM {T.sql('series')} WHERE date < {d(DUE)}""")
def visible_rows(spark, sf):
    from probcast.operators.filters import until_last_data_day

    return until_last_data_day(T.table(spark, sf, "series"), DUE).select(
        "id", "date", num(F.col("value"), "value", 2))


# --- ensembles -----------------------------------------------------------------------------------

@register("ensembles_a8_a9", f"""
    WITH p AS (SELECT source, id, forecast_due_date, resolution_date, nullif(forecast, 0) AS p
               FROM {I.DATASET_FORECASTS})
    SELECT source, id, forecast_due_date, resolution_date, CAST(count(p) AS BIGINT) AS n,
           {n('median(p)', 'median')},
           {n('CASE WHEN count(p) = 0 THEN 0 ELSE exp(avg(ln(p))) END', 'geometric_mean')},
           {n('''CASE WHEN count(p) = 0 THEN 0 WHEN max(p) = 1 THEN 1
               ELSE 1 / (1 + exp(-avg(CASE WHEN p < 1 THEN ln(p / (1 - p)) END))) END''',
              'log_odds_mean')},
           {n('avg(p)', 'mean')},
           {n('CASE WHEN count(p) > 2 THEN (sum(p) - min(p) - max(p)) / (count(p) - 2) END',
              'trimmed_mean')}
    FROM p GROUP BY 1, 2, 3, 4""")
def ensemble(spark, sf):
    key = ["source", "id", "forecast_due_date", "resolution_date"]
    rows = I.dataset_forecasts(spark, sf).withColumn("id", joined())
    return ensembles.ensemble(rows, key).select(*key, "n", *[num(c) for c in (
        "median", "geometric_mean", "log_odds_mean", "mean", "trimmed_mean")])


@register("brier_summary_a10", f"""
    WITH s AS (SELECT m.model, f.forecast, r.resolved_to,
                      pow(coalesce(f.forecast, 0.5) - r.resolved_to, 2) AS score
               FROM {I.RESOLVED_MARKET} r CROSS JOIN {T.sql('model_dim')} m
               LEFT JOIN {I.MARKET_FORECASTS} f ON f.model_no = m.model_no AND f.id = r.id
                AND f.source = r.source AND f.forecast_due_date = r.forecast_due_date
               WHERE r.resolved_to IS NOT NULL)
    SELECT model, {n('avg(score)', 'mean_brier')},
           {n('avg(score) - 2 * stddev_pop(score) / sqrt(count(score))', 'lower')},
           {n('avg(score) + 2 * stddev_pop(score) / sqrt(count(score))', 'upper')},
           CAST(count(*) FILTER (forecast IS NULL) AS BIGINT) AS refusals,
           CAST(count(score) AS BIGINT) AS n
    FROM s GROUP BY 1""")
def brier_summary(spark, sf):
    from probcast.operators import resolve

    market = resolve.drop_unresolved(I.resolved_market(spark, sf)[0])
    rows = resolve.match_forecasts(market, I.market_forecasts(spark, sf))
    return ensembles.brier_summary(rows).select(
        "model", num("mean_brier"), num("lower"), num("upper"), "refusals", "n")


@register("forecast_success_a14", f"""
    SELECT concat('v', l_linenumber % 2) AS variant,
           CAST(count(CASE WHEN l_tax <= 0.07 THEN 1 END) AS BIGINT) AS got,
           CAST((SELECT count(*) * {len(C.HORIZONS_DAYS)} FROM {T.sql('dataset_questions')}) AS BIGINT) AS expected
    FROM lineitem GROUP BY 1""")
def success(spark, sf):
    forecasts = T.raw(spark, sf, "lineitem").select(
        F.concat(F.lit("v"), (F.col("l_linenumber") % 2).cast("string")).alias("variant"),
        F.when(F.col("l_tax") <= 0.07, F.col("l_discount")).alias("forecast"))
    return ensembles.success_counts(forecasts, I.dataset_question_set(spark, sf))


@register("shared_forecasts_u12", """
    WITH f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount
               FROM lineitem)
    SELECT v.variant, f.* FROM f JOIN (VALUES (0, 'zero-shot'), (0, 'zero-shot-with-freeze-values'),
        (1, 'scratchpad')) AS v(k, variant) ON v.k = f.l_linenumber % 2 WHERE l_linenumber <= 4
    UNION ALL SELECT 'scratchpad-with-news', f.* FROM f WHERE l_linenumber > 4""")
def shared(spark, sf):
    base = T.raw(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    dataset = base.filter("l_linenumber <= 4").withColumn("variant", F.when(
        F.col("l_linenumber") % 2 == 0, "zero-shot").otherwise("scratchpad"))
    market = base.filter("l_linenumber > 4").withColumn("variant", F.lit("scratchpad-with-news"))
    return U.share_forecasts(dataset, market, {
        "zero-shot": ["zero-shot", "zero-shot-with-freeze-values"]})


# --- response text ---------------------------------------------------------------------------------

@register("parse_probability", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN regexp_full_match(trim(response),
        '\\*?([0-9]*\\.?[0-9]+)\\*?') THEN {n("TRY_CAST(replace(trim(response), '*', '') AS DOUBLE)", ' forecast').replace('AS  forecast', '')}
        END AS forecast FROM {T.sql('responses')}""")
def parse_probability(spark, sf):
    return T.table(spark, sf, "responses").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        num(parsing.probability(F.col("response")), "forecast"))


@register("parse_market_responses", f"""
    SELECT l_orderkey, l_linenumber, l_partkey,
           {n("CAST(replace(trim(response), '*', '') AS DOUBLE)", 'forecast')}
    FROM {T.sql('responses')} WHERE l_linenumber % 4 IN (0, 1)""")
def parse_market(spark, sf):
    return parsing.market_forecasts(T.table(spark, sf, "responses")).select(
        "l_orderkey", "l_linenumber", "l_partkey", num("forecast"))


@register("parse_dataset_responses", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(DATE '2024-01-08' + x.k * 7 AS DATE)
           AS resolution_date,
           round(CAST(CASE x.k WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE 0.5 END AS DOUBLE), 8)
               + 0.0 AS forecast
    FROM lineitem CROSS JOIN (VALUES (0), (1), (2)) AS x(k) WHERE l_linenumber % 3 <> 0""")
def parse_dataset(spark, sf):
    text = lambda c: F.format_number(F.abs(F.col(c)), 2)
    dates = F.array(*[F.lit(date(2024, 1, 8 + 7 * k)) for k in range(3)])
    full = F.concat_ws(", ", text("l_discount"), F.concat(F.lit("*"), text("l_tax"), F.lit("*")),
                       F.lit("0.5"))
    short = F.concat_ws(" ", text("l_discount"), text("l_tax"))
    responses = T.raw(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", dates.alias("resolution_dates"),
        F.when(F.col("l_linenumber") % 3 != 0, full).otherwise(short).alias("response"))
    return parsing.dataset_forecasts(responses).select(
        "l_orderkey", "l_linenumber", "l_partkey", "resolution_date", num("forecast"))


@register("parse_literal_lists_and_last_token", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_linenumber <= 5 THEN concat(printf('%.2f', abs(l_discount)), '|',
                printf('%.2f', abs(l_tax))) END AS listed,
           round(abs(l_discount), 8) + 0.0 AS last_token FROM lineitem""")
def parse_lists(spark, sf):
    text = lambda c: F.format_number(F.abs(F.col(c)), 2)
    body = F.concat_ws(", ", text("l_discount"), text("l_tax"))
    listed = F.when(F.col("l_linenumber") <= 5, F.concat(F.lit(" ["), body, F.lit("] "))).otherwise(
        F.concat(F.lit("about "), body))
    note = F.concat(F.lit("first *0.9* then *"), text("l_discount"), F.lit("* but not *7* at all"))
    shown = F.transform(parsing.literal_list(listed), lambda v: F.format_number(v, 2))
    return T.raw(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join(shown, "|").alias("listed"),
        num(parsing.last_starred(note), "last_token"))


@register("rendered_prompts_g13", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN
        concat('Q: Will order ', o_orderkey, ' rise by each of the resolution dates provided below since 1999-01-11? B: bg',
               CASE WHEN o_custkey % 2 = 0 THEN chr(10) || 'crit' ELSE '' END)
        ELSE concat('M: Will order ', o_orderkey, ' rise by {resolution_date} since {forecast_due_date}? B: bg',
               CASE WHEN o_custkey % 2 = 0 THEN chr(10) || 'crit' ELSE '' END) END AS prompt
    FROM orders""")
def prompts(spark, sf):
    text = F.concat(F.lit("Will order "), F.col("o_orderkey").cast("string"),
                    F.lit(" rise by {resolution_date} since {forecast_due_date}?"))
    rows = T.raw(spark, sf, "orders").select(
        "o_orderkey", text.alias("question"), F.lit("bg").alias("background"),
        F.when(F.col("o_orderkey") % 2 == 0, "fred").otherwise("infer").alias("source"),
        F.lit(date(1999, 1, 11)).alias("forecast_due_date"),
        F.when(F.col("o_custkey") % 2 == 0, "crit").otherwise("N/A").alias(
            "market_info_resolution_criteria"))
    return Q.render_prompts(rows, "Q: {question} B: {background}",
                            "M: {question} B: {background}").select("o_orderkey", "prompt")
