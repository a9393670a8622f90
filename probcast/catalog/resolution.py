"""Resolution queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from probcast import constants as C
from probcast.catalog import inputs as I, register
from probcast.catalog.inputs import d, joined, n, num
from probcast.operators import filters, reports, resolve
from probcast.sources import testtables as T

SIGNS = "(VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) AS g(s0, s1)"
_PAIRS_DATASET = f"""(
    SELECT a.source, concat(a.id, '|', b.id) AS ids, a.id AS id0, b.id AS id1,
           a.forecast_due_date
    FROM {T.sql('dataset_questions')} a JOIN {T.sql('dataset_questions')} b
      ON b.source = a.source AND b.forecast_due_date = a.forecast_due_date
     AND b.part_no = a.part_no + 3)"""


@register("explode_question_set_r1", f"""
    SELECT source, ids, direction, forecast_due_date, resolution_date FROM (
        SELECT q.source, q.id AS ids, '' AS direction, q.forecast_due_date,
               CAST(q.forecast_due_date + h.days AS DATE) AS resolution_date
        FROM {T.sql('dataset_questions')} q CROSS JOIN (VALUES {I.HORIZON_VALUES}) AS h(days)
        UNION ALL
        SELECT p.source, p.ids, concat(g.s0, '|', g.s1), p.forecast_due_date,
               CAST(p.forecast_due_date + h.days AS DATE)
        FROM {_PAIRS_DATASET} p CROSS JOIN (VALUES {I.HORIZON_VALUES}) AS h(days)
        CROSS JOIN {SIGNS})
    WHERE resolution_date < {d(I.AS_OF)}""")
def explode(spark, sf):
    rows = resolve.explode_question_set(I.dataset_question_set(spark, sf, True), I.AS_OF)
    return rows.select("source", joined().alias("ids"), joined("direction").alias("direction"),
                       "forecast_due_date", "resolution_date")


@register("explode_market_dates_r1", f"""
    SELECT q.source, q.id, due AS forecast_due_date, x.resolution_date
    FROM {T.sql('market_questions')} q CROSS JOIN (VALUES {I.DUE_VALUES}) AS u(due)
    JOIN (SELECT DISTINCT due AS set_due, CAST(due + 7 AS DATE) AS resolution_date
          FROM (VALUES {I.DUE_VALUES}) AS u(due)) x ON x.set_due = u.due
    WHERE x.resolution_date < {d(I.TRADES_AS_OF)}""")
def explode_market(spark, sf):
    rows = resolve.explode_question_set(I.market_question_set(spark, sf), I.TRADES_AS_OF)
    return rows.select("source", joined().alias("id"), "forecast_due_date", "resolution_date")


@register("resolve_dataset_r2", f"""
    SELECT source, id, forecast_due_date, resolution_date, resolved_to,
           {n('market_value_on_due_date')}, resolved_to IS NOT NULL AS resolved
    FROM {I.RESOLVED_DATASET}""")
def resolve_dataset(spark, sf):
    return I.resolved_dataset(spark, sf).select(
        "source", joined().alias("id"), "forecast_due_date", "resolution_date", "resolved_to",
        num("market_value_on_due_date"), "resolved")


@register("resolve_dataset_combinations_j3", f"""
    SELECT p.source, p.ids, concat(g.s0, '|', g.s1) AS direction, p.forecast_due_date,
           a.resolution_date,
           CASE WHEN g.s0 = 1 THEN a.resolved_to ELSE 1 - a.resolved_to END
         * CASE WHEN g.s1 = 1 THEN b.resolved_to ELSE 1 - b.resolved_to END AS resolved_to
    FROM {_PAIRS_DATASET} p CROSS JOIN {SIGNS}
    JOIN {I.RESOLVED_DATASET} a ON a.source = p.source AND a.id = p.id0
     AND a.forecast_due_date = p.forecast_due_date
    JOIN {I.RESOLVED_DATASET} b ON b.source = p.source AND b.id = p.id1
     AND b.forecast_due_date = p.forecast_due_date AND b.resolution_date = a.resolution_date""")
def resolve_combinations(spark, sf):
    return I.resolved_dataset(spark, sf, True).filter(F.size("ids") > 1).select(
        "source", joined().alias("ids"), joined("direction").alias("direction"),
        "forecast_due_date", "resolution_date", "resolved_to")


@register("value_lookups_j1_j2", f"""
    SELECT q.source, q.id, q.forecast_due_date, {n('a.value', 'on_due_date', 2)},
           {n('b.value', 'before_due_date', 2)}, {n('l.value', 'last_value', 2)}
    FROM {T.sql('dataset_questions')} q
    LEFT JOIN {T.sql('series')} a ON a.source = q.source AND a.id = q.id
     AND a.date = q.forecast_due_date
    LEFT JOIN {T.sql('series')} b ON b.source = q.source AND b.id = q.id
     AND b.date = q.forecast_due_date - 1
    LEFT JOIN (SELECT source, id, arg_max(value, date) AS value FROM {T.sql('series')}
               GROUP BY 1, 2) l ON l.source = q.source AND l.id = q.id""")
def value_lookups(spark, sf):
    asked = T.table(spark, sf, "dataset_questions")
    due = F.col("forecast_due_date")
    wanted = asked.select(F.explode(F.array(due, F.date_sub(due, 1))).alias("date"))
    maps = resolve.value_maps(T.table(spark, sf, "series"), wanted)
    return asked.join(maps, ["source", "id"], "left").select(
        "source", "id", "forecast_due_date",
        num(F.try_element_at("values", due), "on_due_date", 2),
        num(F.try_element_at("values", F.date_sub(due, 1)), "before_due_date", 2),
        num(F.col("last.value"), "last_value", 2))


@register("resolve_market_r3", f"""
    SELECT source, id, forecast_due_date, resolution_date, resolved, {n('resolved_to')},
           {n('market_value_on_due_date')}, {n('market_value_on_due_date_minus_one')}
    FROM {I.RESOLVED_MARKET}""")
def resolve_market(spark, sf):
    rows, _ = I.resolved_market(spark, sf)
    return rows.select(
        "source", joined().alias("id"), "forecast_due_date", "resolution_date", "resolved",
        num("resolved_to"), num("market_value_on_due_date"),
        num("market_value_on_due_date_minus_one"))


@register("market_resolution_warnings_r3", f"""
    SELECT DISTINCT source, id, url, {n('last_value', 'value')} FROM {I.RESOLVED_MARKET}
    WHERE resolved AND last_value IS NOT NULL AND last_value NOT IN (0, 1)""")
def market_warnings(spark, sf):
    return I.resolved_market(spark, sf)[1].select("source", "id", "url", num("value"))


@register("market_resolution_date_r4", f"""
    SELECT source, id, resolved_on FROM {I.MARKET_FACTS}""")
def market_dates(spark, sf):
    return T.table(spark, sf, "market_questions").select(
        "source", "id", resolve.market_resolution_date(
            F.col("market_info_close_datetime"),
            F.col("market_info_resolution_datetime")).alias("resolved_on"))


def market_combinations_sql(resolved, yesterday):
    return f"""
    WITH legs AS (
        SELECT a.source, a.forecast_due_date, concat(a.id, '|', b.id) AS ids, g.s0, g.s1,
               a.resolved AS r0, b.resolved AS r1, a.resolved_to AS v0, b.resolved_to AS v1,
               a.resolution_date AS d0, b.resolution_date AS d1,
               a.market_value_on_due_date AS m0, b.market_value_on_due_date AS m1
        FROM {resolved} a JOIN {resolved} b
          ON b.source = a.source AND b.forecast_due_date = a.forecast_due_date
         AND b.user_no = a.user_no + 4
        CROSS JOIN {SIGNS}),
    decided AS (
        SELECT *, (
            SELECT CASE WHEN bool_or(done) THEN coalesce(
                min(day) FILTER (WHERE value IS NULL OR (done AND value <> CAST(sign = 1 AS INT)
                                 AND value IN (0, 1))),
                CASE WHEN count(*) FILTER (WHERE done AND value = CAST(sign = 1 AS INT)) = 2
                     THEN max(day) END) END
            FROM (VALUES (r0, s0, v0, d0), (r1, s1, v1, d1)) AS leg(done, sign, value, day)
            ) AS decided_on
        FROM legs)
    SELECT source, ids, concat(s0, '|', s1) AS direction, forecast_due_date,
           coalesce(decided_on, {d(yesterday)}) AS resolution_date,
           decided_on IS NOT NULL AS resolved,
           {n('CASE WHEN s0 = 1 THEN v0 ELSE 1 - v0 END * CASE WHEN s1 = 1 THEN v1 ELSE 1 - v1 END',
              'resolved_to')},
           {n('CASE WHEN s0 = 1 THEN m0 ELSE 1 - m0 END * CASE WHEN s1 = 1 THEN m1 ELSE 1 - m1 END',
              'market_value_on_due_date')}
    FROM decided"""


@register("resolve_market_combinations_r5_r6",
          market_combinations_sql(I.RESOLVED_MARKET, I.TRADES_YESTERDAY))
def resolve_market_combinations(spark, sf):
    rows, _ = I.resolved_market(spark, sf, True)
    return rows.filter(F.size("ids") > 1).select(
        "source", joined().alias("ids"), joined("direction").alias("direction"),
        "forecast_due_date", "resolution_date", "resolved", num("resolved_to"),
        num("market_value_on_due_date"))


# --- conflict --------------------------------------------------------------------------------

CONFLICT_DUES = [date(2024, 1, 16), date(2024, 1, 22)]
_METRICS = ["view", "signup", "error", "click", "purchase", "fatalities"]
_METRIC_VALUES = ", ".join(f"('{m}')" for m in _METRICS)
_KEY_VALUES = f"('{C.CONFLICT_KEY_PLAIN}'), ('{C.CONFLICT_KEY_TENFOLD}')"
CONFLICT_DAILY = f"""(
    SELECT country, event_date AS date, event_type AS metric, CAST(count(*) AS BIGINT) AS n
    FROM {T.sql('conflict_events')} GROUP BY 1, 2, 3
    UNION ALL
    SELECT country, event_date, 'fatalities', CAST(sum(fatalities) AS BIGINT)
    FROM {T.sql('conflict_events')} GROUP BY 1, 2)"""


def conflict_attributes(spark, sf):
    kinds = F.array(*[F.struct(F.lit(m).alias("event_type"), F.lit(k).alias("key"))
                      for m in _METRICS for k in (C.CONFLICT_KEY_PLAIN, C.CONFLICT_KEY_TENFOLD)])
    return T.table(spark, sf, "conflict_events").select("country").distinct().select(
        "country", F.explode(kinds).alias("_k")).select(
        F.concat_ws("/", "country", "_k.event_type", "_k.key").alias("id"), "_k.key",
        "_k.event_type", "country")


def conflict_sql(dues, days):
    return f"""
    WITH asked AS (
        SELECT concat(c.country, '/', m.metric, '/', k.key) AS id, c.country, m.metric, k.key,
               u.due AS forecast_due_date, CAST(u.due + {days} AS DATE) AS resolution_date
        FROM (SELECT DISTINCT country FROM {T.sql('conflict_events')}) c
        CROSS JOIN (VALUES {_METRIC_VALUES}) AS m(metric)
        CROSS JOIN (VALUES {_KEY_VALUES}) AS k(key)
        CROSS JOIN (VALUES {", ".join(f"({d(x)})" for x in dues)}) AS u(due)),
    recent AS (
        SELECT a.id, a.forecast_due_date, sum(e.n) AS total FROM asked a
        JOIN {CONFLICT_DAILY} e ON e.country = a.country AND e.metric = a.metric
         AND e.date >= a.resolution_date - 30 AND e.date < a.resolution_date GROUP BY 1, 2),
    base AS (
        SELECT a.id, a.forecast_due_date, sum(e.n) AS total FROM asked a
        JOIN {CONFLICT_DAILY} e ON e.country = a.country AND e.metric = a.metric
         AND e.date >= a.forecast_due_date - 360 AND e.date < a.forecast_due_date GROUP BY 1, 2)
    SELECT a.id, a.forecast_due_date, a.resolution_date,
           CAST(coalesce(r.total, 0) > CASE WHEN a.key = '{C.CONFLICT_KEY_PLAIN}'
                THEN coalesce(b.total, 0) / CAST(12 AS DOUBLE)
                ELSE 10 * (1 + coalesce(b.total, 0) / CAST(12 AS DOUBLE)) END AS DOUBLE)
               AS resolved_to, TRUE AS resolved
    FROM asked a LEFT JOIN recent r ON r.id = a.id AND r.forecast_due_date = a.forecast_due_date
    LEFT JOIN base b ON b.id = a.id AND b.forecast_due_date = a.forecast_due_date"""


@register("resolve_conflict_r7", conflict_sql(CONFLICT_DUES, 7))
def resolve_conflict(spark, sf):
    attributes = conflict_attributes(spark, sf)
    asked = attributes.select(
        F.lit("acled").alias("source"), F.array("id").alias("ids"),
        F.array().cast("array<int>").alias("direction"),
        F.explode(F.array(*[F.lit(x) for x in CONFLICT_DUES])).alias("forecast_due_date")
    ).withColumn("resolution_date", F.date_add("forecast_due_date", 7))
    rows = resolve.resolve_conflict(
        asked, attributes.select("id"), attributes, T.table(spark, sf, "conflict_events"))
    return rows.select(joined().alias("id"), "forecast_due_date", "resolution_date",
                       "resolved_to", "resolved")


# --- pages -----------------------------------------------------------------------------------

_KINDS = [C.SAME, C.SAME_OR_MORE, C.SAME_OR_LESS, C.MORE, C.ONE_PERCENT_MORE]
_KIND_SQL = ("CASE part_no % 5 " + " ".join(
    f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END")
_PAGE_SERIES = f"""(SELECT id, date, CASE WHEN day(date) % 9 = 0 THEN NULL ELSE value END AS value
                    FROM {T.sql('series')})"""


PAGES_SQL = f"""
    WITH held AS (
        SELECT k.id, k.date, s.value FROM (
            SELECT id, CAST(unnest(generate_series(min(date), {d(I.YESTERDAY)}, INTERVAL 1 DAY))
                   AS DATE) AS date FROM {_PAGE_SERIES} GROUP BY id) k
        ASOF JOIN {_PAGE_SERIES} s ON k.id = s.id AND k.date >= s.date),
    asked AS (
        SELECT q.id, CASE WHEN part_no % 10 = 0 AND part_no > 0
                          THEN concat('p', CAST(part_no - 1 AS VARCHAR)) ELSE q.id END AS target,
               q.forecast_due_date, CAST(q.forecast_due_date + h.days AS DATE) AS resolution_date
        FROM {T.sql('dataset_questions')} q CROSS JOIN (VALUES {I.HORIZON_VALUES}) AS h(days)
        WHERE q.forecast_due_date + h.days < {d(I.AS_OF)}),
    kinds AS (SELECT DISTINCT id, {_KIND_SQL} AS kind FROM {T.sql('dataset_questions')})
    SELECT a.id, a.forecast_due_date, a.resolution_date,
           CASE WHEN b.value IS NULL OR k.kind IS NULL THEN NULL ELSE CAST(coalesce(CASE k.kind
               WHEN 'SAME' THEN l.value = b.value WHEN 'SAME_OR_MORE' THEN l.value >= b.value
               WHEN 'SAME_OR_LESS' THEN l.value <= b.value WHEN 'MORE' THEN l.value > b.value
               ELSE l.value >= b.value * CAST(1.01 AS DOUBLE) END, FALSE) AS DOUBLE) END
               AS resolved_to, TRUE AS resolved
    FROM asked a LEFT JOIN kinds k ON k.id = a.target
    LEFT JOIN held b ON b.id = a.target AND b.date = a.forecast_due_date
    LEFT JOIN held l ON l.id = a.target AND l.date = a.resolution_date"""


def page_inputs(spark, sf, prefix="p"):
    """(attributes, remaps, series) of page questions made of the part series."""
    base = T.table(spark, sf, "dataset_questions")
    named = lambda number: F.concat(F.lit(prefix), number.cast("string"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]),
                        (F.col("part_no") % 5 + 1).cast("int"))
    attributes = base.select(named(F.col("part_no")).alias("id"), kind.alias("question_type")).distinct()
    remaps = base.filter((F.col("part_no") % 10 == 0) & (F.col("part_no") > 0)).select(
        named(F.col("part_no")).alias("old_id"), named(F.col("part_no") - 1).alias("new_id")).distinct()
    stored = T.table(spark, sf, "series").select(
        F.concat(F.lit(prefix), F.substring("id", 2, 20)).alias("id"), "date",
        F.when(F.dayofmonth("date") % 9 != 0, F.col("value")).alias("value"))
    return attributes, remaps, stored


@register("resolve_pages_r8", PAGES_SQL)
def resolve_pages(spark, sf):
    attributes, remaps, stored = page_inputs(spark, sf)
    asked = T.table(spark, sf, "dataset_questions").select(
        F.lit("wikipedia").alias("source"), F.array("id").alias("ids"),
        F.array().cast("array<int>").alias("direction"), "forecast_due_date",
        F.explode(F.array(*[F.date_add("forecast_due_date", h) for h in I.HORIZONS])).alias(
            "resolution_date")).filter(F.col("resolution_date") < F.lit(I.AS_OF))
    rows = resolve.resolve_pages(asked, attributes, remaps, stored, I.AS_OF)
    return rows.select(joined().alias("id"), "forecast_due_date", "resolution_date",
                       "resolved_to", "resolved")


# --- nullification and wrappers ----------------------------------------------------------------

def nullified_list(spark, sf):
    """Every part whose number ends in 0 is nullified from a date that depends on the part."""
    return T.table(spark, sf, "dataset_questions").filter(F.col("part_no") % 10 == 0).select(
        "source", "id", F.date_add(F.lit(date(2024, 1, 20)), (F.col("part_no") % 7).cast(
            "int")).alias("start_date")).distinct()


_NULLIFIED = f"""(SELECT DISTINCT source, id,
    CAST(DATE '2024-01-20' + CAST(part_no % 7 AS INT) AS DATE) AS start_date
    FROM {T.sql('dataset_questions')} WHERE part_no % 10 = 0)"""


@register("nullified_ids_f7", f"""
    SELECT source, id FROM {_NULLIFIED} WHERE start_date <= DATE '2024-01-23'""")
def nullified_ids(spark, sf):
    return filters.active_nullifications(nullified_list(spark, sf), date(2024, 1, 23))


@register("resolve_with_nullification_r9", f"""
    SELECT r.source, r.id, r.forecast_due_date, r.resolution_date,
           CASE WHEN x.id IS NULL THEN r.resolved_to END AS resolved_to,
           x.id IS NOT NULL OR r.resolved_to IS NOT NULL AS resolved
    FROM {I.RESOLVED_DATASET} r LEFT JOIN {_NULLIFIED} x ON x.source = r.source
     AND x.id = r.id AND x.start_date <= r.forecast_due_date""")
def resolve_nullified(spark, sf):
    exploded = resolve.explode_question_set(I.dataset_question_set(spark, sf), I.AS_OF)
    daily = I.daily_series(spark, sf)
    rows = resolve.with_nullification(
        exploded, nullified_list(spark, sf), lambda part: resolve.resolve_dataset(part, daily))
    return rows.select("source", joined().alias("id"), "forecast_due_date", "resolution_date",
                       "resolved_to", "resolved")


@register("missing_series_r10", f"""
    SELECT DISTINCT source, concat(id, 'x') AS id FROM {T.sql('dataset_questions')}
    WHERE part_no % 4 = 0
    EXCEPT SELECT source, id FROM {T.sql('series')}""")
def missing_series(spark, sf):
    asked = I.dataset_question_set(spark, sf).withColumn("ids", F.transform("ids", lambda x: F.when(
        F.substring(x, 2, 20).cast("bigint") % 4 == 0, F.concat(x, F.lit("x"))).otherwise(x)))
    return resolve.missing_series(asked, T.table(spark, sf, "series"))


@register("resolve_all_r11", f"""
    SELECT source, id, forecast_due_date, resolution_date, {n('resolved_to')} FROM (
        SELECT r.source, r.id, r.forecast_due_date, r.resolution_date, r.resolved_to
        FROM {I.RESOLVED_DATASET} r LEFT JOIN {_NULLIFIED} x ON x.source = r.source
         AND x.id = r.id AND x.start_date <= r.forecast_due_date
        WHERE x.id IS NULL AND r.resolved_to IS NOT NULL
        UNION ALL
        SELECT source, id, forecast_due_date, resolution_date, resolved_to
        FROM {I.RESOLVED_MARKET} WHERE resolved_to IS NOT NULL)""")
def resolve_all(spark, sf):
    from probcast import schemas as S

    dataset = resolve.explode_question_set(I.dataset_question_set(spark, sf), I.AS_OF)
    nothing = S.empty(spark, "id STRING, key STRING, event_type STRING, country STRING")
    common = dict(
        conflict_events=T.table(spark, sf, "conflict_events"), conflict_attributes=nothing,
        page_attributes=S.empty(spark, "id STRING, question_type STRING"),
        page_remaps=S.empty(spark, "old_id STRING, new_id STRING"), check=False)
    questions = T.table(spark, sf, "market_questions")
    first, _ = resolve.resolve_all(dataset, questions, I.daily_series(spark, sf),
                                   nullified_list(spark, sf), I.AS_OF, **common)
    market = resolve.explode_question_set(
        I.market_question_set(spark, sf), I.TRADES_AS_OF, market_once=True)
    second, _ = resolve.resolve_all(market, questions, I.market_series(spark, sf),
                                    nullified_list(spark, sf), I.TRADES_AS_OF, **common)
    return first.unionByName(second).select(
        "source", joined().alias("id"), "forecast_due_date", "resolution_date",
        num("resolved_to"))


# --- the whole job ----------------------------------------------------------------------------

JOB_CONFLICT_DUES = [date(2024, 1, 11), date(2024, 1, 25)]
JOB_CONFLICT_DAYS = 5
_JOB_MARKET = I.resolved_market_sql(I.YESTERDAY)
_JOB_RESOLVED = f"""(
    WITH part AS (
        SELECT r.* FROM {I.RESOLVED_DATASET} r LEFT JOIN {_NULLIFIED} x ON x.source = r.source
         AND x.id = r.id AND x.start_date <= r.forecast_due_date
        WHERE x.id IS NULL AND r.resolved_to IS NOT NULL),
    market AS (SELECT * FROM {_JOB_MARKET}),
    pairs AS ({market_combinations_sql('market', I.YESTERDAY)}),
    conflict AS ({conflict_sql(JOB_CONFLICT_DUES, JOB_CONFLICT_DAYS)}),
    pages AS ({PAGES_SQL})
    SELECT source, id AS ids, '' AS direction, forecast_due_date, resolution_date, resolved_to,
           NULL AS on_due, NULL AS before_due FROM part
    UNION ALL
    SELECT a.source, concat(a.id, '|', b.id), concat(g.s0, '|', g.s1), a.forecast_due_date, a.resolution_date,
           CASE WHEN g.s0 = 1 THEN a.resolved_to ELSE 1 - a.resolved_to END
           * CASE WHEN g.s1 = 1 THEN b.resolved_to ELSE 1 - b.resolved_to END, NULL, NULL
    FROM part a JOIN part b ON b.source = a.source AND b.forecast_due_date = a.forecast_due_date
     AND b.resolution_date = a.resolution_date AND b.part_no = a.part_no + 3 CROSS JOIN {SIGNS}
    UNION ALL
    SELECT source, id, '', forecast_due_date, resolution_date, resolved_to, market_value_on_due_date,
           market_value_on_due_date_minus_one FROM market WHERE resolved_to IS NOT NULL
    UNION ALL
    SELECT source, ids, direction, forecast_due_date, resolution_date, resolved_to, market_value_on_due_date, NULL
    FROM pairs WHERE resolved_to IS NOT NULL
    UNION ALL
    SELECT 'acled', id, '', forecast_due_date, resolution_date, resolved_to, NULL, NULL
    FROM conflict WHERE resolved_to IS NOT NULL
    UNION ALL
    SELECT 'wikipedia', concat('w', substr(id, 2)), '', forecast_due_date, resolution_date, resolved_to, NULL, NULL
    FROM pages WHERE resolved_to IS NOT NULL)"""
_JOB_FORECASTS = f"""(
    SELECT model_no, source, id, forecast_due_date, resolution_date, forecast FROM {I.DATASET_FORECASTS}
    UNION ALL
    SELECT model_no, source, id, forecast_due_date, NULL, forecast FROM {I.MARKET_FORECASTS} WHERE forecast IS NOT NULL)"""
_MARKET_SOURCES = ", ".join(f"'{x}'" for x in C.MARKET_SOURCES)


@register("resolve_job_r10_r11_r12", f"""
    WITH resolved AS {_JOB_RESOLVED}, given AS {_JOB_FORECASTS},
    submitted AS (SELECT DISTINCT model_no, forecast_due_date FROM given),
    filled AS (
        SELECT r.source, r.ids, r.direction, r.forecast_due_date, r.resolution_date, r.resolved_to,
               f.forecast IS NULL AS imputed,
               coalesce(f.forecast, CASE WHEN r.source NOT IN ({_MARKET_SOURCES}) THEN 0.5
                   WHEN s.model_no = 'm2' THEN r.on_due WHEN s.model_no = 'm1' THEN r.before_due ELSE 0.5 END) AS forecast
        FROM resolved r JOIN submitted s ON s.forecast_due_date = r.forecast_due_date
        LEFT JOIN given f ON f.model_no = s.model_no AND f.source = r.source AND f.id = r.ids
         AND r.direction = '' AND f.forecast_due_date = r.forecast_due_date
         AND (f.resolution_date = r.resolution_date OR r.source IN ({_MARKET_SOURCES})))
    SELECT source, ids, direction, forecast_due_date, resolution_date, {n('resolved_to')},
           CAST(count(*) AS BIGINT) AS n_models, CAST(count(*) FILTER (imputed) AS BIGINT) AS n_imputed,
           CAST(count(forecast) AS BIGINT) AS n_forecasts, {n('sum(forecast)', 'sum_forecast', 6)},
           {n('min(forecast)', 'min_forecast')}, {n('max(forecast)', 'max_forecast')}
    FROM filled GROUP BY ALL""")
def resolve_job(spark, sf):
    """Question sets of all four families, one of them with renames, singles and combinations, nullified
    questions left out, all checks on; then every submission of each due date on every resolved row."""
    from probcast.plans.resolution import QuestionBank, process_forecasts, resolve_question_set

    base, attributes = T.table(spark, sf, "dataset_questions"), conflict_attributes(spark, sf)
    page_attributes, remaps, page_series = page_inputs(spark, sf, "w")
    no_dates = lambda df, source: df.select(F.lit(source).alias("source"), "id")
    questions = T.table(spark, sf, "market_questions").unionByName(
        base.select("source", "id").distinct(), True).unionByName(
        no_dates(attributes, "acled"), True).unionByName(no_dates(page_attributes, "wikipedia"), True)
    series = I.daily_series(spark, sf).select("source", "id", "date", "value").unionByName(
        I.market_series(spark, sf, I.YESTERDAY).select("source", "id", "date", "value")).unionByName(
        page_series.select(F.lit("wikipedia").alias("source"), "id", "date", "value"))
    bank = QuestionBank(questions, series, nullified_list(spark, sf), T.table(spark, sf, "conflict_events"),
                        attributes, page_attributes, remaps)
    conflict = attributes.select(
        F.explode(F.array(*[F.lit(x) for x in JOB_CONFLICT_DUES])).alias("forecast_due_date"),
        F.lit("acled").alias("source"), F.array("id").alias("ids")).withColumn(
        "resolution_dates", F.array(F.date_add("forecast_due_date", JOB_CONFLICT_DAYS)))
    pages = base.select(
        "forecast_due_date", F.lit("wikipedia").alias("source"),
        F.array(F.concat(F.lit("w"), F.col("part_no").cast("string"))).alias("ids"),
        F.array(*[F.date_add("forecast_due_date", h) for h in I.HORIZONS]).alias("resolution_dates"))
    asked = I.dataset_question_set(spark, sf, True).unionByName(
        I.market_question_set(spark, sf, True)).unionByName(conflict).unionByName(pages)
    resolved, _ = resolve_question_set(asked, bank, I.AS_OF)
    given = I.dataset_forecasts(spark, sf).withColumn("resolution_date", F.col("resolution_date").cast("string"))
    market = I.market_forecasts(spark, sf).withColumn("resolution_date", F.lit(None).cast("string"))
    rows = process_forecasts(given.unionByName(market, True), resolved, I.ORG)
    key = ["source", joined().alias("ids"), joined("direction").alias("direction"), "forecast_due_date",
           "resolution_date", num("resolved_to")]
    return rows.groupBy(*key).agg(
        F.count("*").alias("n_models"), F.count_if("imputed").alias("n_imputed"),
        F.count("forecast").alias("n_forecasts"), num(F.sum("forecast"), "sum_forecast", 6),
        num(F.min("forecast"), "min_forecast"), num(F.max("forecast"), "max_forecast"))


# --- forecasts -------------------------------------------------------------------------------

@register("prepare_forecasts_f5", f"""
    SELECT m.model, f.source, f.id, f.forecast_due_date, f.resolution_date, {n('f.forecast', 'forecast')}
    FROM {I.VALID_DATASET_FORECASTS} f JOIN {T.sql('model_dim')} m ON m.model_no = f.model_no""")
def prepare_forecasts(spark, sf):
    return filters.valid_forecasts(I.raw_dataset_forecasts(spark, sf)).select(
        "model", "source", joined().alias("id"), "forecast_due_date", "resolution_date",
        num("forecast"))


@register("duplicate_forecasts_f5", f"""
    SELECT m.model, f.source, f.id, f.forecast_due_date, f.resolution_date,
           CAST(count(*) AS BIGINT) AS n
    FROM {I.VALID_DATASET_FORECASTS} f JOIN {T.sql('model_dim')} m ON m.model_no = f.model_no
    GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1""")
def duplicate_forecasts(spark, sf):
    valid = filters.valid_forecasts(I.raw_dataset_forecasts(spark, sf))
    return filters.duplicate_forecasts(valid).select(
        "model", "source", joined().alias("id"), "forecast_due_date", "resolution_date",
        F.col("count").alias("n"))


# A 29 February that its shifted year does not have is no date.
@register("bounded_dates_f6", """
    SELECT o_orderkey, CASE WHEN 1995 + o_orderkey % 300 > 2262 THEN DATE '2262-04-11' ELSE (SELECT CASE WHEN x IS NOT NULL THEN least(x, DATE '2262-04-11') END FROM (SELECT TRY_CAST(
           concat(CAST(1995 + o_orderkey % 300 AS VARCHAR), strftime(o_orderdate, '-%m-%d')) AS DATE) AS x))
           END AS day FROM orders""")
def bounded_dates(spark, sf):
    from probcast.functions.dates import bounded_date

    text = F.concat((F.lit(1995) + F.col("o_orderkey") % 300).cast("string"),
                    F.date_format("o_orderdate", "-MM-dd"))
    return T.raw(spark, sf, "orders").select("o_orderkey", bounded_date(text).alias("day"))


@register("match_and_impute_j4_r12", f"""
    SELECT model, source, id, forecast_due_date, resolution_date, imputed, {n('forecast')},
           {n('resolved_to')} FROM {I.PROCESSED}""")
def match_and_impute(spark, sf):
    return I.processed(spark, sf).select(
        "model", "source", joined().alias("id"), "forecast_due_date", "resolution_date",
        "imputed", num("forecast"), num("resolved_to"))


@register("human_set_resolutions_j5", f"""
    SELECT r.source, r.id, r.forecast_due_date, r.resolution_date, r.resolved_to
    FROM {I.RESOLVED_DATASET} r WHERE EXISTS (
        SELECT 1 FROM {T.sql('dataset_questions')} h WHERE h.part_no % 5 < 2
         AND h.source = r.source AND h.id = r.id AND h.forecast_due_date = r.forecast_due_date)""")
def human_set(spark, sf):
    human = T.table(spark, sf, "dataset_questions").filter("part_no % 5 < 2").select(
        "forecast_due_date", "source", F.array("id").alias("ids"))
    return resolve.restrict_to_human_set(I.resolved_dataset(spark, sf), human).select(
        "source", joined().alias("id"), "forecast_due_date", "resolution_date", "resolved_to")


@register("resolution_breakdown_r13", f"""
    WITH singles AS (
        SELECT forecast_due_date, source, CAST(count(*) AS BIGINT) AS k FROM {I.RESOLVED_MARKET}
        WHERE resolved_to IS NOT NULL GROUP BY 1, 2),
    pairs AS (
        SELECT a.forecast_due_date, a.source, count(*) AS total,
               CAST(sum(CAST(a.resolved_to IS NOT NULL AND b.resolved_to IS NOT NULL AS INT))
                    AS BIGINT) AS k
        FROM {I.RESOLVED_MARKET} a JOIN {I.RESOLVED_MARKET} b ON b.source = a.source
         AND b.forecast_due_date = a.forecast_due_date AND b.user_no = a.user_no + 4
        GROUP BY 1, 2),
    asked AS (
        SELECT u.due AS forecast_due_date, q.source, count(*) AS k
        FROM {T.sql('market_questions')} q CROSS JOIN (VALUES {I.DUE_VALUES}) AS u(due)
        GROUP BY 1, 2)
    SELECT a.forecast_due_date, a.source, CAST(a.k + coalesce(p.total, 0) AS BIGINT) AS n_asked,
           coalesce(s.k, 0) AS n_single, coalesce(p.k, 0) AS n_combination
    FROM asked a LEFT JOIN singles s ON s.forecast_due_date = a.forecast_due_date
     AND s.source = a.source
    LEFT JOIN pairs p ON p.forecast_due_date = a.forecast_due_date AND p.source = a.source""")
def breakdown(spark, sf):
    rows, _ = I.resolved_market(spark, sf, True)
    return reports.resolution_breakdown(
        resolve.drop_unresolved(rows), I.market_question_set(spark, sf, True))


@register("unmatched_questions_r13", f"""
    SELECT DISTINCT source, id, forecast_due_date FROM {I.RESOLVED_MARKET}
    WHERE resolved_to IS NULL""")
def unmatched(spark, sf):
    rows, _ = I.resolved_market(spark, sf)
    return reports.unmatched_questions(
        resolve.drop_unresolved(rows), I.market_question_set(spark, sf)).select(
        "source", joined().alias("id"), "forecast_due_date")


@register("first_seen_resolution_r14", f"""
    SELECT source, id,
           coalesce(min(CASE WHEN resolved THEN forecast_due_date END), max(forecast_due_date))
               AS forecast_due_date, bool_or(resolved) AS resolved
    FROM {I.RESOLVED_MARKET} GROUP BY 1, 2""")
def first_seen(spark, sf):
    rows, _ = I.resolved_market(spark, sf)
    return resolve.first_seen_resolution(rows).select(
        "source", joined().alias("id"), "forecast_due_date", "resolved")
