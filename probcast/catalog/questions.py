"""Question generation, upkeep, screens, upserts and identifier queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from probcast import constants as C
from probcast.catalog import inputs as I, register
from probcast.catalog.inputs import TRADES_AS_OF, d, n, num
from probcast.catalog.resolution import CONFLICT_DAILY
from probcast.catalog.series import MARKED, marked_items
from probcast.functions import dates as D, hashing, text as X
from probcast.operators import filters, questions as Q, upsert as U
from probcast.session import fresh_folder
from probcast.sources import testtables as T
from probcast.sources.store import KeyedStore

EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]
TEMPLATES = {
    C.CONFLICT_KEY_PLAIN: (
        "More {event_type} in {country} before {resolution_date}?", "Average of {event_type}."),
    C.CONFLICT_KEY_TENFOLD: (
        "Ten times {event_type} in {country}?", "One plus average of {event_type}."),
}
_ALL = EVENT_TYPES + ["fatalities"]


@register("conflict_questions_g1_j11", f"""
    WITH g AS (SELECT c.country, m.metric, k.key, k.tenfold,
                      CASE WHEN m.metric = 'fatalities' THEN m.metric
                           ELSE concat('''', m.metric, '''') END AS shown
        FROM (SELECT DISTINCT country FROM {T.sql('conflict_events')}) c
        CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in _ALL)}) AS m(metric)
        CROSS JOIN (VALUES ('{C.CONFLICT_KEY_PLAIN}', FALSE), ('{C.CONFLICT_KEY_TENFOLD}', TRUE))
             AS k(key, tenfold)),
    s AS (SELECT country, metric, sum(n) / CAST(12 AS DOUBLE) AS a FROM {CONFLICT_DAILY}
          WHERE date >= {d(TRADES_AS_OF)} - 360 AND date < {d(TRADES_AS_OF)} GROUP BY 1, 2)
    SELECT sha256(concat('{{"country": "', g.country, '", "event_type": "', g.metric,
                         '", "key": "', g.key, '"}}')) AS id,
           CASE WHEN tenfold THEN concat('Ten times ', shown, ' in ', g.country, '?')
                ELSE concat('More ', shown, ' in ', g.country, ' before {{resolution_date}}?') END
               AS question,
           {n('coalesce(s.a, 0) + CASE WHEN tenfold THEN 1 ELSE 0 END', 'freeze_value')}
    FROM g LEFT JOIN s ON s.country = g.country AND s.metric = g.metric""")
def conflict_questions(spark, sf):
    return Q.conflict_questions(
        T.table(spark, sf, "conflict_events"), EVENT_TYPES, TRADES_AS_OF, TEMPLATES).select(
        "id", "question", num("freeze_value"))


# Stored and new sides of the updates: parts, and customers under shifted numbers, overlap in part.
@register("update_conflict_questions_u4", """
    SELECT coalesce(s.id, g.id) AS id, coalesce(g.question, s.question) AS question,
           coalesce(s.url, g.url) AS url
    FROM (SELECT p_partkey AS id, p_type AS question, 'kept' AS url FROM part) s
    FULL JOIN (SELECT c_custkey + 1000 AS id, c_mktsegment AS question, 'new' AS url FROM customer) g
      ON g.id = s.id""")
def update_conflict(spark, sf):
    stored = T.raw(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("question"),
        F.lit("kept").alias("url"))
    fresh = T.raw(spark, sf, "customer").select(
        (F.col("c_custkey") + 1000).alias("id"), F.col("c_mktsegment").alias("question"),
        F.lit("new").alias("url"))
    return Q.update_conflict_questions(stored, fresh)


# Purchases read 1 from 50 on, else 0.
_PAGE_VALUE = """CASE WHEN page = 'purchase' AND v IS NOT NULL THEN CASE WHEN v >= 50 THEN '1' ELSE '0' END
    ELSE printf('%.2f', v) END"""


@register("page_questions_g2", f"""
    WITH l AS (SELECT page, item, max(date) AS last, arg_max(struct_pack(v := value), date).v AS v
               FROM {MARKED} WHERE page <> 'error' GROUP BY 1, 2),
    t AS (SELECT page, item, {_PAGE_VALUE} AS v FROM l WHERE last >= DATE '2024-01-20'),
    r AS (SELECT *, CASE WHEN page = 'purchase' THEN coalesce(v = '1', FALSE) ELSE v IS NULL END AS resolved,
                 CASE WHEN page = 'purchase' THEN CASE WHEN v = '1' THEN 'Yes' ELSE 'No' END ELSE v END AS shown
          FROM t)
    SELECT page, item, sha256(concat('{{"id_field_value": "', item, '", "id_root": "', page, '"}}')) AS id,
           CASE page WHEN 'view' THEN concat('Will ', item, ' have a rating on {{resolution_date}} at least 1% higher?')
               WHEN 'click' THEN concat('Will ', item, ' rank as high by {{resolution_date}}?')
               WHEN 'signup' THEN concat('Will ', item, ' still hold the record for ', coalesce(shown, ''), ' on {{resolution_date}}?')
               ELSE concat('Will there be one for ', item, ' since {{forecast_due_date}}?') END AS question,
           CASE page WHEN 'view' THEN concat('Ratings of ', item, '.') WHEN 'signup' THEN concat('Record holder ', item, '.')
               ELSE '' END AS background,
           concat('https://en.wikipedia.org/wiki/', CASE page WHEN 'view' THEN 'Views' WHEN 'click' THEN 'Clicks'
               WHEN 'signup' THEN 'Signups' ELSE 'Purchases' END) AS url,
           shown AS freeze_datetime_value,
           CASE page WHEN 'view' THEN concat('Rating of ', item, '.') WHEN 'click' THEN concat('Rank of ', item, '.')
               WHEN 'signup' THEN concat(item, ' holds ', coalesce(shown, ''), '.')
               ELSE concat('Whether ', item, ' has ', shown, '.') END AS freeze_datetime_value_explanation,
           resolved, CASE WHEN resolved THEN '' ELSE '7,30,90,180,365,1095,1825,3650' END AS horizons,
           'N/A' AS market_info_resolution_criteria, 'N/A' AS market_info_open_datetime,
           'N/A' AS market_info_close_datetime, 'N/A' AS market_info_resolution_datetime
    FROM r""")
def page_questions(spark, sf):
    marked = marked_items(spark, sf)
    text = F.when((F.col("page") == "purchase") & F.col("value").isNotNull(), F.when(
        F.col("value") >= 50, "1").otherwise("0")).otherwise(
        F.when(F.col("value").isNotNull(), F.format_string("%.2f", "value")))
    rows = Q.page_questions(marked.withColumn("value", text), I.PAGE_RULES, date(2024, 1, 20))
    return rows.withColumn("horizons", F.array_join(F.col("forecast_horizons").cast("array<string>"), ",")).drop(
        "forecast_horizons")


@register("dropped_and_remapped_pages_g3", """
    SELECT o_orderkey AS id, o_orderstatus = 'F' OR o_orderkey % 5 = 0 OR o_custkey % 7 = 0
           OR EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.o_orderkey + 1
               AND o.o_orderkey % 11 = 0 AND (x.o_orderstatus = 'F' OR x.o_orderkey % 5 = 0
               OR x.o_custkey % 7 = 0)) AS resolved FROM orders o""")
def dropped_pages(spark, sf):
    orders = T.raw(spark, sf, "orders")
    questions = orders.select(F.col("o_orderkey").alias("id"),
                              (F.col("o_orderstatus") == "F").alias("resolved"))
    attributes = orders.filter("o_orderkey % 5 <> 0").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 7 == 0, "gone").otherwise("kept").alias("id_root"))
    remaps = orders.filter("o_orderkey % 11 = 0").select(
        F.col("o_orderkey").alias("old_id"), (F.col("o_orderkey") + 1).alias("new_id"))
    return Q.resolve_remapped(Q.resolve_dropped_pages(questions, attributes, ["kept"]), remaps)


def observations(spark, sf):
    """Weather-like observations with text gaps, one per series and period."""
    return T.table(spark, sf, "series").select(
        "id", F.col("date").alias("period"),
        F.when(F.dayofmonth("date") % 4 == 0, "NA").otherwise(
            F.format_string("%.2f", "value")).alias("value"), F.lit("Office").alias("provider"),
        F.lit("Daily").alias("dataset"), F.concat(F.lit("Station "), "id").alias("name"))


_OBS = f"""(SELECT id, date AS period, CASE WHEN day(date) % 4 = 0 THEN 'NA'
    ELSE printf('%.2f', value) END AS value FROM {T.sql('series')})"""
_NA_FIELDS = ", ".join(f"'N/A' AS {c}" for c in Q.MARKET_FIELDS)


def _number():
    """Number of the part in a series id."""
    return F.substring("id", 2, 20).cast("int")


def stored_questions(ids, horizons="365"):
    """Question rows as an earlier run left them."""
    return ids.select(*Q.question_row(
        id=F.col("id"), question=F.concat(F.lit("old question "), "id"), background=F.lit("old background"),
        url=F.lit("old url"), resolved=F.lit(False), forecast_horizons=F.array(F.lit(int(horizons))),
        freeze_datetime_value=F.lit("1.0"), freeze_datetime_value_explanation=F.lit("old value")))


def shown_questions(rows):
    return rows.withColumn("forecast_horizons", F.array_join(F.col("forecast_horizons").cast("array<string>"), ","))


_ALL_DAYS = ",".join(map(str, C.HORIZONS_DAYS))
_OLD = f"""'old question ' || id AS question, 'old background' AS background, 'old url' AS url, FALSE AS resolved,
    '365' AS forecast_horizons, '1.0' AS freeze_datetime_value, 'old value' AS freeze_datetime_value_explanation, {_NA_FIELDS}"""


# Every third series is stored already; those whose number ends in 7 are stored but no longer fetched.
@register("weather_questions_g4", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY period DESC) AS k FROM {_OBS}),
    s AS (SELECT id, bool_or(value <> 'NA' AND k <= 10) AS lively,
                 any_value(CASE WHEN k = 1 AND period > DATE '2024-03-20' AND value <> 'NA' THEN value END) AS new_value,
                 arg_max(CASE WHEN value <> 'NA' THEN value END, CASE WHEN value <> 'NA' THEN period END) AS known_value,
                 CAST(substr(id, 2) AS INT) AS number FROM r GROUP BY id),
    fetched AS (SELECT * FROM s WHERE lively AND number % 10 <> 7)
    SELECT id, 'Warmer at ' || id || '?' AS question,
           'The history of Daily - Station ' || id || ' from Office is available at https://db.nomics.world/W/' || substr(id, 2) || '.' AS background,
           'https://db.nomics.world/W/' || substr(id, 2) AS url, FALSE AS resolved, '{_ALL_DAYS}' AS forecast_horizons,
           coalesce(CAST(CAST(new_value AS DOUBLE) AS VARCHAR), 'N/A') AS freeze_datetime_value,
           'Mean at ' || id AS freeze_datetime_value_explanation, {_NA_FIELDS}
    FROM (SELECT * REPLACE ('W_' || number AS id) FROM fetched) f WHERE number % 3 <> 0
    UNION ALL
    SELECT id, 'old question ' || id,
           'The history of Daily - Station ' || id || ' from Office is available at https://db.nomics.world/W/' || number || '.',
           'https://db.nomics.world/W/' || number, FALSE, '365', CAST(CAST(known_value AS DOUBLE) AS VARCHAR), 'old value', {_NA_FIELDS}
    FROM (SELECT * REPLACE ('W_' || number AS id) FROM fetched) f WHERE number % 3 = 0
    UNION ALL
    SELECT id, {_OLD} FROM (SELECT 'W_' || number AS id, number FROM s
        WHERE (number % 3 = 0 OR number % 10 = 7) AND NOT (lively AND number % 10 <> 7))""".replace(
    "W/' || substr(id, 2)", "W/' || number"))
def weather(spark, sf):
    """Series W/n of part n; rows of known, new and vanished series with every column."""
    rows = observations(spark, sf)
    key = F.concat(F.lit("W_"), _number())
    catalog = rows.filter(_number() % 10 != 7).select(
        F.concat(F.lit("W/"), _number()).alias("series"), F.concat(F.lit("Warmer at "), key, F.lit("?")).alias("question"),
        F.concat(F.lit("Mean at "), key).alias("explanation")).distinct()
    stored = stored_questions(rows.filter((_number() % 3 == 0) | (_number() % 10 == 7)).select(key.alias("id")).distinct())
    named = rows.withColumn("id", key).withColumn("name", F.concat(F.lit("Station "), "id"))
    return shown_questions(Q.weather_questions(named, catalog, stored, date(2024, 3, 21)))


@register("weather_series_g4", f"""
    SELECT id, period AS date, replace(value, 'NA', 'N/A') AS value_str,
           {n('TRY_CAST(value AS DOUBLE)', 'value', 2)} FROM {_OBS} WHERE period >= DATE '2024-02-01'""")
def weather_series(spark, sf):
    return Q.weather_resolution_rows(
        Q.within_window(observations(spark, sf), date(2024, 2, 1))).select(
        "id", "date", "value_str", num(F.col("value"), "value", 2))


# Every tenth series is nullified, every fourth stored; every sixth has no name of its own.
@register("macro_questions_g5", f"""
    WITH s AS (SELECT id, CAST(substr(id, 2) AS INT) AS number, arg_max(value, date) AS value
               FROM {T.sql('series')} GROUP BY id)
    SELECT id, CASE WHEN number % 6 <> 0 THEN 'Will part ' || id || ' have increased by {{resolution_date}} as compared to its value on {{forecast_due_date}}?'
                    WHEN number % 4 = 0 THEN 'old question ' || id END AS question,
           'The notes from the release: N/A.  The notes from the series: Notes of ' || id
           || '.  Additional background of the series:  1. the units of the series: Units.  2. the seasonal adjustments of the series:  '
           || CASE WHEN number % 2 = 0 THEN 'SA' ELSE 'N/A' END || '  3. the update frequency: '
           || CASE WHEN number % 2 = 0 THEN 'Monthly' ELSE 'Daily' END || ' ' AS background,
           'https://fred.stlouisfed.org/series/' || id AS url, FALSE AS resolved,
           CASE WHEN number % 2 = 0 THEN '{_ALL_DAYS[2:]}' ELSE '{_ALL_DAYS}' END AS forecast_horizons,
           CAST(value AS VARCHAR) AS freeze_datetime_value,
           'The latest value released in Title from the release Release.' AS freeze_datetime_value_explanation, {_NA_FIELDS}
    FROM s WHERE number % 10 <> 0""")
def macro(spark, sf):
    rows = T.table(spark, sf, "series").select("id", "date", "value")
    ids, monthly = rows.select("id").distinct(), _number() % 2 == 0
    info = ids.select(
        "id", F.when(_number() % 6 != 0, F.concat(F.lit("part "), F.col("id"))).alias("name"), F.lit("Title").alias("title"),
        F.lit("Release").alias("release"), F.lit(None).cast("string").alias("release_notes"),
        F.concat(F.lit("Notes of "), "id").alias("notes"), F.lit("Units").alias("units"),
        F.when(monthly, "SA").alias("seasonal_adjustment"), F.when(monthly, "Monthly").otherwise("Daily").alias("frequency"),
        F.when(monthly, "M").otherwise("D").alias("frequency_short"))
    out = ids.filter(_number() % 10 == 0).select(F.lit("fred").alias("source"), "id")
    return shown_questions(Q.macro_questions(info, rows, stored_questions(ids.filter(_number() % 4 == 0)), out))


@register("nested_observations_g5_g8", f"""
    SELECT id, date, {n('value', decimals=2)} FROM {T.sql('series')}""")
def nested(spark, sf):
    packed = T.table(spark, sf, "series").groupBy("id").agg(F.collect_list(F.struct(
        F.col("date").cast("string").alias("date"), "value")).alias("observations"))
    return Q.nested_observations(packed).select("id", "date", num(F.col("value"), "value", 2))


# Parts are stored or listed; a ticker's number is twice that of the part whose lines give its prices, so
# odd ones have none; one brand is nullified, some sizes are renamed.
@register("stock_questions_g6_u8", f"""
    WITH p AS (SELECT 2 * l_partkey AS id, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS c
               FROM lineitem GROUP BY 1),
    k AS (SELECT p_partkey AS id, p_size > 5 AS stored, p_size <= 30 AS listed, p_brand = 'Brand#7' OR p_size % 11 = 0 AS dead FROM part),
    t AS (SELECT CAST(k.id AS VARCHAR) AS id, k.id % 5 AS company, p.c, stored AND (dead OR (p.c IS NULL AND NOT listed)) AS carried, dead
          FROM k LEFT JOIN p ON p.id = k.id WHERE stored OR listed)
    SELECT id, 'Will ' || id || '''s market close price on {{resolution_date}} be higher than its market close price on {{forecast_due_date}}?'
               || chr(10) || chr(10) || 'Stock splits and reverse splits will be accounted for in resolving this question. '
               || 'Forecasts on questions about companies that have been delisted (through mergers or bankruptcy) will resolve to their final close price.' AS question,
           CASE WHEN company = 0 THEN 'N/A' ELSE 'Company ' || id END AS background,
           'https://finance.yahoo.com/quote/' || id AS url, FALSE AS resolved, '{_ALL_DAYS}' AS forecast_horizons,
           CAST(round(c, 2) AS VARCHAR) AS freeze_datetime_value,
           'The latest market close price of ' || id || '.' AS freeze_datetime_value_explanation, {_NA_FIELDS}
    FROM t WHERE NOT carried AND c IS NOT NULL AND NOT dead
    UNION ALL
    SELECT id, 'old question ' || id, 'old background', 'old url', TRUE, '365', 'N/A', 'old value', {_NA_FIELDS} FROM t WHERE carried""")
def stocks(spark, sf):
    key = F.col("p_partkey").cast("string").alias("id")
    parts = T.raw(spark, sf, "part")
    closes = T.raw(spark, sf, "lineitem").groupBy((2 * F.col("l_partkey")).cast("string").alias("id")).agg(
        F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("value")
    ).withColumn("date", F.lit(date(2024, 1, 1)))
    companies = parts.filter("p_partkey % 5 <> 0").select(key, F.concat(F.lit("Company "), F.col("p_partkey")).alias("background"))
    renames = parts.filter("p_size % 11 = 0").select(
        F.col("p_partkey").cast("string").alias("old_id"), F.concat(F.lit("N"), F.col("p_partkey")).alias("new_id"))
    return shown_questions(Q.stock_questions(
        stored_questions(parts.filter("p_size > 5").select(key)), closes, companies,
        parts.filter("p_size <= 30").select(key),
        parts.filter("p_brand = 'Brand#7'").select(F.lit("yfinance").alias("source"), key), renames))


@register("wanted_ids_u8", """
    (SELECT p_partkey AS id FROM part UNION SELECT c_custkey + 1000 FROM customer)
    EXCEPT SELECT s_suppkey FROM supplier EXCEPT SELECT user_id FROM events""")
def wanted(spark, sf):
    ids = lambda name, column: T.raw(spark, sf, name).select(column.cast("bigint").alias("id"))
    return U.wanted_ids(ids("part", F.col("p_partkey")), ids("customer", F.col("c_custkey") + 1000),
                        ids("supplier", F.col("s_suppkey")),
                        ids("events", F.col("user_id")).distinct())


@register("renamed_series_g7_j13", f"""
    SELECT CASE WHEN CAST(substr(id, 2) AS INT) % 6 = 0 THEN concat('old-', id) ELSE id END AS id,
           date, {n('value', decimals=2)} FROM {T.sql('series')}
    UNION ALL SELECT id, date, {n('value', decimals=2)} FROM {T.sql('series')}
    WHERE CAST(substr(id, 2) AS INT) % 6 = 0""")
def renamed(spark, sf):
    rows = T.table(spark, sf, "series").select("id", "date", "value")
    renames = rows.filter(F.substring("id", 2, 20).cast("int") % 6 == 0).select(
        F.concat(F.lit("old-"), "id").alias("old_id"), F.col("id").alias("new_id")).distinct()
    return U.relabel_copies(rows, renames).select("id", "date", num(F.col("value"), "value", 2))


@register("remapped_ids_j13_j16", """
    SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN concat('c', o_custkey + 1)
           ELSE concat('c', o_custkey) END AS id FROM orders""")
def remapped(spark, sf):
    orders = T.raw(spark, sf, "orders")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    mapping = orders.filter("o_custkey % 4 = 0").select(
        name(F.col("o_custkey")).alias("old_id"), name(F.col("o_custkey") + 1).alias("new_id")
    ).distinct()
    return U.remap(orders.select("o_orderkey", name(F.col("o_custkey")).alias("id")), mapping)


# --- market payloads built from orders -------------------------------------------------------------

def _stamp(column: str, hour: str):
    return F.concat(F.date_format(column, "yyyy-MM-dd"), F.lit(f"T{hour}Z"))


@register("infer_questions_g8", f"""
    WITH t AS (
        SELECT o_orderkey AS number, CAST(o_orderkey AS VARCHAR) AS id, o_custkey % 2 = 0 AS noted, o_custkey % 5 = 0 AS other,
               o_orderstatus = 'F' AS resolved, strftime(o_orderdate, '%Y-%m-%dT12:00:00+00:00') AS opened,
               least(CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate + INTERVAL 5 DAY END,
                     CASE WHEN o_custkey % 4 <> 0 THEN o_orderdate + INTERVAL 3 DAY END) AS closed,
               CASE WHEN o_custkey % 7 <> 0 THEN o_orderdate + INTERVAL 4 DAY END AS settled,
               CASE WHEN o_custkey % 5 <> 0 THEN 0.25 + 0.5 * (o_orderkey % 2) END AS p FROM orders)
    SELECT id, 'Question ' || id AS question, 'About ' || id AS background,
           'https://www.randforecastinginitiative.org/questions/' || id AS url, resolved, NULL AS forecast_horizons,
           coalesce(CAST(CAST(p AS DOUBLE) AS VARCHAR), 'N/A') AS freeze_datetime_value,
           'The crowd forecast.' AS freeze_datetime_value_explanation,
           CASE WHEN noted THEN 'First ' || id || '. Then more.' ELSE 'N/A' END AS market_info_resolution_criteria,
           opened AS market_info_open_datetime,
           coalesce(strftime(closed, '%Y-%m-%dT12:00:00+00:00'), 'N/A') AS market_info_close_datetime,
           CASE WHEN resolved THEN coalesce(strftime(least(closed, settled), '%Y-%m-%dT12:00:00+00:00'), 'N/A') ELSE 'N/A' END
               AS market_info_resolution_datetime,
           {n('p', 'probability')}, other AS nullify_question FROM t""")
def infer(spark, sf):
    """All orders as payloads, those without any close time included."""
    later = lambda days: F.concat(F.date_format(F.date_add(
        F.col("o_orderdate").cast("date"), days), "yyyy-MM-dd"), F.lit("T12:00:00Z"))
    answer = lambda name, p: F.struct(F.lit(name).alias("name"), p.alias("probability"))
    note = lambda text: F.struct(text.alias("content"))
    yes_first, key = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")
    notes = F.array(note(F.concat(F.lit("First "), key, F.lit("."))), note(F.lit("Then more.")))
    payload = T.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Question "), key).alias("name"),
        F.concat(F.lit("About "), key).alias("description"),
        F.when(F.col("o_custkey") % 2 == 0, notes).otherwise(F.slice(notes, 1, 0)).alias("clarifications"),
        F.when(F.col("o_custkey") % 5 == 0, "Forecast::Number").otherwise(
            "Forecast::YesNoQuestion").alias("type"),
        (F.col("o_orderstatus") == "F").alias("resolved"),
        F.when(F.col("o_custkey") % 7 != 0, later(4)).alias("resolved_at"),
        F.when(F.col("o_custkey") % 3 != 0, later(5)).alias("ends_at"),
        F.when(F.col("o_custkey") % 4 != 0, later(3)).otherwise("").alias("scoring_end_time"),
        later(0).alias("scoring_start_time"),
        F.when(yes_first, F.array(answer("Yes", F.lit(0.25)), answer("No", F.lit(0.75)))).otherwise(
            F.array(answer("No", F.lit(0.25)), answer("Yes", F.lit(0.75)))).alias("answers"))
    return shown_questions(Q.infer_questions(payload)).withColumn("probability", num("probability"))


@register("manifold_questions_g8", """
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT00:00:01+00:00') AS open,
           CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 2 DAY,
                '%Y-%m-%dT00:00:00+00:00') ELSE 'N/A' END AS resolution
    FROM orders""")
def manifold(spark, sf):
    millis = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000
    payload = T.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("q").alias("question"),
        F.lit("t").alias("textDescription"), F.lit("u").alias("url"),
        (millis + 1999).alias("createdTime"), (millis + 86400000).alias("closeTime"),
        (F.col("o_orderstatus") == "F").alias("isResolved"),
        (millis + 2 * 86400000).alias("resolutionTime"))
    return Q.manifold_questions(payload).select(
        "id", F.col("market_info_open_datetime").alias("open"),
        F.col("market_info_resolution_datetime").alias("resolution"))


@register("metaculus_questions_g8", """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('https://www.metaculus.com/questions/', o_orderkey) AS url,
           CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL (CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END) DAY,
                '%Y-%m-%dT06:00:00+00:00') ELSE 'N/A' END AS resolution FROM orders""")
def metaculus(spark, sf):
    later = lambda days: F.concat(F.date_format(F.date_add(
        F.col("o_orderdate").cast("date"), days), "yyyy-MM-dd"), F.lit("T06:00:00Z"))
    resolve_days = F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(3)
    payload = T.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("t").alias("title"),
        (F.col("o_orderstatus") == "F").alias("resolved"),
        F.struct(F.lit(None).cast("string").alias("description"),
                 later(F.lit(0)).alias("open_time"), later(F.lit(2)).alias("actual_close_time"),
                 later(resolve_days).alias("actual_resolve_time")).alias("question"))
    return Q.metaculus_questions(payload).select(
        "id", "url", F.col("market_info_resolution_datetime").alias("resolution"))


@register("polymarket_questions_g8_json", """
    SELECT CAST(o_orderkey AS VARCHAR) AS id,
           strftime(o_orderdate + INTERVAL (CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 4 END) DAY,
                    '%Y-%m-%dT10:00:00+00:00') AS resolution,
           CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.8 ELSE 0.2 END AS DOUBLE) AS resolved_price
    FROM orders WHERE o_custkey % 9 <> 1""")
def polymarket(spark, sf):
    later = lambda days: F.concat(F.date_format(F.date_add(
        F.col("o_orderdate").cast("date"), days), "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    payload = T.raw(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("conditionId"), F.lit("q").alias("question"),
        F.lit("t").alias("description"), F.lit("s").alias("slug"),
        F.lit("2024-01-01").alias("startDateIso"),
        F.when(F.col("o_custkey") % 9 > 1, later(4)).alias("endDate"),
        F.when(F.col("o_custkey") % 9 == 0, F.array(F.struct(later(4).alias("endDate")))).otherwise(
            F.array().cast("array<struct<endDate:string>>")).alias("events"),
        F.when(F.col("o_custkey") % 3 == 0, later(1)).otherwise(later(6)).alias("umaEndDate"),
        F.lit("resolved").alias("umaResolutionStatus"),
        F.when(F.col("o_orderkey") % 2 == 0, '["Yes", "No"]').otherwise('["No", "Yes"]').alias(
            "outcomes"), F.lit('["0.8", "0.2"]').alias("outcomePrices"))
    return Q.polymarket_questions(payload).select(
        "id", F.col("market_info_resolution_datetime").alias("resolution"), num("resolved_price"))


@register("nullified_series_g9", f"""
    SELECT id, date, {n("CASE WHEN CAST(substr(id, 2) AS INT) % 4 <> 0 THEN value END", 'value')}
    FROM {I.DAILY_CLOSE} WHERE CAST(substr(id, 2) AS INT) % 8 <> 4
    UNION ALL SELECT id, {d(I.TRADES_YESTERDAY)}, NULL FROM {T.sql('market_questions')}
    WHERE user_no % 8 = 4""")
def nullified_series(spark, sf):
    number = F.substring("id", 2, 20).cast("int")
    stored = I.daily_close(spark, sf).select("id", "date", "value").filter(number % 8 != 4)
    marks = T.table(spark, sf, "market_questions").select(
        "id", (F.col("user_no") % 4 == 0).alias("nullify_question"))
    return Q.nullify_series(stored, marks, TRADES_AS_OF).select("id", "date", num("value"))


def series_store(spark, series):
    """A fresh store of daily series."""
    table = KeyedStore(fresh_folder(spark, "series"), "source STRING, id STRING, date DATE, value DOUBLE",
                       ("id", "date"), by=("source",))
    table.create(series.select("source", "id", "date", "value"))
    return table


@register("series_to_regenerate_g10_io20", f"""
    SELECT id FROM {T.sql('market_questions')} WHERE resolved AND id NOT IN
        (SELECT id FROM {I.DAILY_CLOSE} WHERE value > 0.9)""")
def regenerate(spark, sf):
    """Resolved questions that have no series in the store."""
    table = series_store(spark, I.daily_close(spark, sf).filter("value > 0.9"))
    return Q.to_regenerate(T.table(spark, sf, "market_questions"), table.keys(spark))


@register("wanted_series_io21", f"""
    SELECT id, date, {n('value')} FROM {I.DAILY_CLOSE} WHERE id IN (
        SELECT id FROM {T.sql('market_questions')} WHERE resolved)""")
def wanted_series(spark, sf):
    """Read by id from the store: only the wanted ids' buckets are opened."""
    wanted = T.table(spark, sf, "market_questions").filter("resolved").select("source", "id")
    return series_store(spark, I.daily_close(spark, sf)).read_keys(wanted).select("id", "date", num("value"))


# --- metadata ------------------------------------------------------------------------------------

_SRC = "CASE o_orderkey % 9 " + " ".join(
    f"WHEN {i} THEN '{s}'" for i, s in enumerate(C.ALL_SOURCES)) + " END"


def _sources():
    return F.element_at(F.array(*[F.lit(s) for s in C.ALL_SOURCES]),
                        (F.col("o_orderkey") % 9 + 1).cast("int"))


@register("assigned_categories_g11_j12", f"""
    WITH q AS (SELECT o_orderkey, {_SRC} AS source FROM orders)
    SELECT source, CAST(o_orderkey AS VARCHAR) AS id, CASE
        WHEN source = 'acled' THEN 'Security & Defense'
        WHEN source IN ('fred', 'yfinance') THEN 'Economics & Business'
        WHEN o_orderkey % 4 = 0 THEN 'Sports'
        WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'Other'
        ELSE 'Arts & Recreation' END AS category FROM q""")
def categories(spark, sf):
    rows = T.raw(spark, sf, "orders").select(
        _sources().alias("source"), F.col("o_orderkey").cast("string").alias("id"), "o_orderkey")
    stored = rows.select("source", "id", F.when(F.col("o_orderkey") % 4 == 0, "Sports").when(
        F.col("o_orderkey") % 4 == 1, "Nonsense").alias("category"))
    labels = rows.filter("o_orderkey % 5 <> 0").select("source", "id", F.when(
        F.col("o_orderkey") % 7 == 0, "Made up").otherwise("Arts & Recreation").alias("label"))
    return Q.assign_categories(rows, stored, labels)


@register("assigned_validity_g12", f"""
    WITH q AS (SELECT o_orderkey, o_custkey, {_SRC} AS source FROM orders)
    SELECT source, CAST(o_orderkey AS VARCHAR) AS id, CASE
        WHEN source = 'wikipedia' AND o_custkey % 3 = 0 THEN FALSE
        WHEN source NOT IN ('manifold', 'polymarket') THEN TRUE
        WHEN o_custkey % 4 = 0 THEN FALSE WHEN o_custkey % 4 = 1 THEN TRUE
        ELSE o_custkey % 4 = 3 END AS valid_question
    FROM q WHERE source NOT IN ('manifold', 'polymarket') OR o_custkey % 5 <> 0
          OR o_custkey % 4 < 2""")
def validity(spark, sf):
    rows = T.raw(spark, sf, "orders").select(
        _sources().alias("source"), F.col("o_orderkey").cast("string").alias("id"), "o_custkey")
    quarter = F.col("o_custkey") % 4
    stored = rows.filter(quarter < 2).select("source", "id", (quarter == 1).alias("valid_question"))
    responses = rows.select("source", "id", F.when(F.col("o_custkey") % 5 == 0, "nothing").when(
        quarter == 3, "so Classification: maybe").otherwise("x Classification: flag").alias(
        "response"))
    bad = rows.filter("source = 'wikipedia' and o_custkey % 3 = 0").select("id")
    return Q.assign_validity(rows, stored, responses, bad)


# --- upserts -------------------------------------------------------------------------------------

def _stored_new(spark, sf):
    stored = T.raw(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.lit("stored").alias("side"),
        F.when(F.col("p_size") <= 40, F.col("p_size")).cast("bigint").alias("value"))
    new = T.raw(spark, sf, "customer").select(
        (F.col("c_custkey") + 1000).alias("id"), F.lit("new").alias("side"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).cast("bigint").alias("value"))
    return stored, new


_STORED = """(SELECT p_partkey AS id, 'stored' AS side,
    CAST(CASE WHEN p_size <= 40 THEN p_size END AS BIGINT) AS value FROM part)"""
_NEW = """(SELECT c_custkey + 1000 AS id, 'new' AS side,
    CAST(CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS BIGINT) AS value FROM customer)"""


@register("keyed_upsert_u3", f"""
    SELECT * FROM {_NEW} UNION ALL
    SELECT * FROM {_STORED} s WHERE s.id NOT IN (SELECT id FROM {_NEW})""")
def keyed_upsert(spark, sf):
    """Through a stored table: only the buckets that new rows fall into are rewritten."""
    stored, new = _stored_new(spark, sf)
    table = KeyedStore(fresh_folder(spark, "upsert"), "id BIGINT, side STRING, value BIGINT")
    table.create(stored)
    table.upsert(new)
    return table.read(spark)


@register("non_null_update_u5", f"""
    SELECT s.id, coalesce(x.side, s.side) AS side, coalesce(x.value, s.value) AS value
    FROM {_STORED} s LEFT JOIN {_NEW} x ON x.id = s.id""")
def non_null_update(spark, sf):
    stored, new = _stored_new(spark, sf)
    return U.update_non_null(stored, new, ["id"])


@register("merged_fields_u11", f"""
    SELECT coalesce(s.id, x.id) AS id, coalesce(s.side, x.side) AS side,
           coalesce(s.value, x.value) AS value
    FROM {_STORED} s FULL JOIN {_NEW} x ON x.id = s.id""")
def merged_fields(spark, sf):
    stored, new = _stored_new(spark, sf)
    return U.merge_fields(stored, new, ["id"])


@register("union_and_distinct_u1_u2", f"""
    SELECT DISTINCT id, value FROM (SELECT id, value FROM {_STORED} UNION ALL
        SELECT id, value FROM {_NEW} UNION ALL SELECT id, value FROM {_STORED})""")
def union_distinct(spark, sf):
    stored, new = _stored_new(spark, sf)
    return U.distinct_rows(U.stack(stored, new, stored).select("id", "value"))


@register("active_rows_first_u9_j6", f"""
    SELECT * FROM {_NEW} UNION ALL SELECT s.* FROM {_STORED} s ANTI JOIN {_NEW} x ON x.id = s.id""")
def active_first(spark, sf):
    stored, new = _stored_new(spark, sf)
    return U.active_first(new, stored, ["id"])


@register("known_rows_j6", f"SELECT x.* FROM {_NEW} x SEMI JOIN {_STORED} s ON s.id = x.id")
def known_rows(spark, sf):
    stored, new = _stored_new(spark, sf)
    return U.known_rows(new, stored, ["id"])


@register("capped_append_u6", f"""
    WITH room AS (SELECT greatest(0, 2000 - (SELECT count(*) FROM {_STORED}
                  WHERE value IS NULL OR value > 3)) AS k),
    c AS (SELECT x.*, row_number() OVER (ORDER BY x.id) AS place FROM {_NEW} x
          ANTI JOIN {_STORED} s ON s.id = x.id)
    SELECT id, side FROM {_STORED} UNION ALL
    SELECT id, side FROM c WHERE place <= (SELECT k FROM room)""")
def capped_append(spark, sf):
    stored, new = _stored_new(spark, sf)
    return U.append_capped(stored, new, ["id"], 2000,
                           "value is null or value > 3").select("id", "side")


@register("replaced_source_u7", """
    SELECT o_orderstatus AS source, o_orderkey AS id,
           CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS label FROM orders""")
def replaced_source(spark, sf):
    rows = T.raw(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("id"))
    new = rows.filter("source = 'F'").withColumn("label", F.lit("new"))
    table = KeyedStore(fresh_folder(spark, "replace"), "source STRING, id BIGINT, label STRING", by=("source",))
    table.create(rows.withColumn("label", F.lit("old")))
    table.replace_groups(new)
    return table.read(spark)


@register("first_event_u10", """
    SELECT l_orderkey AS id, arg_min(l_linenumber, (l_linenumber, l_partkey, l_suppkey)) AS line,
           arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS part
    FROM lineitem GROUP BY 1""")
def first_event(spark, sf):
    rows = T.raw(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    return U.first_by(rows, ["id"], ["line", "part", "supplier"]).select("id", "line", "part")


@register("as_of_configuration_j17", """
    WITH e AS (SELECT DISTINCT o_orderpriority AS page, DATE '1995-01-01'
                      + CAST((length(o_orderpriority) * 37 + k * 400) AS INT) AS start_date, k AS version
               FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k))
    SELECT o.o_orderkey, CAST(max_by(e.version, e.start_date) AS INT) AS version
    FROM orders o LEFT JOIN e ON e.page = o.o_orderpriority
     AND e.start_date <= CAST(o.o_orderdate AS DATE) GROUP BY 1""")
def as_of_configuration(spark, sf):
    orders = T.raw(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("page"),
        F.col("o_orderdate").cast("date").alias("day"))
    versions = F.array(*[F.lit(k) for k in range(4)])
    entries = orders.select("page").distinct().select(
        "page", F.explode(versions).alias("version")).select(
        "page", F.date_add(F.lit(date(1995, 1, 1)), (
            F.length("page") * 37 + F.col("version") * 400).cast("int")).alias("start_date"),
        "version")
    return U.as_of_entry(orders, entries, ["page"], "day").select("o_orderkey", "version")


# --- screens -------------------------------------------------------------------------------------

@register("listing_screens_f18", """
    SELECT 'manifold' AS screen, o_orderkey AS id FROM orders WHERE o_custkey % 40 >= 17
        AND o_totalprice >= 120000 AND CAST(o_orderdate AS DATE) <= DATE '1997-01-01' + 730
    UNION ALL SELECT 'metaculus', o_orderkey FROM orders WHERE o_custkey % 10 > 5
        AND CAST(o_orderdate AS DATE) < DATE '1997-01-01'
    UNION ALL SELECT 'polymarket', o_orderkey FROM orders WHERE o_custkey % 3 <> 0
        AND o_totalprice > 25000 AND o_orderkey % 7 <> 0
    UNION ALL SELECT 'infer', o_orderkey FROM orders WHERE o_orderstatus = 'O'
        AND o_custkey % 4 > 0
    UNION ALL SELECT 'fred', o_orderkey FROM orders WHERE o_custkey % 100 > 50
        AND o_orderstatus <> 'P' AND o_orderkey % 5 <> 0""")
def listing_screens(spark, sf):
    orders = T.raw(spark, sf, "orders").withColumn("id", F.col("o_orderkey"))
    at = date(1997, 1, 1)
    day_text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    screens = {
        "manifold": filters.screen_manifold(orders.select(
            "id", (F.col("o_custkey") % 40).alias("uniqueBettorCount"),
            (F.col("o_totalprice") / 1000).alias("totalLiquidity"),
            (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("closeTime")),
            at),
        "metaculus": filters.screen_metaculus(orders.select(
            "id", (F.col("o_custkey") % 10).alias("nr_forecasters"),
            day_text.alias("cp_reveal_time")), at),
        "polymarket": filters.screen_polymarket(orders.select(
            "id", F.col("o_totalprice").alias("liquidityNum"),
            F.when(F.col("o_custkey") % 3 == 0, '["A", "B"]').otherwise('["No", "Yes"]').alias(
                "outcomes"),
            F.when(F.col("o_orderkey") % 7 == 0, "another-one").otherwise("plain").alias("slug"))),
        "infer": filters.screen_infer(orders.select(
            "id", F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("state"),
            F.lit("Forecast::YesNoQuestion").alias("type"),
            F.array(F.struct((F.col("o_custkey") % 4).alias("predictions_count"))).alias(
                "answers"))),
        "fred": filters.screen_fred_series(orders.select(
            "id", (F.col("o_custkey") % 100).alias("popularity"),
            F.when(F.col("o_orderstatus") == "P", "Q").otherwise("D").alias("frequency_short"),
            F.lit("Daily").alias("frequency"),
            F.when(F.col("o_orderkey") % 5 == 0, "X (DISCONTINUED)").otherwise("X").alias("title"))),
    }
    parts = [df.select(F.lit(name).alias("screen"), "id") for name, df in screens.items()]
    return U.stack(*parts)


@register("fresh_observations_f18", f"""
    WITH o AS (SELECT id, date, CASE WHEN day(date) % 5 = 0 THEN '.' ELSE printf('%.2f', value) END AS v
               FROM {T.sql('series')})
    SELECT id, date, {n('CAST(v AS DOUBLE)', 'value', 2)} FROM o WHERE v <> '.'
      AND id IN (SELECT id FROM o GROUP BY id HAVING max(date) >= DATE '2024-03-20')""")
def fresh_observations(spark, sf):
    rows = T.table(spark, sf, "series").select("id", "date", F.when(
        F.dayofmonth("date") % 5 == 0, ".").otherwise(F.format_string("%.2f", "value")).alias(
        "value"))
    return filters.screen_fred_observations(rows, date(2024, 4, 20)).select(
        "id", "date", num(F.col("value"), "value", 2))


@register("cleaned_page_tables_f19", """
    SELECT 'rankings' AS page, CAST(o_orderkey AS VARCHAR) AS item,
           CASE o_custkey % 3 WHEN 0 THEN 'Gukesh Dommaraju' WHEN 1 THEN 'Nana Dzagnidze'
                ELSE 'Someone' END AS value FROM orders WHERE o_orderkey % 10 <> 0
    UNION ALL SELECT 'swimming', CAST(o_orderkey AS VARCHAR), '' FROM orders
        WHERE o_custkey % 4 = 3
    UNION ALL SELECT 'diseases', CAST(o_custkey AS VARCHAR), CASE WHEN min(o_orderkey) % 2 = 0
        THEN '0' ELSE '1' END FROM orders
        WHERE CAST(o_orderdate AS DATE) > DATE '1996-01-01'
        GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) = 1""")
def cleaned_pages(spark, sf):
    orders = T.raw(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string").alias("item")
    names = F.when(F.col("o_custkey") % 3 == 0, "Gukesh D.").when(
        F.col("o_custkey") % 3 == 1, "Nana Dzagnidze]").otherwise("Someone")
    rankings = filters.clean_rankings(orders.select(key, F.when(
        F.col("o_orderkey") % 10 == 0, "Change from the previous month").otherwise(names).alias(
        "Player"))).select(F.lit("rankings").alias("page"), "item", F.col("Player").alias("value"))
    noise = F.element_at(F.array(*[F.lit(x) for x in ("a (b)", "eventsort", "recordinfo", "Ann")]),
                         (F.col("o_custkey") % 4 + 1).cast("int"))
    swimming = filters.clean_swimming(orders.select(key, noise.alias("Name"))).select(
        F.lit("swimming").alias("page"), "item", F.lit("").alias("value"))
    diseases = filters.clean_diseases(orders.select(
        F.col("o_custkey").cast("string").alias("Common name"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderkey") % 2 == 0, "Under research[4]").otherwise("Yes (2)").alias(
            "Vaccine(s)")), after=date(1996, 1, 1)).select(
        F.lit("diseases").alias("page"), F.col("Common name").alias("item"),
        F.col("value").cast("string").alias("value"))
    return U.stack(rankings, swimming, diseases)


# --- scalar functions ------------------------------------------------------------------------------

@register("hashed_ids", """
    SELECT c_custkey, sha256(concat('{"id_field_value": "', c_name, '", "id_root": "',
           c_mktsegment, '"}')) AS id FROM customer""")
def hashed_ids(spark, sf):
    return T.raw(spark, sf, "customer").select("c_custkey", hashing.object_id(
        id_root=F.col("c_mktsegment"), id_field_value=F.col("c_name")).alias("id"))


@register("date_functions", """
    SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S+00:00') AS from_seconds,
           CAST(epoch(o_orderdate) AS BIGINT) AS to_epoch,
           CAST(CAST(o_orderdate AS DATE) - DATE '0001-01-01' + 1 AS INT) AS ordinal_day,
           strftime(o_orderdate, '%B %Y') AS month,
           CASE WHEN o_custkey % 4000 <= 1 THEN '1d' WHEN o_custkey % 4000 <= 5 THEN '5d'
                WHEN o_custkey % 4000 <= 30 THEN '1mo' WHEN o_custkey % 4000 <= 90 THEN '3mo'
                WHEN o_custkey % 4000 <= 180 THEN '6mo' WHEN o_custkey % 4000 <= 365 THEN '1y'
                WHEN o_custkey % 4000 <= 730 THEN '2y' WHEN o_custkey % 4000 <= 1825 THEN '5y'
                WHEN o_custkey % 4000 <= 3650 THEN '10y' ELSE 'max' END AS period
    FROM orders""")
def date_functions(spark, sf):
    day = F.col("o_orderdate").cast("date")
    seconds = D.date_to_epoch(day)
    return T.raw(spark, sf, "orders").select(
        "o_orderkey", D.epoch_seconds_to_iso(seconds + 1).alias("from_seconds"),
        seconds.alias("to_epoch"), D.ordinal(day).alias("ordinal_day"),
        D.month_year(day).alias("month"), D.history_period(F.col("o_custkey") % 4000).alias(
            "period"))


@register("model_name_functions", """
    WITH m AS (SELECT p_partkey, concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' (zero shot)'
        WHEN 1 THEN ' (scratchpad with news)' WHEN 2 THEN ' (superforecaster with news 2)'
        WHEN 3 THEN ' (scratchpad with freeze values)' ELSE '' END) AS model FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'News' WHEN 2 THEN 'News'
               WHEN 3 THEN 'Freeze values' ELSE '--' END AS info,
           CASE p_partkey % 5 WHEN 0 THEN 'Zero shot' WHEN 1 THEN 'Scratchpad'
               WHEN 2 THEN 'Superforecaster 2' WHEN 3 THEN 'Scratchpad' ELSE '--' END AS prompt,
           CASE p_partkey % 5 WHEN 0 THEN 'zero shot' WHEN 1 THEN 'scratchpad'
               WHEN 2 THEN 'superforecaster 2' WHEN 3 THEN 'scratchpad' ELSE '?' END AS facet,
           concat('2024-01-11.Team.', lower(regexp_replace(model, '\\s+', '-', 'g')), '.json')
               AS file_name FROM m""")
def model_names(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (
        " (zero shot)", " (scratchpad with news)", " (superforecaster with news 2)",
        " (scratchpad with freeze values)", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    model = F.concat("p_name", suffix)
    return T.raw(spark, sf, "part").select(
        "p_partkey", X.information_provided(model).alias("info"),
        X.prompt_type(model).alias("prompt"), X.model_facets(model)["prompt"].alias("facet"),
        X.forecast_file_name(F.lit(date(2024, 1, 11)), F.lit("Team"), model).alias("file_name"))
