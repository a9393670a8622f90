"""Daily series queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from probcast.catalog import inputs as I, register
from probcast.catalog.inputs import TRADES_AS_OF, TRADES_YESTERDAY, d, n, num
from probcast.catalog.resolution import CONFLICT_DAILY
from probcast.operators import series as S
from probcast.session import fresh_folder
from probcast.sources import testtables as T
from probcast.streaming.daily_close import DailyClose, write_daily_close


@register("daily_close_t5", f"SELECT id, date, {n('value')} FROM {I.DAILY_CLOSE}")
def daily_close(spark, sf):
    return I.daily_close(spark, sf).select("id", "date", num("value"))


@register("daily_first_shifted_t6", f"""
    SELECT id, CAST(CAST(ts AS DATE) - 1 AS DATE) AS date, {n('arg_min(value, (ts, seq))', 'value')}
    FROM {T.sql('trades')} WHERE is_filled GROUP BY id, CAST(ts AS DATE)""")
def daily_first(spark, sf):
    return S.daily_first_shifted(I.filled_trades(spark, sf)).select("id", "date", num("value"))


@register("fill_rows_t1", f"SELECT id, date, {n('value')} FROM {I.FILLED_CLOSE}")
def fill_rows(spark, sf):
    return S.fill_rows(I.daily_close(spark, sf), TRADES_YESTERDAY).select(
        "id", "date", num("value"))


# Close with explicit nulls: days on which the value is low count as missing.
def gappy(spark, sf):
    return I.daily_close(spark, sf).withColumn(
        "value", F.when(F.col("value") >= 0.2, F.col("value")))


GAPPY = f"(SELECT id, date, CASE WHEN value >= 0.2 THEN value END AS value FROM {I.DAILY_CLOSE})"
CALENDAR = f"""(SELECT id, CAST(unnest(generate_series(min(date), {d(TRADES_YESTERDAY)},
                INTERVAL 1 DAY)) AS DATE) AS date FROM {GAPPY} GROUP BY id)"""


@register("fill_rows_keeps_nulls_t1", f"""
    SELECT k.id, k.date, {n('g.value', 'value')} FROM {CALENDAR} k
    ASOF JOIN {GAPPY} g ON k.id = g.id AND k.date >= g.date""")
def fill_rows_nulls(spark, sf):
    return S.fill_rows(gappy(spark, sf), TRADES_YESTERDAY).select("id", "date", num("value"))


@register("fill_values_t2", f"""
    SELECT k.id, k.date, {n('g.value', 'value')} FROM {CALENDAR} k
    ASOF LEFT JOIN (SELECT * FROM {GAPPY} WHERE value IS NOT NULL) g
      ON k.id = g.id AND k.date >= g.date""")
def fill_values(spark, sf):
    return S.fill_values(gappy(spark, sf), TRADES_YESTERDAY).select("id", "date", num("value"))


@register("fill_values_keep_last_t3", f"""
    WITH last_day AS (SELECT id, max(date) AS last_date FROM {GAPPY} GROUP BY id),
    done AS (SELECT id, resolved FROM {T.sql('market_questions')})
    SELECT k.id, k.date,
           {n('CASE WHEN q.resolved AND k.date = l.last_date THEN o.value ELSE g.value END', 'value')}
    FROM {CALENDAR} k JOIN last_day l ON l.id = k.id JOIN done q ON q.id = k.id
    LEFT JOIN {GAPPY} o ON o.id = k.id AND o.date = k.date
    ASOF LEFT JOIN (SELECT * FROM {GAPPY} WHERE value IS NOT NULL) g
      ON k.id = g.id AND k.date >= g.date
    WHERE NOT q.resolved OR k.date <= l.last_date""")
def fill_values_keep_last(spark, sf):
    done = T.table(spark, sf, "market_questions").select("id", "resolved")
    with_flag = gappy(spark, sf).join(done, "id")
    return S.fill_values_keep_last(with_flag, F.col("resolved"), TRADES_YESTERDAY).select(
        "id", "date", num("value"))


@register("fill_backward_t4", f"""
    WITH span AS (SELECT id, min(date) AS a, max(date) AS b FROM {GAPPY} GROUP BY id),
    k AS (SELECT id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
    SELECT k.id, k.date, {n('g.value', 'value')} FROM k
    ASOF LEFT JOIN (SELECT * FROM {GAPPY} WHERE value IS NOT NULL) g
      ON k.id = g.id AND k.date <= g.date""")
def fill_backward(spark, sf):
    return S.fill_backward(gappy(spark, sf)).select("id", "date", num("value"))


@register("trailing_sums_t7_j7", f"""
    WITH asked AS (
        SELECT DISTINCT c.country, m.metric, u.date FROM
            (SELECT DISTINCT country FROM {T.sql('conflict_events')}) c
        CROSS JOIN (VALUES ('click'), ('fatalities')) AS m(metric)
        CROSS JOIN (VALUES (DATE '2024-01-10'), (DATE '2024-01-31'), (DATE '2024-02-20')) AS u(date))
    SELECT a.country, a.metric, a.date,
           CAST(coalesce(sum(CASE WHEN e.date >= a.date - 30 THEN e.n END), 0) AS BIGINT) AS sum_30,
           CAST(coalesce(sum(e.n), 0) AS BIGINT) AS sum_360
    FROM asked a LEFT JOIN {CONFLICT_DAILY} e ON e.country = a.country AND e.metric = a.metric
     AND e.date >= a.date - 360 AND e.date < a.date
    GROUP BY 1, 2, 3""")
def trailing_sums(spark, sf):
    events = T.table(spark, sf, "conflict_events")
    days = F.array(*[F.lit(x) for x in (date(2024, 1, 10), date(2024, 1, 31), date(2024, 2, 20))])
    asked = events.select("country").distinct().select(
        "country", F.explode(F.array(F.lit("click"), F.lit("fatalities"))).alias("metric")).select(
        "country", "metric", F.explode(days).alias("date"))
    return S.trailing_sums(S.conflict_daily(events), asked, [30, 360], ["country", "metric"])


# Interval history: each trade holds for some hours; every fiftieth one is still open.
def history(spark, sf):
    hours = (F.col("seq") % 60).cast("int")
    end = F.col("ts") + F.make_dt_interval(F.lit(0), hours)
    return I.filled_trades(spark, sf).select(
        "id", F.col("ts").alias("start_ts"), F.when(F.col("seq") % 50 != 0, end).alias("end_ts"),
        "value")


@register("close_intervals_t8", f"""
    WITH h AS (
        SELECT id, ts AS start_ts, value, CASE WHEN seq % 50 <> 0
                    THEN ts + to_hours(CAST(seq % 60 AS INT))
                    ELSE CAST({d(TRADES_AS_OF)} AS TIMESTAMP) END AS end_ts
        FROM {T.sql('trades')} WHERE is_filled),
    kept AS (
        SELECT *, CASE WHEN strftime(end_ts, '%H:%M:%S.%f') = '23:59:59.999999'
                       THEN CAST(end_ts AS DATE) ELSE CAST(end_ts AS DATE) - 1 END AS date
        FROM h WHERE CAST(start_ts AS DATE) <> CAST(end_ts AS DATE)
                  OR strftime(end_ts, '%H:%M:%S.%f') = '23:59:59.999999'),
    daily AS (SELECT id, CAST(date AS DATE) AS date, arg_max(value, (end_ts, start_ts)) AS value FROM kept
              GROUP BY 1, 2),
    span AS (SELECT id, CAST(min(CAST(start_ts AS DATE)) AS DATE) AS a,
                    CAST(max(date) AS DATE) AS b FROM kept GROUP BY id),
    k AS (SELECT id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
    SELECT k.id, k.date, {n('g.value', 'value')} FROM k ASOF LEFT JOIN daily g
      ON k.id = g.id AND k.date <= g.date
    WHERE k.date < {d(TRADES_AS_OF)}""")
def close_intervals(spark, sf):
    return S.close_intervals(history(spark, sf), TRADES_AS_OF).select("id", "date", num("value"))


@register("splice_resolution_t9", f"SELECT id, date, {n('value')} FROM {I.MARKET_SERIES}")
def splice(spark, sf):
    return I.market_series(spark, sf).select("id", "date", num("value"))


@register("splice_and_refill_t10", f"""
    WITH base AS (
        SELECT c.id, c.date, c.value FROM {I.DAILY_CLOSE} c
        LEFT JOIN {I.MARKET_FACTS} q ON q.id = c.id AND q.resolved
        WHERE q.id IS NULL OR c.date < q.resolved_on
        UNION ALL SELECT id, resolved_on, final_value FROM {I.MARKET_FACTS} WHERE resolved),
    span AS (SELECT id, min(date) AS a, max(date) AS b FROM base GROUP BY id),
    k AS (SELECT id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
    SELECT k.id, k.date, {n('g.value', 'value')} FROM k ASOF JOIN base g
      ON k.id = g.id AND k.date >= g.date""")
def splice_and_refill(spark, sf):
    final = I.market_final_values(spark, sf).drop("source")
    return S.splice_and_refill(I.daily_close(spark, sf).drop("source"), final).select(
        "id", "date", num("value"))


@register("final_values_t9", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(1 AS DOUBLE)
           WHEN 'O' THEN CAST(0 AS DOUBLE)
           WHEN 'P' THEN CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 100 AS DOUBLE) / 100 END
           END AS value FROM orders""")
def final_values(spark, sf):
    outcome = F.when(F.col("o_orderstatus") == "F", "yes").when(
        F.col("o_orderstatus") == "O", "NO").otherwise(
        F.when(F.col("o_custkey") % 2 == 0, "MKT").otherwise("CANCEL"))
    return T.raw(spark, sf, "orders").select(
        "o_orderkey", S.final_value(
            outcome, (F.col("o_custkey") % 100).cast("double") / 100).alias("value"))


@register("clamp_start_t11", f"""
    SELECT id, date, {n('value')} FROM {I.DAILY_CLOSE} WHERE date >= DATE '2024-01-15'""")
def clamp(spark, sf):
    return S.clamp_start(I.daily_close(spark, sf), date(2024, 1, 15)).select(
        "id", "date", num("value"))


# Page tables: the page is the event type, the item the user, a date when the item was listed.
ITEMS = """(SELECT event_type AS page, concat('u', CAST(user_id AS VARCHAR)) AS item,
                   CAST(ts AS DATE) AS date, max(value) AS value FROM events GROUP BY 1, 2, 3)"""


def page_items(spark, sf):
    return T.raw(spark, sf, "events").groupBy(
        F.col("event_type").alias("page"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item"),
        F.col("ts").cast("date").alias("date")).agg(F.max("value").alias("value"))


MARKED = f"""(
    WITH items AS {ITEMS}, pages AS (SELECT DISTINCT page, date FROM items),
    spans AS (SELECT page, item, min(date) AS a, max(date) AS b FROM items GROUP BY 1, 2),
    cut AS (SELECT s.page, s.item, s.a, coalesce(min(p.date), s.b) AS b FROM spans s
            LEFT JOIN pages p ON p.page = s.page AND p.date > s.b GROUP BY s.page, s.item, s.a, s.b)
    SELECT page, item, date, value FROM items
    UNION ALL
    SELECT c.page, c.item, p.date, NULL FROM cut c JOIN pages p ON p.page = c.page
     AND p.date BETWEEN c.a AND c.b
    ANTI JOIN items i ON i.page = c.page AND i.item = c.item AND i.date = p.date)"""


def marked_items(spark, sf):
    items = page_items(spark, sf)
    return S.mark_dropouts(items, items.select("page", "date").distinct())


@register("mark_dropouts_t12", f"SELECT page, item, date, {n('value')} FROM {MARKED}")
def mark_dropouts(spark, sf):
    return marked_items(spark, sf).select("page", "item", "date", num("value"))


@register("contiguity_t13", f"""
    SELECT id, coalesce(bool_and(gap = 1), TRUE) AS is_contiguous FROM (
        SELECT id, date - lag(date) OVER (PARTITION BY id ORDER BY date) AS gap
        FROM {I.DAILY_CLOSE}) GROUP BY id""")
def contiguity(spark, sf):
    return S.contiguous(I.daily_close(spark, sf))


@register("up_to_date_t14", f"""
    SELECT id, max(date) AS last_date, max(date) >= {d(TRADES_YESTERDAY)} AS is_up_to_date
    FROM {I.DAILY_CLOSE} GROUP BY id""")
def up_to_date(spark, sf):
    return S.up_to_date(I.daily_close(spark, sf), F.lit(TRADES_YESTERDAY))


# Stored series differ from the new ones where a value was corrected.
@register("changed_series_t15", f"""
    SELECT id, date, {n('value')} FROM {I.DAILY_CLOSE} WHERE id IN (
        SELECT id FROM {I.DAILY_CLOSE} WHERE value > 0.98)""")
def changed(spark, sf):
    new = I.daily_close(spark, sf).select("id", "date", "value")
    stored = new.withColumn("value", F.when(F.col("value") > 0.98, 0.5).otherwise(F.col("value")))
    return S.changed_series(new, stored).select("id", "date", num("value"))


@register("last_revision_t16", """
    SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS day,
           arg_max(o_totalprice, o_orderkey) AS value, max(o_orderkey) AS revision
    FROM orders GROUP BY 1, 2""")
def last_revision(spark, sf):
    edits = T.raw(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("revision"),
        F.col("o_totalprice").alias("value"), "o_orderdate")
    return S.last_revision(edits, ["id"], F.col("o_orderdate").cast("date"), ["revision"],
                           "day").select("id", "day", "value", "revision")


@register("zero_fill_t17", f"""
    SELECT k.id, k.date, CAST(coalesce(e.n, 0) AS BIGINT) AS value FROM (
        SELECT DISTINCT country AS id, CAST(unnest(generate_series(DATE '2024-01-01',
               DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date
        FROM {T.sql('conflict_events')}) k
    LEFT JOIN (SELECT country, event_date, count(*) AS n FROM {T.sql('conflict_events')}
               GROUP BY 1, 2) e ON e.country = k.id AND e.event_date = k.date""")
def zero_fill(spark, sf):
    events = T.table(spark, sf, "conflict_events").select(
        F.col("country").alias("id"), F.col("event_date").alias("date"),
        F.lit(1).cast("bigint").alias("value"))
    return S.zero_fill(events, date(2024, 1, 1), date(2024, 1, 30))


@register("value_as_of_j8", f"""
    SELECT a.id, a.date, {n('s.value', 'value', 2)}, s.id IS NOT NULL AS found FROM (
        SELECT DISTINCT id, forecast_due_date AS date FROM {T.sql('dataset_questions')}) a
    ASOF LEFT JOIN {T.sql('series')} s ON a.id = s.id AND a.date >= s.date""")
def value_as_of(spark, sf):
    asked = T.table(spark, sf, "dataset_questions").select(
        "id", F.col("forecast_due_date").alias("date"))
    return S.value_as_of(T.table(spark, sf, "series"), asked).select(
        "id", "date", num(F.col("value"), "value", 2), "found")


@register("conflict_wide_a1", """
    SELECT concat('C', CAST(user_id AS VARCHAR)) AS country, CAST(ts AS DATE) AS date,
           count(*) FILTER (event_type = 'view') AS view,
           count(*) FILTER (event_type = 'click') AS click,
           count(*) FILTER (event_type = 'signup') AS signup,
           count(*) FILTER (event_type = 'purchase') AS purchase,
           count(*) FILTER (event_type = 'error') AS error,
           CAST(sum(CAST(round(value * 100) AS BIGINT) % 7) AS BIGINT) AS fatalities
    FROM events GROUP BY 1, 2""")
def conflict_wide(spark, sf):
    return S.conflict_wide(T.table(spark, sf, "conflict_events"),
                           ["view", "click", "signup", "purchase", "error"])


@register("conflict_daily_a1", f"SELECT country, date, metric, n FROM {CONFLICT_DAILY}")
def conflict_daily(spark, sf):
    return S.conflict_daily(T.table(spark, sf, "conflict_events"))


# Three deliveries by day of month; every tenth trade comes one delivery late, to a day that is then
# still open or already closed.
_DELIVERED = """(
    SELECT concat('u', CAST(user_id AS VARCHAR)) AS id, ts, event_id AS seq, CAST(ts AS DATE) AS date,
           (CAST(round(value * 100) AS BIGINT) % 101) / 100.0 AS value,
           least(2, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END
                    + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END) AS batch
    FROM events WHERE event_type <> 'error')"""


@register("streamed_daily_close_st1", f"""
    WITH b AS {_DELIVERED},
    opened AS (SELECT k.batch, max(CAST(b.ts - INTERVAL 1 DAY AS DATE)) AS first_open
               FROM (VALUES (0), (1), (2), (3)) AS k(batch) LEFT JOIN b ON b.batch < k.batch GROUP BY 1),
    r AS (SELECT b.*, coalesce(date < first_open, FALSE) AS late FROM b JOIN opened USING (batch)),
    days AS (SELECT id, date, arg_max(value, (ts, seq)) AS value FROM r WHERE NOT late GROUP BY 1, 2),
    closings AS (SELECT a.batch, a.first_open AS from_day, z.first_open AS to_day
                 FROM opened a JOIN opened z ON z.batch = a.batch + 1)
    SELECT 'day' AS kind, id, date, {n('value')}, CAST(NULL AS BIGINT) AS number FROM days
    UNION ALL SELECT 'late', id, date, {n('value')}, seq FROM r WHERE late
    UNION ALL SELECT 'closed', id, date, {n('value')}, batch FROM days JOIN closings
      ON date < to_day AND (from_day IS NULL OR date >= from_day)""")
def streamed_daily_close(spark, sf):
    """Trades delivered in three micro-batches, the second of them twice: open, closed and late rows."""
    run = fresh_folder(spark, "daily-close")
    trades = T.raw(spark, sf, "events").filter("event_type <> 'error'").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"),
        ((F.round(F.col("value") * 100).cast("bigint") % 101) / F.lit(100.0)).alias("value"))
    day = F.dayofmonth("ts")
    delivery = F.least(F.lit(2), F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
                       + F.when(F.col("seq") % 10 == 3, 1).otherwise(0))
    for batch in range(3):
        trades.filter(delivery == batch).write.mode("append").parquet(f"{run}/arrived")
        stream = spark.readStream.schema(trades.schema).parquet(f"{run}/arrived")
        write_daily_close(stream, f"{run}/close", f"{run}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    close = DailyClose(f"{run}/close")
    if close.apply(trades.filter(delivery == 1), 1):
        raise RuntimeError("a repeated batch was taken twice")
    rows = lambda kind, df, number: df.select(
        F.lit(kind).alias("kind"), "id", "date", num("value"), number.cast("long").alias("number"))
    return rows("day", close.days(spark), F.lit(None)).unionByName(
        rows("late", close.late(spark), F.col("seq"))).unionByName(
        rows("closed", close.closed(spark), F.col("batch_id")))

