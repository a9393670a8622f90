import datetime as dt

import pytest
from pyspark.sql import functions as F

from probcast.operators import baselines as B, series as S, upsert as U
from probcast.streaming.daily_close import DailyClose, write_daily_close
from tests.conftest import day, rows

DDL = "id STRING, date DATE, value DOUBLE"


def frame(spark, *items):
    return spark.createDataFrame([("a", day(f"2024-01-{d:02d}"), v) for d, v in items], DDL)


def values(df):
    return {r.date.day: r.value for r in df.collect()}


GAPPY = ((1, 1.0), (3, None), (5, 2.0))


def test_fills_treat_explicit_nulls_differently(spark):
    df = frame(spark, *GAPPY)
    until = day("2024-01-06")
    assert values(S.fill_rows(df, until)) == {1: 1, 2: 1, 3: None, 4: None, 5: 2, 6: 2}
    assert values(S.fill_values(df, until)) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}
    assert values(S.fill_backward(df)) == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2}
    tail = frame(spark, (1, 1.0), (3, None))
    assert values(S.fill_values_keep_last(tail, F.lit(True), until)) == {1: 1, 2: 1, 3: None}
    assert values(S.fill_values_keep_last(tail, F.lit(False), until)) == {
        1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}


def test_fill_does_not_cut_rows_after_the_limit(spark):
    assert values(S.fill_rows(frame(spark, (1, 1.0), (5, 2.0)), day("2024-01-02"))) == {
        1: 1, 2: 1, 3: 1, 4: 1, 5: 2}


def test_value_as_of_equals_the_filled_calendar(spark):
    df = frame(spark, *GAPPY)
    asked = spark.createDataFrame(
        [("a", day("2024-01-01") + dt.timedelta(days=k)) for k in range(-1, 6)],
        "id STRING, date DATE")
    got = {r.date: (r.value, r.found) for r in S.value_as_of(df, asked).collect()}
    filled = {r.date: r.value for r in S.fill_rows(df, day("2024-01-06")).collect()}
    assert got[day("2023-12-31")] == (None, False)
    assert all(got[d] == (v, True) for d, v in filled.items())


def test_splices(spark):
    df = frame(spark, (1, 0.2), (2, 0.3), (6, 0.9))
    final = spark.createDataFrame([("a", day("2024-01-05"), 1.0)],
                                  "id STRING, resolved_on DATE, final_value DOUBLE")
    assert values(S.splice_resolution(df, final)) == {1: 0.2, 2: 0.3, 5: 1.0}
    assert values(S.splice_and_refill(df, final)) == {1: 0.2, 2: 0.3, 3: 0.3, 4: 0.3, 5: 1.0}


def test_closed_intervals(spark):
    t = lambda text: dt.datetime.fromisoformat(text)
    history = spark.createDataFrame([
        ("a", t("2024-01-01T09:00:00"), t("2024-01-01T10:00:00"), 0.1),      # within a day: dropped
        ("a", t("2024-01-01T10:00:00"), t("2024-01-03T08:00:00"), 0.2),      # last value of the 2nd
        ("a", t("2024-01-04T01:00:00"), t("2024-01-04T23:59:59.999999"), 0.3),  # valid on the 4th
        ("a", t("2024-01-05T08:00:00"), None, 0.4)],
        "id STRING, start_ts TIMESTAMP, end_ts TIMESTAMP, value DOUBLE")
    got = values(S.close_intervals(history, day("2024-01-07")))
    assert got == {1: 0.2, 2: 0.2, 3: 0.3, 4: 0.3, 5: 0.4, 6: 0.4}


def test_dropouts_become_nulls(spark):
    ddl = "page STRING, item STRING, date DATE, value DOUBLE"
    d = [day(f"2024-01-{k:02d}") for k in range(1, 6)]
    items = spark.createDataFrame(
        [("p", "x", d[0], 1.0), ("p", "x", d[2], 2.0)] + [("p", "y", k, 5.0) for k in d], ddl)
    out = S.mark_dropouts(items, items.select("page", "date").distinct()).filter("item = 'x'")
    assert values(out) == {1: 1.0, 2: None, 3: 2.0, 4: None}


def test_trailing_sum_edges(spark):
    daily = spark.createDataFrame([("a", day("2024-01-01"), 3), ("a", day("2024-01-31"), 5)],
                                  "id STRING, date DATE, n BIGINT")
    asked = spark.createDataFrame([("a", day("2024-01-31")), ("a", day("2024-02-01")),
                                   ("z", day("2024-02-01"))], "id STRING, date DATE")
    got = {(r.id, r.date): r.sum_30 for r in S.trailing_sums(daily, asked, [30], ["id"]).collect()}
    assert got == {("a", day("2024-01-31")): 3, ("a", day("2024-02-01")): 5,
                   ("z", day("2024-02-01")): 0}


def test_changed_and_contiguous(spark):
    df = frame(spark, (1, 1.0), (2, 2.0))
    assert S.changed_series(df, df).count() == 0
    assert S.changed_series(df, frame(spark, (1, 1.0))).count() == 2
    assert S.contiguous(df).first().is_contiguous
    assert not S.contiguous(frame(spark, (1, 1.0), (3, 1.0))).first().is_contiguous


def test_upserts(spark):
    ddl = "id STRING, a STRING, b STRING"
    old = spark.createDataFrame([("1", "x", "y"), ("2", "x", "y")], ddl)
    new = spark.createDataFrame([("2", None, "n"), ("3", "m", "n")], ddl)
    assert rows(U.upsert(old, new, ["id"]), "id", "a", "b") == [
        ("1", "x", "y"), ("2", None, "n"), ("3", "m", "n")]
    assert rows(U.upsert(old, new, ["id"], ["b"]), "id", "a", "b") == [
        ("1", "x", "y"), ("2", "x", "n"), ("3", "m", "n")]
    assert rows(U.update_non_null(old, new, ["id"]), "id", "a", "b") == [
        ("1", "x", "y"), ("2", "x", "n")]


TRADES = "id STRING, ts TIMESTAMP, seq BIGINT, value DOUBLE"


def trade(d, h, seq, value, key="a"):
    return key, dt.datetime(2024, 1, d, h), seq, value


def test_stream_closes_days_and_sets_late_rows_aside(spark, tmp_path):
    batches = [[trade(1, 9, 1, 0.1), trade(1, 12, 2, 0.2)],
               [trade(1, 18, 3, 0.3), trade(1, 11, 4, 0.9), trade(2, 9, 5, 0.4)],
               [trade(4, 6, 6, 0.5), trade(2, 23, 7, 0.6)],     # closes the days before the third
               [trade(2, 23, 8, 0.7), trade(3, 1, 9, 0.8), trade(1, 1, 10, 0.9, "b")]]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, TRADES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(TRADES).parquet(source)
        write_daily_close(stream, sink, str(tmp_path / "check")).trigger(
            availableNow=True).start().awaitTermination()
    close = DailyClose(sink)
    got = {(r.id, r.date.day): r.value for r in close.days(spark).collect()}
    assert got == {("a", 1): 0.3, ("a", 2): 0.6, ("a", 3): 0.8, ("a", 4): 0.5}
    assert sorted((r.id, r.seq, r.batch_id) for r in close.late(spark).collect()) == [("a", 8, 3), ("b", 10, 3)]
    assert sorted((r.date.day, r.value, r.batch_id) for r in close.closed(spark).collect()) == [
        (1, 0.3, 2), (2, 0.6, 2)]
    assert close.finished(spark) == (3, day("2024-01-03"))


def test_a_batch_that_failed_midway_or_comes_again_has_no_second_effect(spark, tmp_path, monkeypatch):
    close = DailyClose(str(tmp_path / "out"))
    frame_of = lambda rows_: spark.createDataFrame(rows_, TRADES)
    assert close.apply(frame_of([trade(1, 9, 1, 0.1)]), 0)
    second = frame_of([trade(1, 20, 2, 0.2), trade(5, 1, 3, 0.3)])
    with monkeypatch.context() as m:
        m.setattr(DailyClose, "_finish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            close.apply(second, 1)
    assert close.finished(spark) == (0, day("2023-12-31"))
    assert close.apply(second, 1) and not close.apply(second, 1) and not close.apply(second, 0)
    assert rows(close.days(spark), "date", "value") == [(day("2024-01-01"), 0.2), (day("2024-01-05"), 0.3)]
    assert rows(close.closed(spark), "date", "batch_id") == [(day("2024-01-01"), 1)]
    assert close.late(spark).count() == 0
    assert close.apply(frame_of([]), 2) and close.finished(spark) == (2, day("2024-01-04"))


def test_trend_forecast_follows_a_line(spark):
    df = spark.createDataFrame(
        [("a", day("2024-01-01") + dt.timedelta(days=k), float(k)) for k in range(60)], DDL)
    asked = spark.createDataFrame([("a", day("2024-03-10"))], "id STRING, date DATE")
    model = B.SeriesModel(yearly=False)
    row = B.trend_forecast(df, asked, day("2024-03-01"), model).first()
    assert abs(row["mean"] - 69.0) < 0.5 and row.lower <= row["mean"] <= row.upper
    grown = B.increase_probability(B.trend_forecast(df, asked, day("2024-03-01"), model), model)
    assert grown.first().forecast == 0.95
