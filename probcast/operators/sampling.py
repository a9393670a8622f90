"""Question bins, quotas, even allocation and sampling without replacement."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from probcast import constants as C
from probcast.functions.hashing import sample_order
from probcast.operators.skew import keep_first_n, skew_join
from probcast.session import materialise

BROADCAST_STRATA = 100_000   # strata whose bounds, one small row each, are sent to every task


# --- bins ------------------------------------------------------------------------------------

def value_label(low: float, high: float) -> str:
    return f"{low}-{high}%"


def horizon_label(low: int, high: float) -> str:
    return f"{low}-{high}d"


def market_value_bin(text: Column) -> Column:
    """Bin of a probability given as text; unreadable or out of range is 'unknown'."""
    value = text.try_cast("double")
    last = len(C.MARKET_VALUE_BINS) - 1
    label = F.when(value.isNull() | F.isnan(value), C.UNKNOWN_BIN)
    for position, (low, high, _) in enumerate(C.MARKET_VALUE_BINS):
        inside = (value >= low) & ((value <= high) if position == last else (value < high))
        label = label.when(inside, value_label(low, high))
    return label.otherwise(C.UNKNOWN_BIN)


def time_horizon_bin(close: Column, due: date) -> Column:
    """Bin of the whole days from the due date (midnight UTC) to the close time."""
    seconds = F.unix_timestamp(F.try_to_timestamp(close)) - F.unix_timestamp(
        F.lit(due).cast("timestamp"))
    days = F.floor(seconds / 86400)
    label = F.when(days.isNull(), C.UNKNOWN_BIN)
    for low, high, _ in C.TIME_HORIZON_BINS:
        label = label.when((days >= low) & (days <= high), horizon_label(low, high))
    return label.otherwise(C.UNKNOWN_BIN)


def _weight(bin_column: str, bins: list[tuple], label) -> Column:
    weight = F.lit(0.0)
    for low, high, share in bins:
        weight = F.when(F.col(bin_column) == label(low, high), F.lit(share)).otherwise(weight)
    return weight


def with_bins(questions: DataFrame, due: date) -> DataFrame:
    return questions.withColumns({
        "market_value_bin": market_value_bin(F.col("freeze_datetime_value")),
        "time_horizon_bin": time_horizon_bin(F.col("market_info_close_datetime"), due),
    }).withColumn("composite_bin", F.concat_ws("_", "market_value_bin", "time_horizon_bin"))


def bin_weights(binned: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Available count and renormalised weight of each bin present (an aggregate, bins are few)."""
    group = group or []
    bins = ["composite_bin", "market_value_bin", "time_horizon_bin"]
    raw = _weight("market_value_bin", C.MARKET_VALUE_BINS, value_label) * _weight(
        "time_horizon_bin", C.TIME_HORIZON_BINS, horizon_label)
    counted = binned.groupBy(*group, *bins).agg(
        F.count(F.lit(1)).alias("available")).withColumn("_raw", raw)
    total = F.sum("_raw").over(Window.partitionBy(*group))
    return counted.withColumn(
        "bin_weight", F.when(total > 0, F.col("_raw") / total).otherwise(0.0)).drop("_raw")


def bin_quotas(weights: DataFrame, n: int | Column, group: list[str] | None = None) -> DataFrame:
    """Rows to take from each bin: rounded share, then a greedy fill or cut to reach ``n``.

    A shortage is filled from the heaviest bins, an excess cut from the lightest. Greedy over an
    order is a running sum: each bin gives what is left of the need after the bins before it.
    """
    group = group or []
    target = F.lit(n) if isinstance(n, int) else n
    usable = weights.filter("bin_weight > 0").withColumn("_n", target.cast("bigint"))
    whole = Window.partitionBy(*group)
    before = lambda order: Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    heavy = [F.col("bin_weight").desc(), F.col("composite_bin").asc()]
    light = [F.col("bin_weight").asc(), F.col("composite_bin").asc()]
    sized = usable.withColumn(
        "_base", F.least(F.bround(F.col("_n") * F.col("bin_weight")).cast("bigint"),
                         F.col("available"))
    ).withColumns({
        "_total": F.sum("_base").over(whole),
        "_room": F.col("available") - F.col("_base"),
    }).withColumns({
        "_room_before": F.coalesce(F.sum("_room").over(before(heavy)), F.lit(0)),
        "_base_before": F.coalesce(F.sum("_base").over(before(light)), F.lit(0)),
    })
    zero = F.lit(0).cast("bigint")
    add = F.greatest(zero, F.least(
        F.col("_room"), F.col("_n") - F.col("_total") - F.col("_room_before")))
    cut = F.greatest(zero, F.least(
        F.col("_base"), F.col("_total") - F.col("_n") - F.col("_base_before")))
    return sized.withColumn("quota", F.col("_base") + add - cut).select(
        *group, "composite_bin", "available", "bin_weight", "quota")


def bin_report(binned: DataFrame, quotas: DataFrame, sampled: DataFrame) -> DataFrame:
    """Per bin: available, wanted, got and the shortfall."""
    got = sampled.groupBy("composite_bin").agg(F.count(F.lit(1)).alias("got"))
    available = binned.groupBy("composite_bin").agg(F.count(F.lit(1)).alias("available"))
    return available.join(
        quotas.select("composite_bin", F.col("quota").alias("wanted")), "composite_bin", "left"
    ).join(got, "composite_bin", "left").na.fill(0, ["wanted", "got"]).withColumn(
        "shortfall", F.greatest(F.col("wanted") - F.col("got"), F.lit(0).cast("bigint")))


# --- sampling --------------------------------------------------------------------------------

def sample_strata(rows: DataFrame, quotas: DataFrame, strata: list[str], seed: int,
                  key: str = "id") -> DataFrame:
    """``quota`` rows of each stratum in hash order.

    The order is a uniform hash, so the first rows of a stratum lie below quota / size of its range;
    only rows below that bound, widened by a few standard deviations, leave their task. Counts check
    the bound, and where a stratum came out short it is widened again, so the sample is exact.
    """
    order = sample_order(F.col(key), seed)
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    sized = materialise(rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size")).join(
        quotas.select(*strata, F.col("quota").cast("long").alias("quota")), strata))
    few = sized.count() <= BROADCAST_STRATA
    slack = 8.0
    while True:
        share = (F.col("quota") + slack * (F.sqrt("quota") + 1)) / F.col("_size")
        bounds = sized.withColumn("_bound", F.least(F.lit(1.0), share) * float(1 << 32))
        below = (rows.join(F.broadcast(bounds), strata) if few else skew_join(rows, bounds, strata, [key])).filter(
            place.isNull() | (place < F.col("_bound")))
        kept = materialise(below)
        got = kept.groupBy(*strata).agg(F.count(F.lit(1)).alias("_got"))
        short = sized.join(got, strata, "left").filter(
            F.coalesce("_got", F.lit(0)) < F.least("quota", "_size"))
        if short.isEmpty():
            break
        slack *= 16
    return keep_first_n(kept, strata, [order, F.col(key)], F.col("quota"), (key,)).drop(
        "quota", "_size", "_bound", "_rank")


def sample_simple(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """Simple random sample of n rows: a distributed top-n by hash."""
    return rows.orderBy(sample_order(F.col(key), seed), F.col(key)).limit(n)


def sample_market(questions: DataFrame, n: int | Column, due: date, seed: int,
                  group: list[str] | None = None) -> DataFrame:
    """Market questions by value and horizon bins, per ``group`` (normally the source)."""
    group = group or []
    binned = with_bins(questions, due)
    quotas = bin_quotas(bin_weights(binned, group), n, group)
    return sample_strata(binned, quotas, [*group, "composite_bin"], seed).drop(
        "market_value_bin", "time_horizon_bin", "composite_bin")


# --- allocation ------------------------------------------------------------------------------

def allocate_evenly(available: Mapping[str, int], n: int) -> dict[str, int]:
    """Split n over keys as evenly as their counts allow; raises when the total is below n.

    All keys are filled to the highest common level that n covers (a key with less gives all it
    has); what is left goes one each to the first keys that have more.
    """
    if sum(available.values()) < n:
        raise ValueError(f"cannot allocate {n} from {sum(available.values())}")
    filled = lambda level: sum(min(level, count) for count in available.values())
    level = bisect_right(range(max(available.values(), default=0) + 1), n, key=filled) - 1
    above = [key for key, count in available.items() if count > level][:n - filled(level)]
    return {key: min(level, count) + (key in above) for key, count in available.items()}


def allocate_counts(rows: DataFrame, key: str, n: int, order: list[str] | None = None
                    ) -> dict[str, int]:
    """Even allocation over the values of a small fixed domain (sources or categories)."""
    domain = order or (C.ALL_SOURCES if key == "source" else C.CATEGORIES)
    counts = {row[key]: row["n"] for row in rows.filter(F.col(key).isin(domain)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    return allocate_evenly({name: counts[name] for name in domain if name in counts}, n)


def quota_frame(rows: DataFrame, allocation: Mapping, names: list[str]) -> DataFrame:
    """Allocation as a small table; keys are values or tuples of the named columns."""
    data = [(*(k if isinstance(k, tuple) else (k,)), int(v)) for k, v in allocation.items()]
    ddl = ", ".join([f"{name} STRING" for name in names] + ["quota BIGINT"])
    return F.broadcast(rows.sparkSession.createDataFrame(data, ddl))


def sample_categories_evenly(questions: DataFrame, per_source: Mapping[str, int], seed: int
                             ) -> DataFrame:
    """Dataset questions spread evenly over the categories of each source."""
    counts: dict[str, dict[str, int]] = {}
    for row in questions.filter(F.col("source").isin(list(per_source))).groupBy(
            "source", "category").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(row["source"], {})[row["category"]] = row["n"]
    allocation = {}
    for source, n in per_source.items():
        ordered = {c: counts[source][c] for c in C.CATEGORIES if c in counts.get(source, {})}
        for category, quota in allocate_evenly(ordered, n).items():
            allocation[(source, category)] = quota
    quotas = quota_frame(questions, allocation, ["source", "category"])
    return sample_strata(questions, quotas, ["source", "category"], seed)


def due_date(freeze: date) -> date:
    return freeze + timedelta(days=C.FREEZE_WINDOW_DAYS)
