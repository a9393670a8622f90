"""Set operations and keyed updates of stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from probcast.operators.skew import skew_join


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Row de-duplication in which nulls are equal."""
    return df.dropDuplicates()


def _joined(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    kept = stored.withColumn("_old", F.lit(True))
    fresh = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in key]
                       ).withColumn("_new", F.lit(True))
    return kept.join(fresh, list(key), "full")


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str],
           columns: Sequence[str] | None = None) -> DataFrame:
    """A new row overwrites the listed columns (all of its own by default), else it is appended."""
    listed = set(columns) if columns is not None else set(new.columns)
    fresh = set(new.columns)

    def pick(name: str) -> Column:
        if name in key:
            return F.col(name)
        if name not in fresh:
            return F.col(name)
        incoming = F.col(f"_new_{name}")
        if name in listed:
            return F.when(F.col("_new").isNotNull(), incoming).otherwise(F.col(name)).alias(name)
        return F.when(F.col("_old").isNull(), incoming).otherwise(F.col(name)).alias(name)

    return _joined(stored, new, key).select(*[pick(c) for c in stored.columns])


def update_non_null(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Update matching rows with the non-null values of the new ones; nothing is appended."""
    fresh = [c for c in new.columns if c not in key]
    side = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in fresh])
    return stored.join(side, list(key), "left").select(*[
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fresh else F.col(c)
        for c in stored.columns])


def merge_fields(primary: DataFrame, secondary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full merge by key; the primary side wins on shared fields, others come from either side."""
    names = [*primary.columns, *[c for c in secondary.columns if c not in primary.columns]]
    right = secondary.select(*key, *[
        F.col(c).alias(f"_s_{c}") for c in secondary.columns if c not in key])
    joined = primary.join(right, list(key), "full")

    def pick(name: str) -> Column:
        if name in key:
            return F.col(name)
        if name not in secondary.columns:
            return F.col(name)
        if name not in primary.columns:
            return F.col(f"_s_{name}").alias(name)
        return F.coalesce(F.col(name), F.col(f"_s_{name}")).alias(name)

    return joined.select(*[pick(n) for n in names])


def append_capped(pool: DataFrame, new: DataFrame, key: Sequence[str], cap: int,
                  open_filter: str = "not resolved") -> DataFrame:
    """Append new rows while the pool of open questions stays within ``cap``, in key order.

    The free room is one number; taking the first rows is a distributed top-n.
    """
    candidates = new.join(pool.select(*key), list(key), "left_anti")
    room = max(0, cap - pool.filter(open_filter).count())
    chosen = candidates.orderBy(*key).limit(room)
    return pool.unionByName(chosen, allowMissingColumns=True)


def replace_source(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all rows of the sources that occur in ``new``."""
    return stored.join(new.select("source").distinct(), "source", "left_anti").unionByName(
        new, allowMissingColumns=True)


def new_rows(new: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    return new.join(stored.select(*key), list(key), "left_anti")


def known_rows(new: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    return new.join(stored.select(*key), list(key), "left_semi")


def active_first(active: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Active rows win over existing ones with the same key."""
    return active.unionByName(new_rows(existing, active, key), allowMissingColumns=True)


def wanted_ids(listed: DataFrame, stored: DataFrame, *excluded: DataFrame) -> DataFrame:
    """(listed union stored) minus each of the excluded id sets."""
    ids = listed.select("id").union(stored.select("id")).distinct()
    return reduce(lambda a, b: a.join(b.select("id"), "id", "left_anti"), excluded, ids)


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the given order (page-wise repeats of the same event)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(
        *key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def share_forecasts(dataset_forecasts: DataFrame, market_forecasts: DataFrame,
                    groups: dict[str, Sequence[str]]) -> DataFrame:
    """Dataset forecasts of a group's prompt variant count for each of its output variants.

    ``groups``: prompt variant -> output variants (a fixed short list, so an explode suffices).
    """
    targets = F.lit(None).cast("array<string>")
    for prompt, outputs in groups.items():
        targets = F.when(F.col("variant") == prompt, F.array(*[F.lit(o) for o in outputs])
                         ).otherwise(targets)
    targets = F.coalesce(targets, F.array("variant"))
    shared = dataset_forecasts.withColumn("variant", F.explode(targets))
    return shared.unionByName(market_forecasts, allowMissingColumns=True)


def remap(df: DataFrame, mapping: DataFrame, column: str = "id") -> DataFrame:
    """Replace old ids with new ones; ``mapping``: (old_id, new_id)."""
    side = mapping.select(F.col("old_id").alias(column), "new_id")
    return df.join(side, column, "left").withColumn(
        column, F.coalesce("new_id", column)).drop("new_id").select(*df.columns)


def relabel_copies(series: DataFrame, renames: DataFrame) -> DataFrame:
    """Series of a renamed ticker stored under its old name as well."""
    copies = series.join(renames.select(F.col("new_id").alias("id"), "old_id"), "id").withColumn(
        "id", F.col("old_id")).drop("old_id")
    return new_rows(series, renames.select(F.col("old_id").alias("id")), ["id"]).unionByName(
        copies.select(*series.columns))


def as_of_entry(df: DataFrame, entries: DataFrame, key: Sequence[str], day: str,
                start: str = "start_date") -> DataFrame:
    """For each row the configuration entry with the greatest start date not after its day.

    Entries of a key (a few versions) are held as one sorted array, so this is an equi-join; a key
    that holds many rows is salted by its measured share.
    """
    fields = [c for c in entries.columns if c not in key]
    listed = entries.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        start, *[c for c in fields if c != start]))).alias("_entries"))
    chosen = F.try_element_at(
        F.filter("_entries", lambda e: e[start] <= F.col(day)), F.lit(-1))
    return skew_join(df, listed, list(key), [day], "left").withColumn("_e", chosen).select(
        *df.columns, *[F.col(f"_e.{c}").alias(c) for c in fields])
