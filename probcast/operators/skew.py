"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 8
HOT_KEYS = 128         # keys that may be salted; the sketch tracks SKETCH_ITEMS to find them
SKETCH_ITEMS = 4_096
PIECES = 8             # of one task's fair share into which a hot key is cut


def hot_keys(df: DataFrame, on: Sequence[str], tasks: int) -> dict[int, int]:
    """Hash of each key that holds more than a piece of a task's fair share -> number of salts.

    Counts come from a frequent-items sketch, a bounded state that tasks merge, so the driver sees
    at most ``HOT_KEYS`` of them. A sketch may misjudge a count by rows / ``SKETCH_ITEMS``; salts
    then differ a little, results never.
    """
    known = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in on)).select(F.xxhash64(*on).alias("_key"))
    top, rows = known.agg(F.expr(f"approx_top_k(_key, {HOT_KEYS}, {SKETCH_ITEMS})"), F.count("*")).first()
    piece = max(1.0, rows / (tasks * PIECES))
    return {r["item"]: int(-(-r["count"] // piece)) for r in top or () if r["count"] > piece}


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[str], salt_on: Sequence[str],
              how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Equi-join of a left side with hot keys and a right side with few rows per key.

    Only measured hot keys are salted, each by its share of the rows, and only their right rows are
    repeated. Left rows with a null key match nothing; they are spread over all tasks by their salt
    instead of meeting in one. Inner, left, semi and anti only.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"skew_join does not support {how}")
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = hot_keys(left, on, tasks)
    none = F.lit(False)
    for c in on:
        none = none | F.col(c).isNull()
    number = F.lit(1)
    if salts:
        table = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
        number = F.coalesce(F.try_element_at(table, F.xxhash64(*on)), F.lit(1))
    spread = left.withColumn("_salt", F.pmod(
        F.xxhash64(*salt_on), F.when(none, F.lit(tasks * PIECES)).otherwise(number)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), (number - 1).cast("int"))))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salt_on: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join of a large left side, whose keys may be hot, with a right side unique per key.

    Left rows get a salt from the ``salt_on`` columns (which vary within a key), right rows are
    repeated once per salt, so a key holding a third of the rows spreads over ``salts`` tasks and
    AQE can split those further. Named columns keep column pruning intact. Inner, left, semi and
    anti only: a right row without partner would otherwise appear once per salt.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salted_join does not support {how}")
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def keep_first_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: Column,
                 salt_on: Sequence[str] = ("id",), rank_name: str = "_rank",
                 salts: int = SALTS) -> DataFrame:
    """First ``n`` rows of each group (``n`` may differ by group) in two rounds.

    Round one ranks inside (group, salt) and drops what cannot survive, round two ranks the few
    survivors of a group: at most salts * n rows, whatever the group size was.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    local = Window.partitionBy(*group, "_salt").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_local", F.row_number().over(local)).filter(F.col("_local") <= n)
        .withColumn(rank_name, F.row_number().over(final)).filter(F.col(rank_name) <= n)
        .drop("_salt", "_local")
    )


def require_no_rows(bad: DataFrame, message: str) -> None:
    """Raise when ``bad`` has any row, naming the first one."""
    sample = bad.limit(1).collect()
    if sample:
        raise ValueError(f"{message}: {sample[0].asDict()}")


def require_at_most(df: DataFrame, limit: int, what: str) -> None:
    """Raise when a frame that must stay small does not."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"{what}: more than {limit} rows")
