"""A keyed table kept as Parquet in buckets of its key: reads by key and upserts touch few files.

Rows lie in folders by the ``by`` columns (say, the source) and by a hash bucket of the ``bucket_on``
columns. A read of some keys lists only their folders, which prunes the scan before it starts, and
inside a file rows are sorted by key with min/max statistics and a Bloom filter on it. An upsert reads
and rewrites only the folders that its rows fall into; the others keep their files. Repeating an
upsert changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from probcast.operators.upsert import upsert
from probcast.session import materialise
from probcast.sources.readers import path_exists

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedStore:
    """``key`` identifies a row; ``bucket_on``, its leading part, decides the bucket."""

    path: str
    schema: str
    key: tuple[str, ...] = ("id",)
    bucket_on: tuple[str, ...] = ("id",)
    by: tuple[str, ...] = ()
    buckets: int = 64

    @property
    def folders(self) -> list[str]:
        return [*self.by, BUCKET]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_on), F.lit(self.buckets)).cast("int")

    def _all(self, spark: SparkSession) -> DataFrame:
        full = f"{self.schema}, {BUCKET} INT"
        if not path_exists(spark, f"{self.path}/*"):
            return spark.createDataFrame([], full)
        return spark.read.schema(full).parquet(self.path)

    def _touched(self, rows: DataFrame) -> list:
        """Folders that rows fall into: at most all folders of the table, named by small values."""
        return rows.select(*self.by, self._bucket().alias(BUCKET)).distinct().collect()

    def _inside(self, touched: list) -> Column:
        """Condition on folder columns only, so that it prunes the listing."""
        if not self.by:
            return F.col(BUCKET).isin([r[BUCKET] for r in touched])
        groups: dict[tuple, list[int]] = {}
        for r in touched:
            groups.setdefault(tuple(r[c] for c in self.by), []).append(r[BUCKET])
        condition = F.lit(False)
        for values, own in groups.items():
            same = F.col(BUCKET).isin(own)
            for c, value in zip(self.by, values):
                same = same & (F.col(c) == F.lit(value))
            condition = condition | same
        return condition

    def _save(self, rows: DataFrame, mode: str) -> None:
        """Each folder's rows meet in tasks that Spark may split by size, and are sorted in each file."""
        writer = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", *self.folders).sortWithinPartitions(
            *self.folders, *self.key).write.mode("overwrite").option("partitionOverwriteMode", mode)
        for c in self.bucket_on:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.partitionBy(*self.folders).parquet(self.path)

    # --- reading -----------------------------------------------------------------------------

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).drop(BUCKET)

    def folders_of(self, keys: DataFrame) -> DataFrame:
        """All rows of the folders that hold the keys' buckets."""
        return self._all(keys.sparkSession).filter(self._inside(self._touched(keys)))

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of the wanted keys (``by`` and ``bucket_on`` columns)."""
        on = [*self.by, *self.bucket_on]
        return self.folders_of(keys).drop(BUCKET).join(keys.select(*on).distinct(), on, "left_semi")

    def keys(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).select(*self.by, *self.bucket_on).distinct()

    # --- writing -----------------------------------------------------------------------------

    def create(self, rows: DataFrame) -> None:
        """Replace the whole table."""
        self._save(rows, "static")

    def upsert(self, new: DataFrame, columns: Sequence[str] | None = None) -> None:
        """New rows overwrite the listed columns of stored ones (all by default) or are appended."""
        fresh = materialise(new)
        stored = self.folders_of(fresh).drop(BUCKET)
        # Stored aside, since Spark cannot overwrite what it is reading.
        merged = materialise(upsert(stored, fresh, [*self.by, *self.key], columns))
        if not merged.isEmpty():
            self._save(merged, "dynamic")

    def replace_groups(self, new: DataFrame) -> None:
        """Replace all rows whose ``by`` values occur in ``new``; other groups keep their files."""
        if not self.by:
            raise ValueError("a table without groups is replaced by create")
        fresh = materialise(new)
        groups = fresh.select(*self.by).distinct()
        held = {tuple(r) for r in self._touched(fresh)}
        before = self._all(fresh.sparkSession).join(groups, list(self.by), "left_semi").select(
            *self.folders).distinct().collect()
        self._save(fresh, "dynamic")
        for r in before:
            if tuple(r) not in held:
                self._drop(fresh.sparkSession, r)

    def _drop(self, spark: SparkSession, row) -> None:
        """Remove a folder whose rows were all replaced by none."""
        make = spark._jvm.org.apache.hadoop.fs.Path
        escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        target = make(self.path + "".join(f"/{c}={escape(str(row[c]))}" for c in self.folders))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
