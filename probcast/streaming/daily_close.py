"""Daily closing values from a stream of trades, with closed days and replays.

Each micro-batch keeps, per question and day, its last trade and upserts these rows into a table
partitioned by day; only open days are read and rewritten, so the state of the stream is the open days
of that table and no state store grows. A day closes when a trade is seen more than ``delay`` after its
end. Which days are open for a batch is decided by the batches before it, so the outcome does not depend
on the order of rows inside a batch.

Trades of closed days change nothing and go to a table of late rows. Days that a batch closes go to a
table of final rows. A ledger names the last finished batch and the first open day. Every output of a
batch overwrites its own partition and the ledger is written last, so a batch that failed midway or is
sent again has no second effect.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from probcast.sources.readers import path_exists

DAY = "id STRING, date DATE, value DOUBLE, last_ts TIMESTAMP, last_seq BIGINT"
LATE = "id STRING, ts TIMESTAMP, seq BIGINT, value DOUBLE, date DATE, batch_id BIGINT"
CLOSED = DAY + ", batch_id BIGINT"
KEPT = 10   # ledger entries that stay


def last_of_day(trades: DataFrame) -> DataFrame:
    """(id, date, value, last_ts, last_seq): the last trade per question and day by (ts, seq)."""
    return trades.groupBy("id", F.to_date("ts").alias("date")).agg(
        F.max_by(F.struct("value", F.col("ts").alias("last_ts"), F.col("seq").alias("last_seq")),
                 F.struct("ts", "seq")).alias("_last")).select("id", "date", "_last.*")


def upsert_days(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Newest row per (id, date) of both sides, by (last_ts, last_seq)."""
    columns = ["id", "date", "value", "last_ts", "last_seq"]
    return stored.select(*columns).unionByName(batch.select(*columns)).groupBy("id", "date").agg(
        F.max_by(F.struct("value", "last_ts", "last_seq"), F.struct("last_ts", "last_seq")).alias(
            "_r")).select("id", "date", "_r.*")


@dataclass(frozen=True)
class DailyClose:
    """The tables of one stream below ``folder``."""

    folder: str
    delay: timedelta = timedelta(days=1)

    def days(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "days", DAY)

    def late(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "late", LATE)

    def closed(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "closed", CLOSED)

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)

    # --- ledger ------------------------------------------------------------------------------

    def _ledger(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def finished(self, spark: SparkSession) -> tuple[int, date | None]:
        """Last finished batch (-1: none) and first open day. Entries are empty files named
        ``batch_day``: making one is a single step in any file system."""
        path, files = self._ledger(spark)
        if not files.exists(path):
            return -1, None
        names = [s.getPath().getName().split("_") for s in files.listStatus(path)]
        if not names:
            return -1, None
        batch, day = max(names, key=lambda n: int(n[0]))
        return int(batch), None if day == "none" else date.fromisoformat(day)

    def _finish(self, spark: SparkSession, batch_id: int, first_open: date | None) -> None:
        path, files = self._ledger(spark)
        make = spark._jvm.org.apache.hadoop.fs.Path
        files.create(make(path, f"{batch_id}_{first_open or 'none'}"), True).close()
        for status in files.listStatus(path):
            if int(status.getPath().getName().split("_")[0]) <= batch_id - KEPT:
                files.delete(status.getPath(), False)

    # --- batches -----------------------------------------------------------------------------

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Take one micro-batch of trades (id, ts TIMESTAMP, seq, value); False if it was taken before."""
        spark = batch.sparkSession
        last, first_open = self.finished(spark)
        if batch_id <= last:
            return False
        staged = f"{self.folder}/staged"
        batch.select("id", "ts", F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"),
                     F.to_date("ts").alias("date")).write.mode("overwrite").parquet(staged)
        trades = spark.read.parquet(staged)
        after = trades.agg(F.to_date(F.max("ts") - F.make_interval(
            secs=F.lit(self.delay.total_seconds())))).first()[0]
        if after is None:
            self._finish(spark, batch_id, first_open)
            return True
        is_open = F.lit(True) if first_open is None else F.col("date") >= F.lit(first_open)
        trades.filter(~is_open).write.mode("overwrite").parquet(f"{self.folder}/late/batch_id={batch_id}")
        self._merge(spark, last_of_day(trades.filter(is_open)), is_open)
        after = after if first_open is None else max(after, first_open)
        closing = self.days(spark).filter(is_open & (F.col("date") < F.lit(after)))
        closing.write.mode("overwrite").parquet(f"{self.folder}/closed/batch_id={batch_id}")
        self._finish(spark, batch_id, after)
        return True

    def _merge(self, spark: SparkSession, fresh: DataFrame, is_open) -> None:
        """Rewrite the partitions of the days that the batch touches."""
        days, side = f"{self.folder}/days", f"{self.folder}/merged"
        touched = [r.date for r in fresh.select("date").distinct().collect()]
        if not touched:
            return
        stored = self.days(spark).filter(is_open & F.col("date").isin(touched))
        # A side folder, since Spark cannot overwrite what it is reading.
        upsert_days(stored, fresh).write.mode("overwrite").parquet(side)
        spark.read.schema(DAY).parquet(side).hint("rebalance", "date").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("date").parquet(days)


def write_daily_close(trades: DataFrame, folder: str, checkpoint: str, delay: timedelta = timedelta(days=1)
                      ) -> DataStreamWriter:
    """Writer that keeps the tables below ``folder`` up to date; start it with ``.start()``."""
    close = DailyClose(folder, delay)
    return trades.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: close.apply(batch, batch_id) and None)
