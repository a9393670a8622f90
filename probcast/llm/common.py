"""Helpers shared by the operators: stored stages, word splitting, integer mixing, label folds."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from probcast.session import ensure_checkpoint_dir

SLICE_BYTES = 8 << 20  # text handled at once by a Python task

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bounded_batches(spark: SparkSession) -> None:
    """End Arrow batches by their bytes: rows with long texts or sets must not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """Write a stage once to the shared folder and read it back.

    Unlike ``checkpoint`` the stage is computed once, columns can be pruned later, and the files
    outlive any executor.
    """
    bounded_batches(df.sparkSession)
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows kept for evaluation: those whose CRC32 of the key as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, limits: dict[int, int],
                    key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample to learn from, and the number of usable labels of each class.

    Labels of the held-out fold, null labels and null keys are left out. Each class gives the rows
    whose key hashes lowest, about ``limits[class]`` of them, so the sample is repeatable; their keys
    are few by these limits and travel to the texts as a broadcast. The result has ``text``, ``y``.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(
        F.col(key).alias("_key"), (F.col(label) != 0).cast("int").alias("y"), F.xxhash64(key).alias("_o"))
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y, limit in limits.items():
        part = usable.filter(F.col("y") == y).orderBy("_o").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.join(F.broadcast(chosen.drop("_o")), "_key").select("text", "y"), sizes


def give_back_memory() -> None:
    """Return freed memory to the system: idle Python workers share the executor's room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its memory
        pass


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice has about ``limit`` bytes of text, or a single row."""
    try:
        yield from _slices(batches, column, limit)
    finally:
        give_back_memory()


def _slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        array = batch.column(column)
        if len(batch) == 0:
            continue
        ends = _offsets(array)
        start = 0
        while start < len(batch):
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), len(batch))
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[array.offset:array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the row bounds in it; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = _offsets(array)
    data = array.buffers()[2]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def split_runs(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray,
               lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of bytes outside ``separators`` (a 256-entry mask), never across rows.

    Returns the runs as one binary array, and the row bounds counted in runs.
    """
    keep = ~separators[data]
    starts = keep.copy()
    if len(data):
        starts[1:] &= ~keep[:-1]
        edges = bounds[:-1][bounds[:-1] < len(data)]
        starts[edges] = keep[edges]
    first = np.flatnonzero(starts)
    body = data[keep]
    if lower:
        body = _LOWER[body]
    place = np.concatenate([[0], np.cumsum(keep)]).astype(np.int64)
    offsets = np.append(place[first], len(body)).astype(np.int32)
    runs = pa.Array.from_buffers(
        pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    return runs, np.searchsorted(first, bounds)


def split_words(array: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row: codes, row bounds, and the distinct words."""
    data, bounds = text_bytes(array)
    runs, rows = split_runs(data, bounds, _SPACE, lower)
    encoded = runs.dictionary_encode()
    return np.asarray(encoded.indices), rows, encoded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers with well spread bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``[start, start + length)``."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
