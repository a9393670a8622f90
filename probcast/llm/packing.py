"""Packing of tokenised texts into sequences of fixed capacity by minimum bin slack.

Only texts longer than the capacity are cut; the remainder is the first piece, so all others fill a
sequence. How many pieces there are of each length is all that packing needs to know: at most
``capacity`` numbers reach the driver. Bin by bin, a bitset subset-sum over the available lengths finds
the fullest combination that holds the largest remaining length; the combination is taken as often as
the counts allow, so the number of steps does not grow with the table. Pieces of equal length are
interchangeable: a piece's rank within its length, from counts per (length, salt), decides its place.

Defined cases: a null text is empty and packs its end id alone; repeated rows are packed each on its
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from probcast.llm.common import bounded_batches, stored, text_slices
from probcast.llm.tokens import TextEncoder, with_end

ROWS_PER_SALT = 20_000


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a text of ``n`` tokens: the remainder first, then full pieces."""
    first = (n - 1) % capacity + 1 if n else 0
    return [first] + [capacity] * ((n - first) // capacity) if n else []


def token_pieces(docs: DataFrame, path: str, end: int, capacity: int = 1024, key: str = "doc_id",
                 text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of every text: id, piece, start, length, ids_crc32 and, on request, the ids as bytes."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(F.col(key).alias("id")).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    if keep_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        encoder = TextEncoder(path, keep_spaces=True)
        for part in text_slices(batches, "_text", 4 << 20):
            ids, bounds = with_end(*encoder.encode(part.column("_text")), end)
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                at = a
                for k, size in enumerate(cut_lengths(b - a, capacity)):
                    row.append(i), piece.append(k), start.append(at - a), length.append(size)
                    crc.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
                    if keep_ids:
                        own.append(bytes(raw[4 * at:4 * (at + size)]))
                    at += size
            columns = [part.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(own, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).mapInArrow(run, schema)


def fullest_combination(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest feasible bin that holds the largest available length: length -> how many.

    Bounded subset-sum on a bitset whose bit ``s`` says that total ``s`` can be reached; lengths are
    tried from the largest, so equal fills prefer few large pieces.
    """
    anchor = max(counts)
    room = capacity - anchor
    reach, full, steps = 1, 1 << room, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        free = min(counts[length] - (length == anchor), room // length)
        take = 1
        while free > 0:
            take = min(take, free)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & ((full << 1) - 1)
            free -= take
            take *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen = {anchor: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many, combination of lengths); together they use every piece once."""
    left = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while left:
        bin_ = fullest_combination(left, capacity)
        times = min(left[length] // uses for length, uses in bin_.items())
        plan.append((times, bin_))
        for length, uses in bin_.items():
            left[length] -= times * uses
            if not left[length]:
                del left[length]
    return plan


def _slots(plan: Iterable[tuple[int, dict[int, int]]], stride: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: ranges of ranks, sorted by (length, first rank)."""
    rows, ranks, sequence = [], {}, 0
    for times, bin_ in plan:
        offset = 0
        for length, uses in bin_.items():
            first = ranks.get(length, 0)
            rows.append((length * stride + first, first, uses, sequence, offset))
            ranks[length] = first + times * uses
            offset += uses * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "uses", "sequence", "offset"), table.T))


def ranked_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces with ``rank``, their number from 0 among pieces of the same length.

    Ranks are counted within (length, salt) and shifted by the counts of lower salts, so a length
    that holds a third of the table is spread over many tasks.
    """
    salts = max(16, pieces.count() // ROWS_PER_SALT)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("length", "_salt").orderBy("id", "piece")
    return (salted.withColumn("_rank", F.row_number().over(inside) - 1).join(shift, ["length", "_salt"])
            .withColumn("rank", F.col("_rank") + F.col("_shift")).drop("_salt", "_rank", "_shift"))


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Pieces (``id``, ``piece``, ``length``, any others) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in pieces.filter(F.col("length") > 0).groupBy("length")
              .agg(F.count("*").alias("n")).collect()}
    if counts and max(counts) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    stride = max(counts.values(), default=0) + 1
    slots = _slots(minimum_bin_slack(counts, capacity), stride)
    ranked = ranked_pieces(pieces.filter(F.col("length") > 0))

    def run(batches):
        for batch in batches:
            rank = np.asarray(batch.column("rank").to_numpy(zero_copy_only=False), np.int64)
            length = np.asarray(batch.column("length").to_numpy(zero_copy_only=False), np.int64)
            at = np.searchsorted(slots["key"], length * stride + rank, side="right") - 1
            inner = rank - slots["first"][at]
            uses = slots["uses"][at]
            yield (batch.drop_columns(["rank"])
                   .append_column("sequence_id", pa.array(slots["sequence"][at] + inner // uses))
                   .append_column("offset", pa.array(slots["offset"][at] + inner % uses * length)))

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*ranked.drop("rank").columns, "rank").mapInArrow(run, schema)


def pack_texts(docs: DataFrame, path: str, end: int, capacity: int = 1024, key: str = "doc_id",
               text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole texts."""
    return pack_pieces(stored(token_pieces(docs, path, end, capacity, key, text, keep_ids)), capacity)
