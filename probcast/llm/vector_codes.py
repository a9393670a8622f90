"""Codes of vectors: each part of a vector is replaced by its nearest of few learned entries.

Components become whole numbers, so sums and squared distances are exact and do not depend on the order
of addition. Every part position is sorted along a Hilbert curve through its cells and cut into flat
blocks that keep their points, the box around them (least and greatest components) and their sum. In a
round, the distances from the box to every entry bound the distances of all its points: an entry whose
least distance exceeds the smallest of the greatest distances is nearest to none of them. What is left
is the block's shortlist. With one entry left, the block's sum and size serve without a look at its
points; otherwise a small kernel finds the nearest entries of the points among the shortlist.

Kernels multiply doubles that hold whole numbers, and are exact while all results stay below 2^53;
beyond that they use 64-bit integers. Components of 65,536 or more raise an error, since distances then
leave 64 bits.

Defined cases: vectors that are null, hold null, NaN or infinite components, or differ in length from
the kept vector with the smallest id are dropped; null ids are kept, last in order; equal ids are
ordered by their vectors; repeated rows are rows each; fewer vectors than entries give as many entries
as there are vectors; null labels are one label; an empty table gives no rows. The driver sees the
codebooks only. A task holds one Arrow batch of blocks and the sums of all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probcast.llm.common import bounded_batches, stored

LARGEST = 1 << 26
EXACT = 1 << 53  # doubles hold whole numbers exactly up to here
KEY_BITS = 62


@dataclass(frozen=True)
class CodeOptions:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    block: int = 256  # vectors of a block


@dataclass
class Codes:
    """``rows``: key, label, code, error of every kept vector. ``codebooks``: (part, entry, component)."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def with_label_error(self) -> DataFrame:
        """``rows`` with the error summed over equal labels."""
        sums = self.rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
        return self.rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (n x d whole numbers of ``bits`` bits) on the Hilbert curve.

    The coordinates are turned in place to the curve's transposed index, highest bit first: at each
    bit, a set bit inverts the lower bits of the first axis and a clear one exchanges them with its own.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            swap = np.where(x[i] >> b & 1, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] >> b & 1, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _matrix(column: pa.Array, width: int, kind=np.int32) -> np.ndarray:
    """A binary or list column whose rows all hold ``width`` numbers."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return np.asarray(column.flatten()).reshape(len(column), width)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def _kept(vectors: DataFrame, key: str, vector: str, label: str, options: CodeOptions) -> tuple[DataFrame, np.ndarray]:
    """Stored rows (row, key, label, whole) and the first codebooks."""
    usable = F.col(vector).isNotNull() & F.coalesce(F.forall(
        vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))), F.lit(False))
    named = vectors.filter(usable).select(F.col(key).alias("key"), F.col(label).alias("label"),
                                          F.col(vector).cast("array<double>").alias("vector"))
    first = named.orderBy(F.col("key").asc_nulls_last(), "vector").limit(1).collect()
    width = len(first[0]["vector"]) if first else 0
    if width % options.parts or first and not width:
        raise ValueError(f"{width} components do not make {options.parts} equal parts")
    named = named.filter(F.size("vector") == width)
    start = named.orderBy(F.col("key").asc_nulls_last(), "vector").limit(options.entries).collect()
    scale = options.scale

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            numbers = np.floor(scale * _matrix(batch.column("vector"), width))
            if np.abs(numbers).max() > LARGEST:
                raise ValueError("components of 65,536 or more: distances would leave 64 bits")
            yield pa.record_batch([batch.column("row"), batch.column("key"), batch.column("label"),
                                   _binary(numbers.astype(np.int32))], ["row", "key", "label", "whole"])

    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    rows = stored(named.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        whole, f"row long, key {kinds['key']}, label {kinds['label']}, whole binary"))
    table = np.floor(scale * np.array([r["vector"] for r in start], dtype=float).reshape(len(start), width))
    if table.size and np.abs(table).max() > LARGEST:
        raise ValueError("components of 65,536 or more: distances would leave 64 bits")
    parts = table.astype(np.int64).reshape(len(start), options.parts, width // options.parts)
    return rows, np.ascontiguousarray(parts.transpose(1, 0, 2))


def _spread(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and standard deviation of every component, and the largest magnitude."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second, most = 0, np.zeros(width), np.zeros(width), np.zeros(width)
        for batch in batches:
            x = _matrix(batch.column("whole"), width).astype(float)
            n += len(x)
            first += x.sum(0)
            second += (x * x).sum(0)
            most = np.maximum(most, np.abs(x).max(0, initial=0))
        if n:
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
                                   pa.array(first), pa.array(second), pa.array(most)], ["i", "n", "s", "q", "m"])

    found = rows.select("whole").mapInArrow(sums, "i int, n long, s double, q double, m double").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("m").alias("m")).orderBy("i").collect()
    mean = np.array([r["s"] / r["n"] for r in found])
    return (mean, np.sqrt(np.maximum(np.array([r["q"] / r["n"] for r in found]) - mean ** 2, 1.0)),
            int(max((r["m"] for r in found), default=0)))


def flat_blocks(rows: DataFrame, parts: int, width: int, mean: np.ndarray, deviation: np.ndarray, size: int) -> DataFrame:
    """Stored blocks of all part positions: rows, points, box and sum, in Hilbert order.

    The order has the row as last key, so that equal vectors do not meet in one task.
    """
    d = width // parts
    used = min(d, KEY_BITS)
    bits = max(1, min(8, KEY_BITS // used))
    scaled = (mean - 2 * deviation, (1 << bits) / (4 * deviation))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("whole"), width)
            cells = np.clip((x - scaled[0]) * scaled[1], 0, (1 << bits) - 1).astype(np.int64)
            for p in range(parts):
                yield pa.record_batch(
                    [pa.array(np.full(len(x), p, np.int32)), pa.array(hilbert_keys(cells[:, p * d:p * d + used], bits)),
                     batch.column("row"), _binary(x[:, p * d:(p + 1) * d])], ["part", "place", "row", "point"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            part, row, x = np.asarray(batch.column("part")), np.asarray(batch.column("row")), _matrix(batch.column("point"), d)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if held and (held[0][0] != part[a] or sum(len(h[1]) for h in held) == size):
                        yield block(held)
                        held = []
                    take = min(b - a, size - sum(len(h[1]) for h in held))
                    held.append((int(part[a]), row[a:a + take].copy(), x[a:a + take].copy()))
                    a += take
        if held:
            yield block(held)

    def block(held: list[tuple]) -> pa.RecordBatch:
        row, x = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        return pa.record_batch(
            [pa.array([held[0][0]], pa.int32()), pa.array([len(x)], pa.int32()), _binary(row[None]), _binary(x.reshape(1, -1)),
             _binary(x.min(0)[None]), _binary(x.max(0)[None]), _binary(x.sum(0, dtype=np.int64)[None])],
            ["part", "n", "rows", "points", "low", "high", "sum"])

    placed = rows.select("row", "whole").mapInArrow(keyed, "part int, place long, row long, point binary")
    ordered = placed.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
    return stored(ordered.select("part", "row", "point").mapInArrow(
        packed, "part int, n int, rows binary, points binary, low binary, high binary, sum binary"))


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For boxes (b x d) and entries (e x d): which entries may be nearest to a point of the box."""
    low, high, c = low[:, None, :], high[:, None, :], entries[None]
    outside = np.maximum(np.maximum(low - c, c - high), 0)
    across = np.maximum(np.abs(c - low), np.abs(c - high))
    least, most = (outside * outside).sum(2), (across * across).sum(2)
    return least <= most.min(1, keepdims=True)


def nearest(points: np.ndarray, entries: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point, the lower one of equal ones, and the squared distance."""
    if exact:
        p, c = points.astype(float), entries.astype(float)
        distance = (c * c).sum(1) - 2 * (p @ c.T)
        best = distance.argmin(1)
        return best, (distance[np.arange(len(p)), best] + (p * p).sum(1)).astype(np.int64)
    p = points.astype(np.int64)
    distance = np.stack([((p - c) ** 2).sum(1) for c in entries.astype(np.int64)], 1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(p)), best]


def _walk(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place in the batch, part, shortlist) of every block, boxes compared some at a time."""
    d = books.shape[2]
    part = np.asarray(batch.column("part"))
    low, high = (_matrix(batch.column(c), d).astype(np.int64) for c in ("low", "high"))
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        for at in range(0, len(own), 32):
            some = own[at:at + 32]
            for i, keep in zip(some, shortlists(low[some], high[some], books[p])):
                yield int(i), int(p), np.flatnonzero(keep)


def _round(blocks: DataFrame, books: np.ndarray, exact: bool) -> np.ndarray:
    """The codebooks after one round: entries become the floor of the mean of their points."""
    parts, entries, d = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for batch in batches:
            n, whole, points = np.asarray(batch.column("n")), batch.column("sum"), batch.column("points")
            for i, p, short in _walk(batch, books):
                if len(short) == 1:
                    counts[p, short[0]] += n[i]
                    totals[p, short[0]] += np.frombuffer(whole[i].as_buffer(), np.int64)
                    continue
                x = np.frombuffer(points[i].as_buffer(), np.int32).reshape(-1, d)
                best = short[nearest(x, books[p][short], exact)[0]]
                counts[p] += np.bincount(best, minlength=entries)
                order = np.argsort(best, kind="stable")
                found, first = np.unique(best[order], return_index=True)
                totals[p, found] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
                                   pa.array(list(totals[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    found = blocks.select("part", "n", "points", "low", "high", "sum").mapInArrow(
        sums, "part int, entry int, n long, s array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s")).collect()
    out = books.copy()
    for r in found:
        out[r["part"], r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    return out


def encode_vectors(vectors: DataFrame, options: CodeOptions = CodeOptions(), key: str = "vec_id",
                   vector: str = "embedding", label: str = "label") -> Codes:
    """Learn the codebooks and code every kept vector. See the module for the defined cases."""
    bounded_batches(vectors.sparkSession)
    rows, books = _kept(vectors, key, vector, label, options)
    parts, entries, d = books.shape
    if not entries:
        return Codes(rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books)
    mean, deviation, most = _spread(rows, parts * d)
    exact = 4 * d * max(most, 1) ** 2 < EXACT
    blocks = flat_blocks(rows, parts, parts * d, mean, deviation, options.block)
    for _ in range(options.rounds):
        books = _round(blocks, books, exact)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, points = batch.column("rows"), batch.column("points")
            for i, p, short in _walk(batch, books):
                x = np.frombuffer(points[i].as_buffer(), np.int32).reshape(-1, d)
                best, distance = nearest(x, books[p][short], exact)
                yield pa.record_batch([
                    pa.array(np.frombuffer(own[i].as_buffer(), np.int64)), pa.array(np.full(len(x), p, np.int32)),
                    pa.array(short[best].astype(np.int32)), pa.array(distance)], ["row", "part", "entry", "distance"])

    found = blocks.select("part", "rows", "points", "low", "high").mapInArrow(
        coded, "row long, part int, entry int, distance long")
    digits = [F.lower(F.lpad(F.hex(F.max(F.when(F.col("part") == p, F.col("entry")))), 2, "0")) for p in range(parts)]
    codes = found.groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("distance").alias("error"))
    return Codes(stored(rows.select("row", "key", "label").join(codes, "row").drop("row")), books)


def codes_sql(options: CodeOptions = CodeOptions()) -> str:
    """DuckDB SQL of the query: every distance in every round."""
    parts, last = options.parts, options.rounds
    assign = """
near{k} AS (
  SELECT id, p.part, min(struct_pack(d := list_dot_product(entry, entry) - 2 * list_dot_product(entry, point), e := e)) AS best
  FROM point p JOIN book{k} b ON b.part = p.part GROUP BY id, p.part)"""
    update = """
mean{k} AS (
  SELECT part, e, i, CAST(floor(sum(x) / count(*)) AS DOUBLE) AS x FROM (
    SELECT part, best.e AS e, unnest(range(1, len(point) + 1)) AS i, unnest(point) AS x
    FROM near{j} JOIN point USING (id, part)) GROUP BY part, e, i),
book{k} AS (
  SELECT part, e, coalesce(m.entry, b.entry) AS entry
  FROM book{j} b LEFT JOIN (SELECT part, e, list(x ORDER BY i) AS entry FROM mean{k} GROUP BY part, e) m USING (part, e))"""
    steps = [assign.format(k=0)]
    for k in range(1, last + 1):
        steps += [update.format(k=k, j=k - 1), assign.format(k=k)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {options.scale})) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
point AS (
  SELECT id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS point
  FROM kept, range({parts}) AS r(part)),
book0 AS (SELECT part, id - 1 AS e, point AS entry FROM point WHERE id <= {options.entries}),{",".join(steps)},
coded AS (
  SELECT id, string_agg(lower(printf('%02x', CAST(best.e AS INTEGER))), '' ORDER BY part) AS code,
         CAST(sum(best.d + list_dot_product(point, point)) AS BIGINT) AS error
  FROM near{last} JOIN point USING (id, part) GROUP BY id),
digest AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS h FROM (
    SELECT part, e, unnest(range(1, len(entry) + 1)) AS i, unnest(entry) AS x FROM book{last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (id), digest
"""
